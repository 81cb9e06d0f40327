"""Text functions on columns.  Patterns are Unicode-aware where letters or blanks beyond ASCII matter."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.binding import bound

NBSP, NNBSP, FORCED_END, KEEPCAPS, RESET = " ", " ", "\x02", "\x03", "\x04"
#: Named one by one: Java looks those up in one table, ranges one after the other.
_SCRUBBED = "[" + "".join(f"\\x{c:02x}" for c in (0, 3, *range(5, 9), *range(0x0B, 0x20))) + "]"
_CONTROLS = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"

#: Marker words of each language, counted as written with their blanks, in order of preference.
MARKERS = {
    "en": ("the ", " is ", " are ", " was ", " have ", " that ", " with ", " this "),
    "fr": (" le ", " la ", " les ", " des ", " est ", " que ", " dans ", " une ", " qui "),
    "de": (" der ", " die ", " das ", " und ", " ist ", " ein ", " nicht ", " den "),
    "es": (" el ", " los ", " las ", " que ", " por ", " una ", " con ", " del "),
    "it": (" il ", " che ", " di ", " una ", " per ", " con ", " sono ", " della "),
    "pt": (" que ", " uma ", " com ", " para ", " dos ", " das ", " não "),
    "uk": (" не ", " що ", " це ", " як ", " для ", " або "),
    "ru": (" не ", " что ", " это ", " как ", " для "),
    "nl": (" het ", " een ", " van ", " dat ", " niet ", " zijn "),
    "pl": (" nie ", " jest ", " się ", " że ", " jak "),
}
#: Characters of a script, and what each counts for a language; languages without marker words come last.
SCRIPTS = {
    "uk": ("\\u0400-\\u04ff", 1), "ru": ("\\u0400-\\u04ff", 1), "zh": ("\\u4e00-\\u9fff", 5),
    "ja": ("\\u3040-\\u30ff", 5), "ko": ("\\uac00-\\ud7af", 5), "ar": ("\\u0600-\\u06ff", 5),
}
#: Letters of Ukrainian alone; each that a text has counts once.
UKRAINIAN, UKRAINIAN_BONUS = "іїєґ", 10


def strip_blanks(t: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")


def strip_html(t: Column) -> Column:
    return F.regexp_replace(t, "<[^>]*>", "")


def strip_controls(t: Column) -> Column:
    """Transcript text without control characters and blanks around."""
    return strip_blanks(F.regexp_replace(t, _CONTROLS, ""))


def scrub(t: Column) -> Column:
    """Control characters go, but for \\x01, \\x02, \\x04, tab and newline; \\x03 stays as the first character only."""
    head = F.when(t.startswith(KEEPCAPS), F.lit(KEEPCAPS)).otherwise(F.lit(""))
    return F.concat(head, F.regexp_replace(t, _SCRUBBED, ""))


def typing_text(t: Column) -> Column:
    """Text as it is typed: plain blanks, dots and dashes, no controls."""
    t = F.translate(t, NBSP + NNBSP, "  ")
    t = F.replace(F.replace(F.replace(t, F.lit("…"), F.lit("...")), F.lit("—"), F.lit("--")), F.lit("–"), F.lit("-"))
    return F.regexp_replace(t, "[\\x00\\x02-\\x08\\x0b-\\x1f]", "")


def letters(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^\\p{L}]", ""))


def cyrillic_share(t: Column) -> Column:
    """Share of Cyrillic among the letters; null without letters."""
    n = letters(t)
    return F.when(n > 0, F.length(F.regexp_replace(t, "[^\\u0400-\\u04FF]", "")) / n)


def reject_wrong_script(t: Column, lang: Column) -> Column:
    """Empty text where the script does not fit the language: over half Cyrillic in a Latin one, under a fifth in a
    Cyrillic one; texts without letters stay."""
    cyr = F.when(F.octet_length(t) == F.length(t), 0).otherwise(F.length(F.regexp_replace(t, "[[^\\u0400-\\u04FF]\\P{L}]+", "")))
    slavic = lang.isin("uk", "ru", "bg", "sr")

    def wrong(n: Column) -> Column:
        """Letters are counted only where some are Cyrillic; without any the share is 0, or there is none."""
        ratio = n / F.length(F.regexp_replace(t, "\\P{L}+", ""))
        return F.when(n > 0, F.when(slavic, ratio < 0.2).otherwise(ratio > 0.5)).otherwise(slavic & t.rlike("\\p{L}"))

    return F.when(F.coalesce(bound(cyr, wrong), F.lit(False)), F.lit("")).otherwise(t)


def needs_paste(t: Column) -> Column:
    """Whether a text has letters that cannot be typed key by key."""
    return t.rlike("[\\p{IsCyrillic}\\p{IsGreek}\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}\\p{IsArabic}\\p{IsHebrew}]")


def _fold_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letter that each decomposes to."""
    marked, plain = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(point))
        if len(base) > 1 and chr(point).islower() and base[0].isascii():
            marked.append(chr(point))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def fold_accents(t: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    marked, plain = _fold_table()
    return F.regexp_replace(F.translate(F.lower(t), marked, plain), "[\\u0300-\\u036f]", "")


def occurrences(t: Column, part: str) -> Column:
    """Times that a string occurs, not overlapping.  Bytes are counted: their number is known without reading the text."""
    return ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def _marked_only(low: Column) -> Column:
    """A text in which marker words occur as often as before: other words are emptied, their blanks stay, up to two in a row.

    A marker begins with a blank or within a word, and ends with a blank.
    """
    whole = sorted({w[1:-1] for some in MARKERS.values() for w in some if w.startswith(" ")})
    ends = sorted({w[:-1] for some in MARKERS.values() for w in some if not w.startswith(" ")})

    def kept(word: Column) -> Column:
        out = F.when(word.isin(*whole), word)
        for end in ends:
            out = out.when(word.endswith(end), F.lit(end))
        return out.otherwise("")

    return F.regexp_replace(F.array_join(F.transform(F.split(low, " ", -1), kept), " "), " {3,}", "  ")


def detect_language(t: Column) -> Column:
    """The language with the most points, the earlier listed one on a tie, ``en`` without any.

    Points are for marker words, characters of the language's script, and letters that only Ukrainian has.  What a text has
    of marker words and of the scripts is taken out of it once, and counted there.
    """
    other = "[^" + "".join(dict.fromkeys(script for script, _ in SCRIPTS.values())) + "]+"

    def ranked(low: Column, written: Column) -> Column:
        def points(lang: str) -> Column:
            total = sum((occurrences(low, w) for w in MARKERS.get(lang, ())), F.lit(0))
            if lang in SCRIPTS:
                script, each = SCRIPTS[lang]
                total = total + F.length(F.regexp_replace(written, f"[^{script}]+", "")) * each
            if lang == "uk":
                total = sum((F.contains(F.lower(written), F.lit(c)).cast("int") * UKRAINIAN_BONUS for c in UKRAINIAN), total)
            return total

        scores = [(lang, points(lang)) for lang in {**MARKERS, **SCRIPTS}]
        return F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, s) in enumerate(scores)]))

    written = F.when(F.octet_length(t) > F.length(t), F.regexp_replace(t, other, "")).otherwise(F.when(t.isNotNull(), F.lit("")))
    best = bound(_marked_only(F.lower(t)), lambda low: bound(written, lambda w: ranked(low, w)))
    return bound(best, lambda x: F.when(x["s"] > 0, x["lang"]).otherwise("en"))


def plain_words(t: Column) -> Column:
    """Lower-case words without punctuation."""
    bare = F.regexp_replace(F.lower(t), "(?U)[^\\w\\s]", "")
    return F.filter(F.split(bare, "(?U)\\s+"), lambda w: w != "")


def speaker_index(label: Column) -> Column:
    """The first integer in a label, 0 without one."""
    return F.coalesce(F.regexp_extract(label, "(\\d+)", 1).try_cast("int"), F.lit(0))


def safe_filename(t: Column) -> Column:
    return F.regexp_replace(t, "(?U)[^\\w.-]", "_")


def capitalise(t: Column) -> Column:
    """First letter, letters after . ! ? … and blanks, and letters after a newline in upper case.

    A forced end mark before such blanks is dropped.  The places are marked, the text is cut there and put together again.
    """
    cut = "\x1e\x1f"
    marked = F.regexp_replace(t, "(?U)([.!?…])\\x02?(\\s+)(?=[a-zà-ÿ])", f"$1$2{cut}")

    def lines(m: Column) -> Column:
        return F.when(F.contains(m, F.lit("\n")), F.regexp_replace(m, "(?U)(\\n\\s*)(?=[a-zà-ÿ])", f"$1{cut}")).otherwise(m)

    parts = bound(bound(marked, lines), lambda m: F.when(F.contains(m, F.lit(cut)), F.split(m, cut, -1)).when(m.isNotNull(), F.array(m)))
    raised = F.transform(
        parts, lambda p: F.when(p.rlike("^\\p{Ll}"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)
    )
    return F.array_join(raised, "")


def lower_first(t: Column) -> Column:
    return F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def upper_first(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def reset_context(t: Column) -> Column:
    """A text with a reset mark starts anew: mark and leading blanks go, the first letter is raised."""
    bare = F.regexp_replace(F.replace(t, F.lit(RESET), F.lit("")), "^[ \\t]+", "")
    return F.when(F.contains(t, F.lit(RESET)), upper_first(bare)).otherwise(t)


def _under(t: Column, limit: int) -> Column:
    """Whether a text has fewer words than ``limit``: no more of it is read than so many words."""
    return ~t.rlike(f"(?U)^\\s*+\\S++(?:\\s++\\S++){{{limit - 1}}}+") if limit > 0 else F.lit(False)


def short_text(t: Column, limit: int = 3) -> Column:
    """Texts under ``limit`` words lose one final . ! ? or , and their Capitalised words' capitals; acronyms and mixed case
    stay.  Texts with a newline or without a letter or digit are left alone."""
    lowered = F.transform(
        F.filter(F.split(F.regexp_replace(t, "(?U)[.!?,]\\s*$", ""), "(?U)\\s+"), lambda w: w != ""),
        lambda w: F.when(w.rlike("^\\p{Lu}[\\p{Ll}\\p{M}'’-]*$"), lower_first(w)).otherwise(w),
    )
    due = _under(t, limit) & ~F.contains(t, F.lit("\n")) & t.rlike("[\\p{L}\\p{N}]")
    return F.when(due, F.array_join(lowered, " ")).otherwise(t)


def keepcaps(t: Column, expressions: list[str], limit: int = 3) -> Column:
    """short_text, but texts that are one of the expressions, whatever accents and case, or begin with its word, keep
    their capitals; those are marked by a leading \\x03.  A final dot that was not forced goes."""
    folded = sorted({unicodedata.normalize("NFD", e).encode("ascii", "ignore").decode().lower() for e in expressions})
    bare = fold_accents(F.regexp_replace(t, "(?U)[.!?,\\x02]+\\s*$", ""))
    first = F.coalesce(F.get(F.split(bare, "(?U)\\s+"), 0), F.lit(""))
    hit = bare.isin(*folded) | (_under(t, limit) & first.isin(*folded))
    kept = F.concat(F.lit(KEEPCAPS), F.regexp_replace(t, "\\.$", ""))
    return F.when(hit & ~F.contains(t, F.lit("\n")), kept).otherwise(short_text(t, limit))


def fill_prompt(template: Column, transcript: Column, previous: Column, dictionary: Column) -> Column:
    """The template's placeholders, the transcript first; missing parts read (none)."""
    none = F.lit("(none)")

    def or_none(x: Column) -> Column:
        return F.when(F.coalesce(x, F.lit("")) == "", none).otherwise(x)

    t = F.replace(template, F.lit("{TRANSCRIPT}"), F.coalesce(transcript, F.lit("")))
    t = F.replace(t, F.lit("{PREVIOUS_SEGMENT}"), or_none(previous))
    return F.replace(t, F.lit("{DICTIONARY}"), or_none(dictionary))


def find_next(t: Column, what: Column, after: Column) -> Column:
    """Place (from 0) of the next occurrence at or after a place, else of the first one, else -1."""
    ahead = F.call_function("locate", what, t, after + 1)
    whole = F.call_function("locate", what, t, F.lit(1))
    return F.when(ahead > 0, ahead - 1).when(whole > 0, whole - 1).otherwise(-1)


def aligned(a: Column, b: Column) -> Column:
    """Number of places where two word arrays agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)


def solo_in_combined(solo: Column, combined: Column) -> Column:
    """The words of a combined text from where the solo text begins, searched from the end by up to three words with at most
    one mismatch; null if it is nowhere.  Both are arrays of words."""

    def cut(solo: Column, combined: Column) -> Column:
        k = F.least(F.size(solo), F.lit(3))
        last = F.size(combined) - k

        def agrees(i: Column) -> Column:
            same = [(F.get(combined, i + n) == F.get(solo, F.lit(n))) & (n < k) for n in range(3)]
            return sum((F.coalesce(x, F.lit(False)).cast("int") for x in same), F.lit(0)) >= k - 1

        places = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), agrees)
        at = F.array_max(places)
        return F.when((k > 0) & at.isNotNull(), F.slice(combined, at + 1, F.size(combined)))

    return bound(solo, lambda s: bound(combined, lambda c: cut(s, c)))


def strip_prefix(buffer: Column, combined: Column) -> Column:
    """Words of a combined text after the buffered ones, if at least three fifths of these agree in place; else all."""
    n = F.size(buffer)
    same = aligned(F.slice(combined, 1, F.greatest(n, F.lit(1))), buffer)
    ok = (n > 0) & (same >= F.ceil(n * F.lit(0.6))) & (n - same <= F.greatest(F.lit(1), F.floor(n / 5)))
    return F.when(ok, F.slice(combined, n + 1, F.size(combined))).otherwise(combined)
