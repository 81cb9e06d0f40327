"""Language-tagged rewriting rules as one column expression.

Rules are rows; those of a language become a chain of ``regexp_replace``, evaluated only on rows of that language and
only where a cheap test says that one of a family can match.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cache, reduce
from itertools import groupby
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.binding import bound
from voxframe.functions.numerals import digits
from voxframe.functions.text import NBSP, NNBSP, capitalise, keepcaps, reject_wrong_script, scrub, short_text


@dataclass(frozen=True)
class Rule:
    """A pattern (Python syntax) and replacement for a language ("*": all), in a family that shares a guard.

    ``holds`` (as written) and ``says`` (in any case) are plain strings: texts with none of them are left alone, before any
    pattern is tried.  Looking for a string costs a small part of what a pattern does.
    """

    pattern: str
    replacement: str
    lang: str = "*"
    family: str = "rules"
    flags: str = "i"
    guard: str | None = None
    holds: tuple[str, ...] = ()
    says: tuple[str, ...] = ()


def _one_letter(made: str, c: str) -> str:
    return made if len(made) == 1 else c


@cache
def _other_cases() -> dict[str, str]:
    """For a small letter, the characters that a pattern in any case takes for it, though their small letter is another."""
    found: dict[str, str] = {}
    for c in map(chr, range(0x80, 0x10000)):
        small = "i" if c == "İ" else _one_letter(_one_letter(c.upper(), c).lower(), c)
        if small != c.lower():
            found[small] = found.get(small, "") + c
    return found


def _has(t: Column, parts: Sequence[str]) -> Column:
    return reduce(or_, (F.contains(t, F.lit(p)) for p in parts))


def _said(t: Column, parts: Sequence[str]) -> Column:
    """Whether a text may hold one of some strings in any case."""
    small = sorted({p.lower() for p in parts})
    odd = sorted({o for p in small for c in p for o in _other_cases().get(c, "")})
    return reduce(or_, [bound(F.lower(t), lambda low: _has(low, small)), *([_has(t, odd)] if odd else [])])


_BEGINS_WORD = re.compile(r"\\b(?:\(\?:([^()\[\]]*)\)(?![?*{])|(\w)(?![?*{]))")


def _letters_first(pattern: str) -> str:
    """A pattern that begins with a word boundary and one of some letters, with the letters asked for first.

    Whether a place is a boundary is dear to say, and with Unicode classes on it would be asked at every place of a text.
    """
    m = _BEGINS_WORD.match(pattern)
    if not m:
        return pattern
    begins = [re.match(r"(\\d|\w)(?![?*{])", part) for part in (m[1] or m[2]).split("|")]
    return f"(?=[{''.join(dict.fromkeys(b[1] for b in begins))}]){pattern}" if all(begins) else pattern


def to_java(pattern: str, flags: str = "") -> str:
    """A Python pattern for Java: Unicode classes on, flags in front."""
    return "(?U" + "".join(f for f in flags if f in "im") + ")" + _letters_first(pattern).replace("(?P<", "(?<")


def to_java_replacement(text: str) -> str:
    """\\1 becomes $1; dollars and other backslashes are literal."""
    out = re.sub(r"\\(?![0-9nt])", r"\\\\", text).replace("$", "\\$")
    out = out.replace("\\n", "\n").replace("\\t", "\t")
    return re.sub(r"\\([0-9])", r"$\1", out)


def lint(rules: Sequence[Rule]) -> list[str]:
    """Complaints about rules: patterns that do not compile, and words that mix Latin and Cyrillic letters."""
    found = []
    for k, rule in enumerate(rules):
        try:
            re.compile(rule.pattern)
        except re.error as e:
            found.append(f"rule {k}: {e}")
        if re.search("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]", rule.pattern):
            found.append(f"rule {k}: mixes scripts")
    return found


_CLASS_BLANK = re.compile(r"\[((?:[^\]\\]|\\[^s])*)\\s([^\]]*)\]")
_ESCAPED = re.compile(r"\\(?:n|t|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4})")
_SUFFIX = re.compile("%SUFFIX_([A-Z]{2})%")


def _decoded(replacement: str) -> str:
    """Escapes of new line, tab and code points read; references to groups stay."""

    def one(m: re.Match) -> str:
        part = m[0][1:]
        return {"n": "\n", "t": "\t"}.get(part) or chr(int(part[1:], 16))

    return _ESCAPED.sub(one, replacement)


def rules_from_rows(rows: DataFrame, suffixes: dict[str, str] | None = None) -> list[Rule]:
    """Rules of a rule file's rows (ord, lang, pattern, replacement, flags), in their order.

    A pattern with a suffix that is not given is left out, and so is one that does not compile.  A blank class within
    brackets means space and tab there, so that it takes no new line another rule has made.  Rule files are small: each rule
    becomes part of the plan.
    """
    found = []
    for row in rows.orderBy("ord").collect():
        pattern, named = row.pattern, _SUFFIX.search(row.pattern)
        if named:
            suffix = (suffixes or {}).get(named[1].lower())
            if not suffix:
                continue
            pattern = pattern.replace(named[0], suffix)
        pattern = _CLASS_BLANK.sub(r"[\1 \\t\2]", pattern)
        rule = Rule(pattern, _decoded(row.replacement), row.lang, f"file-{row.lang}", "".join(f for f in row.flags if f in "im"))
        try:
            re.compile(rule.pattern)
        except re.error:
            continue
        found.append(rule)
    return found


#: Each group of rules with tests of its own is a lambda in another's argument, and the analyzer resolves one a round.
_MOST_GROUPS = 20


def _families(rules: Sequence[Rule]) -> list[list[Rule]]:
    """Neighbouring rules of one language and family with the same tests; very many groups of a family are one, without the
    tests that only save time."""

    def grouped(some: Sequence[Rule], key) -> list[list[Rule]]:
        return [list(g) for _, g in groupby(some, key)]

    out: list[list[Rule]] = []
    for family in grouped(rules, lambda r: (r.lang, r.family, r.guard)):
        parts = grouped(family, lambda r: (r.holds, r.says))
        out += parts if len(parts) <= _MOST_GROUPS else [[replace(r, holds=(), says=()) for r in family]]
    return out


def rewritten(t: Column, lang: Column, rules: Sequence[Rule]) -> Column:
    """A text with all rules applied in order.

    Neighbouring families of single languages become one choice by language.  Every family's text is bound, so the
    expression grows in step with the rules.
    """

    def chain(families: list[list[Rule]]):
        def run(x: Column) -> Column:
            for family in families:
                x = bound(x, lambda y, family=family: guarded(y, family))
            return x

        return run

    def guarded(x: Column, family: list[Rule]) -> Column:
        out, head = x, family[0]
        for rule in family:
            out = F.regexp_replace(out, F.lit(to_java(rule.pattern, rule.flags)), F.lit(to_java_replacement(rule.replacement)))
        tests = [_has(x, head.holds)] if head.holds else []
        if head.says:
            tests.append(_said(x, head.says))
        if head.guard:
            tests.append(x.rlike(to_java(head.guard, head.flags)))
        return F.when(reduce(and_, tests), out).otherwise(x) if tests else out

    def choose(by_lang: dict[str, list[list[Rule]]]):
        def run(x: Column) -> Column:
            out = None
            for code, families in by_lang.items():
                made = chain(families)(x)
                out = F.when(lang == code, made) if out is None else out.when(lang == code, made)
            return out.otherwise(x)

        return run

    waiting: dict[str, list[list[Rule]]] = {}
    for family in [*_families(rules), None]:
        if family is not None and family[0].lang != "*":
            waiting.setdefault(family[0].lang, []).append(family)
            continue
        if waiting:  # what is of different languages can change places
            t, waiting = bound(t, choose(waiting)), {}
        if family is not None:
            t = chain([family])(t)
    return t


def rewrite(df: DataFrame, rules: Sequence[Rule], text: str = "text", lang: str = "lang") -> DataFrame:
    """The frame with all rules applied in order."""
    return df.withColumn(text, rewritten(F.col(text), F.col(lang), rules))


#: Strings whose small letters are known without what stands around them; a text's Greek ones are not.
_LATIN = re.compile("[\x00-\u024f]+")


def cased_variants(word: str, replacement: str, lang: str = "*", family: str = "dictionary") -> list[Rule]:
    """Whole-word rules that carry case over: UPPER to UPPER, Capital to Capital, else as written."""
    upper, first, rest = re.escape(word.upper()), re.escape(word[:1].upper()), re.escape(word[1:])
    small = re.escape(word[:1].lower())
    says = (word,) if _LATIN.fullmatch(word) else ()
    rules = [Rule(rf"\b{upper}\b", replacement.upper(), lang, family, "", holds=(word.upper(),))] if len(word) > 1 else []
    rules.append(Rule(rf"\b{first}(?i:{rest})\b", replacement[:1].upper() + replacement[1:], lang, family, "", says=says))
    rules.append(Rule(rf"\b{small}(?i:{rest})\b", replacement, lang, family, "", says=says))
    return rules


def contraction(first: str, second: str, joined: str, lang: str, ahead: str = "") -> list[Rule]:
    """Two words that become one, in the three cases."""
    out = []
    for a, j in ((first.upper(), joined.upper()), (first[:1].upper() + first[1:], joined[:1].upper() + joined[1:]), (first, joined)):
        b = second.upper() if a.isupper() and len(a) > 1 else second
        out.append(Rule(rf"\b{a}\s+{b}\b{ahead}", j, lang, f"contractions-{lang}", ""))
    return out


_TWO_WORDS = re.compile(r"\\b(\w+)\\s\+(\w+)\\b")


def guarded_contractions(rules: Sequence[Rule]) -> list[Rule]:
    """Contractions of a language, those in capitals first, then those with a capital, each kind with one guard: texts
    without any of the first words before any of the second are left.

    Rules of different kinds change different words, and can change places unless a second word is a first one as well.
    """
    pairs = [_TWO_WORDS.match(r.pattern).groups() for r in rules]
    mixed = {a.lower() for a, _ in pairs} & {b.lower() for _, b in pairs}
    kinds: dict[int, list] = {}
    for rule, (a, b) in zip(rules, pairs, strict=True):
        kinds.setdefault(3 if mixed else 0 if b.isupper() else 1 if a[0].isupper() else 2, []).append((rule, a, b))
    out = []
    for kind, some in sorted(kinds.items()):
        firsts, seconds = (tuple(dict.fromkeys(x[k] for x in some)) for k in (1, 2))
        guard = rf"\b(?:{'|'.join(firsts)})\s+(?:{'|'.join(seconds)})\b"
        out += [replace(rule, guard=guard, holds=() if kind else seconds) for rule, _, _ in some]
    return out


#: Our own small rule set, in the order in which it runs.
ANNOTATIONS = [
    Rule(r"\[[^\]\n]*\]", "", family="annotations", holds=("[", "(", "*")),
    Rule(r"\([^)\n]*\)", "", family="annotations", holds=("[", "(", "*")),
    Rule(r"\*[^*\n]+\*", "", family="annotations", holds=("[", "(", "*")),
]
HESITATIONS = [
    Rule(r"\b(?:uh+|um+|hmm+)\b[,.]?\s*", "", "en", "hesitations"),
    Rule(r"\b(?:euh+|heu+|hum+)\b[,.]?\s*", "", "fr", "hesitations"),
    Rule(r"\b(?:äh+m?|öhm?)\b[,.]?\s*", "", "de", "hesitations"),
    Rule(r"\b(?:ehm?|este)\b,\s*", "", "es", "hesitations"),
    Rule(r"\b(?:ehm?|uhm)\b[,.]?\s*", "", "it", "hesitations"),
    Rule(r"\b(?:hã|hum)\b[,.]?\s*", "", "pt", "hesitations"),
]


def _commands(lang: str, table: dict[str, str]) -> list[Rule]:
    alternatives = "|".join(sorted(map(re.escape, table), key=len, reverse=True))
    says = tuple(table) if all(map(_LATIN.fullmatch, table)) else ()
    return [
        Rule(rf"\s*\b{re.escape(said)}\b[.,]?[ \t]*", text, lang, f"commands-{lang}", "i", rf"\b(?:{alternatives})\b", says=says)
        for said, text in sorted(table.items(), key=lambda x: -len(x[0]))
    ]


COMMANDS = [
    *_commands("en", {"new line": "\n", "new paragraph": "\n\n", "full stop": ". ", "question mark": "? ", "exclamation mark": "! ", "open quote": ' "', "close quote": '" ', "semicolon": "; "}),
    *_commands("fr", {"à la ligne": "\n", "nouveau paragraphe": "\n\n", "point final": ". ", "point d'interrogation": "? ", "point d'exclamation": "! ", "point virgule": "; ", "deux points": ": "}),
    *_commands("de", {"neue zeile": "\n", "neuer absatz": "\n\n", "fragezeichen": "? ", "ausrufezeichen": "! ", "semikolon": "; ", "doppelpunkt": ": "}),
    *_commands("es", {"nueva línea": "\n", "nuevo párrafo": "\n\n", "punto final": ". ", "punto y coma": "; ", "dos puntos": ": "}),
    *_commands("it", {"a capo": "\n", "nuovo paragrafo": "\n\n", "punto e virgola": "; ", "due punti": ": "}),
    *_commands("pt", {"nova linha": "\n", "novo parágrafo": "\n\n", "ponto e vírgula": "; ", "dois pontos": ": "}),
    *_commands("uk", {"новий рядок": "\n", "новий абзац": "\n\n", "крапка з комою": "; "}),
]
# Possessive: Java matches any other repeated group by recursion, and so many repeats of a word overflow the stack of a task
REPEATED_WORDS = [Rule(r"\b(\w++)(?:\s+\1\b)++", r"\1", family="repeats")]
PUNCTUATION = [
    Rule(r",{2,}", ",", family="punctuation", guard=r"[,;:!?.]{2}"),
    Rule(r"\.{4,}", "...", family="punctuation", guard=r"[,;:!?.]{2}"),
    Rule(r"!{2,}", "!", family="punctuation", guard=r"[,;:!?.]{2}"),
    Rule(r"\?{2,}", "?", family="punctuation", guard=r"[,;:!?.]{2}"),
    Rule(r"[,;:]+([.!?])", r"\1", family="punctuation", guard=r"[,;:!?.]{2}"),
]
SPACING = [
    Rule(r"[ \t](?:[ \t]+|(?<=\t))", " ", family="spacing", holds=("  ", "\t")),
    Rule(r" ([,.])", r"\1", family="spacing", holds=(" ,", " .")),
    Rule(r"(?=[ \n])(?: +\n *|\n +)", "\n", family="spacing", holds=(" \n", "\n ")),
    Rule(r"\n{3,}", "\n\n", family="spacing", holds=("\n\n\n",)),
]
_MEASURED = r"\d\s*(?:percent|pour ?cent|prozent|por ciento|per cento|euros?|dollars?|degrees|degrés|grad|grados)\b"
SYMBOLS = [
    Rule(r"(\d)\s*(?:percent|pour ?cent|prozent|por ciento|per cento)\b", r"\1 %", family="symbols", guard=_MEASURED),
    Rule(r"(\d)\s*(?:euros?)\b", r"\1 €", family="symbols", guard=_MEASURED),
    Rule(r"(\d)\s*(?:dollars?)\b", r"\1 $", family="symbols", guard=_MEASURED),
    Rule(r"(\d)\s+(?:degrees|degrés|grad|grados)\b", r"\1°", family="symbols", guard=_MEASURED),
]
# French words whose h blocks elision, as dictionaries mark them.
ASPIRATED = (
    "hache", "hachis", "hachoir", "haie", "haillon", "haine", "haineux", "haineuse", "haïr", "hall", "halo", "halte", "hamac", "hamburger", "hameau",
    "hamster", "hanche", "happer", "harasser", "handball", "handicap", "handicapé", "hangar", "hanneton", "hanter", "hantise", "harceler", "harcèlement", "hardi",
    "harem", "hareng", "hargne", "hargneux", "haricot", "harnais", "harpe", "harpon", "hasard", "hasardeux", "hâte", "hâtif", "hausse",
    "haut", "hautain", "hautbois", "hauteur", "havre", "hayon", "hennissement", "hérisson", "hernie", "héron", "héros", "herse", "hêtre", "heurt",
    "heurter", "hibou", "hideux", "hideuse", "hiérarchie", "hiérarchique", "hippie", "hisser", "hobby", "hocher", "hochet", "hockey", "hollandais", "hollandaise",
    "hollande", "homard", "hongrie", "hongrois", "hongroise", "honte", "honteux", "honteuse", "hoquet", "horde", "hors", "hot", "hotte", "houblon", "houille",
    "houle", "housse", "houx", "hublot", "huche", "huée", "huer", "huit", "huitaine", "huitième", "hurlement", "hurler", "hussard", "hutte", "hyène",
)
_ELIDED = {"le": "l'", "la": "l'", "de": "d'", "que": "qu'", "je": "j'", "ne": "n'", "se": "s'", "me": "m'", "te": "t'", "ce": "c'"}
#: Stands before a word that has just been joined, until its capital is lowered.
_JOINED = "\ue000"
_VOWELS_FR = "aeiouyàâéèêëîïôûùh"
ELISION_FR = [
    Rule(r"\bsi\s+(ils?)\b", r"s'\1", "fr", "elision"),
    *[
        Rule(rf"\b{full}\s+(?!(?:{'|'.join(ASPIRATED)})(?:e?s?|x)\b)(?=[{_VOWELS_FR}])", short + _JOINED, "fr", "elision")
        for full, short in _ELIDED.items()
    ],
    # A capitalised word is lowered as it is joined; others, of one letter or with more capitals, stay
    *[
        Rule(rf"{_JOINED}{c.upper()}(?=(?:(?!\p{{Lu}})\w)++\b)", c, "fr", "elision-capitals", "", holds=(_JOINED + c.upper(),))
        for c in _VOWELS_FR
    ],
    Rule(_JOINED, "", "fr", "elision-capitals", "", holds=(_JOINED,)),
]
#: Italian words that lose their vowel before another, and what is left of them.
_ELIDED_IT = (
    ("lo|la", "l'"), ("una", "un'"), ("di", "d'"), ("ci", "c'"), ("quell[oa]", "quell'"), ("quest[oa]", "quest'"), ("bell[oa]", "bell'"),
    ("come", "com'"), ("dove", "dov'"),
)
ELISION_IT = [
    Rule(rf"\b(?=\p{{{kind}}})(?i:{word})\s+(?=h?[aeiouyàèéìòóù]|(?-i:H?[AEIOUYÀÈÉÌÒÓÙ]))", short[:1].upper() + short[1:] if kind == "Lu" else short, "it", "elision-it", "")
    for word, short in _ELIDED_IT
    for kind in ("Lu", "Ll")
]
ITALIAN = guarded_contractions([
    r
    for a, rows in {
        "di": {"il": "del", "lo": "dello", "la": "della", "i": "dei", "gli": "degli", "le": "delle"},
        "a": {"il": "al", "lo": "allo", "la": "alla", "i": "ai", "gli": "agli", "le": "alle"},
        "da": {"il": "dal", "lo": "dallo", "la": "dalla", "i": "dai", "gli": "dagli", "le": "dalle"},
        "in": {"il": "nel", "lo": "nello", "la": "nella", "i": "nei", "gli": "negli", "le": "nelle"},
        "su": {"il": "sul", "lo": "sullo", "la": "sulla", "i": "sui", "gli": "sugli", "le": "sulle"},
    }.items()
    for b, joined in rows.items()
    for r in contraction(a, b, joined, "it")
])
#: Spanish question words.
ASKING_ES = ("qué", "quién", "quiénes", "cómo", "cuándo", "dónde", "por qué", "cuál", "cuáles", "cuánto", "cuánta", "cuántos", "cuántas")
SPANISH = [
    *guarded_contractions([*contraction("a", "el", "al", "es", r"(?!\s+\p{Lu})"), *contraction("de", "el", "del", "es", r"(?!\s+\p{Lu})")]),
    Rule(rf"(^|(?<=[\s,;]))((?:{'|'.join(ASKING_ES)})\b[^?]*\?)", r"\1¿\2", "es", "spanish-questions", "i", r"\?"),
    # What is called out is marked as a whole first, with or without its mark, so that no later part of it is marked again
    Rule(r"(^|(?<=[.!?\n]\s))([^!]*!)", rf"{_JOINED}\2", "es", "spanish-calls", "", "!"),
    Rule(rf"{_JOINED}(?:¡|\s*(?!¡))", "¡", "es", "spanish-calls", "", "!"),
]
PORTUGUESE = guarded_contractions([
    r
    for a, rows in {
        # The contractions of the written language
        "de": {
            "o": "do", "a": "da", "os": "dos", "as": "das", "ele": "dele", "ela": "dela", "eles": "deles", "elas": "delas",
            "este": "deste", "esta": "desta", "esse": "desse", "essa": "dessa", "aquele": "daquele", "aquela": "daquela",
            "isto": "disto", "isso": "disso", "aquilo": "daquilo",
        },
        "em": {
            "o": "no", "a": "na", "os": "nos", "as": "nas", "um": "num", "uma": "numa", "este": "neste", "esta": "nesta",
            "esse": "nesse", "essa": "nessa", "aquele": "naquele", "aquela": "naquela", "isto": "nisto", "isso": "nisso", "aquilo": "naquilo",
            "ele": "nele", "ela": "nela", "eles": "neles", "elas": "nelas",
        },
        "por": {"o": "pelo", "a": "pela", "os": "pelos", "as": "pelas"},
        "a": {"o": "ao", "os": "aos", "a": "à", "as": "às", "aquele": "àquele", "aquela": "àquela", "aquilo": "àquilo"},
    }.items()
    for b, joined in rows.items()
    for r in contraction(a, b, joined, "pt")
])
GERMAN = [
    *guarded_contractions([
        r
        for a, b, j in (
            ("in", "dem", "im"), ("an", "dem", "am"), ("zu", "dem", "zum"), ("zu", "der", "zur"), ("bei", "dem", "beim"),
            ("von", "dem", "vom"), ("in", "das", "ins"), ("an", "das", "ans"), ("auf", "das", "aufs"),
        )
        for r in contraction(a, b, j, "de")
    ]),
    Rule(r'"([^"\n]+)"', r"„\1“", "de", "quotes", "", '"'),
]
DUTCH = [
    *[Rule(rf"\bin de {part}s?\b", f"'s {part}s", "nl", "dutch") for part in ("morgen", "avond", "nacht", "middag")],
    Rule(r"\b[Hh]et\b", "'t", "nl", "dutch", ""),
    Rule(r"\b[Ee]en\b(?=\s+[a-zà-ÿ])", "'n", "nl", "dutch", ""),
]
ROMANIAN = [
    *[r for a, b, j in (
        ("într", "un", "într-un"), ("dintr", "un", "dintr-un"), ("printr", "un", "printr-un"),
        ("nu", "am", "n-am"), ("nu", "ai", "n-ai"), ("nu", "a", "n-a"), ("nu", "au", "n-au"), ("nu", "o", "n-o"), ("într", "o", "într-o"), ("dintr", "o", "dintr-o"), ("printr", "o", "printr-o"),
    ) for r in contraction(a, b, j, "ro")],
    Rule(r'"([^"\n]+)"', r"„\1“", "ro", "quotes", "", '"'),
]
TYPOGRAPHY_FR = [
    Rule(r"\.{3,}", "…", "fr", "typography", holds=("...",)),
    Rule(r'"([^"\n]+)"', f"«{NBSP}\\1{NBSP}»", "fr", "typography", "", holds=('"',)),
    Rule(r"«[ \t\u00a0\u202f]*", f"«{NBSP}", "fr", "typography", "", holds=("«",)),
    Rule(r"[ \t\u00a0\u202f]*»", f"{NBSP}»", "fr", "typography", "", holds=("»",)),
    Rule(r"(?=[ \t\u00a0\u202f;!?])(?<=[^\s;!?])[ \t\u00a0\u202f]*([;!?])", f"{NNBSP}\\1", "fr", "typography", "", holds=(";", "!", "?")),
    Rule(r"(?<=\S)[ \t ]*:", f"{NBSP}:", "fr", "typography", "", holds=(":",)),
]
# The words of 0 to 10, with their variants after a slash.
_DIGITS = {
    "en": "zero one two three four five six seven eight nine ten",
    "fr": "zéro/zero un/une deux trois quatre cinq six sept huit neuf dix",
    "de": "null eins/ein/eine zwei drei vier fünf sechs sieben acht neun zehn",
    "es": "cero uno/una/un dos tres cuatro cinco seis siete ocho nueve diez",
    "it": "zero uno/una/un due tre quattro cinque sei sette otto nove dieci",
    "pt": "zero um/uma dois/duas três quatro cinco seis sete oito nove dez",
}
_POINT = {"en": "point", "fr": "point", "de": "punkt", "es": "punto", "it": "punto", "pt": "ponto"}


def _versions(lang: str) -> list[Rule]:
    """two point three becomes 2.3: numbers before the word for a point, then those after it, then the word between them."""
    words, point = [w.replace("/", "|") for w in _DIGITS[lang].split()], _POINT[lang]
    any_ = "|".join([*words, r"\d+"])
    guard = rf"\b(?:{any_})\s+{point}\s+(?:{any_})\b"

    def rule(pattern: str, made: str) -> Rule:
        return Rule(pattern, made, lang, f"versions-{lang}", "i", guard, says=(point,))

    return [
        *[rule(rf"\b(?:{word})(?=\s+{point}\s+(?:{any_})\b)", str(n)) for n, word in enumerate(words)],
        *[rule(rf"(?<=\d\s{{1,9}}{point}\s{{1,9}})(?:{word})\b", str(n)) for n, word in enumerate(words)],
        rule(rf"(?<=\d)\s+{point}\s+(?=\d)", "."),
    ]


VERSIONS = [r for lang in _DIGITS for r in _versions(lang)]
DECIMAL_COMMA = [
    Rule(r"(?<![0-9,]\s)(?<!\d)(\d+),\s+(\d+)(?!\d)(?!,?\s\d)", r"\1,\2", lang, "decimal", "", r"\d,\s+\d") for lang in ("fr", "de", "es", "it", "pt")
]
TIME_FR = [
    Rule(rf"\b{hour}\s+heures?\s+{minute}\b", made, "fr", "time", "", r"heure")
    for hour, left in ((r"([01]\d|2[0-3])", r"\1h"), (r"(\d)", r"0\1h"))
    for minute, made in ((r"([0-5]\d)", left + r"\2"), (r"(\d)", left + r"0\2"))
]
EQUALS_FR = [Rule(r"(\d)(\s*)égale?(\s*)(?=\d)", r"\1\2=\3", "fr", "equals", "i", r"égal")]

LANGUAGE_PACKS = [*ELISION_FR, *ITALIAN, *ELISION_IT, *SPANISH, *PORTUGUESE, *GERMAN, *DUTCH, *ROMANIAN]
NUMBERS = [*VERSIONS, *DECIMAL_COMMA, *TIME_FR, *EQUALS_FR]
FIRST_RULES = [*ANNOTATIONS, *HESITATIONS, *COMMANDS, *REPEATED_WORDS, *PUNCTUATION, *SYMBOLS, *SPACING]


@dataclass(frozen=True)
class Gates:
    """Which steps run."""

    rules: bool = True
    script: bool = True
    continuation: bool = True
    language: bool = True
    typography: bool = True
    numbers: bool = True
    spelled: bool = False
    dictionary: bool = True
    capitals: bool = True
    short: bool = True
    short_limit: int = 3
    keep: tuple[str, ...] = ()


#: The step that runs in Python, between columns: it cannot stand inside a lambda.
SPELLED = "spelled"
#: Words after which a sentence goes on, of our own choosing.
CONTINUING = {
    "en": ("the", "a", "of", "and", "to", "with"),
    "fr": ("le", "la", "les", "de", "et", "que"),
    "de": ("der", "die", "das", "und", "mit"),
    "es": ("el", "la", "de", "y", "que"),
}


def fix_continuation(t: Column, words: Sequence[str]) -> Column:
    """A dot after a word that goes on is taken out and the letter after it lowered: "of. The" becomes "of the"."""
    some = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
    parts = F.split(t, f"(?iU)(?=(?-i:[.…]))(?<=\\b(?:{some}))(?:\\.{{1,3}}|…)\\s+(?=\\p{{L}})", -1)
    lowered = F.transform(
        parts, lambda p, i: F.when(i > 0, F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)
    )
    return F.array_join(lowered, " ")


def _ends_with_any(t: Column, chars: str) -> Column:
    return reduce(or_, (t.endswith(c) for c in chars))


#: What may stand after the place that $ matches.
_LINE_ENDS = "\n\r\x85\u2028\u2029"


def _trimmed(t: Column) -> Column:
    """Without blanks and tabs at both ends and before a last line's end; only the ends of a text tell whether it has some."""
    edges = t.startswith(" ") | t.startswith("\t") | _ends_with_any(t, " \t" + _LINE_ENDS)
    return F.when(edges, F.regexp_replace(t, "^[ \\t]+|[ \\t]+$", "")).otherwise(t)


def _without_newline(t: Column) -> Column:
    return F.when(_ends_with_any(t, _LINE_ENDS), F.regexp_replace(t, "\\n$", "")).otherwise(t)


@dataclass
class TextChain:
    """The text steps in order; ``steps`` gives (label, column function of text and language)."""

    gates: Gates = field(default_factory=Gates)
    dictionary: dict[str, dict[str, str]] = field(default_factory=dict)

    def steps(self) -> list:
        """(label, function of text and language columns) of the steps that run."""
        g = self.gates
        entries = [r for lang, rows in self.dictionary.items() for w, x in rows.items() for r in cased_variants(w, x, lang)]

        def by(rules):
            return lambda t, lang: rewritten(t, lang, rules)

        def continuing(t: Column, lang: Column) -> Column:
            out = t
            for code, words in CONTINUING.items():
                out = F.when(lang == code, fix_continuation(t, words)).otherwise(out)
            return out

        def short(t: Column, lang: Column) -> Column:
            return keepcaps(t, list(g.keep), g.short_limit) if g.keep else short_text(t, g.short_limit)

        table = [
            (g.rules, "rules", lambda t, lang: bound(rewritten(t, lang, FIRST_RULES), _trimmed)),
            (g.script, "script", reject_wrong_script),
            (g.continuation, "continuation", continuing),
            (g.language, "language", by(LANGUAGE_PACKS)),
            (g.typography, "typography", by(TYPOGRAPHY_FR)),
            (g.numbers and g.spelled, "versions", by(VERSIONS)),
            (g.numbers and g.spelled, SPELLED, digits),
            (g.numbers, "numbers", by(NUMBERS)),
            (g.dictionary and bool(entries), "dictionary", by(entries)),
            (g.capitals, "capitals", lambda t, lang: capitalise(t)),
            (g.short, "short", short),
            (True, "scrub", lambda t, lang: scrub(t)),
        ]
        return [(label, f) for on, label, f in table if on]

    def apply(self, df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
        """The frame with the text rewritten; one final newline is taken off first, and blank texts stay as they are."""

        df = df.withColumn(text, _without_newline(F.col(text)))
        for python, steps in self._runs():
            if python:
                df = df.withColumn(text, digits(F.col(text), F.col(lang)))
                continue
            # A column for each step: they become one expression, but each is resolved alone, without what stands below it
            df = df.withColumn("_whole", F.col(text))
            for _, step in steps:
                df = df.withColumn(text, bound(F.col(text), lambda x, step=step: step(x, F.col(lang))))
            df = df.withColumn(text, F.when(F.col("_whole").rlike("(?U)\\S"), F.col(text)).otherwise(F.col("_whole"))).drop("_whole")
        return df

    def _runs(self) -> list:
        """(whether it is the step in Python, its steps) of each run of steps that are one expression."""
        out: list = []
        for label, step in self.steps():
            python = label == SPELLED
            if not out or python or out[-1][0]:
                out.append((python, []))
            out[-1][1].append((label, step))
        return out

    def trace(self, df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
        """The frame with ``trace``: label, text before and after of every step.  Each step runs once: the texts so far are
        one array that a step adds to."""
        steps = self.steps()
        df = df.withColumn("_held", F.array(_without_newline(F.col(text))))
        for python, part in self._runs():
            if python:
                df = df.withColumn("_digits", digits(F.element_at("_held", -1), F.col(lang)))
                df = df.withColumn("_held", F.concat("_held", F.array("_digits")))
                continue
            for _, step in part:
                added = bound(F.col("_held"), lambda a, step=step: F.concat(a, F.array(bound(F.element_at(a, -1), lambda x: step(x, F.col(lang))))))
                df = df.withColumn("_held", added)

        def shown(t: Column) -> Column:
            t = F.replace(t, F.lit("\\"), F.lit("\\\\"))
            return F.replace(F.replace(t, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))

        def rows(a: Column) -> Column:
            return F.array(
                *[
                    F.struct(F.lit(label).alias("label"), shown(F.get(a, k)).alias("before"), shown(F.get(a, k + 1)).alias("after"))
                    for k, (label, _) in enumerate(steps)
                ]
            )

        return df.withColumn("trace", bound(F.col("_held"), rows)).drop("_held", "_digits")
