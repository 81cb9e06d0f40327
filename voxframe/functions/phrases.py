"""Keywords, guards and suggestions around dictated text, and how settings are written."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxframe.functions.binding import bound

#: Recogniser sizes whose word times can be relied on.
TIMED_SIZES = ("tiny", "base", "small", "medium")
_BLANKS = "[ \\t\\n\\r\\f]*"


def keyword_pattern(aliases: str) -> str:
    """One pattern for comma-separated keywords at the start of a text: a blank or hyphen may be either or missing, a
    plural s and one full stop or comma may follow.  Without any keyword it matches nothing."""
    words = [re.split("[- ]", a.strip().lower()) for a in aliases.split(",") if a.strip()]
    if not words:
        return "(?!)"
    either = "|".join("[- ]?".join(re.escape(part) for part in word) for word in words)
    return f"^(?iu:{either})(?i:s)?[.,]?{_BLANKS}"


def after_keyword(t: Column, aliases: str) -> Column:
    """What follows a keyword that the text starts with; null where it starts with none."""
    pattern = keyword_pattern(aliases)
    return F.when(t.rlike(pattern), F.regexp_replace(t, pattern, ""))


def find_previous(t: Column, what: Column, before: Column) -> Column:
    """Place (from 0) of the last occurrence that ends at or before a place, else of the last one, else -1."""

    def last(part: Column) -> Column:
        at = F.call_function("locate", F.reverse(what), F.reverse(part), F.lit(1))
        return F.when(at > 0, F.length(part) - F.length(what) - at + 1)

    return F.coalesce(last(F.substring(t, F.lit(1), F.greatest(before, F.lit(0)))), last(t), F.lit(-1))


def readable_suffix(form: Column) -> Column:
    """A suffix pattern as a word: e?s? at the end reads e, s? nothing; else each optional letter goes."""
    short = F.substring(form, F.lit(1), F.length(form) - 4)
    return (
        F.when(F.endswith(form, F.lit("e?s?")), F.concat(short, F.lit("e")))
        .when(F.endswith(form, F.lit("s?")), F.substring(form, F.lit(1), F.length(form) - 2))
        .otherwise(F.regexp_replace(form, "[A-Za-zÀ-ÿ]\\?", ""))
    )


def setting_text(value: Column, kind: Column) -> Column:
    """A setting as written for its kind: numbers plain, truth as true or false, all else quoted.

    Numbers that cannot be read are null; fractions beyond 18 places keep Spark's own form.
    """
    whole = F.trim(value).try_cast("long").cast("string")
    number = F.trim(value).try_cast("double")
    plain = F.regexp_replace(number.try_cast("decimal(38,18)").cast("string"), "(\\.\\d+?)0+$", "$1")
    fraction = F.when(F.abs(number).between(1e-4, 1e15) | (number == 0), plain).otherwise(number.cast("string"))
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return (
        F.when(kind.isin("Int", "UInt"), whole)
        .when(kind == "Double", fraction)
        .when(kind == "Bool", (F.lower(F.trim(value)) == "true").cast("string"))
        .otherwise(F.concat(F.lit('"'), quoted, F.lit('"')))
    )


def length_guard(found: Column, solo: Column, least: float = 0.5, most: float = 1.8) -> Column:
    """The found text where its length suits that of the text recognised alone, else the latter."""
    return bound(found, lambda f: F.when(F.length(f).between(F.length(solo) * least, F.length(solo) * most), f).otherwise(solo))


def reliable_times(backend: Column, size: Column) -> Column:
    """Whether word times can be relied on: of one backend only with certain sizes, of another never."""
    name = F.lower(backend)
    return F.when(name == "whisper", F.lower(F.coalesce(size, F.lit("small"))).isin(*TIMED_SIZES)).otherwise(name != "vosk")


def suggested_rules(raw: Column, processed: Column, lang: str) -> Column:
    """Rule lines for a text with Cyrillic letters that no rule has changed, one that makes a comma of it and one that makes
    a new line; empty for any other text."""
    pattern = F.regexp_replace(F.regexp_replace(raw, "[.?!,]*\\z", ""), "[\\]/$*.^\\[\\\\]", "\\\\$0")

    def line(to: str) -> Column:
        return F.concat(F.lit(f"[{lang}] /^[,.\\s]*"), pattern, F.lit(f"[,.\\s]*/{to}/igm"))

    open_ = raw.rlike("[А-Яа-яЁё]") & raw.eqNullSafe(processed)
    return F.when(open_, F.array(line(", "), line("\\n"))).otherwise(F.array().cast("array<string>"))


def reply_language_head(lang_name: Column) -> Column:
    """The order, before all else, to answer in a language; empty without one."""
    order = F.format_string("Write all of your answer in %s, headings and lists too, whatever language the text is in.\n\n", lang_name)
    return F.when(F.coalesce(lang_name, F.lit("")) != "", order).otherwise("")


def reply_language_tail(lang_name: Column) -> Column:
    """The same order in short, as the last thing read; empty without a language."""
    return F.when(F.coalesce(lang_name, F.lit("")) != "", F.format_string("\n\n[Answer only in %s.]", lang_name)).otherwise("")
