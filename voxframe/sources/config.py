"""Rules, dictionaries and word lists as rows, and how system and user rows combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import strip_blanks

_RULE = r"^\s*\[([a-z*]+)\]\s*/((?:[^/\\]|\\.)*)/((?:[^/\\]|\\.)*)/([a-z]*)\s*$"
_ENTRY = r"^\s*\[([a-z*]+)\]\s*([^=]+?)\s*=\s*(.*?)\s*$"
_WORDS = r"^\s*\[(?:(exclude|keyword):)?([a-z*]+)\]\s*(.*)$"


def parse_rules(lines: DataFrame) -> DataFrame:
    """(ord, lang, pattern, replacement, flags) of "[lang] /pattern/replacement/flags" lines."""
    part = [F.regexp_extract("value", _RULE, k) for k in range(1, 5)]
    return lines.where(F.col("value").rlike(_RULE)).select(
        F.col("line_no").alias("ord"), *[p.alias(n) for p, n in zip(part, ("lang", "pattern", "replacement", "flags"), strict=True)]
    )


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """(ord, lang, word, replacement) of "[lang] word=replacement" lines."""
    part = [F.regexp_extract("value", _ENTRY, k) for k in range(1, 4)]
    found = lines.where(F.col("value").rlike(_ENTRY) & ~F.col("value").rlike("^\\s*#"))
    return found.select(F.col("line_no").alias("ord"), *[p.alias(n) for p, n in zip(part, ("lang", "word", "replacement"), strict=True)])


def parse_word_sets(lines: DataFrame, separator: str = "\\s+") -> DataFrame:
    """(lang, op, word) of "[lang] w1 w2", "[exclude:lang] ..." and "[keyword:lang] ..." lines; op: add, exclude, keyword."""
    op = F.regexp_extract("value", _WORDS, 1)
    words = F.split(F.regexp_extract("value", _WORDS, 3), separator)
    lang = F.regexp_extract("value", _WORDS, 2)
    rows = lines.where(F.col("value").rlike(_WORDS)).select(lang.alias("lang"), F.when(op == "", "add").otherwise(op).alias("op"), words.alias("words"))
    return (
        rows.select("lang", "op", F.explode("words").alias("word"))  # what is said once a line is read once a line
        .withColumn("word", F.lower(strip_blanks(F.col("word"))))
        .where("word <> ''")
    )


def for_language(rows: DataFrame, lang: str | None) -> DataFrame:
    """Rows tagged * or with the language; all without one."""
    return rows if lang is None else rows.where(F.col("lang").isin("*", lang))


def replace_rows(system: DataFrame, user: DataFrame) -> DataFrame:
    """The user's rows if there are any, else the system's."""
    any_user = user.limit(1).select(F.lit(1).alias("_user"))
    return user.unionByName(system.join(any_user, F.lit(True), "left_anti"))


def builtins_then_user(builtin: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in rows, then the user's with the ids they have; ``origin`` 0 or 1 and ``ord`` give the order."""
    return builtin.withColumn("origin", F.lit(0)).unionByName(user.withColumn("origin", F.lit(1)))


def merge_words(system: DataFrame, user: DataFrame) -> DataFrame:
    """(lang, word): both word sets together, without what the user excludes."""
    added = system.where("op = 'add'").unionByName(user.where("op = 'add'")).select("lang", "word").distinct()
    return added.join(user.where("op = 'exclude'").select("lang", "word"), ["lang", "word"], "left_anti")


def stored_delta(defaults: DataFrame, current: DataFrame) -> DataFrame:
    """(id, value) that a user's settings file keeps: what differs from the built-in rows or is new."""
    known = defaults.select("id", F.col("value").alias("_default"))
    return current.join(known, "id", "left").where(~F.col("value").eqNullSafe(F.col("_default"))).select("id", "value")


def overlay(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, value): built-in rows with the stored ones over them, and the user's own."""
    own = stored.select("id", F.col("value").alias("_own"))
    return defaults.join(own, "id", "full_outer").select("id", F.coalesce("_own", "value").alias("value"))


def audio_nodes(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """(value, icon, label) of the audio nodes in a JSON listing."""
    schema = "array<struct<id:int,info:struct<props:map<string,string>>>>"
    node = rows.select(F.explode(F.from_json(json_col, schema)).alias("n")).select(F.col("n.info.props").alias("p"))
    name, kind = F.col("p")["node.name"], F.col("p")["media.class"]
    label = F.coalesce(F.col("p")["node.description"], name)
    icon = (
        F.when(kind == "Audio/Sink", "audio-speakers")
        .when(F.lower(label).rlike("headset|bluetooth|airpods"), "audio-headset")
        .when(F.lower(label).rlike("webcam|camera"), "camera-web")
        .otherwise("audio-input-microphone")
    )
    return node.where(kind.isin("Audio/Source", "Audio/Sink") & name.isNotNull()).select(
        name.alias("value"), icon.alias("icon"), label.alias("label")
    )
