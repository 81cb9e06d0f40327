"""More named queries: keywords and guards, settings, positions in edited text, whole-recording analysis, batch output."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.catalog import _DOCS, _SCORES, WITH_SPANS, _docs, _finite, _scores, query, spans, table
from voxframe.functions import phrases, text
from voxframe.operators import diarize, ports, sequence, textrules
from voxframe.sources import config, sinks, wire


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '^(?i:the|new[- ]?line|der)(?i:s)?[.,]?') THEN regexp_replace(text, '^(?i:the|new[- ]?line|der)(?i:s)?[.,]?[ \\t\\n\\r\\f]*', '') END AS rest {_DOCS}")
def keyword_rest(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", phrases.after_keyword(F.col("text"), " The, new line,,der ").alias("rest"))


_RFIND = "CASE WHEN contains({0}, 'en') THEN length({0}) - strpos(reverse({0}), 'ne') - 1 END"


@query(f"SELECT doc_id, coalesce({_RFIND.format('text[1:(length(text) // 2)]')}, {_RFIND.format('text')}, -1)::INTEGER AS place {_DOCS}")
def find_previous(spark, sf_dir):
    place = phrases.find_previous(F.col("text"), F.lit("en"), F.floor(F.length("text") / 2).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", place.cast("int").alias("place"))


@query(
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'w' || doc_id || 'e' WHEN 1 THEN 'x?final' || doc_id ELSE 'fin' || doc_id || 'a' END AS word {_DOCS}"""
)
def readable_suffixes(spark, sf_dir):
    n = F.col("doc_id") % 3
    form = F.when(n == 0, F.format_string("w%de?s?", "doc_id")).when(n == 1, F.format_string("x?final%ds?", "doc_id")).otherwise(F.format_string("fl?in%da", "doc_id"))
    return _docs(spark, sf_dir).select("doc_id", phrases.readable_suffix(form).alias("word"))


@query(
    f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN (doc_id / 8.0::DOUBLE)::VARCHAR WHEN 2 THEN CASE WHEN doc_id % 8 = 2 THEN 'true' ELSE 'false' END
    ELSE '"' || replace(replace(text, '\\', '\\\\'), '"', '\\"') || '"' END AS written {_DOCS}"""
)
def settings_written(spark, sf_dir):
    """Whole texts stand for settings of the last kind."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("Int", "Double", "Bool", "String"))), (n % 4 + 1).cast("int"))
    value = (
        F.when(n % 4 == 0, F.format_string(" %d ", n))
        .when(n % 4 == 1, (n / 8.0).cast("string"))
        .when(n % 4 == 2, F.when(n % 8 == 2, " True").otherwise("yes"))
        .otherwise(F.col("text"))
    )
    return _docs(spark, sf_dir).select("doc_id", phrases.setting_text(value, kind).alias("written"))


@query(
    WITH_SPANS
    + """, p AS (SELECT media_id, seg_no, text AS solo, lag(text) OVER (PARTITION BY media_id ORDER BY seg_no) AS found FROM spans)
    SELECT media_id, seg_no, CASE WHEN length(found) >= length(solo) * 0.5 AND length(found) <= length(solo) * 1.8 THEN found ELSE solo END AS kept FROM p"""
)
def guarded_lengths(spark, sf_dir):
    """Each turn beside the one before, where that is neither much shorter nor much longer."""
    found = F.lag("text").over(sequence._by("seg_no"))
    return spans(spark, sf_dir).select("media_id", "seg_no", phrases.length_guard(found, F.col("text")).alias("kept"))


@query("SELECT event_id, event_id % 4 <> 1 AND (event_id % 4 <> 0 OR event_id % 5 <> 4) AS reliable FROM events")
def reliable_times(spark, sf_dir):
    n = F.col("event_id")
    backend = F.element_at(F.array(*map(F.lit, ("Whisper", "vosk", "canary", "parakeet"))), (n % 4 + 1).cast("int"))
    size = F.element_at(F.array(F.lit("tiny"), F.lit("Base"), F.lit(None).cast("string"), F.lit("medium"), F.lit("large-v3")), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", phrases.reliable_times(backend, size).alias("reliable"))


@query(
    f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[fr] /^[,.\\s]*' || regexp_replace(regexp_replace('да ' || text, '[.?!,]*\\z', ''), '([\\]/$*.^\\[\\\\])', '\\\\\\1', 'g') || '[,.\\s]*/, /igm' END AS comma,
    CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END::INTEGER AS n {_DOCS}"""
)
def suggested_rules(spark, sf_dir):
    """A third of the texts has Cyrillic letters that nothing changed, a third such that were changed, a third none."""
    n = F.col("doc_id") % 3
    raw = F.when(n < 2, F.concat(F.lit("да "), F.col("text"))).otherwise(F.col("text"))
    rules = phrases.suggested_rules(raw, F.when(n == 1, F.col("text")).otherwise(raw), "fr")
    return _docs(spark, sf_dir).select("doc_id", rules.alias("r")).select("doc_id", F.get("r", F.lit(0)).alias("comma"), F.size("r").alias("n"))


@query(
    WITH_SPANS
    + """, t AS (SELECT *, "start" - "start" % 4 AS s4, (seg_no % 3)::INTEGER AS spk FROM spans)
    SELECT media_id, seg_no, (row_number() OVER (PARTITION BY media_id ORDER BY s4, spk, seg_no) - 1)::INTEGER AS place FROM t"""
)
def segment_order(spark, sf_dir):
    rows = spans(spark, sf_dir).select(
        "media_id", F.col("seg_no").alias("ord"), (F.col("start") - F.col("start") % 4).alias("start"), (F.col("seg_no") % 3).alias("speaker_id")
    )
    return sequence.segment_order(rows).select("media_id", F.col("ord").alias("seg_no"), "place")


@query(WITH_SPANS + """, t AS (SELECT *, floor(max("end") OVER (PARTITION BY media_id)) - 30 AS cut FROM spans) SELECT media_id, seg_no, text FROM t WHERE "start" >= cut""")
def last_half_minute(spark, sf_dir):
    return sequence.last_seconds(spans(spark, sf_dir)).select("media_id", "seg_no", "text")


@query(
    WITH_SPANS
    + """, t AS (SELECT media_id, seg_no, trim(text, E' \\t\\n\\r') AS part, length(text) - length(ltrim(text, E' \\t\\n\\r')) AS lead,
    sum(length(text) + 1) OVER (PARTITION BY media_id ORDER BY seg_no) - length(text) - 1 AS base FROM spans WHERE seg_no % 4 <> 3)
    SELECT media_id, seg_no::BIGINT AS seg_no, (base + lead)::BIGINT AS "from", (base + lead + length(part))::BIGINT AS "to" FROM t WHERE part <> ''"""
)
def segment_positions(spark, sf_dir):
    """Every fourth segment was edited out of its document; its own text has a mark that nothing else has."""
    out = F.col("seg_no") % 4 == 3
    rows = spans(spark, sf_dir)
    line = F.when(~out, F.struct("seg_no", "text"))
    documents = rows.groupBy("media_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["text"]), "\n").alias("text"))
    wanted = rows.select("media_id", "seg_no", F.when(out, F.concat(F.lit("\x07"), F.col("text"))).otherwise(F.col("text")).alias("text"))
    return sequence.segment_positions(documents, wanted)


@query(
    WITH_SPANS
    + """SELECT media_id, string_agg(text, chr(10) || chr(10) ORDER BY seg_no) FILTER (WHERE trim(text) <> '') AS text,
    (sum(length(text) + 2) FILTER (WHERE trim(text) <> '') - 2 + length('Sum up:  by its words (none)') + length(chr(10) || chr(10) || '[Answer only in French.]')
    + length('Write all of your answer in French, headings and lists too, whatever language the text is in.') + 2)::VARCHAR AS reply FROM spans GROUP BY 1
    HAVING count(*) FILTER (WHERE trim(text) <> '') > 0"""
)
def analysed_whole(spark, sf_dir):
    """The stand-in for a model answers with the length of what it was asked."""
    made = ports.analyse_whole(spans(spark, sf_dir), "Sum up: {TRANSCRIPT} by its words {DICTIONARY}", lambda: lambda ask: str(len(ask)), "French", plain=True)
    return made.select("media_id", "text", F.col("corrected").alias("reply"))


@query(
    WITH_SPANS
    + """SELECT media_id, seg_no::INTEGER + 1 AS line_no, media_id::INTEGER AS chunk, printf('%.2f', "start")::DOUBLE AS "start", printf('%.2f', "end")::DOUBLE AS "end",
    regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM spans WHERE media_id % 5 <> 4"""
)
def batch_read_back(spark, sf_dir):
    """Batch output read again: every fifth recording failed and gives no timed line."""
    bad = F.col("media_id") % 5 == 4
    first = F.row_number().over(sequence._by("seg_no")) - 1
    rows = spans(spark, sf_dir).withColumn("pos", first.cast("int"))
    results = rows.where(~bad | (F.col("pos") == 0)).select(
        "media_id", F.lit("part.wav").alias("path"), "pos", "text", "start", "end",
        F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, "no sound").alias("error"),
    )
    return wire.parse_timed(sinks.batch_lines(results))


@query("SELECT count(*) FILTER (WHERE doc_id % 7 = 3) AS failed, CASE WHEN count(*) FILTER (WHERE doc_id % 7 = 3) > 0 THEN 2 ELSE 0 END::INTEGER AS state " + _DOCS)
def exit_state(spark, sf_dir):
    return sinks.exit_state(_docs(spark, sf_dir).select(F.when(F.col("doc_id") % 7 == 3, "error").otherwise("ok").alias("status")))


@query(
    "SELECT 0 AS origin, doc_id AS ord, 'built-' || doc_id AS id "
    + _DOCS
    + " UNION ALL SELECT 1, page_id, url FROM pages"
)
def builtins_then_user(spark, sf_dir):
    builtin = _docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.format_string("built-%d", "doc_id").alias("id"))
    return config.builtins_then_user(builtin, table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("id")))


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(text, 'er[,. \\t]+', '—', 'gi'), '([0-9])%', '\\1' || chr(160) || '%', 'g') AS text {_DOCS}"""
)
def rules_of_a_file(spark, sf_dir):
    """A rule file from its lines to whole texts: escapes, a suffix, a rule without a suffix and one that does not compile."""
    lines = [
        (1, "# a comment"), (2, r"[*] /%SUFFIX_EN%[,.\s]+/—/i"), (3, r"[*] /\b%SUFFIX_XX%/gone/i"), (4, "[*] /([0-9]%/gone/"),
        (5, r"[*] /([0-9])%/\1 %/"),
    ]
    rows = config.parse_rules(spark.createDataFrame(lines, "line_no int, value string"))
    rules = textrules.rules_from_rows(rows, {"en": "er"})
    return textrules.rewrite(_docs(spark, sf_dir).select("doc_id", "text", "lang"), rules).select("doc_id", "text")


_TWICE = """, b1 AS (SELECT *, row_number() OVER (PARTITION BY media_id, speaker_id ORDER BY score DESC, frame) AS k FROM sc),
  s1 AS (SELECT media_id, frame, speaker_id, CASE WHEN k <= 33 THEN score - 2 * ln(0.5::DOUBLE) ELSE score END AS score FROM b1),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY media_id, speaker_id ORDER BY score DESC, frame) AS k FROM s1)
  SELECT media_id, frame, speaker_id, round(CASE WHEN k <= 66 THEN score - ln(0.5::DOUBLE) ELSE score END, 5) AS score FROM b2"""


@query(_SCORES + _TWICE)
def boosted_twice(spark, sf_dir):
    made = diarize.boost(diarize.log_odds(_scores(spark, sf_dir)))
    return made.select("media_id", "frame", "speaker_id", _finite("score"))


@query(
    WITH_SPANS
    + """, w AS (SELECT media_id, seg_no, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS words FROM spans),
    c AS (SELECT *, ['§1', '§2', '§3'] || words AS joint, least(len(words), 3) AS k FROM w),
    f AS (SELECT *, list_max([i FOR i IN range(0, len(joint) - k + 1) IF (CASE WHEN joint[i + 1] = words[1] THEN 1 ELSE 0 END)
      + (CASE WHEN k >= 2 AND joint[i + 2] = words[2] THEN 1 ELSE 0 END) + (CASE WHEN k >= 3 AND joint[i + 3] = words[3] THEN 1 ELSE 0 END) >= k - 1]) AS place FROM c),
    g AS (SELECT *, array_to_string(joint[place + 1:], ' ') AS found, array_to_string(words, ' ') AS solo FROM f)
    SELECT media_id, seg_no, CASE WHEN length(found) >= length(solo) * 0.5 AND length(found) <= length(solo) * 1.8 THEN found ELSE solo END AS kept FROM g"""
)
def dual_recognition(spark, sf_dir):
    """A text recognised alone and again behind three words of context: what is cut out, sought from the end, must stand the length guard."""
    words = F.split(F.trim(F.regexp_replace("text", "[ \\t\\n\\x0b\\f\\r]+", " ")), " ")
    context = F.array(F.lit("§1"), F.lit("§2"), F.lit("§3"))
    found = F.array_join(text.solo_in_combined(words, F.concat(context, words)), " ")
    solo = F.array_join(words, " ")
    return spans(spark, sf_dir).select("media_id", "seg_no", phrases.length_guard(found, solo).alias("kept"))
