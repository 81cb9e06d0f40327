"""More named queries: line formats, configuration rows, vocabularies, predicates and small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.catalog import _DOCS, _NAMED, WITH_SPANS, _docs, _named, frames, query, spans, table
from voxframe.functions import signal, text, timefmt
from voxframe.operators import intervals, ports, render
from voxframe.sources import config, vocab, wire

_FLAT = "regexp_replace(text, '[\\n\\t]', ' ', 'g')"


@query(
    WITH_SPANS
    + """SELECT media_id, (seg_no - seg_no % 3)::INTEGER AS chunk, seg_no * 2 + 1 AS line_no, printf('%.2f', "start")::DOUBLE AS "start",
    printf('%.2f', "end")::DOUBLE AS "end", regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS text FROM spans WHERE seg_no % 3 < 2"""
)
def timed_lines(spark, sf_dir):
    """Each third turn heads a chunk, each third one an error, after which lines belong to none."""
    rows = spans(spark, sf_dir)
    n = F.col("seg_no") % 3
    head = F.when(n == 0, F.format_string("===CHUNK %d part.wav===", "seg_no")).when(n == 2, F.format_string("===ERROR %d no sound===", "seg_no"))
    body = F.concat(timefmt.span_text(F.col("start"), F.col("end")), F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" ")))
    lines = rows.select("media_id", (F.col("seg_no") * 2).alias("line_no"), head.alias("value")).unionAll(
        rows.select("media_id", F.col("seg_no") * 2 + 1, body)
    )
    return wire.parse_timed(lines.where("value IS NOT NULL"))


@query(
    WITH_SPANS
    + """SELECT media_id, seg_no AS line_no, printf('%.2f', "start")::DOUBLE AS "start", printf('%.2f', "end")::DOUBLE AS "end", (seg_no % 4)::INTEGER AS speaker_id
    FROM spans WHERE seg_no % 5 <> 4"""
)
def segment_lines(spark, sf_dir):
    """Lines "start end speaker", some of which name no number."""
    who = F.when(F.col("seg_no") % 5 == 4, "nobody").otherwise((F.col("seg_no") % 4).cast("string"))
    value = F.concat_ws("  ", timefmt.fixed(F.col("start")), timefmt.fixed(F.col("end")), who)
    return wire.parse_segments(spans(spark, sf_dir).select("media_id", F.col("seg_no").alias("line_no"), value.alias("value")))


@query(
    f"""SELECT doc_id, 'take ' || doc_id || '.wav' AS path, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'timestamps' ELSE 'diarize' END AS mode,
    CASE WHEN doc_id % 2 = 0 THEN {_FLAT} END AS context, CASE WHEN doc_id % 5 < 3 THEN lang END AS lang {_DOCS}"""
)
def request_lines(spark, sf_dir):
    """Requests with the parts in changing order; a whole text is the context."""
    n = F.col("doc_id")
    mode = F.when(n % 3 == 1, "timestamps").when(n % 3 == 2, "diarize")
    context = F.when(n % 2 == 0, F.concat(F.lit("context:"), F.regexp_replace("text", "[\\n\\t]", " ")))
    lang = F.when(n % 5 < 3, F.concat(F.lit("lang:"), F.col("lang")))
    line = F.concat_ws("\t", F.format_string(" take %d.wav ", "doc_id"), lang, mode, context)
    return _docs(spark, sf_dir).select("doc_id", wire.parse_request(line).alias("r")).select("doc_id", "r.*")


@query(
    f"""SELECT doc_id AS ord, coalesce(lang, '*') AS lang, 'w' || doc_id || '\\/x' AS pattern, '\\1-' || coalesce(lang, '') AS replacement,
    CASE WHEN doc_id % 2 = 0 THEN 'i' ELSE '' END AS flags {_DOCS} AND doc_id % 7 <> 3"""
)
def rule_lines(spark, sf_dir):
    """Rule lines with an escaped slash; some are comments."""
    lang = F.coalesce("lang", F.lit("*"))
    line = F.concat(F.lit("["), lang, F.format_string("] /w%d\\/x/\\1-", "doc_id"), F.coalesce("lang", F.lit("")), F.lit("/"), F.when(F.col("doc_id") % 2 == 0, "i").otherwise(""))
    value = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("# "), line)).otherwise(line)
    return config.parse_rules(_docs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), value.alias("value")))


@query(f"SELECT doc_id AS ord, coalesce(lang, '*') AS lang, 'word ' || doc_id AS word, 'a = ' || doc_id AS replacement {_DOCS}")
def dictionary_lines(spark, sf_dir):
    line = F.concat(F.lit(" ["), F.coalesce("lang", F.lit("*")), F.format_string("] word %d  =  a = %d ", "doc_id", "doc_id"))
    return config.parse_dictionary(_docs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), line.alias("value")))


_LISTS = f"""WITH w AS (SELECT coalesce(lang, '*') AS lang, unnest(string_split_regex(lower({_FLAT}), '\\s+')) AS word, doc_id {_DOCS}), p AS (SELECT DISTINCT lang, word, doc_id % 3 AS part FROM w WHERE word <> '') """


@query(_LISTS + "SELECT DISTINCT lang, word FROM p WHERE part < 2 AND (lang, word) NOT IN (SELECT (lang, word) FROM p WHERE part = 2)")
def merged_word_sets(spark, sf_dir):
    """The words of a third of the documents are the system's, of another third the user's, of the last what the user excludes."""
    rows = _docs(spark, sf_dir)
    tag = F.when(F.col("doc_id") % 3 == 2, "exclude:").otherwise("")
    line = F.concat(F.lit("["), tag, F.coalesce("lang", F.lit("*")), F.lit("] "), F.regexp_replace("text", "[\\n\\t]", " "))
    lines = rows.select((F.col("doc_id") % 3).alias("part"), line.alias("value"))
    system, user = (config.parse_word_sets(lines.where(which)) for which in ("part = 0", "part > 0"))
    return config.merge_words(system, user)


_SETTINGS = """WITH d AS (SELECT user_id AS id, count(*)::VARCHAR AS v FROM events GROUP BY 1), c AS (SELECT CASE WHEN id % 5 = 0 THEN id + 1000000 ELSE id END AS id,
  CASE WHEN id % 2 = 0 THEN v ELSE v || ' changed' END AS v FROM d) """


def _settings(spark, sf_dir):
    defaults = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").cast("string").alias("value"))
    new = F.when(F.col("id") % 5 == 0, F.col("id") + 1000000).otherwise(F.col("id"))
    value = F.when(F.col("id") % 2 == 0, F.col("value")).otherwise(F.concat("value", F.lit(" changed")))
    return defaults, defaults.select(new.alias("id"), value.alias("value"))


@query(_SETTINGS + "SELECT c.id, c.v AS value FROM c LEFT JOIN d USING (id) WHERE d.v IS DISTINCT FROM c.v")
def stored_settings(spark, sf_dir):
    return config.stored_delta(*_settings(spark, sf_dir))


@query(_SETTINGS + "SELECT coalesce(c.id, d.id) AS id, coalesce(c.v, d.v) AS value FROM d FULL JOIN c ON c.id = d.id")
def overlaid_settings(spark, sf_dir):
    defaults, current = _settings(spark, sf_dir)
    return config.overlay(defaults, current)


@query("SELECT vec_id::INTEGER AS id, 'p' || label AS piece, (SELECT CASE WHEN max(vec_id) FILTER (WHERE vec_id % 97 = 5) > 0 THEN max(vec_id) FILTER (WHERE vec_id % 97 = 5) ELSE max(vec_id) END FROM embeddings)::INTEGER AS blank FROM embeddings WHERE vec_id % 97 <> 5 UNION ALL SELECT vec_id::INTEGER, '<blk>', (SELECT max(vec_id) FILTER (WHERE vec_id % 97 = 5) FROM embeddings)::INTEGER FROM embeddings WHERE vec_id % 97 = 5")
def vocabulary_lines(spark, sf_dir):
    piece = F.when(F.col("vec_id") % 97 == 5, "<blk>").otherwise(F.concat(F.lit("p"), F.col("label").cast("string")))
    lines = table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", piece, F.col("vec_id").cast("string")).alias("value"))
    pieces = vocab.parse_vocabulary(lines)
    return pieces.join(F.broadcast(vocab.blank_id(pieces)))  # one row


@query(
    "WITH l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) SELECT lang, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, lang)::INTEGER AS n FROM l"
)
def listed_languages(spark, sf_dir):
    return vocab.languages_listed(table(spark, sf_dir, "documents").where("lang IS NOT NULL"), ["fr", "de"])


_FILES = "WITH f AS (SELECT label AS location, CASE WHEN vec_id % 50 = 7 THEN 'encoder.int8.onnx' WHEN vec_id % 11 = 3 THEN 'encoder-' || vec_id ELSE 'other' || vec_id END AS name FROM embeddings) "


@query(
    _FILES
    + """, r AS (SELECT DISTINCT location, name, CASE WHEN name = 'encoder.int8.onnx' THEN 1 ELSE 2 END AS k FROM f WHERE starts_with(name, 'encoder'))
    SELECT location, arg_min(name, (k, name)) AS name FROM r GROUP BY 1"""
)
def picked_candidates(spark, sf_dir):
    n = F.col("vec_id")
    name = F.when(n % 50 == 7, "encoder.int8.onnx").when(n % 11 == 3, F.format_string("encoder-%d", n)).otherwise(F.format_string("other%d", n))
    files = table(spark, sf_dir, "embeddings").select(F.col("label").alias("location"), name.alias("name"))
    return vocab.pick_candidate(files, ["encoder.onnx", "encoder.int8.onnx"], "encoder")


@query("SELECT 'm-' || url AS name FROM pages ORDER BY contains('m-' || url, '-http') DESC, 'm-' || url LIMIT 1")
def picked_folder(spark, sf_dir):
    return vocab.pick_folder(table(spark, sf_dir, "pages").select(F.concat(F.lit("m-"), F.col("url")).alias("name")), "http")


@query("SELECT count(*) AS n, CASE WHEN sum(vec_id) >= 1024 THEN printf('%.1f', sum(vec_id) / 1024.0::DOUBLE) || ' GB' ELSE sum(vec_id) || ' MB' END AS size FROM embeddings")
def model_totals(spark, sf_dir):
    return vocab.total_size(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("size_mb")))


@query(f"SELECT doc_id, (CASE WHEN doc_id % 3 = 0 THEN chr(3) ELSE '' END) || text || chr(1) || chr(2) || chr(4) AS text {_DOCS}")
def scrubbed_text(spark, sf_dir):
    """Control characters strewn in: those that are data stay."""
    lead = F.when(F.col("doc_id") % 3 == 0, "\x03").otherwise("\x05")
    dirty = F.concat(lead, F.col("text"), F.lit("\x01\x03\x02\x0b\x04\x1f"))
    return _docs(spark, sf_dir).select("doc_id", text.scrub(dirty).alias("text"))


@query(f"SELECT doc_id, doc_id % 4 = 1 OR regexp_matches(text, '[\\p{{Cyrillic}}\\p{{Greek}}\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}\\p{{Arabic}}\\p{{Hebrew}}]') AS pasted {_DOCS}")
def pasted_text(spark, sf_dir):
    mixed = F.when(F.col("doc_id") % 4 == 1, F.concat(F.col("text"), F.lit(" да"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.needs_paste(mixed).alias("pasted"))


@query(WITH_SPANS + "SELECT media_id, seg_no, CASE WHEN seg_no % 3 = 0 THEN 0 ELSE seg_no::INTEGER END AS speaker FROM spans")
def speaker_numbers(spark, sf_dir):
    label = F.when(F.col("seg_no") % 3 == 0, "UNKNOWN").otherwise(F.format_string("Speaker %d (of 9)", "seg_no"))
    return spans(spark, sf_dir).select("media_id", "seg_no", text.speaker_index(label).alias("speaker"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Ω' || text ELSE text END AS text {_DOCS}")
def context_resets(spark, sf_dir):
    """Every other text begins anew: its mark and blanks go, its first letter is raised."""
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" \t\x04 ω"), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.reset_context(marked).alias("text"))


@query(f"SELECT doc_id, CASE WHEN instr(text[101:], 'the') > 0 THEN instr(text[101:], 'the') + 99 WHEN instr(text, 'the') > 0 THEN instr(text, 'the') - 1 ELSE -1 END::INTEGER AS place {_DOCS}")
def found_next(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.find_next(F.col("text"), F.lit("the"), F.lit(100)).alias("place"))


@query(f"SELECT doc_id, 'Say: ' || text || ' After: ' || CASE WHEN doc_id % 2 = 0 THEN '(none)' ELSE lang END || ' Words: ' || CASE WHEN doc_id % 3 = 0 THEN '(none)' ELSE 'x' END AS prompt {_DOCS} AND lang IS NOT NULL")
def filled_prompts(spark, sf_dir):
    before, words = F.when(F.col("doc_id") % 2 == 1, F.col("lang")), F.when(F.col("doc_id") % 3 == 0, "").otherwise("x")
    template = F.lit("Say: {TRANSCRIPT} After: {PREVIOUS_SEGMENT} Words: {DICTIONARY}")
    return _docs(spark, sf_dir).where("lang IS NOT NULL").select("doc_id", text.fill_prompt(template, F.col("text"), before, words).alias("prompt"))


_WIDE = "CASE WHEN length(printf('%.2f', {0})) < 5 THEN lpad(printf('%.2f', {0}), 5, '0') ELSE printf('%.2f', {0}) END"


@query(WITH_SPANS + f"""SELECT media_id, seg_no, '[' || {_WIDE.format('"start"')} || 's - ' || {_WIDE.format('"end"')} || 's]' AS span FROM spans""")
def stream_spans(spark, sf_dir):
    return spans(spark, sf_dir).select("media_id", "seg_no", timefmt.stream_span_text(F.col("start"), F.col("end")).alias("span"))


@query(
    WITH_SPANS
    + """, t AS (SELECT media_id, seg_no % 3 AS chunk, 3 AS n_chunks, "start" % 120 AS s, "start" % 120 + 1 AS e, text FROM spans)
    SELECT media_id, chunk, round(s + chunk * 105.0::DOUBLE, 6) AS s, round(e + chunk * 105.0::DOUBLE, 6) AS e, text FROM t
    WHERE (s + e) / 2 >= (CASE WHEN chunk = 0 THEN 0 ELSE 7.5 END) AND (s + e) / 2 < (CASE WHEN chunk = 2 THEN 120 ELSE 112.5 END)"""
)
def merged_chunks(spark, sf_dir):
    start = F.col("start") % 120
    rows = spans(spark, sf_dir).select(
        "media_id", (F.col("seg_no") % 3).alias("chunk"), F.lit(3).alias("n_chunks"), (F.col("seg_no") % 3 * 105.0).alias("chunk_start"), start.alias("start"), (start + 1).alias("end"), "text"
    )
    return intervals.merge_chunks(rows).select("media_id", "chunk", F.round("start", 6).alias("s"), F.round("end", 6).alias("e"), "text")


_BY_USER = "WITH frames AS (SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 500.0::DOUBLE AS level FROM events) "


def _levels(spark, sf_dir):
    return frames(spark, sf_dir).select("media_id", "frame", F.col("p").alias("level"))


@query(_BY_USER + "SELECT media_id, round(CASE WHEN count(*) >= 25 THEN avg(level) * 1.2::DOUBLE END, 6) AS floor FROM frames WHERE frame < 25 GROUP BY 1")
def noise_floors(spark, sf_dir):
    return signal.noise_floor(_levels(spark, sf_dir)).withColumn("floor", F.round("floor", 6))


@query(
    _BY_USER
    + """SELECT media_id, frame::BIGINT AS frame, round((sum(level * (CASE WHEN frame = 0 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END) * pow(0.65::DOUBLE, -frame)) OVER (PARTITION BY media_id ORDER BY frame)) * pow(0.65::DOUBLE, frame) / 3, 6) AS third FROM frames"""
)
def smoothed_levels(spark, sf_dir):
    smooth = signal.smooth_levels(_levels(spark, sf_dir))
    return smooth.select("media_id", "frame", F.round(F.col("level") / 3, 6).alias("third"))  # a third has no ties to round


@query(f"SELECT doc_id, CASE WHEN lang IS NULL THEN '[EN] ' || text ELSE 'x' || doc_id END AS translated {_DOCS}")
def translated_by_table(spark, sf_dir):
    """Texts with a language are in the table; the others fall back."""
    rows = _docs(spark, sf_dir)
    own = rows.withColumn("text", F.when(F.col("lang").isNotNull(), F.concat(F.col("text"), F.lit("#"), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    listed = own.where("lang IS NOT NULL").select(F.lit("xx").alias("src"), F.lit("en").alias("tgt"), "text", F.format_string("x%d", "doc_id").alias("translated"))
    return ports.translate_by_table(own, listed, "xx", "en").select("doc_id", "translated")


@query(
    WITH_SPANS
    + """, c AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS chg FROM spans WINDOW w AS (PARTITION BY media_id ORDER BY seg_no))
    SELECT media_id, seg_no, speaker, text, coalesce(CASE WHEN sum(chg) OVER (PARTITION BY media_id ORDER BY seg_no) % 4 <> 0 THEN trim('> ' || replace(text, chr(10), ' ')) END, text) AS translated,
    (sum(chg) OVER (PARTITION BY media_id ORDER BY seg_no)) % 4 = 0 AS failed FROM c"""
)
def translated_turns(spark, sf_dir):
    """A mark before each line stands for a translation; every fourth turn fails."""
    rows = spans(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))

    def translate(turns):
        return turns.withColumn("translated", F.when(F.col("turn_no") % 4 != 3, F.regexp_replace("text", "(?m)^", "> ")))

    made = ports.translate_turns(rows, translate)
    return made.join(spans(spark, sf_dir).select("media_id", "seg_no", F.col("text").alias("_own")), ["media_id", "seg_no"]).select(
        "media_id", "seg_no", "speaker", F.col("_own").alias("text"), F.when(F.col("failed"), F.col("_own")).otherwise(F.col("translated")).alias("translated"), "failed"
    )


@query("SELECT vec_id, [7] || (CASE WHEN vec_id % 2 = 0 THEN [label] ELSE []::INTEGER[] END) || [4, 16, 62, 76, 5, 9, 11, 13, 3] AS ids FROM embeddings")
def decoder_prompts(spark, sf_dir):
    fixed = {"context": 7, "start": 4, "emotion": 16, "punctuation": 5, "no_normalisation": 9, "no_timestamps": 11, "no_diarization": 13, "first": 3}
    context = F.when(F.col("vec_id") % 2 == 0, F.array(F.col("label").cast("int")))
    rows = table(spark, sf_dir, "embeddings").withColumn("context", context)
    return rows.select("vec_id", ports.prompt_ids({"en": 62, "de": 76}, "en", "de", fixed).alias("ids"))


@query(
    WITH_SPANS
    + _NAMED
    + """, r AS (SELECT media_id, seg_no, json_object('start', "start", 'end', "end", 'speaker_id', speaker, 'speaker', display, 'text', text) AS o FROM named)
    SELECT media_id, count(*) AS n, string_agg(json_extract_string(o, '$.speaker_id') || json_extract_string(o, '$.speaker') || json_extract_string(o, '$.text'), '|' ORDER BY seg_no) AS read FROM r GROUP BY 1"""
)
def json_read_back(spark, sf_dir):
    """The JSON form read again."""
    rows = "array<struct<start:double,end:double,speaker_id:string,speaker:string,text:string>>"
    back = render.json_text(_named(spark, sf_dir)).select("media_id", F.from_json("text", rows).alias("r"))
    each = F.transform("r", lambda s: F.concat(s["speaker_id"], s["speaker"], s["text"]))
    return back.select("media_id", F.size("r").cast("long").alias("n"), F.array_join(each, "|").alias("read"))
