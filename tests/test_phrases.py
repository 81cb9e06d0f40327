"""Small functions on fixtures, batch output on disk, rule files, and model ports that fail."""

from pyspark.sql import functions as F

from voxframe.functions import phrases
from voxframe.operators import ports, sequence, textrules
from voxframe.sources import sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} string" for name in values)).select(column).first()[0]


def test_keywords_at_the_start(spark):
    cases = {"Minuscules, oui": "oui", "à-la ligne": "", "à la lignes. B": "B", "le minuscule": None, "": None}
    for given, want in cases.items():
        assert one(spark, phrases.after_keyword(F.col("t"), "minuscule, à la ligne"), t=given) == want
    assert one(spark, phrases.after_keyword(F.col("t"), " , "), t="any") is None


def test_settings_as_written(spark):
    cases = [("Int", " 12 ", "12"), ("Int", "x", None), ("Double", "0.0005", "0.0005"), ("Double", "3", "3.0"), ("Double", "0.10", "0.1"),
             ("Bool", " TRUE ", "true"), ("Bool", "1", "false"), ("Path", 'a\\b"c', '"a\\\\b\\"c"')]
    for kind, given, want in cases:
        assert one(spark, phrases.setting_text(F.col("v"), F.col("k")), v=given, k=kind) == want


def test_previous_place_wraps(spark):
    text = "ab ab ab"
    for before, want in ((8, 6), (7, 3), (2, 0), (1, 6), (0, 6)):
        assert one(spark, phrases.find_previous(F.col("t"), F.lit("ab"), F.lit(before)), t=text) == want
    assert one(spark, phrases.find_previous(F.col("t"), F.lit("z"), F.lit(8)), t=text) == -1


def test_suggested_rules_escape_the_text(spark):
    made = one(spark, phrases.suggested_rules(F.col("r"), F.col("p"), "fr"), r="да [a.b].!", p="да [a.b].!")
    assert made == [r"[fr] /^[,.\s]*да \[a\.b\][,.\s]*/, /igm", r"[fr] /^[,.\s]*да \[a\.b\][,.\s]*/\n/igm"]
    assert one(spark, phrases.suggested_rules(F.col("r"), F.col("p"), "fr"), r="да", p="et") == []


def test_segments_keep_to_the_cursor(spark):
    documents = spark.createDataFrame([(1, "a b a c"), (2, None)], "media_id long, text string")
    rows = [(1, 0, " a "), (1, 1, "zz"), (1, 2, ""), (1, 3, "a"), (1, 4, "b"), (1, 5, None), (2, 0, "a")]
    segments = spark.createDataFrame(rows, "media_id long, seg_no int, text string")
    got = sorted(tuple(r) for r in sequence.segment_positions(documents, segments).collect())
    assert got == [(1, 0, 0, 1), (1, 3, 4, 5)]  # b stands before the cursor


def test_batch_output_goes_on_after_a_failure(spark, tmp_path):
    def factory():
        def run(samples, rate):
            if rate == 0:
                raise ValueError("no\nsound")
            return [("one\ntwo", 0.0, 1.0), ("three", 1.0, 2.5)]

        return run

    audio = spark.createDataFrame([(1, 16000, [0.0]), (2, 0, [0.0])], "media_id long, sample_rate int, samples array<float>")
    results = ports.recognise(audio, factory).withColumn("path", F.format_string("%d.wav", "media_id"))
    sinks.write_lines(sinks.batch_lines(results), str(tmp_path / "lines"))
    lines = {}
    for media in (1, 2):
        lines[media] = [r[0] for r in spark.read.text(str(tmp_path / "lines" / f"media_id={media}")).collect()]
    assert lines[1][0] == "===CHUNK 1 1.wav===" and lines[1][1].endswith(" one two") and lines[1][2].endswith(" three")
    assert lines[2] == ["===ERROR 2 no sound==="]
    assert tuple(sinks.exit_state(results).first()) == (1, 2)
    assert tuple(sinks.exit_state(results.where("status = 'ok'")).first()) == (0, 0)


def test_texts_and_json_lines_on_disk(spark, tmp_path):
    rendered = spark.createDataFrame([(1, "a\nb"), (2, "c")], "media_id long, text string")
    sinks.write_texts(rendered, str(tmp_path / "texts"))
    back = spark.read.text(str(tmp_path / "texts"), wholetext=True).collect()
    assert sorted((r.media_id, r.value) for r in back) == [(1, "a\nb\n"), (2, "c\n")]
    sinks.write_json_lines(rendered, str(tmp_path / "json"))
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "json")).collect()) == ["a\nb", "c"]


def test_rule_rows_become_rules(spark):
    rows = [
        (1, "*", r"a[,.\s]+b", r"\x01 \n", "i"), (2, "*", "%SUFFIX_FR%", "x", ""), (3, "*", "%SUFFIX_DE%", "x", ""), (4, "fr", "(", "x", ""),
        (5, "fr", "(c)", r"\1\1", ""),
    ]
    frame = spark.createDataFrame(rows, "ord int, lang string, pattern string, replacement string, flags string")
    rules = textrules.rules_from_rows(frame, {"fr": "finale?s?"})
    assert [r.pattern for r in rules] == [r"a[,. \t]+b", "finale?s?", "(c)"] and rules[0].replacement == "\x01 \n"
    text = spark.createDataFrame([("a. b a\nb finales c", "fr"), ("c", "en")], "text string, lang string")
    assert [r.text for r in textrules.rewrite(text, rules).collect()] == ["\x01 \n a\nb x cc", "c"]


def test_elision_and_contractions(spark):
    cases = [
        (textrules.ELISION_FR, "fr", "le homme et le hibou, la haine, les hiboux, le héros, la héroïne, que hurler", "l'homme et le hibou, la haine, les hiboux, le héros, l'héroïne, que hurler"),
        (textrules.PORTUGUESE, "pt", "de aquele, em isto, por as, a aquela", "daquele, nisto, pelas, àquela"),
        (textrules.ROMANIAN, "ro", "într un, printr o, dintr o", "într-un, printr-o, dintr-o"),
    ]
    for rules, lang, given, want in cases:
        rows = spark.createDataFrame([(given, lang)], "text string, lang string")
        assert textrules.rewrite(rows, rules).first().text == want


def test_whole_analysis_keeps_the_transcript_where_the_model_fails(spark):
    rows = [(1, 0, "A", 0.0, 1.0, "good"), (1, 1, "B", 1.0, 2.0, " "), (2, 0, "A", 0.0, 1.0, "bad")]
    segments = spark.createDataFrame(rows, "media_id long, seg_no int, display string, start double, end double, text string")

    def factory():
        def model(ask):
            if "bad" in ask:
                raise RuntimeError("gone")
            return ask

        return model

    got = {r.media_id: (r.text, r.corrected, r.failed) for r in ports.analyse_whole(segments, "<{TRANSCRIPT}>", factory, plain=True).collect()}
    assert got == {1: ("good", "<good>", False), 2: ("bad", "bad", True)}
