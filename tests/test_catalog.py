"""Every catalogue query against its SQL on the smallest tables, and the entry's contract."""

import importlib
import sys
from pathlib import Path

import pytest

from voxframe import catalog, catalog_phrases, catalog_sources, catalog_streams  # noqa: F401  the others register with the first

SF = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, float):
        return f"{value + 0.0:.6g}"  # zero has one sign
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(row[k]) for k in order) for row in data)


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(SF))
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@needs_tables
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    made = catalog.QUERIES[name](spark, str(SF)).cache()  # all columns are worked out
    assert made.count() > 0
    made.unpersist()


def test_detect_language_knows_all_languages(spark):
    from pyspark.sql import functions as F

    from voxframe.functions.text import detect_language

    texts = {
        "uk": "Сьогодні дощ, її немає", "ru": "Сегодня это что", "nl": "dat het een man van zijn huis niet is", "pl": "to nie jest tak jak się mówi",
        "zh": "今天天气很好", "ja": "ひらがなとカタカナ", "ko": "오늘은 날씨가 좋다", "ar": "الطقس جميل اليوم", "en": "12 34",
        "fr": "le chat est sur la table que les enfants", "de": "der Hund und die Katze, das ist nicht",
    }
    rows = spark.createDataFrame(list(texts.items()), "lang string, text string")
    got = {r.lang: r.detected for r in rows.select("lang", detect_language(F.col("text")).alias("detected")).collect()}
    assert got == {lang: lang for lang in texts}
    tie = spark.createDataFrame([("без слов",)], "text string")  # both Cyrillic languages score alike: the earlier one
    assert tie.select(detect_language(F.col("text"))).first()[0] == "uk"


@needs_tables
def test_entry_gives_subtitles(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns and found.count() > 0


def test_entry_stands_without_the_optional_parts(monkeypatch):
    import __spark_entry__

    real = importlib.util.find_spec
    monkeypatch.setattr(
        importlib.util,
        "find_spec",
        lambda name, *a: None if name in ("voxframe.llm", "corpus_pipeline") else real(name, *a),
    )
    try:
        bare = importlib.reload(__spark_entry__)
        assert set(bare.queries()) == set(catalog.QUERIES)
        assert set(bare.oracle_sql()) == set(catalog.ORACLES)
    finally:
        monkeypatch.undo()
        importlib.reload(sys.modules["__spark_entry__"])


def test_cased_dictionary_words(spark):
    from voxframe.operators.textrules import cased_variants, rewrite

    rows = spark.createDataFrame([("the The THE tHe other thé", "*")], "text string, lang string")
    assert rewrite(rows, cased_variants("the", "die")).first().text == "die Die DIE die other thé"


def test_rule_plans_grow_in_step_with_the_rules(spark):
    from voxframe.operators.textrules import Rule, TextChain, rewrite

    rows = spark.createDataFrame([("a b", "en")], "text string, lang string")

    def size(n):
        rules = [Rule(f"w{k}", "x", ("en", "fr")[k % 2], f"family{k}", "i", f"g{k}") for k in range(n)]
        return len(rewrite(rows, rules)._jdf.queryExecution().optimizedPlan().toString())

    assert size(40) < 3 * size(20)
    assert len(TextChain().trace(rows)._jdf.queryExecution().optimizedPlan().toString()) < 100_000


def test_text_steps(spark):
    from voxframe.operators import textrules as tr

    cases = [
        (tr.TYPOGRAPHY_FR, "fr", "quoi ? oui! ?\n! \"mot\" « deja » ici : la...", "quoi ? oui ! ?\n! « mot » « deja » ici : la…"),
        (tr.DECIMAL_COMMA, "fr", "1,  5 et 1, 2, 3", "1,5 et 1, 2, 3"),
        (tr.EQUALS_FR, "fr", "4égale3 et 4 égale 3", "4=3 et 4 = 3"),
        (tr.ITALIAN, "it", "di il e Di la e IN LO", "del e Della e NELLO"),
    ]
    for rules, lang, given, want in cases:
        rows = spark.createDataFrame([(given, lang)], "text string, lang string")
        assert tr.rewrite(rows, rules).first().text == want


def test_array_functions_take_linear_time(spark):
    import time

    from pyspark.sql import functions as F

    from voxframe.functions import signal

    def seconds(f, n):
        samples = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.sin(i.cast("double")))
        start = time.perf_counter()
        spark.range(4).select(F.size(f(samples)).alias("n")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for f in (signal.peak_normalise, signal.preemphasis, lambda x: signal.resample(x, 24000)):
        seconds(f, 1000)
        assert seconds(f, 100_000) < 10  # a minute or more where the time grows with the square


def test_keepcaps_and_continued_utterances(spark):
    import datetime

    from pyspark.sql import functions as F

    from voxframe.functions.text import keepcaps
    from voxframe.operators.session import fold_utterances

    texts = ["Là.", "la", "La Maison", "Une Maison.", "Une Maison et encore autre"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in rows.select(keepcaps(F.col("text"), ["là"])).collect()]
    assert got == ["\x03Là", "\x03la", "\x03La Maison", "une maison", "Une Maison et encore autre"]
    start = datetime.datetime(2026, 1, 1)
    said = [(0, "Je vois le."), (10, "Chat noir,"), (20, "Puis rien!"), (60, "Enfin"), (70, "deux\nlignes"), (75, "Seul")]
    said = [(1, k, start + datetime.timedelta(seconds=s), "fr", t) for k, (s, t) in enumerate(said)]
    frame = spark.createDataFrame(said, "user_id long, seq long, ts timestamp, lang string, text string")
    made = fold_utterances(frame, {"fr": frozenset({"le"})}, ttl=30).orderBy("seq").collect()
    # Goes on after a word that calls for more; lower case after a comma; forgotten after 30 s; a newline ends it
    assert [(r.shown, r.back) for r in made] == [
        ("Je vois le.", 0), (" chat noir,", 1), (" puis rien!", 0), ("Enfin", 0), (" deux\nlignes", 0), ("Seul", 0),
    ]
