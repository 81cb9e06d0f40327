"""The pipeline stage by stage and as a whole: decisions take effect, clean documents stay."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

tokenizer_files = pytest.importorskip("public_tokenizers")
ITEM = "A farmer sells 12 baskets of apples in the morning and then walks 3 miles home to count what is left over."
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    words = "river stone cloud tree paper light door wind garden winter summer bread water child road".split()
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ly", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    texts = [prose(rng, 60) for _ in range(40)]
    near = texts[5].split()
    near[0] = "changed"
    texts += [texts[3], " ".join(near), f"Look: {ITEM}", None, "", "12 34", "token: abcdef123456 " + prose(rng, 30)]
    rows = [(k, t, "aa", "s", len(t or "")) for k, t in enumerate(texts)]
    place = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place)


def test_run_keeps_clean_documents_and_drops_the_rest(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_files.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {*range(40), 46}  # copies, the leaked item and texts without letters go
    for k, r in got.items():
        text = texts[k].replace("token: abcdef123456", "[secret]")
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == docs.columns, name
        assert made.schema["n_chars"].dataType == docs.schema["n_chars"].dataType


def test_stages_take_empty_tables_and_nulls_everywhere(spark, folder):
    nothing = spark.createDataFrame([], DOCS)
    nulls = spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (None, "some words", None, None, None)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0, name
        assert stage(spark, nulls, folder).count() <= 3, name


def test_nothing_learned_keeps_all_lettered_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, folder).collect()}
    assert kept == {*range(43), 46}


def test_rows_that_share_or_lack_an_id_are_judged_by_their_texts(spark, folder):
    rng = random.Random(2)
    mine = [prose(rng, 60) for _ in range(3)]
    rows = [(1, t, "aa", "s", len(t)) for t in (mine[0], mine[1], mine[1])] + [(None, t, "aa", "s", len(t)) for t in (mine[2], f"See: {ITEM}")]
    docs = spark.createDataFrame([*rows, (1, f"Look: {ITEM}", "aa", "s", 0)], DOCS)
    groups = corpus_pipeline.near_duplicate_groups(spark, spark.createDataFrame(rows, DOCS), folder).collect()
    assert sorted(r.text for r in groups if r.doc_id == 1) == sorted(mine[:2])
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, folder).collect()
    assert sorted(r.text for r in kept) == sorted([mine[0], mine[1], mine[1], mine[2]])


def test_repeated_rows_and_extra_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 3")
    twice = docs.unionAll(docs).withColumn("component_id", F.lit("x")).withColumn("_keep", F.lit(1)).withColumn("_leak", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, twice, folder)
        assert made.columns == twice.columns, name
        assert made.select("doc_id").distinct().count() == 3, name
