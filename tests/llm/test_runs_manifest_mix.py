"""Periodic runs, the manifest and the mix against plain brute force and SQL, with nulls, ties, copies and clashing names."""

import hashlib
import random
import time
import zlib
from fractions import Fraction
from pathlib import Path

import pytest

from voxframe.llm.manifest import FIELDS, depth_of, tampered_manifest
from voxframe.llm.mixing import MIX_SQL, mix_sources
from voxframe.llm.periodic import find_runs, kept_words, periodic_runs, plant_repeats, run_digests, strongest, word_ids
from voxframe.llm.queries import oracle_sql, queries
from voxframe.llm.shared import Scratch, clear_scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key string, h string, _text string"
SF = Path("/root/testdata/sf0.001")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, least=24, times=3):
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length, part = j - i + q, words[i : j + q]
            if j > i and length >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    """Words in which runs of several periods meet, nest and overlap."""
    letters, words = rng.choice([1, 2, 2, 3, 5]), []
    while len(words) < n:
        if rng.random() < 0.5:
            words += [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 12))]
        else:
            base = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, rng.choice([4, 12, 40])))]
            words += base * rng.randrange(1, 8) + base[: rng.randrange(len(base) + 1)]
    return words[:n]


def test_runs_equal_a_plain_search():
    rng = random.Random(1)
    for _ in range(600):
        words = repetitive(rng, rng.randrange(260))
        assert find_runs(word_ids(words)) == plain_runs(words)
    assert find_runs(word_ids(list("ab" * 9)), least=10, times=4) == [(0, 18, 2)]
    assert strongest([(5, 30, 10), (0, 24, 8), (2, 25, 8)]) == (2, 25, 8) and strongest([]) is None
    assert kept_words(30, [(2, 26, 3)]).tolist() == [True] * 5 + [False] * 23 + [True] * 2
    with pytest.raises(ValueError, match="periods"):
        find_runs(word_ids(["a"]), times=2)


@pytest.mark.parametrize("kind", ["one word", "two words", "a fifth five times", "no repeats"])
def test_runs_of_a_million_words_end_soon(kind):
    n = 1_000_000
    words = {
        "one word": [0] * n, "two words": ([0] * 999 + [1]) * (n // 1000), "a fifth five times": list(range(n // 5)) * 5,
        "no repeats": list(range(n)),
    }[kind]
    start = time.perf_counter()
    found = find_runs(word_ids(words))
    assert time.perf_counter() - start < 30
    # Between two of the words that differ stand 999 equal ones
    want = {"one word": 1, "two words": 1001, "a fifth five times": 1, "no repeats": 0}[kind]
    assert len(found) == want


def run_rows():
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "ab " * 40, "x", "ä   b\x0bc " * 12, "a b\x1c" * 30]
    texts += [" ".join(repetitive(rng, rng.randrange(1, 200))) for _ in range(80)]
    rows = [(k, t, None, "s", 1, "c", "c", "c", "c") for k, t in enumerate(texts)]
    return [*rows, *rows[3:9], (None, "ab " * 40, None, None, None, "c", "c", "c", "c")]


def test_run_digests_equal_brute_force(spark):
    rows = run_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, run_digests(periodic_runs(plant_repeats(df))).collect()), key=str)
    want, planted = [], 0
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            planted += 1
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        text = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *shown, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(text), len(words)))
    assert planted and got == sorted(want, key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert run_digests(periodic_runs(plant_repeats(empty))).count() == 0


def form(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return sha("".join(form(row[f]) for f in FIELDS))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {}
    for lang in langs:
        part = [r for r in rows if r["lang"] == lang]
        part.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        parts[lang] = part, tree([leaf(r) for r in part])
    top = tree([parts[lang][1][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        part, levels = parts[lang]
        for i, row in enumerate(part):
            now, siblings = leaf(row), ""
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                now = leaf({**row, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])})
            for nodes, j in [(x, i // 8**n) for n, x in enumerate(levels[:-1])] + [(x, k // 8**n) for n, x in enumerate(top[:-1])]:
                run, at = nodes[j // 8 * 8 : j // 8 * 8 + 8], j % 8
                siblings += "".join(run[:at] + run[at + 1 :])
                now = sha("".join([*run[:at], now, *run[at + 1 :]]))
            root = top[-1][0]
            out.append((row["doc_id"], leaf(row), levels[-1][0], root, sha(siblings), now, now == root, i))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "block_levels"), [(1, 2), (9, 1), (300, 1), (300, 2), (300, 4)])
def test_manifest_equals_brute_force(spark, size, block_levels):
    rng = random.Random(size)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    rows = []
    for k in range(size):
        made = (
            rng.choice([None, k, k, k, k // 2, 2**60 + k]), rng.choice([None, "", "Ab é", "x" * rng.randrange(9), f"ZZ{k}"]),
            rng.choice([None, "", "en", "en", "en", f"q{k % 40}"]), rng.choice([None, "s"]), rng.choice([None, 5]), *"cccc",
        )
        rows.append(dict(zip(names, made, strict=True)))
    rows += rows[: size // 4]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = [tuple(r) for r in tampered_manifest(df, block_levels).collect()]
    same = [r[:7] for r in plain_manifest(rows)]  # rows alike may change places
    assert sorted((r[:7] for r in got), key=str) == sorted(same, key=str)
    assert sorted(r[7] for r in got) == sorted(r[7] for r in plain_manifest(rows))


def test_manifest_of_nothing(spark):
    assert tampered_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [depth_of(n) for n in (1, 2, 8, 9, 64, 65)] == [0, 1, 1, 2, 2, 3]


def test_mix_against_sql(spark):
    import duckdb

    rng = random.Random(4)
    texts = [None, "", "  \n", "one", "a b c", "é f g\x0bh", "long " * 5000]
    rows = []
    for k in range(400):
        text = rng.choice(texts[:6]) if rng.random() < 0.5 else "w " * rng.randrange(60)
        # One source holds a third of all, one a single giant, one empty texts alone
        source = rng.choice([None, "big", "big", "ä", "z", "Z", "tiny" if k < 5 else "big"])
        rows.append((rng.choice([None, k, k, k // 3]), text, None, source, 1, *"cccc"))
    rows += [(900, texts[6], None, "giant", 1, *"cccc"), (901, "", None, "blank", 1, *"cccc"), (902, None, None, "blank", 1, *"cccc")]
    rows += [rows[7]] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    con = duckdb.connect()
    table = df.select("doc_id", "text", "source").toArrow()
    con.register("documents", table)
    got = sorted(map(tuple, mix_sources(df).collect()), key=str)
    assert got == sorted(con.execute(MIX_SQL).fetchall(), key=str)
    assert got == sorted(map(tuple, mix_sources(df.repartition(2)).collect()), key=str)
    taken = {}
    for _, size, whole, target, words in got:
        assert 0 <= words <= 3 * size
        taken[whole, target] = taken.get((whole, target), 0) + words
    worded = {r[3] for r in rows if (r[1] or "").split()}
    assert len([whole for whole, _ in taken if whole]) == len(worded)  # no two sources with words are of one size
    assert all(abs(words - target) <= 60 for (_, target), words in taken.items())  # rows alike at a threshold are rounded each
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, "", None, "s", 0, *"cccc")], SCHEMA)
    assert [tuple(r) for r in mix_sources(blank).collect()] == [(1, 0, 0, 0.0, 0)]


def test_mix_meets_every_target(spark):
    rows = [(k, "w " * (1 + k % 7), None, f"s{k % 4}", 1, *"cccc") for k in range(3000)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA))
    sums = got.groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert len(sums) > 1
    for r in sums:
        assert abs(r["sum(taken)"] - r.target) <= 1
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_against_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries()[name](spark, str(SF))
    assert sorted(got.columns) == sorted(names)
    got = got.select(*names)
    assert sorted((tuple(map(plain, r)) for r in got.collect()), key=str) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_scratch_tables_can_be_cleared(spark):
    scratch = Scratch(spark, "clear")
    kept = scratch.keep(spark.range(3), "rows")
    place = Path(scratch.folder.removeprefix("file:"))
    assert kept.count() == 3 and place.exists()
    clear_scratch(spark)
    assert not place.exists()
