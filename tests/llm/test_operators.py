"""The numbered operators against plain brute force, on a fixture with nulls, ties, copies, long texts and clashing names."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import langid, licenses
from voxframe.llm.decontam import find_leaks
from voxframe.llm.langid import fit_languages, identify_languages, keep_languages
from voxframe.llm.licenses import evaluate, scan_licenses, to_postfix
from voxframe.llm.media import cosine_hash, encode_media, filtered, media_features, pad, png_decode, png_encode, unfilter
from voxframe.llm.ngramjoin import near_duplicates
from voxframe.llm.secrets import RULES, find_secrets, mask_secrets, secret_digests, trigram_query
from voxframe.llm.shared import Scratch
from voxframe.llm.suffixdedup import SuffixLevels, _entries, _row_keys, remove_repeats
from voxframe.llm.tokencount import count_tokens
from voxframe.llm.toxicity import fit_toxicity, score_toxicity
from voxframe.llm.wordbpe import bpe_digests

try:
    import public_tokenizers as tokenizer_files
except ImportError:  # the vocabularies are no part of the repository
    tokenizer_files = None
needs_tokenizers = pytest.mark.skipif(tokenizer_files is None, reason="no vocabulary files")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, component string"


def sentence(rng, n, words="red green blue house river stone cloud tree paper light door wind"):
    return " ".join(rng.choice(words.split()) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    long = sentence(rng, 9000)
    shared = sentence(rng, 60)
    texts = [
        None, "", " \n\t ", "one two three", "one two three", "One Two  THREE", "ünïcödé Straße Σίσυφος 東京 👍🏽 é",
        long, long + " tail", shared, "begin " + shared + " end", shared.upper(), "x" * 450, "ab" * 300,
        "password=hunter22 and API_KEY: 'abc.def-123' token=abc secret = zzzzzz",
        "AKIA" + "A1B2" * 5 + " AKIA123 " + "0123456789abcdef" * 2 + " deadbeef",
        "This is under the MIT License. mit license\nSPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH x",
        "GNU General Public License, apache-license; Apache License", "<|endoftext|> then <|startoftext|>it's 2nd",
    ]
    base = sentence(rng, 80).split()
    for k in range(12):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = f"other{k}"
        texts.append(" ".join(near))
    texts += [sentence(rng, rng.randrange(1, 40)) for _ in range(30)]
    return [(k, t, "aa" if k % 2 else "bb", None if k % 3 else "s", k, "clash", "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat, also their ids, and a row without an id."""
    rows = corpus()
    return spark.createDataFrame([*rows[3:8], *rows[3:8], (None, "one two three", None, None, None, "c", "c")], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_license_scan(docs, empty, odd):
    got = by_id(scan_licenses(docs))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for doc_id, text, *_ in corpus():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, v) for p, v in phrases.items() for i in range(len(words)) if words[i : i + p.count(" ") + 1] == p.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({v for _, v in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert to_postfix("(a or") is None and to_postfix("a b") is None
    assert evaluate(to_postfix("mit or gpl-3.0")) == (frozenset({"mit", "gpl"}), True)
    assert evaluate(to_postfix("mit and gpl-3.0"))[1] is False
    assert scan_licenses(empty).count() == 0 and scan_licenses(odd).count() == odd.count()


@needs_tokenizers
def test_bpe_codec_equals_the_library(docs, empty, odd):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = by_id(bpe_digests(docs, path))
    for doc_id, text, *_ in corpus():
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_digests(empty, path).count() == 0 and bpe_digests(odd, path).count() == odd.count()


@needs_tokenizers
def test_bpe_of_long_words_equals_the_library():
    from tokenizers import Tokenizer

    from voxframe.llm import wordbpe

    path = tokenizer_files.path("word_bpe_49k.json")
    library, model, rng = Tokenizer.from_file(path), wordbpe.WordBpe(path), random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(letters, k=k)) for k in (255, 256, 257, 5000, 1_000_000)]
    words += ["a" * 1001, "ab" * 500, "ing" * 300 + "x", "é" * 400, "漢字" * 300]
    words += ["".join(rng.choices(["th", "e", "an", "in", "g", "tion"], k=400)) for _ in range(10)]
    start = time.perf_counter()
    ids, at = model.encode_words(words)
    assert time.perf_counter() - start < 30
    for k, word in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(word, add_special_tokens=False).ids
    for _ in range(200):  # the same routine on words of any length
        word = "".join(rng.choices(letters[: rng.choice([2, 5, 26])], k=rng.randrange(1, 40)))
        raw = np.frombuffer(word.encode(), dtype=np.uint8)
        got = model.encode_long(np.r_[model.inner[raw[:-1]], model.final[raw[-1:]]])
        assert got.tolist() == library.encode(word, add_special_tokens=False).ids


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_ngram_join(docs, empty, odd):
    sets = {d: shingles(t) for d, t, *_ in corpus()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = by_id(near_duplicates(docs))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(s), root(d)) for d, s in sets.items()}
    assert any(r.component_id != d for d, r in got.items())
    assert near_duplicates(empty).count() == 0
    twice = near_duplicates(odd).collect()
    assert len(twice) == odd.count()
    assert {r.component_id for r in twice if r.doc_id in (3, 4, 5)} == {3}
    assert [r.component_id for r in twice if r.doc_id is None] == [None]


def test_ngram_join_rows_of_one_id_are_one_document(spark):
    rng = random.Random(4)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    near = " ".join(["other", *c.split()[1:]])
    rows = [(3, b), (7, a), (7, b), (9, c), (8, near), (8, d), (5, d), (1, sentence(rng, 30)), (9, c), (2, None), (2, a)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(texts).collect()}
    # An empty text is linked with nothing, also where its id has another text that is
    assert got == {(3, 2), (7, 2), (9, 5), (8, 5), (5, 5), (1, 1), (2, 2)}
    assert near_duplicates(texts).count() == len(rows)
    plain = {(r.doc_id, r.n_shingles) for r in near_duplicates(texts).collect()}
    assert plain == {(i, len(shingles(t))) for i, t in rows}


# Few bits of the ordering hash: nearly all beginnings collide, and the bytes must still decide
@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"wide": 1}, {"hash_bits": 3}])
def test_suffix_dedup(docs, empty, odd, options):
    count = Counter()
    data = {d: (t or "").encode() for d, t, *_ in corpus()}
    for text in data.values():
        count.update(text[i : i + 200] for i in range(len(text) - 199))
    got = by_id(remove_repeats(docs, **options))
    touched = 0
    for doc_id, text in data.items():
        gone = np.zeros(len(text) + 2, dtype=int)
        for i in range(len(text) - 199):
            if count[text[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = 1
        kept = bytes(b for b, g in zip(text, gone[1:], strict=False) if not g)
        want = (len(text), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        touched += want[1] > 0
    assert touched > 5
    if not options:
        assert remove_repeats(empty).count() == 0
        assert {r.n_removed for r in remove_repeats(odd).where("doc_id = 7").collect()} == {len(data[7])}


def test_suffix_levels_merge_when_equal(spark, docs):
    entries = _entries(docs.where("length(text) > 200").select(*_row_keys(F.col("text")), "text"), 200, 6, 64).cache()
    levels, weights = SuffixLevels(Scratch(spark, "levels")), []
    for k in range(6):
        levels.add(entries.where(F.col("batch") == k))
        weights.append([w for w, _ in levels.levels])
    assert weights == [[1], [2], [2, 1], [4], [4, 1], [4, 2]] and levels.merged == 4
    kept = [spark.table(name) for _, name in levels.levels]
    assert sum(t.agg(F.sum("n")).first()[0] for t in kept) == entries.count()
    plan = levels._scan(levels.levels[1][1])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan  # a scan shuffles nothing
    levels.clear()


def test_media_round_trip(docs, empty, odd):
    got = by_id(media_features(encode_media(docs)))
    for doc_id, text, *_ in corpus():
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        media = png_encode(pad(data))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    rng = np.random.RandomState(1)
    for step, kinds in ((1, (0,)), (1, (1,)), (1, (2,)), (1, (3,)), (3, (4,)), (2, (0, 1, 2)), (3, (0, 1, 2, 3, 4)), (4, (3, 4))):
        image = np.cumsum(rng.randint(-9, 9, (23, 24 * step)), axis=1).astype(np.uint8)
        raw = filtered(image, kinds, step)
        assert set(raw[:, 0]) <= set(kinds) and (unfilter(raw[:, 1:], raw[:, 0], step) == image).all()
    plain = png_decode(png_encode(pad(b"several rows of text " * 99), kinds=(0,)))
    assert all((png_decode(png_encode(pad(b"several rows of text " * 99), kinds=k)) == plain).all() for k in ((1, 2), (3, 4)))
    with pytest.raises(ValueError):
        unfilter(plain, np.full(len(plain), 5), 1)
    for image in (plain, rng.randint(0, 256, (70, 96)).astype(np.uint8)):  # the hash by a direct transform
        h, w = image.shape
        cut = lambda n, k: slice(k * n // 32, max((k + 1) * n // 32, k * n // 32 + 1))
        small = [[image[cut(h, y), cut(w, x)].astype(float).mean(axis=0).mean() for x in range(32)] for y in range(32)]
        wave = lambda k, n: np.cos(np.pi * k * (2 * n + 1) / 64)
        low = [sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
        low = np.round(low, 6)
        assert cosine_hash(image) == np.packbits(low > np.median(low[1:])).tobytes()
    media = bytearray(png_encode(pad(b"some text")))
    media[45] ^= 1
    with pytest.raises(ValueError):
        png_decode(bytes(media))
    assert media_features(encode_media(empty)).count() == 0
    assert media_features(encode_media(odd)).count() == odd.count()


@needs_tokenizers
@pytest.mark.parametrize("options", [{}, {"huge": 300, "chunk": 200, "overlap": 8}])
def test_token_counts_equal_the_library(docs, empty, odd, options):
    from tokenizers import Tokenizer

    path = tokenizer_files.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_id(count_tokens(docs, path, **options))
    for doc_id, text, *_ in corpus():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = got[doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 1024)
    assert count_tokens(empty, path).count() == 0 and count_tokens(odd, path).count() == odd.count()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity_on_held_out_texts(spark, empty, docs):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = sentence(rng, 25).split()
        if toxic:
            for _ in range(6):
                words[rng.randrange(25)] = rng.choice(["vile", "scum", "idiot"])
        rows.append((k, " ".join(words), None, None, None, "c", "c"))
        labels.append((k, 1, int(toxic)))
    texts = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(texts, known)
    got = score_toxicity(texts, model).collect()
    judged = [(r.predicted, labels[r.doc_id][2]) for r in got if held(r.doc_id)]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(p == t for p, t in judged) >= 0.97 * len(judged)
    assert score_toxicity(empty, model).count() == 0
    assert score_toxicity(docs, model).count() == docs.count()
    # Both models sum to one for every word before, words that are left out counting as one
    kn = model.language
    vocabulary = np.r_[kn.word, np.uint64(1)]
    for before in [*kn.history[:: max(len(kn.history) // 20, 1)], np.uint64(2)]:
        for k in (0, 1):
            p = kn.probability(k, np.full(len(vocabulary), before), vocabulary)
            assert (p > 0).all() and abs(p.sum() - 1) < 1e-9
    again = texts.unionAll(texts).unionAll(spark.createDataFrame([(None, "vile", *[None] * 5)], SCHEMA))
    twice = fit_toxicity(again, known.unionAll(known.limit(5)).unionAll(spark.createDataFrame([(None, 1, 1)], known.schema)))
    assert (twice.slope, twice.offset) == (model.slope, model.offset)
    bare = fit_toxicity(texts, known.where("toxic = 0"))
    assert {r.score for r in score_toxicity(docs, bare).collect()} == {0.5}


def test_language_on_held_out_texts(spark, empty, docs):
    rng = random.Random(3)
    words = {"aa": "kano miru sato hani", "bb": "strum blend crisp thrift", "cc": "ouvel ienne aimer oiseau"}
    rows = []
    for k in range(300):
        lang = rng.choice(sorted(words))
        rows.append((k, " ".join(rng.choice(words[lang].split()) for _ in range(15)), lang, None, None, "c", "c"))
    rows += [(300, None, "aa", None, None, "c", "c"), (301, "12 34 !", None, None, None, "c", "c")]
    texts = spark.createDataFrame(rows, SCHEMA)
    model = fit_languages(texts)
    got = by_id(identify_languages(texts, model))
    assert all(got[k].lang_pred == rows[k][2] for k in range(300) if held(k))
    assert got[300].lang_pred == got[301].lang_pred == "und"
    assert all(r.held_out == held(k) and 0 <= r.score <= 1 for k, r in got.items())
    assert identify_languages(empty, model).count() == 0
    assert {r.lang_pred for r in identify_languages(docs, fit_languages(empty)).collect()} == {"und"}
    kept = keep_languages(texts, model)
    assert kept.columns == texts.columns and {r.doc_id for r in kept.collect()} == set(range(300))


def test_languages_that_were_not_learned_are_rejected_at_any_length(spark):
    rng = random.Random(8)
    english = "the house of my father stands at the river where we went every summer with all our friends and children".split()
    german = "das haus meines vaters steht an dem fluss wohin wir jeden sommer mit allen unseren freunden und kindern gingen".split()

    def prose(words, n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows = [(k, prose((english, german)[k % 2], rng.choice([3, 30, 300])), ("en", "de")[k % 2]) for k in range(300)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = {k: prose((english, german)[k % 2], n) for k, n in enumerate([1, 2, 5, 20, 100, 1000] * 4)}
    letters = "abcdefghijklmnopqrstuvwxyz"
    foreign = [
        "".join(rng.choices(letters + "    ", k=900)), "".join(rng.choices(letters + letters.upper() + "0123456789+/", k=900)),
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 6,
        "Все люди рождаются свободными и равными в своем достоинстве и правах " * 6, "if (a[i] == b[i]) { return NULL; } x++; " * 20,
    ]
    texts = [*clean.items(), *((100 + k, t) for k, t in enumerate(foreign)), (200, None), (201, ""), (202, "12 34")]
    kept = {r.doc_id for r in keep_languages(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert kept == set(clean)


def test_language_profiles_equal_plain_sums_and_stay_small(monkeypatch):
    import tracemalloc

    rng = random.Random(7)
    letters = langid.letter_vectors().astype(int)
    texts = ["Ab c", "", "12", "  éa--Bc  ", "漢字かな", "".join(rng.choice("abc de1漢") for _ in range(500))]

    def plain(text):
        codes = [int(langid.letter_codes()[ord(c)]) for c in f" {text} "]
        codes = [c for k, c in enumerate(codes) if k == 0 or c or codes[k - 1]]
        total = np.zeros(langid.DIMENSIONS, dtype=int)
        for k in range(len(codes) - 2):
            total += np.roll(letters[codes[k]], 2) * np.roll(letters[codes[k + 1]], 1) * letters[codes[k + 2]]
        return total, max(len(codes) - 2, 0)

    for piece, kinds in ((1 << 20, 1 << 13), (7, 3)):
        monkeypatch.setattr(langid, "_PIECE", piece)
        monkeypatch.setattr(langid, "_KINDS", kinds)
        made = langid.Profiles(texts, langid.letter_vectors())
        for k, text in enumerate(texts):
            total, n = plain(text)
            assert (made.bundles[k] == total).all() and made.n_grams[k] == n
        assert made.letters.tolist() == [any(c.isalpha() for c in t) for t in texts]
    monkeypatch.undo()
    long = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200_000)) * 60  # 36 MB of many kinds
    tracemalloc.start()
    langid.Profiles([long], langid.letter_vectors())
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_license_tags_on_one_line_take_linear_time():
    kernel = licenses._kernel()
    start = time.perf_counter()
    made = kernel(["license-expression: mit or so it seems " * 40_000, "spdx-license-identifier: mit\nor apache"])
    assert made["n_tags"] == [40_000, 1] and made["labels"] == ["mit", "mit"] and made["expression"] == [None, "mit"]
    assert time.perf_counter() - start < 10


def test_decontamination_finds_other_numbers_and_spares_clean_texts(spark, empty):
    items = [
        (1, "A train leaves the station at 40 km per hour and Anna waits 15 minutes before she follows it on foot."),
        (2, "Which of the following gases makes up most of the air that we breathe near the ground every single day?"),
        (3, "short one"),
        (None, "no id at all here but words enough to make a window or two of it"),
        (4, None),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "Intro. " + items[0][1] + " Outro."),
        (2, "So: a train leaves the station at 75 km per hour and Boris waits 20 minutes before she follows it on foot!"),
        (3, "A completely different text about stations and trains, and about people who wait before they follow."),
        (4, items[1][1].upper()),
        (5, None),
        (6, ""),
        (None, items[0][1]),
    ]
    texts = spark.createDataFrame([(d, t, None, None, None, "c", "c") for d, t in rows], SCHEMA)
    found = {(r.doc_id, r.item_id): r.exact for r in find_leaks(texts, benchmark).collect()}
    assert found.get((1, 1)) is True and found.get((2, 1)) is False
    assert {d for d, _ in found} <= {1, 2, 4}
    assert find_leaks(empty, benchmark).count() == 0
    assert find_leaks(texts, benchmark.limit(0)).count() == 0


def leaks(spark, items, texts):
    """The pairs of positions (text, item) that are found."""
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(d, t, None, None, None, "c", "c") for d, t in enumerate(texts)]
    return {(r.doc_id, r.item_id): r for r in find_leaks(spark.createDataFrame(rows, SCHEMA), benchmark).collect()}


def test_decontamination_finds_verbatim_items_of_any_kind(spark):
    items = [
        "Add 17 and 25 and 31 then 12 less 4 and 9 times 3 over 8",
        "The Great Wall Of China Was Built By Emperor Qin Shi Huang In Xian",
        "WHICH PLANET IS THE LARGEST ONE OF OUR SOLAR SYSTEM AND HOW MANY MOONS HAS IT",
        "Name two primes",
        "What is the capital of France",
        "Über den Wolken muß die Freiheit wohl ÄRGER und Öde größer sein als hier",
        "?!",
    ]
    texts = [f"some text - {t} - and more of it" for t in items]
    texts += ["some words, and that is what the capital of Spain says about the name of primes", items[5].upper().replace("SS", "ß")]
    texts += ["SE!! CIONCIEZ!! " + items[4].upper() + " WORDS AND MORE OF THEM", "the largest planet and its moons"]
    found = leaks(spark, items, texts)
    assert set(found) == {*((k, k) for k in range(6)), (8, 5), (9, 4)}
    assert all(r.exact for r in found.values())
    assert all(r.n_windows == r.n_item_windows for r in found.values())


def test_decontamination_judges_each_slot_alone(spark):
    long = "then the old clerk of the town hall wrote down what Anna had told him about the house by the river and left. "
    items = [
        "so the farmer sells 3 baskets of red apples and then 5 bags of ripe pears to the old miller",
        "now the baker fills 2 trays with warm rolls and puts 2 cakes on the upper shelf of the oven",
        "the case: " + long + "in the evening Anna came back with her friend and asked the clerk for the paper that he wrote",
        "when the tired Boris meets the angry Clara near the bridge he greets the angry Clara and shakes her hand",
    ]
    texts = [
        items[0].replace("3", "4").replace("5", "4"),
        items[1].replace("2", "3", 1).replace("2 cakes", "7 cakes"),
        items[2].replace("Anna came", "Berta came"),
        items[3].replace("Boris", "David").replace("Clara", "David"),
        items[3].replace("Boris", "David").replace("Clara", "Elsa"),
    ]
    found = leaks(spark, items, texts)
    assert {(0, 0), (1, 1), (2, 2), (4, 3)} <= set(found) <= {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)}
    # All windows where numbers coincide; all but the eight around the other name; fewer where two names became one
    assert all(found[k, k].n_windows == found[k, k].n_item_windows for k in (0, 1))
    assert found[2, 2].n_windows == found[2, 2].n_item_windows - 8
    assert found[4, 3].n_windows > (found[3, 3].n_windows if (3, 3) in found else 0)


def base_secrets(text):
    kinds = (
        (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 1, 6),
        (r"AKIA[A-Z0-9]+", 0, 0, 20),
        (r"[0-9a-f]+", 0, 0, 24),
    )
    out = []
    for kind, (pattern, flags, group, least) in enumerate(kinds):
        # Letters in either case are ASCII only
        found = re.compile(pattern, flags | re.A).finditer(text)
        out += [(m.start(), kind, m.end()) for m in found if len(m[group]) >= least]
    return sorted(out)


def test_secret_scan(docs, empty, odd):
    got = by_id(secret_digests(docs))
    names = [r[0] for r in RULES]
    for doc_id, text, *_ in corpus():
        want = base_secrets(text or "")
        listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        r = got[doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert secret_digests(empty).count() == 0 and secret_digests(odd).count() == odd.count()
    assert trigram_query(RULES[2][1]) is True and trigram_query(RULES[1][1]) is not True
    masked = by_id(mask_secrets(docs))
    assert "hunter22" not in masked[14].text and masked[14].text.count("[secret]") == 3
    assert masked[7].text == corpus()[7][1] and masked[0].text is None
    assert {"_text", "component"} <= set(mask_secrets(docs).columns)
    clash = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("_secret_key", "_secret_rules", "_secret_spans", "_SECRET_KEY_")])
    same = mask_secrets(clash)
    assert same.columns == clash.columns and {tuple(r)[2:] for r in same.collect()} == {(7, 7, 7, 7)}
    assert find_secrets(docs, block_rows=4).where(F.size("_secret_spans") > 0).count() >= 2


def masked_plainly(text, spans):
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out.append(text[at:start] + "[secret]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_secret_scan_of_hostile_texts_takes_linear_time(spark):
    n = 1_000_000
    hostile = [
        "eyJ" * (n // 3) + " .eyJ", "eyJabcdefghijk." * (n // 15), "token=" * (n // 6), "tokén = abcdef " * (n // 15), "AKIA" * (n // 4),
        ("AKIA" + "A1" * 9 + " é") * (n // 24), "0123456789abcdef0123456 " * (n // 24), "token=0123456789abcdef012345678 " * (n // 32),
        "ghp_" * (n // 4), "AIza" * (n // 4), "xoxb-" * (n // 5), "rk_live_" * (n // 8), "-----BEGIN PRIVATE KEY----- " * (n // 28), "password" + " " * n,
    ]
    df = spark.createDataFrame(list(enumerate(hostile)), "doc_id long, text string").repartition(4)
    start = time.perf_counter()
    spans = {r.doc_id: r._secret_spans for r in find_secrets(df).collect()}
    masked = {r.doc_id: r.text for r in mask_secrets(df).collect()}
    assert time.perf_counter() - start < 120
    assert sum(map(len, spans.values())) > 100_000
    for k, text in enumerate(hostile):
        assert masked[k] == masked_plainly(text, spans[k])
        for kind, pattern, group, least in RULES:
            number = [r[0] for r in RULES].index(kind)
            want = [(m.start(), m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
            assert [(s.start, s.end) for s in spans[k] if s.kind == number] == want


def test_decontamination_finds_changed_items_and_spares_the_rest(spark):
    """Recall on items as they are, in other letters, renumbered and without punctuation; none of the clean texts."""
    rng = random.Random(12)
    nouns = "farmer teacher river market bridge garden window sailor village engine winter basket ladder letter island".split()
    verbs = "carries sells measures counts leaves follows paints repairs crosses remembers".split()

    def sentence():
        return f"The {rng.choice(nouns)} {rng.choice(verbs)} {rng.randrange(2, 90)} {rng.choice(nouns)}s and the {rng.choice(nouns)} {rng.choice(verbs)} a {rng.choice(nouns)}"

    items = [f"{sentence()}, while {sentence()[0].lower()}{sentence()[1:]}. How many {rng.choice(nouns)}s are left?" for _ in range(60)]
    clean = [". ".join(sentence() for _ in range(4)) + "." for _ in range(200)]

    def renumbered(text):
        return re.sub(r"\d+", lambda m: str(int(m[0]) + 7), text)

    kinds = {"as is": str, "lower": str.lower, "upper": str.upper, "renumbered": renumbered, "bare": lambda t: re.sub(r"[^\w\s]", "", t)}
    rows, want = [], {}
    for kind, change in kinds.items():
        for k, item in enumerate(items):
            want.setdefault(kind, set()).add((len(rows), k))
            rows.append((len(rows), f"{rng.choice(clean)} {change(item)} {rng.choice(clean)}"))
    first = len(rows)
    rows += [(first + k, t) for k, t in enumerate(clean)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    for kind, pairs in want.items():
        assert len(pairs & got) >= 0.9 * len(pairs), kind
    assert not {d for d, _ in got if d >= first}
