"""Queries whose cost per text must stay small: plans that repeat no work, and results against plain Python."""

from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_detect_language_reads_a_text_once(spark):
    from voxframe.functions import text

    texts = [
        "", " ", "the", "the ", "The the bathe  the the", " is is is is ", "is  is   is is", " que  que que una  una ", "is", " is",
        "x\nis the\n is y", " не не  не що що ", "Її її є ґ", "今天 the ひら 한 ال", "o que é uma das dos não ", " niet  niet niet zijn het ", "  się  się się że jak ",
    ]
    scripts = {"uk": (0x400, 0x4FF, 1), "ru": (0x400, 0x4FF, 1), "zh": (0x4E00, 0x9FFF, 5), "ja": (0x3040, 0x30FF, 5), "ko": (0xAC00, 0xD7AF, 5), "ar": (0x600, 0x6FF, 5)}

    def plain(t):
        low, best = t.lower(), ("en", 0)
        for lang in {**text.MARKERS, **scripts}:
            n = sum(low.count(w) for w in text.MARKERS.get(lang, ()))
            first, last, each = scripts.get(lang, (1, 0, 0))
            n += each * sum(first <= ord(c) <= last for c in t)
            n += 10 * sum(c in low for c in "іїєґ") if lang == "uk" else 0
            best = (lang, n) if n > best[1] else best
        return best[0]

    df = spark.createDataFrame(list(enumerate([*texts, None])), "k int, text string").select("k", text.detect_language(F.col("text")).alias("lang"))
    assert {r.k: r.lang for r in df.collect()} == dict(enumerate([*map(plain, texts), "en"]))
    assert plan_of(df).count("lower(") <= 6  # each further one lowers the whole text again


def test_rule_trace_works_each_step_out_once(spark):
    from voxframe import catalog

    plan = plan_of(catalog.QUERIES["rule_trace"](spark, "/root/testdata/sf0.001"))
    assert plan.count("^[ \\t]+|[ \\t]+$") == 1


def test_text_steps_that_read_less_give_the_same(spark):
    from voxframe.functions.text import _under, reject_wrong_script
    from voxframe.operators import textrules as tr

    assert tr.to_java(r"\b(?:uh+|um)\b", "i") == r"(?Ui)(?=[u])\b(?:uh+|um)\b"
    for pattern in (r"\ba?b", r"\b(?:a*|b)c", r"\b\d+", r"\b(?:a|)b", r"\b(?:ab)?c", r"a\b"):
        assert tr.to_java(pattern) == "(?U)" + pattern
    texts = ["", " ", "\t", "a\tb", "a \t b", "  a  ", "a\n", " \n ", "a \n\n  b\n c", "the the THE they", "thethe the", "a a-a a", "İ i", "ſo so So", "one two", " one  two three\n", "x" * 5000, "це не the", "҂҂҂ abc", "҂ це", "12"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    t = F.col("text")
    before = [(r"[ \t]+", " ", "", tr.SPACING[0]), (r" *\n *", "\n", "", tr.SPACING[2]), (r"\b(\w+)(?:\s+\1\b)+", "$1", "i", tr.REPEATED_WORDS[0]), (r"\bso\b", "x", "i", tr.Rule(r"\bso\b", "x"))]
    for pattern, made, flags, rule in before:
        rows = df.select(F.regexp_replace(t, f"(?U{flags}){pattern}", made).alias("a"), tr.rewritten(t, F.lit("en"), [rule]).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
    for n in (0, 1, 3):
        words = F.size(F.filter(F.split(t, "(?U)\\s+"), lambda w: w != "")) < n
        assert df.where(words != _under(t, n)).count() == 0
    letters = F.regexp_replace(t, "[^\\p{L}]", "")
    share = F.length(F.regexp_replace(letters, "[^\\u0400-\\u04FF]", "")) / F.nullif(F.length(letters), F.lit(0))
    for lang, wrong in (("en", share > 0.5), ("uk", share < 0.2)):
        want = F.when(F.coalesce(wrong, F.lit(False)), "").otherwise(t)
        assert df.where(want != reject_wrong_script(t, F.lit(lang))).count() == 0


def _tables(spark):
    """Tokens of some media, with marks, blanks, punctuation and rows without text."""
    import random

    rng = random.Random(3)
    parts = ["▁the", "▁The", "a", "b.", "?", ",", "'", "-", " ", "▁", "", "▁ ", " x", "\n", ",\n", "..", None, "▁é", "Σ"]
    rows = [(m, p, rng.choice(parts), None if rng.random() < 0.1 else p + 0.0, p + 0.5) for m in range(40) for p in range(rng.choice([1, 2, 7, 30]))]
    return spark.createDataFrame(rows, "media_id long, pos int, text string, start double, end double"), rows


def _both_ways(spark, make, df, order):
    """What an operator gives over rows dealt anew and over rows that stand in order, in batches of three rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        dealt = sorted(map(tuple, make(df.repartition(3), False).collect()), key=str)
        placed = make(df.coalesce(1).sortWithinPartitions("media_id", order), True)
        assert dealt == sorted(map(tuple, placed.collect()), key=str)
        return dealt
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ctc_spans_hold_no_medium(spark):
    import random

    from voxframe import catalog
    from voxframe.operators import sequence

    rng = random.Random(4)
    rows = [(m, f, rng.choice([0, 0, 1, 1, 2])) for m in range(60) for f in range(rng.choice([1, 2, 3, 5, 40]))]
    df = spark.createDataFrame(rows, "media_id long, frame int, id int")
    want = []
    for m in range(60):
        ids = [r[2] for r in rows if r[0] == m]
        heads = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
        speaks = [k for k in heads if ids[k]]
        for k in speaks:
            after = [h for h in heads if h > k][:1]
            end = len(ids) if k == speaks[-1] else after[0] if ids[after[0]] else k
            want.append((m, k, ids[k], k * 0.01, end * 0.01))
    assert _both_ways(spark, lambda x, p: sequence.ctc_spans(x, 0, placed=p), df, "frame") == sorted(want, key=str)
    plan = catalog.QUERIES["ctc_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_words_in_lists_are_those_of_rows(spark):
    from voxframe import catalog
    from voxframe.operators import sequence

    tokens, rows = _tables(spark)
    lists = [(m, [r[2:] for r in rows if r[0] == m]) for m in sorted({r[0] for r in rows})]
    lists = spark.createDataFrame([*lists, (98, []), (99, None)], "media_id long, rows array<struct<text string, start double, end double>>")

    def listed(df):
        return sorted(map(tuple, df.selectExpr("media_id", "inline(rows)").collect()), key=str)

    words = _both_ways(spark, lambda x, p: sequence.words_from_tokens(x, placed=p), tokens, "pos")
    assert words[:1] and listed(sequence.words_in_lists(lists)) == words
    frame = spark.createDataFrame(words, "media_id long, word_no long, text string, start double, end double")
    once = _both_ways(spark, lambda x, p: sequence.drop_repeated(x, placed=p), frame, "word_no")
    assert len(once) < len(words) and listed(sequence.repeats_in_lists(sequence.words_in_lists(lists))) == once
    sentences = _both_ways(spark, lambda x, p: sequence.sentences_from_words(x, placed=p), frame, "word_no")
    assert listed(sequence.sentences_in_lists(sequence.words_in_lists(lists))) == sentences
    for name in ("word_group", "repeated_words_dropped", "sentence_group"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan


def test_contractions_are_tried_on_texts_that_have_them(spark):
    from dataclasses import replace

    from voxframe.operators import textrules as tr

    texts = ["in dem Haus", "IN DEM", "In\ndem", "zu der, zu das", "Bei  dem indem", "de el Perro", "a el perro DE EL", "em o em  A", "di il su LO", "por aquilo", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for lang, rules in (("de", tr.GERMAN), ("it", tr.ITALIAN), ("pt", tr.PORTUGUESE), ("es", tr.SPANISH)):
        assert all(r.guard for r in rules if r.family.startswith("contractions"))
        bare = [replace(r, guard=None) if r.family.startswith("contractions") else r for r in rules]
        rows = df.select(tr.rewritten(F.col("text"), F.lit(lang), rules).alias("a"), tr.rewritten(F.col("text"), F.lit(lang), bare).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_long_runs_in_a_text_need_no_stack(spark):
    from voxframe.functions.text import _under
    from voxframe.operators import textrules as tr

    smiles = "Die " + "\U0001d552a" * 20_000
    cases = {"Anfang " + "und " * 20_000 + "Ende.": ("de", "Anfang und Ende."), "x" + " Der DER\n" * 9000: ("de", "x Der"), "que A" + smiles[4:]: ("fr", "qu'a" + smiles[4:])}
    df = spark.createDataFrame([(t, lang) for t, (lang, _) in cases.items()], "text string, lang string")
    rules = [*tr.REPEATED_WORDS, *tr.ELISION_FR]
    got = {r.text: r.made.strip() for r in df.select("text", tr.rewritten(F.col("text"), F.col("lang"), rules).alias("made")).collect()}
    assert got == {t: want for t, (_, want) in cases.items()}
    assert [r.text.rstrip("\n") for r in tr.TextChain().apply(df).where("lang = 'de'").orderBy("text").collect()] == ["Anfang und Ende.", "x der"]
    assert df.where(_under(F.col("text"), 15_000)).count() == 1


def test_strings_looked_for_first_change_nothing(spark):
    from dataclasses import replace

    from voxframe import catalog
    from voxframe.functions.text import capitalise
    from voxframe.operators import textrules as tr

    texts = [
        "the THE tHe", "lİnux LINUX lınux Linux", "full ſtop. NEW LİNE new line", "trois poınt deux", "IN DEM in dem In dem", "A el De el DE EL a el", "A a o De a o DE A o",
        "que Elle ; « a » : \"b\"... !", "a  b \t c\n d \n\n\n\n ,e .f", "[a] (b) *c* [", "σας ΣΑΣ", " \t\n", "a \n", "x\n\r", "x  ", "\x03a\x1fb", "це the", "", None,
    ]
    df = spark.createDataFrame([(t, lang) for t in texts for lang in ("en", "fr", "de", "es", "it", "pt")], "text string, lang string")
    entries = [*tr.cased_variants("linux", "the"), *tr.cased_variants("the", "die"), *tr.cased_variants("σας", "x")]
    rules = [*tr.FIRST_RULES, *tr.LANGUAGE_PACKS, *tr.TYPOGRAPHY_FR, *tr.VERSIONS, *entries]
    assert sum(bool(r.holds or r.says) for r in rules) > 60
    for some in (tr.FIRST_RULES, tr.LANGUAGE_PACKS, [*tr.TYPOGRAPHY_FR, *tr.VERSIONS], entries):
        bare = [replace(r, holds=(), says=(), guard=None) for r in some]
        rows = df.select(tr.rewritten(F.col("text"), F.col("lang"), some).alias("a"), tr.rewritten(F.col("text"), F.col("lang"), bare).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]
    ends = df.select(tr._trimmed(F.col("text")).alias("a"), F.regexp_replace("text", "^[ \\t]+|[ \\t]+$", "").alias("b"), tr._without_newline(F.col("text")).alias("c"), F.regexp_replace("text", "\\n$", "").alias("d")).collect()
    assert [(r.a, r.c) for r in ends] == [(r.b, r.d) for r in ends]
    assert df.where("text IS NULL").select(capitalise(F.col("text")).alias("t")).where("t IS NOT NULL").count() == 0
    plan = plan_of(catalog.QUERIES["text_chain"](spark, "/root/testdata/sf0.001"))
    assert plan.count("^[ \\t]+|[ \\t]+$") == 1 and plan.lower().count("contains(") > 60


def test_many_dictionary_words(spark):
    from voxframe.operators import textrules as tr

    chain = tr.TextChain(dictionary={"*": {f"w{k}x": f"Y{k}" for k in range(50)}})
    df = spark.createDataFrame([("some w7x and W49X here.", "en")], "text string, lang string")
    assert chain.apply(df).first().text == "Some Y7 and Y49 here."
    assert chain.trace(df).first().trace[-1].after == "Some Y7 and Y49 here."
