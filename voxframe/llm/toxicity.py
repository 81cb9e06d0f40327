"""Toxicity: two class-conditional Kneser-Ney word models that share their backoff counts.

Each class has probabilities of a word given the one before, p(w|h), with absolute discounts: what a pair's count keeps
after the discount is the class's own, and the rest of h's mass goes to the class's p(w).  That one counts distinct words
before w, as Kneser-Ney does, and gives its discounted mass to a distribution that both classes share.  So each model
sums to one over the vocabulary for every h.

How much of a count is discounted is judged by texts, which are independent of each other as the words of one text are
not: of the texts with an expression those go that the shared counts explain (the class's share, or what the backoff expects
if that is more), ERRORS standard errors of that, and DISCOUNT.  An expression too rare to say anything is thus left to the
shared backoff in both models.  With the constant alone, chance differences of rare words drown the rest.
A text's evidence is the difference of its two log-likelihoods by word; a logistic curve fitted on texts that the models
have not seen turns it into a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import IN_LETTER_WORD, Words, mix
from .rows import map_texts, slices
from .shared import Scratch

#: Labelled texts that the models are fitted on, at most: those with the smallest hash of their id, in their natural shares.
TEXT_BOUND = 12_000
#: Words and pairs of fewer texts of both classes together are left to the backoff.
LEAST = 3
#: The constant discount, and the standard errors of what the shared counts explain that it grows by.
DISCOUNT, ERRORS = 0.75, 3.0
THRESHOLD = 0.7
FIELDS = "n_words long, llr double, score double"
_START, _ANY = np.uint64(0x5851F42D4C957F2D), 0
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: the word before it (a mark at a text's start), and the hash of both."""
    before = np.r_[_START, words.hashes[:-1]]
    first = words.first[:-1][np.diff(words.first) > 0]
    before[first] = _START
    return before, mix(before * _PAIR ^ words.hashes)


class KneserNey:
    """Probabilities of both classes (0: ordinary, 1: toxic).

    texts: the number of each class; word, with_word: hashes and the texts with each; after: for each class the distinct
    words before each; total: their sums over all words, also those left out here.  before, follow, pairs: pairs and the
    texts with them by class; history, of_history: words before and the same counts by class, of all pairs.
    """

    def __init__(self, texts, word, with_word, after, total, before, follow, pairs, history, of_history):
        known = np.flatnonzero(after[0] + after[1] > 0)
        order = known[np.argsort(word[known])]
        self.word, after, with_word = word[order], [n[order] for n in after], [n[order] for n in with_word]
        kept = self._kept(with_word, [n / max(sum(texts), 1.0) for n in texts], [0.0, 0.0])
        kept = [n * k / np.maximum(w, 1.0) for n, k, w in zip(after, kept, with_word, strict=True)]
        # Both classes back off to the counts that the discounts leave, with a place for the words that no text has
        rest = sum(total) - sum(k.sum() for k in kept) + 1.0
        self.shared = (after[0] + after[1] - kept[0] - kept[1]) / rest
        self.own = [k / max(n, 1.0) for k, n in zip(kept, total, strict=True)]
        self.left = [1.0 - own.sum() for own in self.own]
        self.unknown = 1.0 - self.shared.sum()

        rank = np.argsort(history)
        self.history, of_history = history[rank], [c[rank] for c in of_history]
        key = mix(before * _PAIR ^ follow)
        order = np.argsort(key)
        self.pair, follow, pairs = key[order], follow[order], [c[order] for c in pairs]
        at = np.searchsorted(self.history, before[order])
        around = [c[at] for c in of_history]
        part = [c / np.maximum(around[0] + around[1], 1.0) for c in around]
        kept = self._kept(pairs, part, [c * self.word_probability(k, follow) for k, c in enumerate(around)])
        self.pair_own = [k / np.maximum(c, 1.0) for k, c in zip(kept, around, strict=True)]
        self.pair_left = [1.0 - np.bincount(at, weights=own, minlength=len(self.history)) for own in self.pair_own]

    @staticmethod
    def _kept(counts, part, expected) -> list[np.ndarray]:
        """What is left of both classes' counts after the discount.

        part: each class's share of all; expected: what its backoff expects.  The shared counts explain a class's share of
        what the discounts leave; what a class keeps is not shared, so that is worked out in turns.
        """
        kept = [np.zeros_like(c) for c in counts]
        for _ in range(40):
            shared = counts[0] + counts[1] - kept[0] - kept[1]
            last, kept = kept, []
            for c, p, e in zip(counts, part, expected, strict=True):
                explained = np.maximum(shared * p, e)
                kept.append(np.maximum(c - explained - DISCOUNT - ERRORS * np.sqrt(explained * (1 - p)), 0.0))
            if max((np.abs(a - b).max(initial=0.0) for a, b in zip(last, kept, strict=True)), default=0.0) < 1e-6:
                break
        return kept

    @staticmethod
    def _look(keys, values, wanted, fallback=0.0) -> np.ndarray:
        if not len(keys):
            return np.full(wanted.shape, fallback, dtype=float)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], fallback)

    def word_probability(self, k: int, word: np.ndarray) -> np.ndarray:
        """p(w) of class k; the words left out share one probability."""
        return self._look(self.word, self.own[k], word) + self.left[k] * self._look(self.word, self.shared, word, self.unknown)

    def probability(self, k: int, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """p(w|h) of class k."""
        own = self._look(self.pair, self.pair_own[k], mix(before * _PAIR ^ word))
        return own + self._look(self.history, self.pair_left[k], before, 1.0) * self.word_probability(k, word)

    def evidence(self, words: Words) -> np.ndarray:
        """The difference of each word's log-probabilities given the one before."""
        before, _ = _ngrams(words)
        return np.log(self.probability(1, before, words.hashes)) - np.log(self.probability(0, before, words.hashes))

    def means(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Words and mean evidence of each text (0 where it has no words)."""
        words = Words(texts, IN_LETTER_WORD)
        total = np.r_[0.0, np.cumsum(self.evidence(words))]
        count = np.diff(words.first)
        return count, (total[words.first[1:]] - total[words.first[:-1]]) / np.maximum(count, 1)


def _count_batches(batches):
    """(fold, toxic, word before, word, texts with the pair); before _ANY: texts with the word."""
    for batch in batches:
        for start, stop in slices(batch.column(0)):
            part = batch.slice(start, stop - start)
            words = Words(part.column(0).to_pylist(), IN_LETTER_WORD)
            before, _ = _ngrams(words)
            group = part.column(1).to_numpy(zero_copy_only=False) * 2 + part.column(2).to_numpy(zero_copy_only=False)
            owner = words.owner()
            seen = {"owner": owner, "group": group[owner], "before": before.view(np.int64), "word": words.hashes.view(np.int64)}
            once = pd.DataFrame(seen).drop_duplicates()
            words_once = once.drop_duplicates(["owner", "word"]).assign(before=_ANY)
            once = pd.concat([once, words_once]).groupby(["group", "before", "word"]).size().reset_index(name="n")
            columns = [once["group"] // 2, once["group"] % 2, once["before"], once["word"], once["n"]]
            types = [pa.int32()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(c).astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)],
                names=["fold", "toxic", "before", "word", "n"],
            )


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) by Newton steps; both classes weigh the same, and a small penalty bounds the slope."""
    n1 = max(y.sum(), 1.0)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / max(len(y) - y.sum(), 1.0)) * len(y)
    design, beta = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - np.array([1e-3, 0]) * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


class ToxicityModel:
    """The two models and the curve.  Without texts of both classes every score is 0.5 (predicted 0)."""

    def __init__(self, language: KneserNey | None, slope: float = 0.0, offset: float = 0.0):
        self.language, self.slope, self.offset = language, slope, offset

    def score(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.language is None:
            zero = np.zeros(len(texts))
            return np.diff(Words(texts, IN_LETTER_WORD).first), zero, zero + 0.5
        count, llr = self.language.means(texts)
        return count, llr, 1 / (1 + np.exp(-np.clip(self.slope * llr + self.offset, -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text has remainder 1 by 3; a null id is not held out, and not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: The models that are fitted, by the folds that they see: one to judge each fold's texts without them, and the one that is used.
FOLDS = 4
_MODELS = (*(tuple(f for f in range(FOLDS) if f != out) for out in range(FOLDS)), tuple(range(FOLDS)))


def fit_toxicity(documents: DataFrame, labels: DataFrame, text_bound: int = TEXT_BOUND, least: int = LEAST) -> ToxicityModel:
    """Fit on at most ``text_bound`` labelled texts that are not held out.

    Rows without id, text or label are not learned from; an id labelled twice counts as toxic if either label says so, and of
    the texts of one id that with the least hash counts.  The sample, and with it all that comes to the driver, is bounded
    by the parameter.
    """
    scratch = Scratch(documents.sparkSession, "toxicity")
    pick = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out("id"))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("turn", F.xxhash64(F.col("id").cast("string")))
        .orderBy("turn", "id")
        .limit(text_bound)
    )
    texts = (
        documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
        .where("text IS NOT NULL")
        .join(F.broadcast(pick), "id")  # at most text_bound ids
        .groupBy("id", "toxic", F.pmod("turn", F.lit(FOLDS)).cast("int").alias("fold"))
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    )
    texts = scratch.keep(texts.select("text", "fold", "toxic"), "texts")
    counted = texts.mapInArrow(_count_batches, "fold int, toxic int, before long, word long, n long")
    cell = [(f, t) for f in range(FOLDS) for t in (0, 1)]
    by_class = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"c{f}{t}") for f, t in cell]
    pairs = scratch.keep(counted.groupBy("before", "word").agg(*by_class), "pairs")

    def seen(folds: tuple[int, ...], toxic: int):
        return F.count_if(F.expr(f"before <> {_ANY} AND " + " + ".join(f"c{f}{toxic}" for f in folds) + " > 0"))

    # Distinct words before each word, by model and class, and the texts with it
    after = [seen(folds, k).alias(f"a{m}{k}") for m, folds in enumerate(_MODELS) for k in (0, 1)]
    after += [F.sum(F.when(F.col("before") == _ANY, F.col(f"c{f}{t}")).otherwise(0)).alias(f"c{f}{t}") for f, t in cell]
    words = scratch.keep(pairs.groupBy("word").agg(*after), "words")
    sums = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in words.columns[1:]]).first().asDict()
    if any(not sums[f"a{m}{k}"] for m in range(len(_MODELS)) for k in (0, 1)):
        return ToxicityModel(None)
    size = {(r.fold, r.toxic): r["count"] for r in texts.groupBy("fold", "toxic").count().collect()}
    enough = F.expr(" + ".join(f"c{f}{t}" for f, t in cell)) >= least
    pairs = pairs.where(F.col("before") != _ANY)
    often = pairs.where(enough)
    histories = pairs.groupBy("before").agg(*[F.sum(f"c{f}{t}").alias(f"c{f}{t}") for f, t in cell])
    word_table = words.where(enough).toPandas()
    pair_table = often.toPandas()
    history_table = histories.join(often.select("before"), "before", "left_semi").toPandas()

    def bits(column) -> np.ndarray:
        return column.to_numpy().astype(np.int64).view(np.uint64)

    def model(m: int) -> KneserNey:
        def by_fold(table) -> list[np.ndarray]:
            return [sum(table[f"c{f}{t}"].to_numpy(dtype=float) for f in _MODELS[m]) for t in (0, 1)]

        after = [word_table[f"a{m}{k}"].to_numpy(dtype=float) for k in (0, 1)]
        return KneserNey(
            [float(sum(size.get((f, t), 0) for f in _MODELS[m])) for t in (0, 1)],
            bits(word_table["word"]), by_fold(word_table), after, [float(sums[f"a{m}{k}"]) for k in (0, 1)],
            bits(pair_table["before"]), bits(pair_table["word"]), by_fold(pair_table),
            bits(history_table["before"]), by_fold(history_table),
        )

    parts = [model(m) for m in range(FOLDS)]  # a text of fold f is judged by the model without it

    def judge(batches):
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                fold = part.column(1).to_numpy(zero_copy_only=False)
                each = np.stack([m.means(part.column(0).to_pylist())[1] for m in parts])
                yield pa.RecordBatch.from_arrays([pa.array(each[fold, np.arange(len(fold))]), part.column(2)], names=["llr", "toxic"])

    judged = texts.mapInArrow(judge, "llr double, toxic int").toPandas()  # a row for each sampled text
    slope, offset = _logistic(judged["llr"].to_numpy(), judged["toxic"].to_numpy().astype(float))
    scratch.drop("texts", "pairs", "words")
    return ToxicityModel(model(FOLDS), slope, offset)


def score_toxicity(
    df: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence behind them, for every row.

    Null and empty texts have evidence 0 and the score of the curve there.  Repeated rows and null ids are kept; extra
    columns are ignored; texts are scored whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        fitted = shared.value

        def work(texts: list) -> dict[str, list]:
            count, llr, score = fitted.score(texts)
            return {"n_words": count.tolist(), "llr": llr.tolist(), "score": score.tolist()}

        return work

    return map_texts(df, kernel, FIELDS, id_col, text_col).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
        "n_words",
        "llr",
    )
