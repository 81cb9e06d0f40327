"""Language ID by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A three-letter window is bound into one vector: the letters'
vectors, rotated by their place, multiplied.  A text's windows are bundled (added) into its profile, a language's
prototype is the bundle of its texts, and the prototype nearest by cosine names the language.  What all prototypes
have in common is taken off before the comparison, for it tells no languages apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import bound_batches, map_texts, slices
from .toxicity import held_out

DIMENSIONS, GRAM = 1024, 3
#: Letter codes: 0 for what is no letter, 1-26 for a-z, the rest shared by all other letters.
ALPHABET = 128
#: Texts and kinds of windows bundled at once, and the characters of a piece; the sharpness of the score.
_BLOCK, _KINDS, _PIECE, _SHARP = 64, 1 << 13, 1 << 20, 12.0
FIELDS = "lang_pred string, score double, similarity double, n_grams long"
UNDETERMINED = "und"
_letter_codes: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Code of every code point, upper and lower case alike."""
    if not _letter_codes:
        codes = np.zeros(0x110000, dtype=np.uint8)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = ord(char.lower()[0])
                codes[point] = low - 96 if 97 <= low <= 122 else 27 + low % (ALPHABET - 27)
        _letter_codes.append(codes)
    return _letter_codes[0]


def letter_vectors() -> np.ndarray:
    return np.random.RandomState(11).choice(np.array([-1, 1], dtype=np.int8), (ALPHABET, DIMENSIONS))


class Profiles:
    """The bundled windows of a list of texts: bundles (one row a text), n_grams, and letters (whether it has any).

    Runs of other characters count as one gap, also before and after the text.  ``groups``: texts of one number share a row.
    Neither a long text nor many kinds of windows are held at once: texts are read in pieces, and kinds are bound in blocks.
    """

    def __init__(self, texts: list, letters: np.ndarray, groups: np.ndarray | None = None, dtype=np.float32):
        rows = np.arange(len(texts)) if groups is None else groups
        self.bundles = np.zeros((int(rows.max(initial=-1)) + 1, DIMENSIONS), dtype=dtype)
        self.n_grams, self.letters = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
        held, owner, size = [], [], 0
        for k, text in enumerate(texts):
            for codes, lettered in _pieces(text or ""):
                self.letters[k] |= lettered
                self.n_grams[k] += len(codes)
                held.append(codes)
                owner.append(np.full(len(codes), rows[k], dtype=np.int32))
                size += len(codes)
                if size >= _PIECE:
                    self._add(np.concatenate(held), np.concatenate(owner), letters)
                    held, owner, size = [], [], 0
        if size:
            self._add(np.concatenate(held), np.concatenate(owner), letters)

    def _add(self, codes: np.ndarray, owner: np.ndarray, letters: np.ndarray) -> None:
        kinds = np.flatnonzero(np.bincount(codes, minlength=ALPHABET**GRAM))
        place = np.zeros(ALPHABET**GRAM, dtype=np.int32)
        place[kinds] = np.arange(len(kinds))
        index = place[codes]
        for low in range(0, len(kinds), _KINDS):
            some = kinds[low : low + _KINDS]
            bound = _bound(some, letters).astype(self.bundles.dtype)
            here = np.flatnonzero((index >= low) & (index < low + _KINDS)) if len(kinds) > _KINDS else np.arange(len(index))
            row, kind = owner[here], index[here] - low  # rows ascend
            first = np.searchsorted(row, np.arange(0, len(self.bundles) + _BLOCK, _BLOCK))
            for block, (start, stop) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if start == stop:
                    continue
                top = min(_BLOCK, len(self.bundles) - block * _BLOCK)
                cell = (row[start:stop] - block * _BLOCK) * len(some) + kind[start:stop]
                counts = np.bincount(cell, minlength=top * len(some)).reshape(top, len(some))
                self.bundles[block * _BLOCK : block * _BLOCK + top] += counts.astype(bound.dtype) @ bound


def _pieces(text: str):
    """(window codes, whether a letter is in them) of a text, piece by piece."""
    table, held = letter_codes(), np.zeros(1, dtype=np.uint8)
    for start in range(0, max(len(text), 1), _PIECE):
        points = np.frombuffer(text[start : start + _PIECE].encode("utf-32-le", "replace"), dtype=np.uint32)
        end = np.zeros(int(start + _PIECE >= len(text)), dtype=np.uint8)
        codes = np.r_[held, table[points], end]
        codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
        n = max(len(codes) - GRAM + 1, 0)
        gram = np.zeros(n, dtype=np.int32)
        for k in range(GRAM):
            gram = gram * ALPHABET + codes[k : k + n]
        yield gram, bool(codes.any())
        held = codes[-(GRAM - 1) :]


def _bound(kinds: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vector of every kind of window."""
    bound = np.ones((len(kinds), DIMENSIONS), dtype=np.int8)
    for k in range(GRAM):
        code = kinds // ALPHABET ** (GRAM - 1 - k) % ALPHABET
        bound *= np.roll(letters, GRAM - 1 - k, axis=1)[code]
    return bound


class LanguageModel:
    """Prototypes of the learned languages, in the order of their names.

    own: a language's mean projection, of its own windows on its prototype; a window of something else has 0 on average.
    """

    def __init__(self, names: list[str], bundles: np.ndarray, n_grams: np.ndarray | None = None):
        self.names = names
        self.own = np.linalg.norm(bundles, axis=1) / np.maximum(1 if n_grams is None else n_grams, 1)
        length = np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-9)
        self.unit = (bundles / length).astype(np.float32)
        apart = self.unit - self.unit.mean(axis=0) if len(names) > 1 else self.unit
        self.apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-9)


def fit_languages(documents: DataFrame) -> LanguageModel:
    """Prototypes from all documents that have a text and a language and are not held out.

    Bundles are integers, so their sum does not depend on the order; one vector a language comes to the driver.
    """

    def bundle(batches):
        letters = letter_vectors()
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                names, group = np.unique(batch.column(1).slice(start, stop - start).to_pylist(), return_inverse=True)
                order = np.argsort(group, kind="stable")
                texts = batch.column(0).slice(start, stop - start).to_pylist()
                made = Profiles([texts[k] for k in order], letters, group[order], np.float64)
                windows = np.bincount(group[order], made.n_grams, len(names))
                for name, total, n in zip(names.tolist(), made.bundles, windows, strict=True):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * (DIMENSIONS + 1)),
                            pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)),
                            pa.array(np.r_[total, n].astype(np.int64)),  # the number of windows comes last
                        ],
                        names=["lang", "dim", "total"],
                    )

    bound_batches(documents.sparkSession)
    learn = (
        documents.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
        .where(~held_out())
        .select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    )
    table = learn.mapInArrow(bundle, "lang string, dim int, total long").groupBy("lang", "dim").agg(F.sum("total"))
    sums = table.toPandas()
    names = sorted(set(sums["lang"]))
    bundles = np.zeros((len(names), DIMENSIONS + 1))
    row = {n: k for k, n in enumerate(names)}
    bundles[sums["lang"].map(row).to_numpy(dtype=int), sums["dim"].to_numpy(dtype=int)] = sums.iloc[:, 2]
    return LanguageModel(names, bundles[:, :-1], bundles[:, -1])


def identify_languages(
    df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the nearest prototype), similarity (its plain cosine), n_grams.

    Null texts and texts without a letter, and all texts where no language was learned, get ``und`` and score 0.
    Repeated rows and null ids are kept, extra columns ignored, texts read whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        fitted, letters = shared.value, letter_vectors()

        def work(texts: list) -> dict[str, list]:
            made = Profiles(texts, letters)
            profile = made.bundles / np.maximum(np.linalg.norm(made.bundles, axis=1, keepdims=True), 1e-9)
            out: dict[str, list] = {"lang_pred": [], "score": [], "similarity": [], "n_grams": made.n_grams.tolist()}
            apart, plain = profile @ fitted.apart.T, profile @ fitted.unit.T
            for k in range(len(texts)):
                if not made.letters[k] or not fitted.names:
                    best, share, near = UNDETERMINED, 0.0, 0.0
                else:
                    at = int(np.argmax(apart[k]))
                    weight = np.exp(_SHARP * (apart[k].astype(float) - float(apart[k][at])))
                    best, share = fitted.names[at], float(1 / weight.sum())
                    near = float(np.clip(plain[k][at], 0, 1))
                out["lang_pred"].append(best)
                out["score"].append(share)
                out["similarity"].append(near)
            return out

        return work

    return map_texts(df, kernel, FIELDS, id_col, text_col).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "similarity", "n_grams"
    )


def keep_languages(
    df: DataFrame, model: LanguageModel, share: float = 0.25, errors: float = 3.0, text_col: str = "text"
) -> DataFrame:
    """All columns of the rows whose text is in one of the learned languages.

    Rejected: texts without a letter (null and empty ones too), and texts whose windows project on every prototype less
    than ``share`` of what the language's own windows do on average, by more than ``errors`` standard errors.  A window of
    anything else projects 0 on average with deviation 1, so the error of a text's mean is one over the root of its windows:
    the shorter a text, the less it is rejected, and none for its length alone.  All texts with a letter stay where no
    language was learned.  Nothing is joined: rows are judged where they are.
    """
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        fitted, letters = shared.value, letter_vectors()
        for batch in batches:
            for start, stop in slices(batch.column(at)):
                part = batch.slice(start, stop - start)
                made = Profiles(part.column(at).to_pylist(), letters)
                keep = made.letters.copy()
                if fitted.names:
                    n = np.maximum(made.n_grams, 1)[:, None]
                    mean = made.bundles @ fitted.unit.T / n
                    keep &= (mean + errors / np.sqrt(n) >= share * fitted.own).any(axis=1)
                yield part.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
