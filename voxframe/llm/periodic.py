"""Periodic runs of words by bit-parallel lags.

Each word of a text has an id; plane b is one big integer that holds bit b of every id.  For a lag q, the planes are
XORed with themselves shifted by q and the results are ORed: a zero at i says that words i and i+q are equal.  A run of
period q and length m is a stretch of m-q zeros.  ANDing with shifted copies, whose shift doubles, leaves only stretches
that are long enough.

Which lags are worth it: a run of period q, Q <= q < 2Q, spans three periods, so it holds a block [kQ, kQ+Q) together with
its copy q words on.  Window hashes compared row by row find all lags for which some block has such a copy; lags that
hashes suggest wrongly cost time only, as the planes decide.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import mix, span_hashes
from .rows import map_texts

#: Words that a run has at least, and how many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Lags below this are all looked at.
_SMALL = 8


def word_ids(words: list) -> np.ndarray:
    known: dict = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the ids; bit i of it belongs to word i."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(width)]


def _long_zeros(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of at least ``least`` words that equal the word ``lag`` on."""
    differ = 0
    for p in planes:
        differ |= p ^ (p >> lag)
    inside = (1 << (n - lag)) - 1
    left, have = inside & ~differ, 1
    while left and have < least:
        step = min(have, least - have)
        left &= left >> step
        have += step
    if not left:
        return []
    size = (n + 7) // 8
    bits = np.unpackbits(np.frombuffer(left.to_bytes(size, "little"), dtype=np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(bits, prepend=0, append=0))
    return [(a, b + least - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _lags(values: np.ndarray, block: int, runs: list) -> list[int]:
    """Lags from ``block`` to under twice as much for which some block of words has a copy so many words on.

    A block that lies with its copy in one run of a shorter period is passed over: whatever longer period it has there is
    a multiple of the shorter one (Fine and Wilf), so no new run.
    """
    n = len(values)
    starts = np.arange(n - block + 1)
    rows = np.zeros(-(-n // block) * block, dtype=np.uint64)
    rows[: len(starts)] = span_hashes(values, starts, starts + block)
    valid = np.zeros(len(rows), dtype=bool)
    valid[: len(starts)] = True
    rows, valid = rows.reshape(-1, block), valid.reshape(-1, block)
    same = (rows[1:] == rows[:-1, :1]) & valid[1:]
    if runs and same.any():
        order = sorted((s, s + length) for s, length, _ in runs)
        reach = np.maximum.accumulate(np.array([e for _, e in order]))
        first = np.arange(len(same)) * block
        at = np.searchsorted([s for s, _ in order], first, side="right") - 1
        within = np.where(at >= 0, reach[at], 0) - first - block
        same &= np.arange(block, 2 * block)[None, :] > within[:, None]
    return (np.flatnonzero(same.any(axis=0)) + block).tolist()


def find_runs(ids: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs of ``least`` words and ``times`` periods, by start and period.

    A stretch may have several periods, then the smallest divides the others and was found before them.
    """
    if times < 3:
        raise ValueError("a run has three periods or more")
    n = len(ids)
    if n < max(least, times):
        return []
    planes, values = bit_planes(ids), mix(ids.astype(np.uint64) + np.uint64(1))
    runs: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    block = _SMALL
    lags = list(range(1, _SMALL))
    while lags or times * block <= n:
        for q in lags:
            if q * times > n:
                break
            for a, b in _long_zeros(planes, n, q, max(least - q, (times - 1) * q)):
                if (a, b + q) not in seen:
                    seen.add((a, b + q))
                    runs.append((a, b + q - a, q))
        lags = []
        if times * block <= n:
            lags = _lags(values, block, runs)
            block *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length/period; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def periodic_runs(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_WORDS,
    times: int = LEAST_TIMES,
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period), best (the strongest run), and
    collapsed: the words that no run holds after its first period, joined by one space.

    A null or empty text, or one of blanks, has no words and no runs, a null ``best`` and an empty ``collapsed``.  Rows
    that repeat and null ids are kept, one result each; of runs that tie for the strongest the first is taken; other
    columns are not read, whatever their names; an empty table gives an empty result.  Texts of any length are read whole;
    beyond the words themselves a text costs some 60 bytes a word.
    """

    def kernel():
        def named(run: tuple[int, int, int]) -> dict[str, int]:
            return dict(zip(("start", "length", "period"), run, strict=True))

        def work(texts: list) -> dict[str, list]:
            out: dict[str, list] = {"n_words": [], "runs": [], "best": [], "collapsed": []}
            for text in texts:
                words = (text or "").encode().split()  # of bytes: exactly at \x20 and \x09-\x0D
                runs = find_runs(word_ids(words), least, times)
                best = strongest(runs)
                if runs:
                    words_left = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                out["n_words"].append(len(words))
                out["runs"].append([named(r) for r in runs])
                out["best"].append(named(best) if best else None)
                out["collapsed"].append(b" ".join(words_left if runs else words).decode())
            return out

        return work

    run = "struct<start:long,length:long,period:long>"
    return map_texts(df, kernel, f"n_words long, runs array<{run}>, best {run}, collapsed string", id_col, text_col)


def plant_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where the checksum of every tenth id or so makes the text's end repeat itself.

    With h = crc32 of the decimal id and g = floor(h/10): if 10 divides h and the text has n > 0 words, each word from
    a = g%n on becomes word a+(i-a)%p, p = 1+floor((n-a)/(3+g%8)), and the words are joined by one space.  All other rows
    pass as they are, those with a null id too.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string"))

    def kernel():
        def work(texts: list) -> dict[str, list]:
            return {"text": [_planted(t) for t in texts]}

        return work

    marked = rows.withColumn("h", F.when(h % 10 == 0, h))
    chosen = marked.where("h IS NOT NULL").select("doc_id", F.concat_ws(" ", F.col("h").cast("string"), F.col("text")).alias("text"))
    return map_texts(chosen, kernel, "text string").unionByName(marked.where("h IS NULL").select("doc_id", "text"))


def _planted(marked: str) -> str:
    h, *words = marked.encode().split()
    g, n = int(h) // 10, len(words)
    if n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + k % p] for k in range(n - a)]
    return b" ".join(words).decode()


def run_digests(df: DataFrame) -> DataFrame:
    """What a row of periodic_runs comes to: number of runs, the strongest one, and digests of the runs and the text."""
    best = F.col("best")

    def line(r: Column) -> Column:
        return F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])

    return df.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[k].alias(k) for k in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
