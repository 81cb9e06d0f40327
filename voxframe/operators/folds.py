"""Folds over ordered rows of a key: what one row leaves behind decides about the next.

A ``Fold`` is written once.  ``fold_in_order`` runs it over a table: rows are dealt out by key and sorted, and one key's
memory at a time is carried from batch to batch, so that a key of any length needs no more memory than its state.
``voxframe.streaming.folding`` runs the same fold over a stream on event time, with equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Name under which a fold finds the event time of its rows, in milliseconds (state rows allow no leading underscore).
AT = "at_ms"


class Fold:
    """Steps over the rows of one key.

    columns: the DDL of what it gives; idle: after a gap of more than so many milliseconds the key begins anew (None:
    never), and what it still held is given by ``end``.
    """

    columns: str
    idle: float | None = None

    def start(self, key: tuple) -> Any:
        """What is known before the first row."""
        return None

    def rows(self, key: tuple, memory: Any, frame: pd.DataFrame) -> tuple[Any, list[tuple]]:
        """The memory after some rows in order, and what they give.  However rows are cut into frames, it is the same."""
        raise NotImplementedError

    def end(self, key: tuple, memory: Any) -> list[tuple]:
        """What is given once no row follows."""
        return []

    def over(self, memory: Any) -> bool:
        """Whether a memory may be given up after a gap; one that still counts is kept."""
        return True

    def names(self) -> list[str]:
        return [c.split()[0] for c in _top_level(self.columns)]


class ModelFold(Fold):
    """A fold that asks a plugged-in model; each worker makes its own, once."""

    def __init__(self, factory: Callable[[], Any]):
        self.factory, self._model = factory, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_model": None}

    @property
    def model(self) -> Any:
        if self._model is None:
            self._model = self.factory()
        return self._model


def _top_level(ddl: str) -> list[str]:
    parts, depth, now = [], 0, ""
    for c in ddl:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(now.strip())
            now = ""
        else:
            now += c
    return [*parts, now.strip()]


def advance(fold: Fold, key: tuple, memory: Any, last: float | None, frame: pd.DataFrame) -> tuple[Any, float | None, list[tuple]]:
    """Feeds rows in order, beginning anew after each gap; ``last`` is the event time of the row before."""
    if not len(frame):
        return memory, last, []
    if fold.idle is None or AT not in frame:
        memory, out = fold.rows(key, memory, frame)
        return memory, (float(frame[AT].iloc[-1]) if AT in frame else None), out
    at = frame[AT].to_numpy(dtype=np.float64)
    gap = np.diff(np.r_[at[0] if last is None else last, at])
    cuts = [0, *np.flatnonzero(gap > fold.idle).tolist(), len(frame)]
    out: list[tuple] = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if k and fold.over(memory):
            out += fold.end(key, memory)
            memory = fold.start(key)
        if b > a:
            memory, made = fold.rows(key, memory, frame.iloc[a:b])
            out += made
    return memory, float(at[-1]), out


def as_frame(fold: Fold, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=fold.names()).astype(object)


def event_ms(at: str):
    """Event time in whole milliseconds, rounded up."""
    return F.ceil(F.col(at).cast("timestamp").cast("double") * 1000).cast("long")


def in_place(df: DataFrame, keys: list[str], order: list[str], placed: bool) -> DataFrame:
    """The rows of each key together and in order.  placed: they already are, as those exploded from one row of a key are;
    then they are neither dealt out nor sorted, and a task's memory does not grow with its rows."""
    return df if placed else df.repartition(*keys).sortWithinPartitions(*keys, *order)


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], fold: Fold, at: str | None = None, placed: bool = False) -> DataFrame:
    """What a fold gives over the rows of each key by ``order``.  at: a timestamp column, where the fold knows gaps;
    placed: see ``in_place``.

    Keys are not null.  Without ``at`` a key never begins anew.  One task holds one key's memory and one batch of rows at a time.
    """
    rows = df if at is None else df.withColumn(AT, event_ms(at))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, memory, last = None, None, None
        for frame in frames:
            if not len(frame):
                continue
            changed = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
            changed[0] = True
            cuts = [*np.flatnonzero(changed).tolist(), len(frame)]
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(frame[k].iloc[a] for k in keys)
                if now != key:
                    if key is not None:
                        out += fold.end(key, memory)
                    key, memory, last = now, fold.start(now), None
                memory, last, made = advance(fold, key, memory, last, frame.iloc[a:b])
                out += made
            yield as_frame(fold, out)
        if key is not None:
            yield as_frame(fold, fold.end(key, memory))

    return in_place(rows, keys, order, placed).mapInPandas(run, fold.columns)
