"""Greedy decoding of many recordings side by side: a lane each, and lanes that have ended leave.

A step model works on arrays whose first axis is the lane.  What a recording gives does not depend on the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Frames that are decoded side by side at most, so that lanes fit a task's memory.
LANE_FRAMES = 200_000


class StepModel(Protocol):
    """memory is a list of arrays, each with a row for every lane."""

    def begin(self, lanes: int) -> list[np.ndarray]:
        """Memory before the first token."""

    def step(self, memory: list, last: np.ndarray, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, list]:
        """Scores (lane, id), durations (or None), and the memory if the best token is taken; ``last`` is -1 at first."""


class AttentionModel(Protocol):
    def first(self, prompts: list[list[int]], encoded: list[np.ndarray]) -> tuple[np.ndarray, list]:
        """Log-probabilities of each lane's first token, and the memory."""

    def next(self, memory: list, last: np.ndarray) -> tuple[np.ndarray, list]:
        """Log-probabilities of the next token, and the memory."""


def finite_argmax(scores: np.ndarray) -> np.ndarray:
    """Place of each row's greatest finite value, the first of equal ones; 0 where none is finite."""
    return np.argmax(np.where(np.isfinite(scores), scores, -np.inf), axis=-1)


def _take(memory: list, lanes: np.ndarray) -> list:
    return [m[lanes] for m in memory]


def _put(memory: list, lanes: np.ndarray, values: list) -> None:
    for m, v in zip(memory, values, strict=True):
        m[lanes] = v


def transducer_lanes(frames: list[np.ndarray], model: StepModel, blank: int, most: int = 10) -> list[list[tuple[int, int]]]:
    """(id, frame) of each recording.  A blank or a positive duration moves on, by one frame at least; after ``most``
    tokens of a frame the next one comes."""
    out: list[list[tuple[int, int]]] = [[] for _ in frames]
    length = np.array([len(f) for f in frames], dtype=np.int64)
    at, here, last = np.zeros_like(length), np.zeros_like(length), np.full_like(length, -1)
    memory, lanes = model.begin(len(frames)), np.flatnonzero(length > 0)
    while len(lanes):
        now = np.stack([frames[i][at[i]] for i in lanes])
        scores, duration, after = model.step(_take(memory, lanes), last[lanes], now)
        token = finite_argmax(scores)
        said = token != blank
        for i, t in zip(lanes[said].tolist(), token[said].tolist(), strict=True):
            out[i].append((t, int(at[i])))
        _put(memory, lanes[said], [a[said] for a in after])
        last[lanes[said]] = token[said]
        here[lanes] += said
        step = np.zeros(len(lanes), dtype=np.int64) if duration is None else duration
        moves = (step > 0) | ~said | (here[lanes] >= most)
        at[lanes[moves]] += np.maximum(step[moves], 1)
        here[lanes[moves]] = 0
        lanes = lanes[at[lanes] < length[lanes]]
    return out


def utterance_lanes(
    frames: list[np.ndarray], model: StepModel, blank: int, end: int, most: int = 5, size: int | None = None, reset: bool = True
) -> list[list[tuple[int, int]]]:
    """(id, frame) of each recording.  Blank, id 0 and ids from ``size`` on end a frame, and so does the end mark, which
    with ``reset`` is given and lets the memory, not the frames, begin anew; ``most`` tokens come from a frame."""
    out: list[list[tuple[int, int]]] = [[] for _ in frames]
    length = np.array([len(f) for f in frames], dtype=np.int64)
    at, here, last = np.zeros_like(length), np.zeros_like(length), np.full_like(length, -1)
    memory, lanes = model.begin(len(frames)), np.flatnonzero(length > 0)
    while len(lanes):
        now = np.stack([frames[i][at[i]] for i in lanes])
        scores, _, after = model.step(_take(memory, lanes), last[lanes], now)
        token = finite_argmax(scores)
        ended = token == end
        said = ~((token == blank) | (token == 0) | ended)
        if size is not None:
            said &= token < size
        shown = said | (ended & reset)
        for i, t in zip(lanes[shown].tolist(), token[shown].tolist(), strict=True):
            out[i].append((t, int(at[i])))
        _put(memory, lanes[said], [a[said] for a in after])
        last[lanes[said]] = token[said]
        if reset and ended.any():
            _put(memory, lanes[ended], model.begin(int(ended.sum())))
            last[lanes[ended]] = -1
        here[lanes] += said
        moves = ~said | (here[lanes] >= most)
        at[lanes[moves]] += 1
        here[lanes[moves]] = 0
        lanes = lanes[at[lanes] < length[lanes]]
    return out


def attention_lanes(prompts: list[list[int]], encoded: list[np.ndarray], model: AttentionModel, end: int, most: int = 1024) -> list[list[tuple[int, float]]]:
    """(id, log-probability) of each recording up to its end mark or ``most`` tokens.  A prompt must not be empty."""
    if not all(prompts):
        raise ValueError("an empty prompt")
    out: list[list[tuple[int, float]]] = [[] for _ in prompts]
    lanes = np.arange(len(prompts))
    if not len(lanes):
        return out
    scores, memory = model.first(prompts, encoded)
    for _ in range(most):
        token = finite_argmax(scores)
        goes_on = token != end
        for i, t, row in zip(lanes[goes_on].tolist(), token[goes_on].tolist(), scores[goes_on], strict=True):
            out[i].append((t, float(row[t])))
        lanes, token, memory = lanes[goes_on], token[goes_on], _take(memory, goes_on)
        if not len(lanes):
            break
        scores, memory = model.next(memory, token)
    return out


def _batches(frame: pd.DataFrame, column: str, limit: int) -> Iterator[pd.DataFrame]:
    """Rows of about equal length together, of ``limit`` frames in all."""
    size = frame[column].map(len).to_numpy()
    order = np.argsort(size, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and size[order[stop]] * (stop + 1 - start) <= limit:
            stop += 1
        yield frame.iloc[order[start:stop]]
        start = stop


def _decoded(df: DataFrame, decode: Callable[[pd.DataFrame], list], columns: tuple[str, str], kinds: str, limit: int) -> DataFrame:
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _batches(frame, "vectors", limit):
                rows = [
                    (media, k, *pair) for media, tokens in zip(part["media_id"], decode(part), strict=True) for k, pair in enumerate(tokens)
                ]
                yield pd.DataFrame(rows, columns=["media_id", "pos", *columns])

    kind = df.schema["media_id"].dataType.simpleString()
    return df.mapInPandas(run, f"media_id {kind}, pos int, {kinds}")


def _vectors(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.array([np.asarray(v, dtype=np.float64) for v in vectors]) for vectors in part["vectors"]]


def _once(factory: Callable) -> Callable:
    made: list = []

    def get():
        if not made:
            made.append(factory())
        return made[0]

    return get


def decode_transducer(df: DataFrame, factory: Callable[[], StepModel], blank: int, most: int = 10, limit: int = LANE_FRAMES) -> DataFrame:
    """(media_id, pos, id, frame) of recordings (media_id, vectors).  Recordings too long for a row go frame by frame
    through ``ports.greedy_transducer``."""
    get = _once(factory)
    rows = df.select("media_id", "vectors")
    return _decoded(rows, lambda part: transducer_lanes(_vectors(part), get(), blank, most), ("id", "frame"), "id int, frame int", limit)


def decode_utterances(
    df: DataFrame, factory: Callable[[], StepModel], blank: int, end: int, most: int = 5, size: int | None = None, limit: int = LANE_FRAMES
) -> DataFrame:
    """(media_id, pos, id, frame) of recordings (media_id, vectors); the end mark appears as a token of its own."""
    get = _once(factory)
    rows = df.select("media_id", "vectors")
    return _decoded(rows, lambda part: utterance_lanes(_vectors(part), get(), blank, end, most, size), ("id", "frame"), "id int, frame int", limit)


def decode_attention(df: DataFrame, factory: Callable[[], AttentionModel], end: int, most: int = 1024, limit: int = LANE_FRAMES) -> DataFrame:
    """(media_id, pos, id, logprob) of recordings (media_id, prompt, vectors); see ports.prompt_ids for prompts."""
    get = _once(factory)

    def decode(part: pd.DataFrame) -> list:
        return attention_lanes([list(p) for p in part["prompt"]], _vectors(part), get(), end, most)

    return _decoded(df.select("media_id", "prompt", "vectors"), decode, ("id", "logprob"), "id int, logprob double", limit)
