"""Diarization of a recording as it comes in: a model sees a speaker cache, a queue of late frames and a new chunk.

What leaves the queue goes to the cache; a cache that is too long is compressed to its best cells by the same scores as
in ``diarize``, here over the few hundred frames that a state holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd

from voxframe.operators.folds import ModelFold


class SpeakerModel(Protocol):
    def __call__(self, cache: np.ndarray, queue: np.ndarray, chunk: np.ndarray, used: int) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of cache and queue, a chunk of feature rows filled up with zeros and how many of them are real:
        speaker probabilities of cache, queue and chunk frames, one after another, and embeddings of the chunk's frames."""


@dataclass(frozen=True)
class CacheSizes:
    """Frames of a chunk, of the queue, of the cache, and that leave the queue at once; feature rows of a
    frame; silent places and the sum of probabilities under which a frame is silent; the scores' floor, and the shares of a
    speaker's places that are boosted by two, boosted by one, or enough to drop scores that are not positive."""

    chunk: int = 124
    queue: int = 124
    cache: int = 188
    period: int = 124
    stride: int = 8
    silent_places: int = 3
    silence: float = 0.2
    floor: float = 0.25
    strong: float = 0.75
    weak: float = 1.5
    enough: float = 0.5


@dataclass
class SpeakerState:
    """What is known of a recording: feature rows short of a chunk, the arrays, the mean of silent embeddings, and how
    many frames were given."""

    pending: list = field(default_factory=list)
    cache: np.ndarray | None = None
    cache_p: np.ndarray | None = None
    queue: np.ndarray | None = None
    queue_p: np.ndarray | None = None
    quiet: np.ndarray | None = None
    n_quiet: int = 0
    given: int = 0


def cell_scores(p: np.ndarray, sizes: CacheSizes) -> np.ndarray:
    """Scores of frames by speakers, low ones disabled and the best ones boosted (see diarize.log_odds and after)."""
    raised = np.maximum(p, sizes.floor)
    log_q = np.log(np.maximum(1 - raised, sizes.floor))
    score = np.log(raised) - log_q + log_q.sum(axis=1, keepdims=True) - np.log(0.5)
    places = sizes.cache // p.shape[1] - sizes.silent_places
    many = (score > 0).sum(axis=0) >= int(places * sizes.enough)
    score = np.where((p > 0.5) & ((score > 0) | ~many), score, -np.inf)
    for share, scale in ((sizes.strong, 2.0), (sizes.weak, 1.0)):
        best = np.argsort(-score, axis=0, kind="stable")[: int(places * share)]
        lifted = np.take_along_axis(score, best, axis=0) - scale * np.log(0.5)  # -infinity stays
        np.put_along_axis(score, best, lifted, axis=0)
    return score


def best_frames(score: np.ndarray, sizes: CacheSizes) -> np.ndarray:
    """The frame of each cache slot, -1 where it is disabled (see diarize.cache_frames)."""
    frames, speakers = score.shape
    flat = np.vstack([score, np.full((sizes.silent_places, speakers), np.inf)]).T.ravel()
    best = np.argsort(-flat, kind="stable")[: sizes.cache]
    void = flat[best] == -np.inf
    best = best[np.lexsort((best, void))]
    frame = best % (frames + sizes.silent_places)
    return np.where((flat[best] == -np.inf) | (frame >= frames), -1, frame)


def _joined(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    return b if a is None or not len(a) else np.concatenate([a, b])


class StreamingDiarizer(ModelFold):
    """(media_id, frame, p array) of feature rows (media_id, ..., vector), chunk by chunk; a last, shorter chunk is given
    once the recording has been silent for ``idle`` milliseconds, or has ended."""

    columns = "media_id long, frame long, p array<double>"

    def __init__(self, factory: Callable[[], SpeakerModel], sizes: CacheSizes = CacheSizes(), idle: float | None = 5000.0):
        super().__init__(factory)
        self.sizes, self.idle = sizes, idle

    def start(self, key: tuple) -> SpeakerState:
        return SpeakerState()

    def rows(self, key: tuple, memory: SpeakerState, frame: pd.DataFrame) -> tuple[SpeakerState, list[tuple]]:
        out: list[tuple] = []
        size = self.sizes.chunk * self.sizes.stride
        for vector in frame["vector"]:
            memory.pending.append(np.asarray(vector, dtype=np.float64))
            if len(memory.pending) == size:
                out += self._chunk(key, memory)
        return memory, out

    def end(self, key: tuple, memory: SpeakerState) -> list[tuple]:
        return self._chunk(key, memory) if memory.pending else []

    def _chunk(self, key: tuple, s: SpeakerState) -> list[tuple]:
        z = self.sizes
        used = len(s.pending)
        chunk = np.zeros((z.chunk * z.stride, len(s.pending[0])))
        chunk[:used] = s.pending
        s.pending = []
        none = np.zeros((0, 0))
        cached, queued = (0 if a is None else len(a) for a in (s.cache, s.queue))
        p, made = self.model(s.cache if cached else none, s.queue if queued else none, chunk, used)
        new = -(-used // z.stride)
        first = cached + queued
        fresh = p[first : first + new]
        s.queue, s.queue_p = _joined(s.queue, made[:new]), p[cached : first + new]
        if s.quiet is None:
            s.quiet = np.zeros(made.shape[1])
        if len(s.queue) > z.queue:
            self._leave(s, min(max(z.period, max(new - z.queue, 0) + queued), len(s.queue)), p[:cached])
        out = [(key[0], s.given + k, row.tolist()) for k, row in enumerate(fresh)]
        s.given += new
        return out

    def _leave(self, s: SpeakerState, n: int, cached_p: np.ndarray) -> None:
        """``n`` frames go from the queue to the cache, which is compressed when it is too long."""
        gone, gone_p = s.queue[:n], s.queue_p[:n]
        s.queue, s.queue_p = s.queue[n:], s.queue_p[n:]
        for vector in gone[gone_p.sum(axis=1) < self.sizes.silence]:
            s.quiet = (s.quiet * s.n_quiet + vector) / (s.n_quiet + 1)
            s.n_quiet += 1
        s.cache = _joined(s.cache, gone)
        if s.cache_p is not None:
            s.cache_p = np.concatenate([s.cache_p, gone_p])
        if len(s.cache) <= self.sizes.cache:
            return
        if s.cache_p is None:  # before the first compression, the model's latest word on the cache counts
            s.cache_p = _joined(cached_p, gone_p)
        frame = best_frames(cell_scores(s.cache_p, self.sizes), self.sizes)
        used = (frame >= 0)[:, None]
        s.cache, s.cache_p = np.where(used, s.cache[frame], s.quiet), np.where(used, s.cache_p[frame], 0.0)
