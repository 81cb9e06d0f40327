"""Recordings that come in as blocks of samples: frames, levels and recognisers that give the same however blocks are cut."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd

from voxframe.functions.signal import hann, mel_filters
from voxframe.operators.decoding import finite_argmax
from voxframe.operators.folds import Fold, ModelFold

RATE = 16_000


@dataclass
class FrameState:
    """Samples short of a frame, and the sample before them as it came."""

    tail: np.ndarray
    before: float | None = None


class MelFrames:
    """Log-mel frames of a signal in pieces: (padded length - window) // hop + 1 frames in all.

    centred: half an FFT of zeros stands before the signal, and behind it when it ends.
    """

    def __init__(self, n_mels: int = 128, n_fft: int = 512, window: int = 400, hop: int = 160, centred: bool = True, factor: float = 0.97):
        self.n_fft, self.window, self.hop, self.factor = n_fft, window, hop, factor
        self.pad, self.bank, self.shape = (n_fft // 2 if centred else 0), mel_filters(n_mels, n_fft), hann(window)

    def start(self) -> FrameState:
        return FrameState(np.zeros(self.pad))

    def push(self, state: FrameState, samples: np.ndarray) -> np.ndarray:
        """The frames that the new samples complete.  Samples that are not finite count as 0."""
        x = np.nan_to_num(np.asarray(samples, dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        if len(x):
            shifted = np.r_[0.0 if state.before is None else state.before, x[:-1]]
            state.before = float(x[-1])
            x = x - self.factor * shifted
        return self._frames(state, x)

    def finish(self, state: FrameState) -> np.ndarray:
        return self._frames(state, np.zeros(self.pad))

    def _frames(self, state: FrameState, x: np.ndarray) -> np.ndarray:
        signal = np.concatenate([state.tail, x])
        n = max((len(signal) - self.window) // self.hop + 1, 0)
        state.tail = signal[n * self.hop :]
        if not n:
            return np.zeros((0, len(self.bank)))
        cut = np.lib.stride_tricks.sliding_window_view(signal, self.window)[:: self.hop][:n] * self.shape
        power = np.abs(np.fft.rfft(cut, self.n_fft, axis=1)) ** 2
        return np.log(power @ self.bank.T + 2.0**-24)

    def whole(self, samples: np.ndarray) -> np.ndarray:
        state = self.start()
        return np.concatenate([self.push(state, samples), self.finish(state)])


class MelStream(Fold):
    """(media_id, frame, mel) of blocks (media_id, ..., samples)."""

    columns = "media_id long, frame long, mel array<double>"

    def __init__(self, idle: float | None = 5000.0, **options):
        self.frames, self.idle = MelFrames(**options), idle

    def start(self, key: tuple) -> list:
        return [self.frames.start(), 0]

    def _given(self, key: tuple, memory: list, made: np.ndarray) -> list[tuple]:
        first, memory[1] = memory[1], memory[1] + len(made)
        return [(key[0], first + k, m.tolist()) for k, m in enumerate(made)]

    def rows(self, key: tuple, memory: list, frame: pd.DataFrame) -> tuple[list, list[tuple]]:
        out: list[tuple] = []
        for samples in frame["samples"]:
            out += self._given(key, memory, self.frames.push(memory[0], samples))
        return memory, out

    def end(self, key: tuple, memory: list) -> list[tuple]:
        return self._given(key, memory, self.frames.finish(memory[0]))


class ChunkModel(Protocol):
    def __call__(self, chunk: np.ndarray, used: int, memory: Any) -> tuple[list[tuple[int, int]], Any]:
        """Look-back and new frames, how many of the new ones are real, and the memory: (id, new frame) and the memory."""


@dataclass
class ChunkState:
    frames: FrameState
    held: np.ndarray  # look-back, then frames not yet read
    read: int = 0
    tokens: int = 0
    memory: Any = None


class ChunkedRecogniser(ModelFold):
    """(media_id, pos, id, frame) of blocks (media_id, ..., samples): a model with a memory reads ``new`` frames at a time,
    with ``back`` frames before them (zeros at first).  What is left of a chunk is read when the recording ends."""

    columns = "media_id long, pos long, id int, frame long"

    def __init__(self, factory: Callable[[], ChunkModel], new: int = 56, back: int = 9, idle: float | None = 5000.0, **options):
        super().__init__(factory)
        self.new, self.back, self.idle, self.frames = new, back, idle, MelFrames(**options)

    def start(self, key: tuple) -> ChunkState:
        return ChunkState(self.frames.start(), np.zeros((self.back, len(self.frames.bank))))

    def _read(self, key: tuple, s: ChunkState, used: int) -> list[tuple]:
        chunk = np.zeros((self.back + self.new, s.held.shape[1]))
        part = s.held[: self.back + used]
        chunk[: len(part)] = part
        tokens, s.memory = self.model(chunk, used, s.memory)
        out = [(key[0], s.tokens + k, i, s.read + t) for k, (i, t) in enumerate(tokens)]
        s.held, s.read, s.tokens = s.held[used:], s.read + used, s.tokens + len(tokens)
        return out

    def _chunks(self, key: tuple, s: ChunkState, made: np.ndarray) -> list[tuple]:
        out: list[tuple] = []
        s.held = np.concatenate([s.held, made])
        while len(s.held) - self.back >= self.new:
            out += self._read(key, s, self.new)
        return out

    def rows(self, key: tuple, memory: ChunkState, frame: pd.DataFrame) -> tuple[ChunkState, list[tuple]]:
        out: list[tuple] = []
        for samples in frame["samples"]:
            out += self._chunks(key, memory, self.frames.push(memory.frames, samples))
        memory.held = memory.held.copy()  # not a view of a longer array
        return memory, out

    def end(self, key: tuple, memory: ChunkState) -> list[tuple]:
        out = self._chunks(key, memory, self.frames.finish(memory.frames))
        rest = len(memory.held) - self.back
        return out + (self._read(key, memory, rest) if rest else [])


class UtteranceModel(Protocol):
    """An encoder with a cache and a decoder of one lane."""

    def encode(self, features: np.ndarray, cache: Any) -> tuple[np.ndarray, Any]: ...

    def step(self, state: Any, last: int, frame: np.ndarray) -> tuple[np.ndarray, Any]: ...

    def piece(self, token: int) -> str: ...


class UtteranceRecogniser(ModelFold):
    """(media_id, seq, text) of blocks (media_id, seq, ..., samples), a row for each block that gives text.

    The model sees the last ``seen`` frames of the last ``ring`` samples, from ``warm`` samples on.  After the end mark the
    text reads " [EOU]", the rest of the block is left, and the decoder, not the encoder, begins anew.
    """

    columns = "media_id long, seq long, text string"

    def __init__(
        self, factory: Callable[[], UtteranceModel], blank: int, end: int, size: int | None = None, ring: int = 4 * RATE,
        warm: int = RATE, seen: int = 25, most: int = 5, idle: float | None = None, **options,
    ):
        super().__init__(factory)
        self.blank, self.mark, self.size, self.most = blank, end, size, most
        self.ring, self.warm, self.seen, self.idle, self.frames = ring, warm, seen, idle, MelFrames(**options)

    def start(self, key: tuple) -> dict:
        return {"ring": np.zeros(0), "cache": None, "state": None, "last": -1}

    def rows(self, key: tuple, memory: dict, frame: pd.DataFrame) -> tuple[dict, list[tuple]]:
        out = []
        for seq, samples in zip(frame["seq"], frame["samples"], strict=True):
            memory["ring"] = np.concatenate([memory["ring"], np.asarray(samples, dtype=np.float64)])[-self.ring :]
            if len(memory["ring"]) < self.warm:
                continue
            seen = self.frames.whole(memory["ring"])[-self.seen :]
            encoded, memory["cache"] = self.model.encode(seen, memory["cache"])
            text = self._text(memory, encoded)
            if text:
                out.append((key[0], seq, text))
        return memory, out

    def _text(self, memory: dict, encoded: np.ndarray) -> str:
        text = ""
        for vector in encoded:
            for _ in range(self.most):
                scores, state = self.model.step(memory["state"], memory["last"], vector)
                token = int(finite_argmax(scores))
                if token == self.mark:
                    memory["state"], memory["last"] = None, -1
                    return text + " [EOU]"
                if token in (self.blank, 0) or (self.size is not None and token >= self.size):
                    break
                memory["state"], memory["last"] = state, token
                text += self.model.piece(token)
        return text


@dataclass
class LevelState:
    tail: np.ndarray
    chunks: int = 0
    total: np.ndarray | None = None
    floor: np.ndarray | None = None
    shown: np.ndarray | None = None


class LevelMeter(Fold):
    """(media_id, chunk, levels) of blocks (media_id, ..., samples in -1..1): bands of each 40 ms between 0 and 1.

    The first ``quiet`` chunks tell the noise floor and show zeros; then a band is what exceeds the floor, as
    log1p(excess / floor) / log1p(20), smoothed over time, low bands more than high ones.  Samples short of a chunk at the
    end are left out.
    """

    columns = "media_id long, chunk long, levels array<double>"

    def __init__(
        self, bands: int = 8, chunk: int = 640, quiet: int = 25, margin: float = 1.2, low: float = 80.0, high: float = 4000.0,
        smooth: tuple[float, float] = (0.35, 0.05), idle: float | None = None,
    ):
        self.bands, self.chunk, self.quiet, self.margin, self.idle = bands, chunk, quiet, margin, idle
        edge = (low * (high / low) ** (np.arange(bands + 1) / bands) * chunk / RATE).astype(int)
        bins = chunk // 2 + 1
        self.spans = [(a, min(max(a + 1, b), bins)) for a, b in zip(np.maximum(edge[:-1], 1).tolist(), edge[1:].tolist(), strict=True)]
        self.gain = np.sqrt((high / low) ** ((np.arange(bands) + 0.5) / bands))
        self.shape, self.keep = hann(chunk), np.linspace(*smooth, bands)

    def start(self, key: tuple) -> LevelState:
        return LevelState(np.zeros(0))

    def _bands(self, samples: np.ndarray) -> np.ndarray:
        size = np.abs(np.fft.rfft(samples * self.shape))
        return np.array([0.6 * np.sqrt(np.mean(size[a:b] ** 2)) + 0.4 * size[a:b].max() for a, b in self.spans]) * self.gain

    def rows(self, key: tuple, memory: LevelState, frame: pd.DataFrame) -> tuple[LevelState, list[tuple]]:
        out: list[tuple] = []
        for samples in frame["samples"]:
            signal = np.concatenate([memory.tail, np.asarray(samples, dtype=np.float64)])
            n = len(signal) // self.chunk
            memory.tail = signal[n * self.chunk :]
            for part in signal[: n * self.chunk].reshape(n, self.chunk):
                out.append((key[0], memory.chunks, self._level(memory, part).tolist()))
                memory.chunks += 1
        return memory, out

    def _level(self, s: LevelState, part: np.ndarray) -> np.ndarray:
        bands = self._bands(part)
        if s.floor is None:
            s.total = bands if s.total is None else s.total + bands
            if s.chunks + 1 == self.quiet:
                s.floor, s.shown = s.total / self.quiet * self.margin, np.zeros(self.bands)
            return np.zeros(self.bands)
        excess = np.maximum(0, bands - s.floor) / np.maximum(s.floor, 1e-6)
        s.shown = s.shown * self.keep + np.minimum(1, np.log1p(excess) / np.log1p(20)) * (1 - self.keep)
        return s.shown


class TimedModel(Protocol):
    def __call__(self, samples: np.ndarray) -> list[tuple[str, float, float]]:
        """Words of samples with start and end in seconds; times are not used in ``dual`` mode."""


def cut_out(solo: str, combined: str, least: float = 0.5, most: float = 1.8) -> str:
    """The part of a text recognised with context that a text recognised alone begins, sought from the end by up to three
    words with one mismatch at most; the latter where it is not found, or where its length does not suit."""
    plain = [["".join(c for c in w if c.isalnum() or c == "_") for w in t.lower().split()] for t in (solo, combined)]
    alone, both = ([w for w in words if w] for words in plain)
    k = min(3, len(alone))
    if not alone or not both:
        return solo
    for i in range(len(both) - k, -1, -1):
        if sum(a == b for a, b in zip(alone[:k], both[i : i + k], strict=True)) >= k - 1:
            found = " ".join(combined.split()[i:])
            return found if len(solo) * least <= len(found) <= len(solo) * most else solo
    return solo


class ContextRecogniser(ModelFold):
    """(user_id, seq, text, with_context, failed) of recordings (user_id, seq, ..., samples): each is recognised behind the
    one before it, if that is not older than ``expiry`` milliseconds, with a pause of ``pause`` seconds between them.

    mode ``times``: words that start up to half a second before the new part count; ``dual``: the text recognised alone
    tells where the new part begins; ``none``: no context.  A failure of the model, or no word at all with context, makes
    an empty text and, in the latter case, gives the buffer up.  A recording with a text becomes the next one's context.
    """

    columns = "user_id long, seq long, text string, with_context boolean, failed boolean"

    def __init__(self, factory: Callable[[], TimedModel], mode: str = "times", expiry: float = 30_000.0, pause: float = 0.5, rate: int = RATE):
        super().__init__(factory)
        if mode not in ("times", "dual", "none"):
            raise ValueError(f"unknown mode {mode}")
        self.mode, self.idle, self.pause, self.rate = mode, expiry, pause, rate

    def rows(self, key: tuple, memory: tuple | None, frame: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
        out = []
        for seq, at, samples in zip(frame["seq"], frame["at_ms"], frame["samples"], strict=True):
            new = np.asarray(samples, dtype=np.float64)
            if memory is not None and at - memory[0] > self.idle:
                memory = None
            try:
                text, used, keep = self._text(None if memory is None else memory[1], new)
                failed = used and not keep
            except Exception:  # noqa: BLE001  any failure of a plugged-in model is this recording's
                text, used, keep, failed = "", False, True, True
            out.append((key[0], seq, text, used, failed))
            memory = (at, new[-int(self.idle / 1000 * self.rate) :]) if text else memory if keep else None
        return memory, out

    def _words(self, samples: np.ndarray) -> str:
        return " ".join(w for w, _, _ in self.model(samples)).strip()

    def _text(self, buffer: np.ndarray | None, new: np.ndarray) -> tuple[str, bool, bool]:
        """Text, whether the context was used, and whether the buffer stays."""
        if buffer is None or self.mode == "none":
            return self._words(new), False, True
        both = np.concatenate([buffer, np.zeros(int(self.pause * self.rate)), new])
        if self.mode == "dual":
            solo = self._words(new)
            combined = self._words(both) if solo else ""
            return (cut_out(solo, combined), True, True) if combined else (solo or self._words(new), False, True)
        timed = self.model(both)
        begin = len(buffer) / self.rate + self.pause - 0.5
        return " ".join(w for w, start, _ in timed if start >= begin).strip(), True, bool(timed)
