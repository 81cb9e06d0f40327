"""Words of many texts as flat arrays of 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers: polynomial base over bytes, base over words, and the two of the final mix.
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes as words have them: A-Z lower-cased.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Which bytes belong to words: all but white space; or letters, digits and all that is not ASCII.
IN_SPACE_WORD = ~np.isin(np.arange(256), [32, *range(9, 14)])
IN_LETTER_WORD = (LOWER >= 128) | ((LOWER >= 97) & (LOWER <= 122)) | ((LOWER >= 48) & (LOWER <= 57))

_random = np.random.RandomState(20)
BYTE = _random.randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(have)
    return have[:n]


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BYTE_BASE) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span; equal spans give equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(base, len(values)), out=total[1:])
    back = _power(_inverse(base), len(values) + 1)
    return (total[ends] - total[starts]) * back[starts]


class Words:
    """The words of a list of texts (None: empty).

    hashes: one a word; first: index of each text's first word, and the number of words at the end;
    inside: which bytes belong to words.
    """

    def __init__(self, texts: list, inside: np.ndarray):
        data = [(t or "").encode() for t in texts]
        joined = b"\n".join([*data, b""])
        raw = np.frombuffer(joined, dtype=np.uint8)
        within = np.r_[False, inside[raw], False]
        edge = np.flatnonzero(within[1:] != within[:-1])
        starts, ends = edge[::2], edge[1::2]
        at = np.r_[0, np.cumsum([len(d) + 1 for d in data], dtype=np.int64)]
        self.first = np.searchsorted(starts, at)
        self.hashes = mix(span_hashes(BYTE[LOWER[raw]], starts, ends))

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive values (across texts too: the caller masks those)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out += hashes[k : k + n] * _power(_WORD_BASE, size)[k]
    return mix(out + np.uint64(size))


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of fewer words than a window; its length counts."""
    with np.errstate(over="ignore"):
        total = np.sum(hashes * _power(_WORD_BASE, len(hashes)), dtype=np.uint64) + np.uint64(len(hashes))
    return mix(np.array([total]))[0]
