"""BPE encoding and decoding in batched numpy merge rounds.

All words of a batch that are not yet known lie as symbols in one flat array.  A round looks every neighbouring pair up
by binary search in the sorted pair keys, takes each word's lowest rank, and merges all its places at once; words with
nothing left to merge leave the array.  Ranks grow with every merge a vocabulary learned, so merging all places of the
lowest pair at once gives the same symbols as merging them one by one.

A word of many symbols (text without blanks, encoded bytes, junk) would need a round over all of them for each of its
merges.  Such words keep their symbols in linked arrays instead, and places by the rank of their pair: a round takes the
places of the lowest rank out, merges them, and looks up only the pairs that are new.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from .rows import map_texts

#: Words kept between batches of a task.
KNOWN_WORDS = 150_000
#: Symbols from which a word is merged place by place, and up to which what it gives is remembered.
LONG_WORD, _REMEMBERED = 256, 4096
_NONE = np.int64(1 << 40)
_SHIFT = np.int64(1 << 21)
#: Scripts in which Python's and the library's character tables agree; other texts take the library's splitter.
_SETTLED = (
    "\\x00-\\u024f\\u0300-\\u036f\\u0391-\\u03a1\\u03a3-\\u03c9\\u0400-\\u045f\\u2010-\\u2027\\u2030-\\u205e"
    "\\u20a0-\\u20bd\\u2190-\\u21ff\\u2200-\\u22ff\\u2500-\\u25ff\\u3001-\\u3002\\u3041-\\u3096\\u30a1-\\u30fa"
    "\\u4e00-\\u9fa5\\uac00-\\ud7a3"
)
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: itself if printable Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary whose words end in a suffix."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = np.empty(max([*vocab.values(), *self.special.values()]) + 1, dtype=object)
        for piece, i in [*vocab.items(), *self.special.items()]:
            self.pieces[i] = piece
        self.alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in self.alphabet], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in self.alphabet], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] for a, _ in merges]) * _SHIFT + np.array([vocab[b] for _, b in merges])
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        born = np.full(len(self.pieces), -1, dtype=np.int64)
        born[made] = np.arange(len(made))
        if (np.maximum(born[keys // _SHIFT], born[keys % _SHIFT]) >= np.arange(len(keys))).any():
            raise ValueError("a merge comes before the pieces that it joins")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.unsettled = regex.compile(f"[^{_SETTLED}]").search
        self.space = regex.compile(r"\s+")
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}

    def split_words(self, text: str) -> list:
        """The words of a text in order; special tokens come as their id."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list = []
        for k, part in enumerate(self.cut(text)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words(text.lower())
        if self.unsettled(text):
            parts = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes(self.byte_of[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in parts]
        # Lower-casing goes letter by letter, so capital sigma has one small form
        text = self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return self.words(text.lower())

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (_NONE: no merge) and its place in the table."""
        key = left * _SHIFT + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], _NONE), place

    def encode_long(self, sym: np.ndarray) -> np.ndarray:
        """The ids of one word of many symbols."""
        n = len(sym)
        sym, after, before = sym.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        rank, made = np.full(n, _NONE), np.zeros(n, dtype=np.int64)
        places: dict[int, list] = {}
        heap: list[int] = []

        def look_up(at: np.ndarray) -> None:
            at = at[after[at] < n]
            if not len(at):
                return
            rank[at], made[at] = self._pairs(sym[at], sym[after[at]])
            at = at[rank[at] != _NONE]
            order = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.r_[0, cut]].tolist() if len(ranks) else (), np.split(order, cut), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        look_up(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]  # others have changed since
            if not len(at):
                continue
            # In a run such as a a a the pairs overlap: every second one merges, from the left
            first = np.r_[True, at[1:] != after[at[:-1]]]
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]
            gone = after[at]
            sym[at], rank[gone] = self.made[made[at]], _NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            rank[at] = _NONE
            after[gone] = -1  # marks what is gone
            left = before[at]
            look_up(np.unique(np.concatenate([left[left >= 0], at])))
        return sym[after >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and where each word's ids begin (one more entry than words)."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        long = [k for k, r in enumerate(raw) if len(r) >= LONG_WORD]
        if not long:
            return self._encode_short(raw)
        ids, at = self._encode_short([b"" if len(r) >= LONG_WORD else r for r in raw])
        parts = np.split(ids, at[1:-1])
        for k in long:
            flat = np.frombuffer(raw[k], dtype=np.uint8)
            parts[k] = self.encode_long(np.r_[self.inner[flat[:-1]], self.final[flat[-1:]]])
        return np.concatenate(parts), np.r_[0, np.cumsum(list(map(len, parts)))]

    def _encode_short(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        owner = np.repeat(np.arange(len(raw), dtype=np.int64), size)
        sym = self.inner[flat]
        ends = (np.cumsum(size) - 1)[size > 0]
        sym[ends] = self.final[flat[ends]]
        done_sym, done_owner = [], []
        while len(sym):
            rank, at = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
            same = np.flatnonzero(owner[:-1] == owner[1:])
            rank[same], at[same] = self._pairs(sym[same], sym[same + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            count = np.diff(np.r_[starts, len(owner)])
            low = np.repeat(np.minimum.reduceat(rank, starts), count)
            over = low == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                keep = ~over
                sym, owner, rank, at, low = sym[keep], owner[keep], rank[keep], at[keep], low[keep]
                if not len(sym):
                    break
            pick = rank == low
            # In a run such as a a a the pairs overlap: every second one merges, from the left
            first = pick & ~np.r_[False, pick[:-1]]
            index = np.arange(len(pick))
            run = np.maximum.accumulate(np.where(first, index, -1))
            chosen = np.flatnonzero(pick & ((index - run) % 2 == 0))
            sym[chosen] = self.made[at[chosen]]
            keep = np.ones(len(sym), dtype=bool)
            keep[chosen + 1] = False
            sym, owner = sym[keep], owner[keep]
        if not done_sym:
            return np.zeros(0, dtype=np.int64), np.zeros(len(raw) + 1, dtype=np.int64)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(raw)))]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder, so pieces are joined by a space."""
        return " ".join(self.pieces[i] for i in ids)


def _coder(path: str):
    model = WordBpe(path)
    known: dict = {}

    def learn(lists: list[list]) -> None:
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = list({w for words in lists for w in words if w not in known})
        for w in [w for w in new if isinstance(w, int)]:
            known[w] = (str(w), model.pieces[w])
        new = [w for w in new if not isinstance(w, int)]
        ids, at = model.encode_words(new)
        number = list(map(str, ids.tolist()))
        piece = model.pieces[ids].tolist()
        at = at.tolist()
        for k, w in enumerate(new):
            known[w] = (" ".join(number[at[k] : at[k + 1]]), " ".join(piece[at[k] : at[k + 1]]))

    def code(texts: list) -> list[tuple[str, str]]:
        """Of each text the ids as decimals and the decoded text, both joined by one space."""
        lists = [model.split_words(t) if t else [] for t in texts]
        learn(lists)
        out = []
        for words in lists:
            got = [known[w] for w in words]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        for words in lists:
            for w in words:
                if not isinstance(w, int) and len(w) > _REMEMBERED:
                    known.pop(w, None)
        return out

    return code


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text for every document.

    Null texts count as empty: no tokens, and both digests are those of the empty string.  Repeated rows and null ids
    are kept, one result each; extra columns are ignored; texts of any length are encoded whole, words of any length in
    about linear time.
    """

    def kernel():
        code = _coder(path)

        def work(texts: list) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids, text in code(texts):
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            return out

        return work

    return map_texts(df, kernel, FIELDS, id_col, text_col)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every document; null texts give an empty array and an empty string."""

    def kernel():
        code = _coder(path)

        def work(texts: list) -> dict[str, list]:
            got = code(texts)
            return {"ids": [list(map(int, i.split())) for i, _ in got], "decoded": [t for _, t in got]}

        return work

    return map_texts(df, kernel, "ids array<int>, decoded string", id_col, text_col)
