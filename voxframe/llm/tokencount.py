"""Token counts with overlap resynchronisation for huge documents.

A huge text is encoded in overlapping chunks with offsets, and neighbours are spliced where both begin a pre-token at
the same character.  Such a place is stable: the splitting pattern looks at most one character ahead and never back, so
what the left chunk found up to some characters before its end is what the whole text gives, and from a pre-token's
first character on both go the same way.  Without such a place in the overlap, the overlap is doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .rows import map_texts

#: Texts over HUGE characters go in chunks of CHUNK with OVERLAP characters in common.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
FIELDS = "n_bytes long, n_tokens long, over_limit boolean"


def begins(encoding) -> dict[int, int]:
    """Character offset -> token index of every token that begins a pre-token."""
    words, out, last = encoding.word_ids, {}, object()
    for k, (word, (start, _)) in enumerate(zip(words, encoding.offsets, strict=True)):
        if word != last:
            out.setdefault(start, k)
        last = word
    return out


def count_chunked(encode, text: str, guard: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, spliced.  ``encode`` gives an encoding with offsets and pre-token numbers.

    guard: characters before a chunk's end that are not trusted; more than the longest special string.
    """
    total, origin = 0, 0  # text before origin, a true pre-token boundary, is counted
    start, end = 0, min(chunk, len(text))
    left, first = encode(text[start:end]), 0  # first: the left chunk's token that begins at origin
    while end < len(text):
        wide, cut = overlap, None
        ours = {start + o: k for o, k in begins(left).items() if k >= first and start + o <= end - guard}
        while cut is None:
            at = max(origin + 1, end - wide - guard)
            right_end = min(len(text), max(end, at) + chunk)
            right = encode(text[at:right_end])
            theirs = {at + o: k for o, k in begins(right).items() if o}
            cut = max(ours.keys() & theirs.keys(), default=None)
            if cut is None and at == origin + 1:
                break
            wide *= 2
        if cut is None:  # no stable place in the whole chunk: encode it again with as much text after it
            start, end, first = origin, min(len(text), end + max(chunk, end - origin)), 0
            left = encode(text[start:end])
            continue
        total += ours[cut] - first
        left, start, end, first, origin = right, at, right_end, theirs[cut], cut
    return total + len(left.ids) - first


def count_tokens(
    df: DataFrame,
    path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    huge: int = HUGE,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """UTF-8 bytes, tokens and whether the tokens are over ``limit``, for every document.

    Null texts count as empty (0 bytes, 0 tokens, not over).  Repeated rows and null ids are kept; extra columns are
    ignored; no text is cut.
    """

    def kernel():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        guard = 2 + max([len(t.content) for t in library.get_added_tokens_decoder().values()], default=0)

        def encode(text: str):
            return library.encode(text, add_special_tokens=False)

        def work(texts: list) -> dict[str, list]:
            texts = [t or "" for t in texts]
            short = [k for k, t in enumerate(texts) if len(t) <= huge]
            counts = [0] * len(texts)
            for at in range(0, len(short), 256):
                part = short[at : at + 256]
                for k, e in zip(
                    part, library.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True
                ):
                    counts[k] = len(e)
            for k, t in enumerate(texts):
                if len(t) > huge:
                    counts[k] = count_chunked(encode, t, guard, chunk, overlap)
            return {
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": counts,
                "over_limit": [c > limit for c in counts],
            }

        return work

    return map_texts(df, kernel, FIELDS, id_col, text_col)
