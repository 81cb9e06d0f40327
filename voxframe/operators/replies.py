"""Text that comes in pieces: model replies streamed as lines, and tokens whose letters span several pieces."""

from __future__ import annotations

import codecs
import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators.folds import Fold, fold_in_order

#: The three kinds of streams that replies come in.
NDJSON, CHAT_EVENTS, BLOCK_EVENTS = "ndjson", "chat", "blocks"


def read_line(kind: str, line: bytes) -> tuple[str, bool, str | None]:
    """(text, whether the reply ends here, error) of one line.  What is no data, or no JSON object, gives nothing.

    ndjson: ``response`` of each object, until ``done``; chat: ``choices[0].delta.content`` after ``data: ``, until [DONE];
    blocks: ``delta.text`` of content_block_delta events, until message_stop or an error event.
    """
    line = line.strip()
    if kind != NDJSON:
        if not line.startswith(b"data: "):
            return "", False, None
        line = line[6:]
        if kind == CHAT_EVENTS and line == b"[DONE]":
            return "", True, None
    try:
        value = json.loads(line)
    except ValueError:
        return "", False, None
    if not isinstance(value, dict):
        return "", False, None
    if kind == NDJSON:
        return value.get("response") or "", bool(value.get("done")), None
    if kind == CHAT_EVENTS:
        first = (value.get("choices") or [{}])[0]
        return (first.get("delta") or {}).get("content") or "", False, None
    event = value.get("type")
    if event == "error":
        return "", True, str((value.get("error") or {}).get("message"))
    text = (value.get("delta") or {}).get("text") or "" if event == "content_block_delta" else ""
    return text, event == "message_stop", None


class StreamedReplies(Fold):
    """(reply_id, seq, text) of pieces (reply_id, seq, kind, data binary): what each piece adds; and, once no piece
    follows, a row without a seq that has the error of the reply, or null.

    Pieces may be cut anywhere, inside a line or a letter: the memory is the line that is not yet whole.  What follows the
    end of a reply is left out.  A chat reply without text is an error.
    """

    columns = "reply_id long, seq long, text string, error string"

    def start(self, key: tuple) -> dict:
        return {"tail": b"", "kind": None, "done": False, "error": None, "any": False}

    def _lines(self, memory: dict, data: bytes) -> str:
        *lines, memory["tail"] = (memory["tail"] + data).split(b"\n")
        out = []
        for line in lines:
            if memory["done"]:
                break
            text, memory["done"], memory["error"] = read_line(memory["kind"], line)
            out.append(text)
        return "".join(out)

    def rows(self, key: tuple, memory: dict, frame: pd.DataFrame) -> tuple[dict, list[tuple]]:
        out = []
        for seq, kind, data in zip(frame["seq"], frame["kind"], frame["data"], strict=True):
            memory["kind"] = memory["kind"] or kind
            text = self._lines(memory, bytes(data or b""))
            memory["any"] |= bool(text)
            out.append((key[0], seq, text, None))
        return memory, [r for r in out if r[2]]

    def end(self, key: tuple, memory: dict) -> list[tuple]:
        text = self._lines(memory, b"\n")  # a last line may lack its end
        error = memory["error"]
        if error is None and memory["kind"] == CHAT_EVENTS and not (text or memory["any"]):
            error = "empty reply"
        return [(key[0], None, text, error)]


def streamed_replies(pieces: DataFrame) -> DataFrame:
    """(reply_id, text, error) of pieces (reply_id, seq, kind, data): each whole reply, without blanks at its ends."""
    parts = fold_in_order(pieces.select("reply_id", "seq", "kind", "data"), ["reply_id"], ["seq"], StreamedReplies())
    placed = F.struct(F.col("seq").isNull().alias("last"), "seq", "text")
    ordered = F.array_sort(F.collect_list(placed))
    whole = F.array_join(F.transform(ordered, lambda p: p["text"]), "")
    return parts.groupBy("reply_id").agg(whole.alias("text"), F.max("error").alias("error")).select(
        "reply_id", F.when(F.col("error").isNull(), F.regexp_replace("text", "(?U)^\\s+|\\s+$", "")).alias("text"), "error"
    )


_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")
_SPECIAL = re.compile(r"<(?!unk>)[^<>]*>|\[(?:CLS|SEP|PAD|BOS|EOS)\]")


@lru_cache(1 << 16)
def _piece_bytes(piece: str) -> bytes:
    byte = _BYTE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else b"" if _SPECIAL.fullmatch(piece) else piece.replace("▁", " ").encode()


class ProgressiveText(Fold):
    """(media_id, pos, text, start, end) of tokens (media_id, pos, piece, start, end): what each adds to the text so far.

    A piece's low bar is a space, which the text does not begin with; ``<0xNN>`` is a byte; special pieces add nothing.  A
    letter in several pieces is added by the one that completes it, with that one's time.  Tokens that add nothing go.
    """

    columns = "media_id long, pos long, text string, start double, end double"

    def start(self, key: tuple) -> tuple:
        return (b"", 0), True

    def rows(self, key: tuple, memory: tuple, frame: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        state, first = memory
        decoder, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        decoder.setstate(state)
        for pos, piece, start, end in zip(*(frame[c].tolist() for c in ("pos", "piece", "start", "end")), strict=True):
            text = decoder.decode(_piece_bytes(piece))
            if first and text:
                text, first = text.removeprefix(" "), False
            if text:
                out.append((key[0], pos, text, start, end))
        return (decoder.getstate(), first), out


def progressive_text(tokens: DataFrame, placed: bool = False) -> DataFrame:
    """See ProgressiveText; one pass over the sorted tokens of a medium, not a prefix for each of them.  placed: see
    ``folds.in_place``."""
    rows = tokens.selectExpr("media_id", "pos", "piece", "cast(start AS double) AS start", "cast(end AS double) AS end")
    return fold_in_order(rows, ["media_id"], ["pos"], ProgressiveText(), placed=placed)
