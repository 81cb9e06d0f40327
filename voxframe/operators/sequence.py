"""Ordered sequences: collapsing decoder output, timing tokens, grouping them into words, sentences and turns."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.folds import Fold, fold_in_order
from voxframe.operators.runs import joined_lists, joined_runs, token_runs, unlike_before, unlike_in_lists

ENDS_SENTENCE = "[.?!]"
PUNCTUATION = "^[!-/:-@\\[-`{-~]+$"


def _by(order: str, key: str = "media_id"):
    return Window.partitionBy(key).orderBy(order)


def ctc_collapse(ids: DataFrame, blank: int) -> DataFrame:
    """Frames (media_id, frame, id) without blanks and without repeats of the frame before."""
    before = F.lag("id").over(_by("frame"))
    return ids.withColumn("_before", before).where(
        (F.col("id") != blank) & (F.col("_before").isNull() | (F.col("_before") != F.col("id")))
    ).drop("_before")


def ctc_spans(ids: DataFrame, blank: int, hop: int = 160, rate: int = 16000, stride: int = 1, placed: bool = False) -> DataFrame:
    """Collapsed tokens with times.  A token ends where a different token follows at once, else where it starts; the
    last token ends with the frames.  placed: see ``folds.in_place``."""
    scale = hop * stride / rate
    return token_runs(ids, blank, placed).select(
        "media_id", "frame", "id", (F.col("frame") * scale).alias("start"), (F.col("_end") * scale).alias("end")
    )


def duration_spans(tokens: DataFrame, hop: int = 160, rate: int = 16000, stride: int = 8, tail: float = 0.01) -> DataFrame:
    """Transducer tokens (media_id, pos, frame, piece): start by frame, end where the next token starts, also a special
    one that is dropped afterwards; the last ends ``tail`` later."""
    scale = stride * hop / rate
    timed = tokens.withColumn("start", F.col("frame") * scale)
    timed = timed.withColumn("end", F.coalesce(F.lead("start").over(_by("pos")), F.col("start") + tail))
    return timed.where(~(F.col("piece").rlike("^<.*>$") & (F.col("piece") != "<unk>")))


def proportional_spans(tokens: DataFrame) -> DataFrame:
    """Tokens (media_id, pos, text, duration) without times of their own share the medium's duration evenly."""
    i = F.row_number().over(_by("pos")) - 1
    n = F.count("*").over(Window.partitionBy("media_id"))
    return tokens.withColumn("start", i * F.col("duration") / n).withColumn("end", (i + 1) * F.col("duration") / n)


class DigitSpacing(Fold):
    """Pieces (media_id, pos, piece), spaced; the memory is the run of letters at the end of the text so far, as far as it
    counts: two letters are as good as more."""

    columns = "media_id long, pos long, text string"
    _letters = re.compile(r"[^\W\d_]*\Z")

    def rows(self, key: tuple, memory: str | None, frame: pd.DataFrame) -> tuple[str, list[tuple]]:
        run, out = memory or "", []
        for pos, piece in zip(frame["pos"], frame["piece"], strict=True):
            gap = piece.isascii() and piece.isdigit() and (len(run) > 1 or run.lower() == "a")
            out.append((key[0], pos, " " + piece if gap else piece))
            end = self._letters.search(piece)[0]
            run = (run + piece if len(end) == len(piece) else end)[-2:]
        return run, out


def digit_spacing(tokens: DataFrame) -> DataFrame:
    """Text of each medium from pieces (media_id, pos, piece): an all-digit piece without a leading space gets one after
    more than one trailing letter, or after exactly the letter a."""
    spaced = fold_in_order(tokens.select("media_id", F.col("pos").cast("long").alias("pos"), "piece"), ["media_id"], ["pos"], DigitSpacing())
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return spaced.groupBy("media_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))


def _marked(t: Column) -> Column:
    return t.startswith("▁") | t.startswith(" ")


def _blank(t: Column) -> Column:
    """Whether a token is white space or marks; null without text.  What begins with a sign above all blanks is not."""
    return F.when((t <= " ") | _marked(t), t.rlike("^[\\s▁]*$")).otherwise(t.isNull() & F.lit(None))


def _opens_word(t: Column) -> Column:
    return _marked(t) | (t.rlike(PUNCTUATION) & ~t.isin("'", "-"))


def _word_text(t: Column) -> Column:
    return F.trim(F.replace(t, F.lit("▁"), F.lit(" ")))


def _closes_sentence(t: Column) -> Column:
    return t.contains(".") | t.contains("?") | t.contains("!")


#: PUNCTUATION and blanks as patterns of Arrow: the end may have a line end before it, as in the patterns of columns.
_PUNCTUATION_ARROW = "^[!-/:-@\\[-`{-~]+(?:\\r\\n|[\\n\\r\\x{85}\\x{2028}\\x{2029}])?\\z"
_BLANK_ARROW = "^[ \\t\\n\\x0b\\f\\r▁]*[\\x{85}\\x{2028}\\x{2029}]?\\z"


def words_in_lists(tokens: DataFrame) -> DataFrame:
    """``words_from_tokens`` where each row holds a whole medium: (media_id, rows), rows a list of (text, start, end) in order.
    Rows of the result are lists of (word_no, text, start, end)."""

    def blank(t: pa.Array) -> pa.Array:
        return pc.match_substring_regex(t, _BLANK_ARROW)

    def opens(t: pa.Array) -> pa.Array:
        mark = pc.and_not(pc.match_substring_regex(t, _PUNCTUATION_ARROW), pc.is_in(t, pa.array(["'", "-"])))
        return pc.or_(mark, pc.or_(pc.starts_with(t, "▁"), pc.starts_with(t, " ")))

    def shown(t: pa.Array) -> pa.Array:
        return pc.utf8_trim(pc.replace_substring(t, "▁", " "), " ")

    return joined_lists(tokens, opens, blank, lambda t: pc.invert(blank(t)), lambda t: t, shown, 1, "word_no")


def repeats_in_lists(words: DataFrame) -> DataFrame:
    """``drop_repeated`` for such lists: their words without those that repeat the one before."""
    return unlike_in_lists(words)


def sentences_in_lists(words: DataFrame) -> DataFrame:
    """``sentences_from_words`` for such lists; rows of the result are lists of (sentence_no, text, start, end)."""

    def spaced(t: pa.Array) -> pa.Array:
        return pc.if_else(pc.is_in(t, pa.array(list(".,!?;:)"))), t, pc.binary_join_element_wise(" ", t, ""))

    def always(t: pa.Array) -> pa.Array:
        return pc.is_in(pa.nulls(len(t), pa.string()), pa.array([None], pa.string()))

    return joined_lists(
        words, lambda t: pc.invert(always(t)), lambda t: pc.match_substring_regex(t, ENDS_SENTENCE), always, spaced, lambda t: pc.utf8_ltrim(t, " "), 0, "sentence_no"
    )


def words_from_tokens(tokens: DataFrame, placed: bool = False) -> DataFrame:
    """Words (media_id, word_no, text, start, end) from tokens (media_id, pos, text, start, end).

    A word begins at the medium's first token, at a word mark or space, and at pure punctuation other than apostrophe
    and hyphen.  Tokens of white space only end a word and are dropped.  placed: see ``folds.in_place``.
    """
    t = F.col("text")
    words = joined_runs(tokens, "pos", _opens_word(t), _blank(t), ~_blank(t), 1, "word_no", placed)
    return words.withColumn("text", _word_text(t))


def drop_repeated(words: DataFrame, order: str = "word_no", placed: bool = False) -> DataFrame:
    """Words without those that repeat the one before, whatever their case.  placed: see ``folds.in_place``."""
    return unlike_before(words, order, F.lower("text"), placed)


def sentence_word(word: Column) -> Column:
    """A word as it stands in a sentence: behind a space, but a single closing mark behind none."""
    return F.when(word.isin(*".,!?;:)"), word).otherwise(F.concat(F.lit(" "), word))


def sentences_from_words(words: DataFrame, order: str = "word_no", placed: bool = False) -> DataFrame:
    """Sentences (media_id, sentence_no, text, start, end): a word that contains . ? or ! closes one.  placed: see
    ``folds.in_place``."""
    t = F.col("text")
    closes = _closes_sentence(t)
    rows = words.withColumns({"_closes": closes, "text": sentence_word(t)})
    found = joined_runs(rows, order, F.lit(False), F.col("_closes"), F.lit(True), 0, "sentence_no", placed)
    return found.withColumn("text", F.ltrim("text"))


def speaker_turns(segments: DataFrame, glue: str = " ") -> DataFrame:
    """Runs of one speaker (media_id, turn_no, speaker, start, end, n, text) from (media_id, seg_no, speaker, ...)."""
    w = _by("seg_no")
    changed = F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("long"), F.lit(1))
    runs = segments.withColumn(
        "_changed", changed
    ).withColumn("turn_no", F.sum("_changed").over(w) - 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda t: t["text"])
    return runs.groupBy("media_id", "turn_no", "speaker").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.array_join(texts, glue).alias("text")
    )


def dominant_speaker(segments: DataFrame) -> DataFrame:
    """The most frequent speaker of each medium; the one seen first wins a tie."""
    seen = segments.groupBy("media_id", "speaker").agg(F.count("*").alias("n"), F.min("seg_no").alias("first"))
    best = seen.groupBy("media_id").agg(F.max(F.struct("n", -F.col("first"), "speaker")).alias("best"))
    return best.select("media_id", F.col("best.speaker").alias("speaker"), F.col("best.n").alias("n"))


def speakers_in_order(segments: DataFrame) -> DataFrame:
    """Distinct speakers of each medium by first appearance, and their number."""
    seen = segments.groupBy("media_id", "speaker").agg(F.min("seg_no").alias("first"))
    return seen.groupBy("media_id").agg(
        F.count("*").alias("n_speakers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda s: s["speaker"]), ",").alias(
            "speakers"
        ),
    )


def stream_sentences(chunks: DataFrame, seconds: float = 0.56) -> DataFrame:
    """Sentences of streamed text chunks (media_id, chunk, text): a chunk with . ? or ! closes the sentence, whose end is
    the time before that chunk is added."""
    w = _by("chunk")
    closes = F.col("text").rlike(ENDS_SENTENCE).cast("long")
    grouped = chunks.withColumn("_closes", closes).withColumn(
        "sentence_no", F.sum(F.coalesce(F.lag("_closes").over(w), F.lit(0))).over(w)
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda t: t["text"])
    return grouped.groupBy("media_id", "sentence_no").agg(
        F.trim(F.array_join(texts, "")).alias("text"),
        (F.min("chunk") * seconds).alias("start"),
        (F.max("chunk") * seconds).alias("end"),
    )


def piece_text(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Text of token ids (media_id, pos, id) by a vocabulary (id, piece); unknown ids are left out.

    A vocabulary is small by nature, but its size is left to the planner to judge.
    """
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"])
    joined = F.trim(F.regexp_replace(F.array_join(pieces, ""), "▁", " "))
    return ids.join(vocabulary, "id").groupBy("media_id").agg(joined.alias("text"))


def segment_order(segments: DataFrame) -> DataFrame:
    """Segments with ``place``: by start within a recording; of equal starts the lower speaker comes first, then the earlier row."""
    w = Window.partitionBy("media_id").orderBy("start", "speaker_id", "ord")
    return segments.withColumn("place", F.row_number().over(w) - 1)


def last_seconds(tokens: DataFrame, seconds: int = 30) -> DataFrame:
    """What starts in the last ``seconds`` of each recording; the whole seconds of its length count."""
    whole = F.floor(F.max("end").over(Window.partitionBy("media_id")))
    return tokens.withColumn("_from", whole - seconds).where("start >= _from").drop("_from")


def segment_positions(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """(media_id, seg_no, from, to): where segments stand in the edited text (media_id, text) of their recording.

    Each is searched from the end of the one found before it, so repeated phrases meet their own place; what is not found or
    empty is left out and moves nothing.  Places count characters from 0.
    """

    @F.pandas_udf("array<struct<seg_no long, `from` long, to long>>")
    def places(text: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(t: str | None, rows) -> list[dict]:
            found, at = [], 0
            for row in rows:
                part = (row["text"] or "").strip()
                start = (t or "").find(part, at) if part else -1
                if start >= 0:
                    at = start + len(part)
                    found.append({"seg_no": row["seg_no"], "from": start, "to": at})
            return found

        return pd.Series([one(t, rows) for t, rows in zip(text, wanted, strict=True)])

    row = F.struct(F.col("seg_no").cast("long").alias("seg_no"), "text")
    wanted = segments.groupBy("media_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    both = documents.join(wanted, "media_id").select("media_id", places("text", "_rows").alias("p"))
    return both.select("media_id", F.inline("p"))
