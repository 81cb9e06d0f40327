"""Places where a model or a service plugs in: speech recognition, language models, translation.

A port is a factory, called once per task, that gives a function on batches; deterministic stand-ins are included.
A row that fails keeps its input and says so; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxframe.functions.phrases import reply_language_head, reply_language_tail
from voxframe.functions.text import fill_prompt
from voxframe.operators.folds import ModelFold, fold_in_order
from voxframe.operators.render import prompt_plain, prompt_text
from voxframe.operators.sequence import speaker_turns


class Recogniser(Protocol):
    def __call__(self, samples: list, rate: int) -> list[tuple[str, float, float]]:
        """Timed tokens of one recording."""


class TextModel(Protocol):
    def __call__(self, prompt: str) -> str:
        """A model's reply."""


def recognise(audio: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """(media_id, pos, text, start, end, status, error) of audio (media_id, sample_rate, samples)."""
    schema = "media_id long, pos int, text string, start float, end float, status string, error string"

    def run(frames: Iterable[pd.DataFrame]):
        model = factory()
        for frame in frames:
            out = []
            for row in frame.itertuples():
                try:
                    tokens = model(row.samples, row.sample_rate)
                    out += [(row.media_id, k, t, s, e, "ok", None) for k, (t, s, e) in enumerate(tokens)]
                except Exception as e:  # noqa: BLE001  any failure of a plugged-in model is this row's
                    out.append((row.media_id, None, None, None, None, "error", str(e)))
            yield pd.DataFrame(out, columns=["media_id", "pos", "text", "start", "end", "status", "error"]).astype(
                {"pos": "Int32"}
            )

    return audio.select("media_id", "sample_rate", "samples").mapInPandas(run, schema)


def correct_text(df: DataFrame, factory: Callable[[], TextModel], prompt: str = "prompt", text: str = "text") -> DataFrame:
    """The frame with ``corrected`` and ``failed``: the model's reply, the text itself where that fails or is empty."""
    schema = StructType([*df.schema.fields]).add("corrected", "string").add("failed", "boolean")

    def run(frames: Iterable[pd.DataFrame]):
        model = factory()
        for frame in frames:
            replies, failed = [], []
            for ask, own in zip(frame[prompt], frame[text], strict=True):
                try:
                    reply = (model(ask) or "").strip()
                    replies.append(reply or own)
                    failed.append(not reply)
                except Exception:  # noqa: BLE001
                    replies.append(own)
                    failed.append(True)
            yield frame.assign(corrected=replies, failed=failed)

    return df.mapInPandas(run, schema)


def analyse_whole(
    segments: DataFrame, template: str, factory: Callable[[], TextModel], lang_name: str = "", dictionary: str = "", plain: bool = False
) -> DataFrame:
    """(media_id, text, corrected, failed): a model's reply on each whole recording, asked with the template.

    Plain profiles read the texts alone, the others speakers and times too; where the model fails, the transcript stands.
    """
    whole = prompt_plain(segments) if plain else prompt_text(segments)
    name = F.lit(lang_name)
    ask = F.concat(
        reply_language_head(name), fill_prompt(F.lit(template), F.col("text"), F.lit(None).cast("string"), F.lit(dictionary)), reply_language_tail(name)
    )
    return correct_text(whole.withColumn("prompt", ask), factory).drop("prompt")


class InTurn(ModelFold):
    """Segments (media_id, seg_no, text) corrected one after another; the memory is the corrected text before."""

    columns = "media_id long, seg_no long, text string, corrected string"

    def rows(self, key: tuple, memory: str | None, frame: pd.DataFrame) -> tuple[str, list[tuple]]:
        before, out = memory or "", []
        for seg_no, text in zip(frame["seg_no"], frame["text"], strict=True):
            try:
                before = (self.model(text, before) or "").strip() or text
            except Exception:  # noqa: BLE001  any failure of a plugged-in model keeps the segment
                before = text
            out.append((key[0], seg_no, text, before))
        return before, out


def correct_in_turn(segments: DataFrame, factory: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """(media_id, seg_no, text, corrected): each segment corrected with the corrected one before it as context; a failure
    keeps that segment's text."""
    return fold_in_order(segments.select("media_id", "seg_no", "text"), ["media_id"], ["seg_no"], InTurn(factory))


def translate_by_table(df: DataFrame, table: DataFrame, src: str, tgt: str, text: str = "text") -> DataFrame:
    """The frame with ``translated`` by a table (src, tgt, text, translated); what it lacks reads "[TGT] text"."""
    rows = table.where((F.col("src") == src) & (F.col("tgt") == tgt)).select(F.col("text").alias("_t"), F.col("translated").alias("_x"))
    return df.join(rows, df[text] == F.col("_t"), "left").withColumn(
        "translated", F.coalesce("_x", F.concat(F.lit(f"[{tgt.upper()}] "), F.col(text)))
    ).drop("_t", "_x")


def translate_turns(segments: DataFrame, translate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(media_id, seg_no, speaker, text, translated, failed): turns of one speaker are translated as one text and their
    lines dealt back by place; a missing line keeps the segment's text, a failed turn is flagged.

    ``translate`` adds ``translated`` (null on failure) to a frame with ``text``.
    """
    w = Window.partitionBy("media_id").orderBy("seg_no")
    changed = F.coalesce((F.lag("speaker").over(w) != F.col("speaker")).cast("long"), F.lit(1))
    placed = segments.withColumn("_c", changed).withColumn("turn_no", F.sum("_c").over(w) - 1).drop("_c")
    placed = placed.withColumn("_k", F.row_number().over(Window.partitionBy("media_id", "turn_no").orderBy("seg_no")) - 1)
    turns = translate(speaker_turns(segments, "\n").select("media_id", "turn_no", "text"))
    lines = F.filter(F.transform(F.split("translated", "\n"), F.trim), lambda x: x != "")
    dealt = turns.select("media_id", "turn_no", lines.alias("_lines"))
    return placed.join(dealt, ["media_id", "turn_no"], "left").select(
        "media_id",
        "seg_no",
        "speaker",
        "text",
        F.coalesce(F.get("_lines", F.col("_k")), F.col("text")).alias("translated"),
        F.col("_lines").isNull().alias("failed"),
    )


class Transducer(ModelFold):
    """Tokens of frames (media_id, frame, vector) in order; the memory is the model's state, how many frames to leave out,
    and the numbers of frames and tokens so far."""

    columns = "media_id long, pos int, id int, frame int"

    def __init__(self, factory: Callable[[], Callable], blank: int, most: int = 10):
        super().__init__(factory)
        self.blank, self.most = blank, most

    def start(self, key: tuple) -> tuple:
        return None, 0, 0, 0

    def rows(self, key: tuple, memory: tuple, frame: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        (state, skip, t, pos), out = memory, []
        for vector in frame["vector"]:
            here = 0
            while not skip:
                token, duration, after = self.model(state, vector)
                if token != self.blank:
                    out.append((key[0], pos, token, t))
                    state, here, pos = after, here + 1, pos + 1
                if duration > 0 or token == self.blank or here >= self.most:
                    skip = max(duration, 1)
            skip, t = skip - 1, t + 1
        return (state, skip, t, pos), out


def greedy_transducer(frames: DataFrame, factory: Callable[[], Callable], blank: int, most: int = 10) -> DataFrame:
    """(media_id, pos, id, frame) by a step function (state, frame vector) -> (id, duration, state): a blank or a positive
    duration moves on, at most ``most`` tokens come from one frame.  Frames: (media_id, frame, vector)."""
    return fold_in_order(frames.select("media_id", "frame", "vector"), ["media_id"], ["frame"], Transducer(factory, blank, most))


#: Languages an attention decoder knows, by the order of their prompt tokens.
PROMPT_LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "uk")


def prompt_ids(lang_ids: dict[str, int], src: str, tgt: str, fixed: dict[str, int], context: str = "context"):
    """Ids that an attention decoder starts from: context mark, context, start, emotion, languages, punctuation and the
    switches for normalisation, timestamps and diarization."""
    for lang in (src, tgt):
        if lang not in lang_ids:
            raise ValueError(f"unknown language {lang}")
    names = ("context", "start", "emotion")
    tail = ("punctuation", "no_normalisation", "no_timestamps", "no_diarization")
    lead = F.array(F.lit(fixed[names[0]]))
    rest = F.array(
        *[F.lit(fixed[n]) for n in names[1:]], F.lit(lang_ids[src]), F.lit(lang_ids[tgt]), *[F.lit(fixed[n]) for n in tail], F.lit(fixed["first"])
    )
    return F.concat(lead, F.coalesce(F.col(context), F.array().cast("array<int>")), rest)
