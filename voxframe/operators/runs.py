"""Runs of neighbouring rows, found as rows go by in order: no window holds a medium, and no list of rows is sorted anew.

Rows come as Arrow batches; what is carried from batch to batch is the run that is not yet whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from voxframe.operators.folds import in_place

#: Rows of a medium meet by this key.
KEY = "media_id"
#: Of an array of texts: which ones have a property; what becomes of them.
Test = Change = Callable[[pa.Array], pa.Array]


def changes(values: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Whether each value differs from the one before it; ``before`` is the last one of the batch before, as one value."""
    known = before is not None and len(before) > 0
    joined = pa.concat_arrays([before, values]) if known else values
    a, b = joined[:-1], joined[1:]
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    differ = differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return differ if known else np.r_[True, differ]


def _true(flags: pa.Array) -> np.ndarray:
    return pc.fill_null(flags, False).to_numpy(zero_copy_only=False)


def _flag(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def joined_runs(rows: DataFrame, order: str, opens: Column, closes: Column, kept: Column, first: int, number: str, placed: bool) -> DataFrame:
    """(media_id, number, text, start, end) of rows (media_id, order, text, start, end): the texts of a run put together, its
    least start and its last end.

    A run begins at the first row of a medium, where ``opens`` holds, and after a row where ``closes`` does; runs are numbered
    from ``first``.  Rows that are not ``kept`` count for the numbers alone.
    """
    flags = [F.coalesce(c, F.lit(False)).alias(n) for c, n in ((opens, "_opens"), (closes, "_closes"), (kept, "_kept"))]
    wanted = rows.select(KEY, order, F.coalesce("text", F.lit("")).alias("text"), F.col("start").cast("double"), F.col("end").cast("double"), *flags)
    schema = StructType([rows.schema[KEY], StructField(number, LongType()), StructField("text", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, closed, count, held = None, False, 0, None
        names = [f.name for f in schema]

        def made(table: pa.Table, begins: np.ndarray) -> pa.RecordBatch:
            """One row of each run; ``begins`` has the row that each begins with, and the number of rows."""
            at, last = pa.array(begins[:-1]), pa.array(begins[1:] - 1)
            texts = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), table["text"].combine_chunks())
            start = np.fmin.reduceat(table["start"].to_numpy(), begins[:-1])
            return pa.RecordBatch.from_arrays(
                [table[KEY].take(at).combine_chunks(), table[number].take(at).combine_chunks(), pc.binary_join(texts, ""), pa.array(start, from_pandas=True), table["end"].take(last).combine_chunks()], names
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            other, closes_ = changes(batch.column(KEY), key), _flag(batch, "_closes")
            new = other | _flag(batch, "_opens") | np.r_[closed, closes_[:-1]]
            counted = np.cumsum(new)
            starts = np.flatnonzero(other)
            # Before the first row of a further medium the count goes on
            bases = np.r_[count, 1 - counted[starts]]
            numbers = counted + bases[np.cumsum(other)]
            key, closed, count = batch.column(KEY)[-1:], bool(closes_[-1]), int(numbers[-1])
            fresh = pa.table([batch.column(KEY), pa.array(numbers + (first - 1)), batch.column("text"), batch.column("start"), batch.column("end")], names)
            fresh = fresh.filter(batch.column("_kept"))
            table = fresh if held is None else pa.concat_tables([held, fresh])
            if not table.num_rows:
                continue
            edge = changes(table[KEY].combine_chunks(), None) | changes(table[number].combine_chunks(), None)
            begins = np.flatnonzero(edge)
            if len(begins) > 1:
                yield made(table.slice(0, begins[-1]), begins)
            held = table.slice(begins[-1]).combine_chunks()
        if held is not None and held.num_rows:
            yield made(held, np.array([0, held.num_rows]))

    return in_place(wanted, [KEY], [order], placed).mapInArrow(run, schema)


def unlike_before(rows: DataFrame, order: str, value: Column, placed: bool) -> DataFrame:
    """Rows whose value differs from that of the row before in their medium."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("_value")
            before = pa.concat_arrays([pa.nulls(1, values.type) if last is None else last, values])[:-1]
            differs = pc.or_(pc.is_null(before), pc.fill_null(pc.not_equal(before, values), False))
            kept = pc.or_(pa.array(changes(batch.column(KEY), key)), differs)
            key, last = batch.column(KEY)[-1:], values[-1:]
            yield batch.filter(kept).select(batch.schema.names[:-1])

    return in_place(rows.withColumn("_value", value), [KEY], [order], placed).mapInArrow(run, rows.schema)


def token_runs(ids: DataFrame, blank: int, placed: bool) -> DataFrame:
    """(media_id, frame, id, _end) of frames (media_id, frame, id): each run of an id that is not blank.

    A run ends where another id that is not blank follows at once, else where it starts; the last one ends with the frames.
    Two runs ahead tell which; so many are carried.
    """
    schema = StructType([*(ids.schema[c] for c in (KEY, "frame", "id")), StructField("_end", LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = frame = None

        def made(heads: pa.Table, ends: list[int], whole: bool) -> tuple[pa.RecordBatch, pa.Table]:
            """What is known of the runs, and those that wait for more; ``ends``: where the frames of each whole medium end."""
            medium = np.cumsum(changes(heads[KEY].combine_chunks(), None)) - 1
            at, speaks = heads["frame"].to_numpy(), heads["id"].to_numpy() != blank
            n = len(at)
            one = np.r_[medium[1:] == medium[:-1], False]
            two = np.r_[medium[2:] == medium[:-2], False, False][:n] if n > 1 else np.zeros(n, bool)
            next_speaks, next_at = np.r_[speaks[1:], False] & one, np.r_[at[1:], 0]
            total = np.array([*ends, 0])[medium]
            end = np.where(next_speaks, next_at, np.where(two, at, total))
            known = n if whole else max(int(np.searchsorted(medium, medium[-1])), n - 2)
            out = heads.append_column("_end", pa.array(end, pa.int64())).slice(0, known).filter(pa.array(speaks[:known]))
            return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], [f.name for f in schema]), heads.slice(known)

        for batch in batches:
            if not batch.num_rows:
                continue
            other, frames = changes(batch.column(KEY), key), batch.column("frame").to_numpy()
            heads = other | changes(batch.column("id"), None if held is None else held["id"].combine_chunks()[-1:])
            ends = np.r_[0 if frame is None else frame, frames][:-1][other] + 1
            ends = ends[1:] if frame is None else ends
            key, frame = batch.column(KEY)[-1:], int(frames[-1])
            fresh = pa.Table.from_batches([batch.select([KEY, "frame", "id"])]).filter(pa.array(heads))
            table = (fresh if held is None else pa.concat_tables([held, fresh])).combine_chunks()
            out, held = made(table, ends.tolist(), False)
            held = held.combine_chunks()
            yield out
        if held is not None:
            yield made(held, [frame + 1], True)[0]

    return in_place(ids.select(KEY, "frame", "id"), [KEY], ["frame"], placed).mapInArrow(run, schema)


def joined_lists(lists: DataFrame, opens: Test, closes: Test, kept: Test, before: Change, after: Change, first: int, number: str) -> DataFrame:
    """``joined_runs`` where each row holds a whole medium: (media_id, rows), rows a list of (text, start, end) in order.

    What it gives is of that form too, with the number first.  ``opens``, ``closes`` and ``kept`` say of an array of texts
    which ones do; null counts as no.  ``before`` changes texts before they are joined, ``after`` the joined ones.  Lists go
    to Python whole: a row of its own for each of their elements costs more than the work on it.
    """
    names = [number, "text", "start", "end"]
    made = StructType([StructField(number, LongType()), StructField("text", StringType()), StructField("start", DoubleType()), StructField("end", DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("rows")
            rows = held.flatten()
            texts, begin, end = (rows.field(c) for c in ("text", "start", "end"))
            medium = np.repeat(np.arange(len(held)), pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
            found, owners = [pa.array([], t) for t in (pa.int64(), pa.string(), pa.float64(), pa.float64())], medium[:0]
            if len(medium):
                other = np.r_[True, medium[1:] != medium[:-1]]
                counted = np.cumsum(other | _true(opens(texts)) | np.r_[False, _true(closes(texts))[:-1]])
                numbers = counted - (counted[np.flatnonzero(other)] - 1)[np.cumsum(other) - 1] + (first - 1)
                stay = np.flatnonzero(_true(kept(texts)))
                medium, numbers = medium[stay], numbers[stay]
                texts, begin, end = (x.take(pa.array(stay)) for x in (pc.fill_null(before(texts), ""), begin, end))
            if len(medium):
                at = np.flatnonzero(np.r_[True, (medium[1:] != medium[:-1]) | (numbers[1:] != numbers[:-1])])
                ends = np.r_[at[1:], len(medium)]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[at, len(medium)], pa.int32()), texts), "")
                start = np.fmin.reduceat(pc.cast(begin, pa.float64()).to_numpy(zero_copy_only=False), at)
                found = [pa.array(numbers[at]), after(joined), pa.array(start, from_pandas=True), pc.cast(end, pa.float64()).take(pa.array(ends - 1))]
                owners = medium[at]
            offsets = np.r_[0, np.cumsum(np.bincount(owners, minlength=len(held)))]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(found, names))], [KEY, "rows"])

    return lists.select(KEY, "rows").mapInArrow(run, StructType([lists.schema[KEY], StructField("rows", ArrayType(made))]))


def unlike_in_lists(lists: DataFrame) -> DataFrame:
    """``unlike_before`` for lists that hold a whole medium: without rows whose text is that of the row before, whatever case."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("rows")
            rows = held.flatten()
            lengths = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
            medium = np.repeat(np.arange(len(held)), lengths)
            texts = rows.field("text").dictionary_encode()
            low = pa.array([None if t is None else t.lower() for t in texts.dictionary.to_pylist()], pa.string()).take(texts.indices)
            stay = np.r_[True, (medium[1:] != medium[:-1])][: len(medium)] | changes(low, None)[: len(medium)]
            kept = rows.take(pa.array(np.flatnonzero(stay)))
            offsets = np.r_[0, np.cumsum(np.bincount(medium[stay], minlength=len(held)))]
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), kept)], [KEY, "rows"])

    return lists.select(KEY, "rows").mapInArrow(run, lists.select(KEY, "rows").schema)
