"""Removal of repeated byte strings with a logarithmic family of sampled suffix arrays.

Suffixes are sampled by content: of every stretch of LENGTH bytes the place with the least hash of GRAM bytes is kept, so
equal stretches keep equal places, and two suffixes that share a stretch share their first GRAM bytes.  A suffix array
level is a table of such suffixes in buckets by their beginning, sorted within each.  A new batch is sorted the same
way and merge-scanned against the levels bucket by bucket, so no level is shuffled again; what shares its beginning with
something else goes on.  Levels of equal weight merge, so an entry is rewritten a logarithmic number of times.

What is removed is decided by bytes: suffixes with the same BLAKE2b digest of their whole context are copies, the
contexts of the others that share a beginning are compared by true suffix arrays (prefix doubling over their bytes), and
rows are told apart by 128 bits of the SHA-256 of their texts.  Beginnings that very many suffixes share stay out of the
levels: their contexts meet by digests of ever longer stretches, partly aggregated before each shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import BYTE, mix, span_hashes
from .rows import lean, slices, with_id
from .shared import KeyMap, Scratch

#: Bytes of a stretch that must not start twice, and of the hashed beginnings.
LENGTH, GRAM = 200, 32
#: Batches of a run over one table.
BATCHES = 4
#: Context bytes sorted together; beginnings of more suffixes than WIDE stay out of the levels, and if they have more
#: contexts than that, these are compared by digests of stretches instead.
SORTED_BYTES, WIDE = 1 << 20, 2_000
#: Suffixes of about so many bytes of text from which on a beginning is counted as one that may be wide.
HEAVY, HEAVY_BYTES = 8, 32 << 20
#: Starts of stretches that are told apart together in the first look at a wide beginning's contexts.
STEP = 34
_KEY, _CLASS = ["k1", "k2"], ["gram", "c1", "c2"]
_ENTRY = "gram long, c1 long, c2 long, k1 long, k2 long, lo int, hi int, at int, batch int, heavy boolean"


def _row_keys(text: Column) -> list[Column]:
    """128 bits of the SHA-256 of a text as two longs."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long").alias(name) for at, name in ((1, "k1"), (17, "k2"))]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def digests(data, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of data[start:end] as rows of two numbers."""
    view, digest = memoryview(data), hashlib.blake2b
    made = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(made, dtype=np.int64).reshape(-1, 2)


def sampled_suffixes(data: list[bytes], length: int = LENGTH, gram: int = GRAM, bits: int = 64):
    """(owner, gram hash, context digests, lo, hi, at) of every sampled suffix.

    Stretches that start from lo to hi have it as their least place, which is lo + at; its context is all bytes of those
    stretches.  ``bits``: how many of the hash are used.
    """
    size = np.array([len(d) for d in data], dtype=np.int64)
    joined = b"".join(data)
    raw = np.frombuffer(joined, dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    nothing = none, none, none.reshape(0, 2), none, none, none
    if len(raw) < length:
        return nothing
    places = np.arange(len(raw) - gram + 1)
    grams = mix(span_hashes(BYTE[raw], places, places + gram)) & np.uint64((1 << bits) - 1)
    packed = (mix(grams) >> np.uint64(32) << np.uint64(32)) | places.astype(np.uint64)
    least = (_sliding_least(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.r_[0, np.cumsum(size)]
    room = np.repeat(first[1:], size)[: len(least)] - np.arange(len(least))
    starts = np.flatnonzero(room >= length)
    if not len(starts):
        return nothing
    place = least[starts]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    lo, hi = starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]]
    owner = np.searchsorted(first, lo, side="right") - 1
    at = place[new]
    return owner, grams[at].view(np.int64), digests(joined, lo, hi + length), lo - first[owner], hi - first[owner], at - lo


def _entries(rows: DataFrame, length: int, batches: int, bits: int) -> DataFrame:
    """The sampled suffixes of rows (k1, k2, text).  A text that a task has seen before is left out: one of a task's
    copies stands for them all, and texts that repeat are removed whole anyway."""

    def counted(parts: list[tuple]):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        _, which, count = np.unique(columns[0], return_inverse=True, return_counts=True)
        columns += [columns[4] % batches, count[which] >= HEAVY]
        types = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.bool_()]
        table = pa.Table.from_arrays(
            [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True)],
            names=[f.split()[0] for f in _ENTRY.split(", ")],
        )
        yield from table.to_batches(max_chunksize=1 << 16)

    def run(frames):
        seen: set[tuple[int, int]] = set()
        parts, size = [], 0
        for batch in frames:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            fresh = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            batch = batch.take(pa.array(fresh, pa.int64()))
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                owner, gram, ctx, lo, hi, at = sampled_suffixes(texts, length, bits=bits)
                k1, k2 = (part.column(c).to_numpy()[owner] for c in (0, 1))
                parts.append((gram, ctx[:, 0], ctx[:, 1], k1, k2, lo, hi, at))
                size += sum(map(len, texts))
                if size >= HEAVY_BYTES:  # whatever the size of Arrow's batches
                    yield from counted(parts)
                    parts, size = [], 0
        if parts:
            yield from counted(parts)

    return rows.mapInArrow(lean(run), _ENTRY)


def _classes(entries: DataFrame) -> DataFrame:
    """(gram, c1, c2, n, k1, k2, lo, hi, at): suffixes with one context, their number, and one of them."""
    one = [F.first(c).alias(c) for c in (*_KEY, "lo", "hi", "at")]
    return entries.groupBy(*_CLASS).agg(F.count("*").alias("n"), *one)


class SuffixLevels:
    """Levels of sampled suffixes, each in buckets by its suffixes' beginnings and sorted in them.

    ``add`` takes a batch's entries and returns the classes that share a beginning with another one of the batch and the
    levels, the levels' own included; levels of equal weight then merge.  Nothing but the batch is shuffled.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"suffixes_{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []
        self.made = self.merged = 0

    def _write(self, classes: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        writer = classes.write.bucketBy(self.buckets, "gram").sortBy("gram")
        writer.option("path", f"{self.scratch.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def _scan(self, batch: str) -> DataFrame:
        new = self.spark.table(batch)
        levels = [self.spark.table(name) for _, name in self.levels]
        due = new.groupBy("gram").agg((F.count("*") + F.max("n")).alias("weight"))
        for k, level in enumerate(levels):
            known = level.select("gram", F.lit(True).alias(f"in_{k}")).distinct()
            due = due.join(known, "gram", "left")
        shared = due.where(" OR ".join(["weight > 2", *(f"in_{k}" for k in range(len(levels)))])).select("gram")
        found = new.join(shared, "gram", "left_semi")
        for level in levels:
            found = found.unionAll(level.join(shared, "gram", "left_semi"))
        return found

    def add(self, entries: DataFrame, last: bool = False) -> DataFrame:
        """``last``: no batch will follow, so the levels need not be kept up."""
        weight, name = 1, self._write(_classes(entries.repartition(self.buckets, "gram")))
        found = self.scratch.keep(self._scan(name), f"found-{self.made}")
        if last:
            self._drop(name)
            self.clear()
            return found
        while self.levels and self.levels[-1][0] == weight:
            weight, (_, other) = weight * 2, self.levels.pop()
            both = self.spark.table(other).unionAll(self.spark.table(name))
            one = [F.first(c).alias(c) for c in (*_KEY, "lo", "hi", "at")]
            merged = self._write(both.groupBy(*_CLASS).agg(F.sum("n").alias("n"), *one))
            for old in (name, other):
                self._drop(old)
            name = merged
            self.merged += 1
        self.levels.append((weight, name))
        return found

    def clear(self) -> None:
        for _, name in self.levels:
            self._drop(name)
        self.levels = []


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each context the starts of stretches that start more than once among all contexts, by prefix doubling.

    A rank stands for the first 8, 16, ... bytes of a suffix; a suffix whose rank nothing shares drops out.
    """
    flat = np.frombuffer(b"".join(contexts) + bytes(8), dtype=np.uint8)
    size = np.array([len(c) for c in contexts], dtype=np.int64)
    first = np.r_[0, np.cumsum(size)]
    n = int(first[-1])
    word = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | flat[k : k + n]
    room = np.repeat(first[1:], size) - np.arange(n)

    def ranked(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A rank from 1 for every key that occurs twice at least, 0 elsewhere."""
        rank = np.zeros(n, dtype=np.int64)
        if len(at):
            order = np.argsort(keys, kind="stable")
            sorted_ = keys[order]
            new = np.r_[True, sorted_[1:] != sorted_[:-1]]
            alone = new & np.r_[new[1:], True]
            rank[at[order]] = np.where(alone, 0, np.cumsum(new))
        return rank

    have = 8
    at = np.flatnonzero(room >= have)
    rank = ranked(word[at], at)
    while have < length:
        step = min(have, length - have)
        at = np.flatnonzero((rank > 0) & (room >= have + step))
        at = at[rank[at + step] > 0]
        rank = ranked(rank[at] * np.int64(n + 1) + rank[at + step], at)
        have += step
    hits = np.flatnonzero(rank)
    owner = np.searchsorted(first, hits, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(contexts) + 1))
    return [hits[a:b] - first[k] for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]


_CONTEXT = "gram long, broad boolean, twice boolean, k1 long, k2 long, lo int, at int, context binary"


def _cut(length: int):
    """Contexts out of rows (k1, k2, text, asks)."""

    def run(batches):
        for batch in batches:
            lists, texts = batch.column(3), batch.column(2)
            bounds, asks = lists.offsets.to_numpy(), lists.values
            field = {f: asks.field(f).to_numpy(zero_copy_only=False) for f in ("gram", "broad", "twice", "lo", "hi", "at")}
            for k in range(batch.num_rows):
                data = texts[k].as_py().encode()
                for start in range(bounds[k], bounds[k + 1], 4096):
                    some = slice(start, min(start + 4096, bounds[k + 1]))
                    lo, hi = field["lo"][some].tolist(), field["hi"][some].tolist()
                    m = len(lo)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array(field[f][some]) for f in ("gram", "broad", "twice")],
                            *[pa.array(np.full(m, batch.column(c)[k].as_py(), dtype=np.int64)) for c in (0, 1)],
                            *[pa.array(field[f][some]) for f in ("lo", "at")],
                            pa.array([data[a : b + length] for a, b in zip(lo, hi, strict=True)], pa.binary()),
                        ],
                        names=[f.split()[0] for f in _CONTEXT.split(", ")],
                    )

    return run


def _compare(length: int):
    """Repeated runs among the contexts of rows sorted by beginning; about SORTED_BYTES are compared together."""

    def run(batches):
        held: list[tuple] = []
        weight = 0

        def settle(some: list[tuple]):
            out = []
            for (_, twice, k1, k2, lo, _), starts in zip(some, repeated_starts([r[5] for r in some], length), strict=True):
                if not twice and len(starts):
                    out += [(k1, k2, lo + int(a), lo + int(b)) for a, b in zip(*_runs(starts), strict=True)]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[*_KEY, "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if weight >= SORTED_BYTES and row[0] != held[-1][0]:
                    yield settle(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[5])
        if held:
            yield settle(held)

    return run


def _stretches(length: int, first_look: bool):
    """Digests of stretches of contexts (k1, k2, lo, at, context, steps).

    First look: one for each STEP starts, of the bytes that all stretches from there have; else one for each start that the
    steps hold.
    """

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column(4), 1 << 18):
                part = batch.slice(start, stop - start)
                data, at = part.column(4).to_pylist(), part.column(3).to_pylist()
                steps = [None] * len(data) if first_look else part.column(5).to_pylist()
                base, owner, begin, step = 0, [], [], []
                for k, (context, place) in enumerate(zip(data, at, strict=True)):
                    for s in range((place + STEP) // STEP) if first_look else steps[k]:
                        low, high = max(place - STEP * s - STEP + 1, 0), min(place - STEP * s, len(context) - length)
                        if low <= high:
                            found = [place - STEP * s] if first_look else range(low, high + 1)
                            begin += [base + b for b in found]
                            owner += [k] * len(found)
                            step += [s] * len(found)
                    base += len(context)
                begin, owner = np.array(begin, dtype=np.int64), np.array(owner, dtype=np.int64)
                made = digests(b"".join(data), begin, begin + (length - STEP + 1 if first_look else length))
                offset = np.r_[0, np.cumsum([len(c) for c in data])][owner]
                lo = part.column(2).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(made[:, c]) for c in (0, 1)],
                        *[part.column(c).take(pa.array(owner)) for c in (0, 1)],
                        pa.array(lo),
                        pa.array((np.array(step, dtype=np.int32) if first_look else (begin - offset + lo).astype(np.int32))),
                    ],
                    names=["d1", "d2", *_KEY, "lo", "place"],
                )

    return run


_STRETCH = "d1 long, d2 long, k1 long, k2 long, lo int, place int"


def _to_runs(batches):
    for batch in batches:
        out = []
        for k1, k2, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            out += [(k1, k2, int(a), int(b)) for a, b in zip(*_runs(np.unique(places)), strict=True)]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[*_KEY, "lo", "hi"])


def _broad_ranges(contexts: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(k1, k2, lo, hi) of repeated runs among contexts whose beginnings have too many of them for one task.

    Two equal stretches also agree in what all stretches of their step have; so only steps that something shares are
    looked at start by start.
    """

    def shared(rows: DataFrame, *more: str) -> DataFrame:
        often = rows.groupBy("d1", "d2", *more).count().where("count > 1").drop("count")
        return rows.join(often, ["d1", "d2", *more], "left_semi")

    looked = contexts.select(*_KEY, "lo", "at", "context", F.lit(None).cast("array<int>").alias("steps"))
    looked = scratch.keep(looked.mapInArrow(_stretches(length, True), _STRETCH), "looked")
    steps = shared(looked, "place").groupBy(*_KEY, "lo").agg(F.collect_set("place").alias("steps"))  # a few for each context
    again = contexts.join(steps, [*_KEY, "lo"])
    each = again.select(*_KEY, "lo", "at", "context", "steps").mapInArrow(_stretches(length, False), _STRETCH)
    each = scratch.keep(each, "stretches")
    starts = shared(each).join(contexts.where("NOT twice"), [*_KEY, "lo"], "left_semi")
    # At most as many as a context has
    return starts.groupBy(*_KEY, "lo").agg(F.collect_list("place").alias("places")).select(*_KEY, "places").mapInArrow(
        _to_runs, "k1 long, k2 long, lo int, hi int"
    )


def _repeated_ranges(rows: DataFrame, entries: DataFrame, shared: DataFrame, broad: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """(k1, k2, lo, hi): stretches from lo to hi that start elsewhere too."""
    spread = [f(c).alias(f"{name}_{c}") for c in (*_KEY, "lo") for name, f in (("low", F.min), ("top", F.max))]
    one = [F.first(c).alias(c) for c in (*_KEY, "lo", "hi", "at")]
    twice = F.expr("n > 1 OR low_k1 <> top_k1 OR low_k2 <> top_k2 OR low_lo <> top_lo")
    # A class is found once a scan, from each level that has it
    classes = shared.groupBy(*_CLASS).agg(F.max("n").alias("n"), *one, *spread).withColumn("twice", twice)
    classes = scratch.keep(classes.select(*_CLASS, *_KEY, "lo", "hi", "at", "twice"), "classes")

    again = classes.where("twice").select(*_CLASS)
    alike = KeyMap(again, "c1").filter(entries.select(*_CLASS, *_KEY, "lo", "hi")).join(again, _CLASS, "left_semi").select(*_KEY, "lo", "hi")

    kinds = classes.groupBy("gram").count().where("count > 1").join(broad.withColumn("broad", F.lit(True)), "gram", "left")
    kinds = kinds.select("gram", F.coalesce("broad", F.lit(False)).alias("broad"))
    asked = classes.join(kinds, "gram").groupBy(*_KEY).agg(
        F.collect_list(F.struct("gram", "broad", "twice", "lo", "hi", "at")).alias("asks")  # as many as the text has places
    )
    asked = scratch.keep(asked, "asked")
    texts = KeyMap(asked, "k1").filter(rows.select(*_KEY, "text")).dropDuplicates(_KEY)
    contexts = texts.join(asked, _KEY).select(*_KEY, "text", "asks").mapInArrow(_cut(length), _CONTEXT)
    contexts = scratch.keep(contexts, "contexts")
    few = contexts.where("NOT broad").select("gram", "twice", *_KEY, "lo", "context")
    partly = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(length), "k1 long, k2 long, lo int, hi int")
    ranges = alike.unionAll(partly)
    if not broad.isEmpty():
        ranges = ranges.unionAll(_broad_ranges(contexts.where("broad"), scratch, length))
    return ranges


FIELDS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut_out(data: bytes, ranges: list, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    kept, at, removed, spans, end = [], 0, 0, 0, -1
    for lo, hi in sorted(ranges):
        stop = hi + length
        if lo > end:
            kept.append(data[at:lo])
            spans += 1
            removed += stop - lo
        else:
            removed += max(0, stop - end)
        end = max(end, stop)
        at = end
    kept.append(data[at:])
    return removed, spans, b"".join(kept)


def remove_repeats(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    batches: int = BATCHES,
    wide: int = WIDE,
    with_text: bool = False,
    hash_bits: int = 64,
) -> DataFrame:
    """Every row with its text's repeated stretches taken out: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``with_text`` adds kept: what is left, decoded (bytes of a character that was cut are left out).  Null texts count as
    empty.  A row that repeats another's text is a copy like any other, whatever its id: both lose all that is long
    enough.  Null ids are kept; extra columns are ignored; an empty table gives an empty result.  Matches do not cross
    documents.  ``wide`` and ``hash_bits`` (bits of the hash that orders the suffixes) change the work, not the result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffixdedup")
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).alias("doc_id"), text.alias("text"), *_row_keys(text))
    usable = rows.where(F.octet_length("text") >= length)
    entries = scratch.keep(_entries(usable.select(*_KEY, "text"), length, batches, hash_bits), "entries")

    # Beginnings of very many suffixes: few, since each has more than ``wide``
    hot = entries.where("heavy").groupBy("gram").count().where(F.col("count") > wide).select("gram")
    hot = scratch.keep(hot, "hot")
    levels, shared = SuffixLevels(scratch), None
    for k in range(batches):
        found = levels.add(entries.where(F.col("batch") == k).join(hot, "gram", "left_anti"), last=k == batches - 1)
        shared = found if shared is None else shared.unionAll(found)
    crowd = scratch.keep(_classes(entries.join(hot, "gram", "left_semi")), "crowd")
    broad = scratch.keep(crowd.groupBy("gram").count().where(F.col("count") > wide).select("gram"), "broad")
    ranges = _repeated_ranges(rows, entries, shared.unionByName(crowd), broad, scratch, length)

    again = usable.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1")
    ranges = ranges.unionAll(again.select(*_KEY, F.lit(0).alias("lo"), (F.col("size") - length).cast("int").alias("hi")))
    by_row = ranges.groupBy(*_KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))  # as many as the text has places
    by_row = scratch.keep(by_row, "ranges")
    scratch.drop("entries", "found", "contexts", "asked", "classes", "crowd", "looked", "stretches")
    wanted = KeyMap(by_row, "k1")
    schema = with_id(rows.schema["doc_id"], FIELDS if with_text else FIELDS.replace(", kept string", ""))

    def finish(ids, texts, ranges):
        out = []
        for text, some in zip(texts, ranges, strict=True):
            data = (text or "").encode()
            removed, spans, kept = _cut_out(data, [(r["lo"], r["hi"]) for r in some or ()], length)
            row = (len(data), removed, spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()][: 5 if with_text else 4]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([ids, *columns], names=schema.names)

    def untouched(batches):
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                part = batch.slice(start, stop - start)
                yield finish(part.column(1), part.column(2).to_pylist(), [()] * part.num_rows)

    def touched(batches):
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                yield finish(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist())

    # The map is exact for what it excludes: those rows lose nothing.  The others meet their ranges by key.
    found = wanted.filter(rows.select(*_KEY, "doc_id", "text")).join(by_row, _KEY, "left")
    done = found.select("doc_id", "text", "ranges").mapInArrow(touched, schema)
    free = wanted.filter(rows.select("k1", "doc_id", "text"), inside=False)
    return done if free is None else free.mapInArrow(untouched, schema).unionAll(done)
