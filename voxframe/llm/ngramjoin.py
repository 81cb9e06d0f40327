"""Similarity join on word n-grams: rare-first prefixes with length, positional and suffix filters.

Documents with the same set of shingles form one class, and only the class's least id takes part.  A set's shingles
are ordered by a corpus-wide count (rare first), and two sets that overlap enough share one of the first few, so
prefixes are joined by shingle.  Of a prefix only the shingles that other prefixes have too can be shared; how many a
document has bounds what it can overlap with, and ordered by their exact number of documents they form a second, shorter
prefix.  A large group of near copies is not expanded into all its pairs: first every member is compared with the
member of each shingle's group that has the fewest shingles of its own, and then only pairs from different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .components import connected
from .hashing import IN_SPACE_WORD, Words, mix, sequence_hash, window_hashes
from .rows import slices, with_id
from .shared import KeyMap, Scratch

#: Words of a shingle; the similarity is NEED / OF.
SHINGLE, NEED, OF = 5, 3, 4
#: Cells of the count sketch for each document, the least and the most of them; cells are moved in chunks.  Every task moves
#: its own sketch, so the most is a small part of what a task reads.
CELLS_A_ROW, LEAST_CELLS, MOST_CELLS, CHUNK = 4, 1 << 20, 1 << 22, 1 << 16
#: Hash ranges of the suffix filter.
RANGES = 64
#: Shingles counted more often, beyond what a cell has of others, are dealt by shingle and salt.
HOT, SALTS = 1 << 16, 64
#: Choices among equally good hubs, by shingle.
HUBS = 4


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for null, empty and blank texts."""
    words = Words(texts, IN_SPACE_WORD)
    windows = window_hashes(words.hashes, SHINGLE)
    out = []
    for start, stop in zip(words.first[:-1], words.first[1:], strict=True):
        if stop - start >= SHINGLE:
            out.append(np.unique(windows[start : stop - SHINGLE + 1]))
        elif stop > start:
            out.append(np.array([sequence_hash(words.hashes[start:stop])]))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _rows(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = np.sum(mix(shingles ^ np.uint64(0x243F6A8885A308D3)), dtype=np.uint64)
    b = np.sum(mix(shingles ^ np.uint64(0x13198A2E03707344)), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _describe(rows: DataFrame, cells: int) -> DataFrame:
    """A row per document (n, k1, k2: its set; ranges: its shingles by hash range), and this task's counts in chunks."""
    schema = with_id(rows.schema["doc_id"], "n long, k1 long, k2 long, ranges binary, chunk int, counts binary")

    def run(batches):
        counts = np.zeros(cells, dtype=np.uint32)  # of one task
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(start, stop - start).to_pylist())
                flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
                np.add.at(counts, (flat % np.uint64(cells)).astype(np.int64), 1)
                keys = [_key(s) for s in sets]
                shift = np.uint64(64 - RANGES.bit_length() + 1)
                ranges = [np.bincount((s >> shift).astype(np.int64), minlength=RANGES).astype("<u4") for s in sets]
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, m),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([r.tobytes() for r in ranges], pa.binary()),
                        pa.nulls(m, pa.int32()),
                        pa.nulls(m, pa.binary()),
                    ],
                    names=schema.names,
                )
        for k in range(cells // CHUNK):
            part = counts[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                kind = next(t for t in ("<u1", "<u2", "<u4") if part.max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, f.type) for f in list(to_arrow_schema(schema))[:5]]
                    + [pa.array([k], pa.int32()), pa.array([part.astype(kind).tobytes()], pa.binary())],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def _sum_chunks(usual: float):
    """Levels of the counts of each chunk over all tasks; a partition holds its own chunks only.

    ``usual`` is what a cell has on the average.  Only what it has beyond that tells its shingles from others: so the
    order stays rare-first where the corpus has many more shingles than there are cells.
    """

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(data, dtype=f"<u{len(data) // CHUNK}").astype(np.int64)
                total[k] = total[k] + part if k in total else part
        for k, part in total.items():
            level = np.minimum(8 * np.log2(np.maximum(part - usual, 0) + 1.0), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()])], names=["chunk", "level"])

    return run


def _prefix_length(n):
    return n - (NEED * n + OF - 1) // OF + 1


def _prefix_length_column(n: Column) -> Column:
    return n - _suffix_length(n)


def _prefixes(rows: DataFrame, levels) -> DataFrame:
    """(doc_id, k1, k2, n, prefix, hot): the rarest shingles of each set, rarest first."""
    schema = with_id(rows.schema["doc_id"], "k1 long, k2 long, n long, prefix array<long>, hot array<boolean>")
    hot_level = min(255, int(8 * np.log2(HOT + 1.0)))

    def run(batches):
        level = levels.value
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(start, stop - start).to_pylist())
                prefix, hot, keys = [], [], []
                for s in sets:
                    keys.append(_key(s))
                    if not len(s):
                        prefix.append([])
                        hot.append([])
                        continue
                    rank = level[(s % np.uint64(len(level))).astype(np.int64)]
                    order = np.lexsort((s, rank))[: _prefix_length(len(s))]
                    prefix.append(s[order].view(np.int64))
                    hot.append(rank[order] >= hot_level)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(sets)),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prefix, pa.list_(pa.int64())),
                        pa.array(hot, pa.list_(pa.bool_())),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def _keyed(rows: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, text) of rows with an id."""

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                sets = shingle_sets(part.column(1).to_pylist())
                keys = [_key(s) for s in sets]
                columns = [[k[0] for k in keys], [k[1] for k in keys], [len(s) for s in sets]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in columns], part.column(1)],
                    names=["doc_id", "k1", "k2", "n", "text"],
                )

    rows = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, text string")


def _in_two(batches):
    """(token, id) of rows (token, salt, id) sorted by token and id whose token more than one id has; salted rows are hot
    and pass.  Repeated rows count once.  Only one row is held between batches."""
    held, passed = None, False  # the last batch's last row, and whether it was passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])])
        batch = batch.take(pa.array(new))
        token, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = token[1:] == token[:-1]
        shared = np.r_[False, same] | np.r_[same, False] | (salt > 0)
        keep = shared.copy()
        if held is not None and passed:
            keep[0] = False
        passed = bool(shared[-1]) or (len(token) == 1 and passed)
        held = batch.slice(batch.num_rows - 1, 1)
        if keep.any():
            some = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2)], names=["token", "id"])


def _suffix_length(n: Column) -> Column:
    return F.floor((NEED * n + OF - 1) / OF) - 1


def _close(x: str, y: str) -> Column:
    """Length filter, and what two documents' shared prefix shingles allow at one that they have in common.

    n: shingles, t: shared ones in the prefix, pos: this one's place among those.  What two documents have in common up
    to the end of the prefix that ends first is shared in both prefixes; beyond it lies no more than that one's suffix.
    """
    n1, t1, p1 = (F.col(c + x) for c in ("n", "t", "pos"))
    n2, t2, p2 = (F.col(c + y) for c in ("n", "t", "pos"))
    q1, q2 = _suffix_length(n1), _suffix_length(n2)
    wanted = NEED * (n1 + n2)  # times NEED + OF

    def enough(most: Column) -> Column:
        return (NEED + OF) * most >= wanted

    least = F.greatest(F.ceil(wanted / (NEED + OF)) - F.greatest(q1, q2), F.lit(1))  # prefix shingles in common
    there = F.least(p1, p2) + 1 + F.least(t1 - p1 - 1, t2 - p2 - 1) + F.greatest(q1, q2)
    return (
        (OF * F.least(n1, n2) >= NEED * F.greatest(n1, n2))
        & enough(F.least(t1, t2) + F.greatest(q1, q2))
        & (p1 <= t1 - least)
        & (p2 <= t2 - least)
        & enough(there)
    )


def _ranges_differ(batches):
    """Suffix filter: sets whose counts by hash range differ too much cannot overlap enough."""
    for batch in batches:
        a, b = (batch.column(k).to_pylist() for k in (2, 3))
        if not a:
            continue
        x, y = (np.frombuffer(b"".join(c), dtype="<u4").reshape(len(c), RANGES).astype(np.int64) for c in (a, b))
        total = x.sum(axis=1) + y.sum(axis=1)
        most = (total - np.abs(x - y).sum(axis=1)) // 2
        keep = pa.array((NEED + OF) * most >= NEED * total)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])


def _similar(batches):
    for batch in batches:
        left, right = (batch.column(k).to_pylist() for k in (2, 3))
        keep = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(OF * both >= NEED * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["u", "v"])


class _Join:
    def __init__(self, texts: DataFrame, scratch: Scratch):
        """texts: one text (id, text) of each class."""
        self.texts, self.scratch = texts, scratch

    def sets_of(self, pairs: DataFrame, name: str) -> DataFrame:
        """(id, shingles) of the documents in pairs.  A map of their ids spares the other texts the shuffle."""
        ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
        ids = self.scratch.keep(ids.withColumn("spread", F.xxhash64("id")), f"{name}-ids")

        wanted = KeyMap(ids, "spread").test()

        def run(batches):
            for batch in batches:
                if wanted is not None:
                    batch = batch.filter(pa.array(wanted(batch.column(2).to_numpy())))
                for start, stop in slices(batch.column(1)):
                    sets = shingle_sets(batch.column(1).slice(start, stop - start).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, stop - start), pa.array([s.tobytes() for s in sets])], names=["id", "shingles"]
                    )

        # One Python worker a task looks ids up and makes the sets
        sets = self.texts.select("id", "text", F.xxhash64("id").alias("spread")).mapInArrow(run, "id long, shingles binary")
        return self.scratch.keep(sets.join(ids.select("id"), "id", "left_semi"), name)

    def links(self, pairs: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are similar, each verified once, as edges (u, v)."""
        near = (
            pairs.join(ranges.select(F.col("id").alias("a"), F.col("ranges").alias("ra")), "a")
            .join(ranges.select(F.col("id").alias("b"), F.col("ranges").alias("rb")), "b")
            .select("a", "b", "ra", "rb")
            .mapInArrow(_ranges_differ, "a long, b long")
        )
        near = self.scratch.keep(near, f"{name}-pairs")
        sets = self.sets_of(near, f"{name}-sets")
        found = (
            near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            .select("a", "b", "sa", "sb")
            .mapInArrow(_similar, "u long, v long")
        )
        found = self.scratch.keep(found, f"{name}-links")
        self.scratch.drop(f"{name}-sets", f"{name}-pairs")
        return found


def _once(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs (a, b) of joined rows, if what follows the last shared place leaves enough."""
    first = F.col("id" + x) < F.col("id" + y)

    def pick(c: str, low: bool) -> Column:
        one, two = (x, y) if low else (y, x)
        return F.when(first, F.col(c + one)).otherwise(F.col(c + two))

    columns = [pick(c, low).alias(c + ("a" if low else "b")) for c in ("id", "n", "t", "pos") for low in (True, False)]
    shared = rows.select(*columns).groupBy(F.col("ida").alias("a"), F.col("idb").alias("b")).agg(
        F.count("*").alias("c"), *[F.max(c + s).alias(c + s) for c in ("n", "t", "pos") for s in "ab"]
    )
    c = F.col
    rest = F.least(c("ta") - c("posa") - 1, c("tb") - c("posb") - 1) + F.greatest(_suffix_length(c("na")), _suffix_length(c("nb")))
    return shared.where((NEED + OF) * (c("c") + rest) >= NEED * (c("na") + c("nb"))).select("a", "b")


def _classes(linkable: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(k1, k2, n, id, own) of the distinct sets: ``id`` is unique, ``own`` is the least document id with the set.

    ``id`` is ``own`` too, but where a document id comes with several sets it can name only one of them; a set that no
    document id is left for gets a hash that is no other's.  The second frame has edges (u, v) between sets of one id,
    or is None where there are none.
    """
    key = ["k1", "k2", "n"]
    pairs = scratch.keep(linkable.select("doc_id", *key).distinct(), "id-sets")
    several = pairs.groupBy("doc_id").agg(F.count("*").alias("sets")).where("sets > 1").select("doc_id")
    several = scratch.keep(several, "several")
    if several.isEmpty():
        found = pairs.groupBy(*key).agg(F.min("doc_id").alias("id"))
        return scratch.keep(found.withColumn("own", F.col("id")), "classes"), None
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(*key))
    first = pairs.join(several, "doc_id", "left_anti").withColumn("turn", F.lit(1))
    first = first.unionByName(pairs.join(several, "doc_id", "left_semi").withColumn("turn", turn))
    found = first.groupBy(*key).agg(F.min(F.when(F.col("turn") == 1, F.col("doc_id"))).alias("id"), F.min("doc_id").alias("own"))
    for salt in range(64):
        named = found.withColumn("id", F.coalesce("id", F.xxhash64(*key, F.lit(salt))))
        named = scratch.keep(named.select(*key, "id", "own"), f"classes-{salt}")
        if named.groupBy("id").count().where("count > 1").isEmpty():
            break
        scratch.drop(f"classes-{salt}")
    else:
        raise ValueError("no free ids for the shingle sets of repeated document ids")
    mine = pairs.join(several, "doc_id").join(named.select(*key, "id"), key).select("doc_id", "id")
    least = mine.groupBy("doc_id").agg(F.min("id").alias("u"))
    return named, scratch.keep(mine.join(least, "doc_id").where("id <> u").select("u", F.col("id").alias("v")), "same-id")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) for every row.

    ``class_id``: least id with the same shingle set; ``component_id``: least id reachable by links of similarity 0.75.
    Documents without words have no shingles and link with nothing.  Rows that repeat an id count as one document: what
    links with one of them links with all.  Rows without an id get null class and component and link with nothing.
    Extra columns are ignored; an empty table gives an empty result.  Ids are integers.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "ngramjoin")
    rows = _rows(documents, id_col, text_col)
    cells = min(max(LEAST_CELLS, 1 << (CELLS_A_ROW * documents.count()).bit_length()), MOST_CELLS)
    described = scratch.keep(_describe(rows, cells), "described")
    docs = described.where("n IS NOT NULL").drop("chunk", "counts")

    # Corpus-wide shingle counts: at most MOST_CELLS bytes on the driver and in each task
    usual = (docs.agg(F.sum("n")).first()[0] or 0) / cells
    chunks = described.where("chunk IS NOT NULL").select("chunk", "counts")
    summed = chunks.repartition(cells // CHUNK, "chunk").mapInArrow(_sum_chunks(usual), "chunk int, level binary")
    level = np.zeros(cells, dtype=np.uint8)
    for chunk, data in summed.collect():
        level[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(data, dtype=np.uint8)
    levels = spark.sparkContext.broadcast(level)

    linkable = docs.where("n > 0 AND doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    classes, same_id = _classes(linkable, scratch)
    own = classes.select("k1", "k2", "n", "id", F.col("own").alias("doc_id"))
    ranges = linkable.join(own, ["doc_id", "k1", "k2", "n"]).groupBy("id").agg(F.first("ranges").alias("ranges"))

    prefixes = _prefixes(rows.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")), levels)
    tokens = (
        prefixes.join(own, ["doc_id", "k1", "k2", "n"])
        .select("id", F.explode(F.arrays_zip("prefix", "hot")).alias("t"))
        .select(
            F.col("t.prefix").alias("token"),
            F.when(F.col("t.hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int") + 1).otherwise(0).alias("salt"),
            "id",
        )
    )
    shared = tokens.repartition("token", "salt").sortWithinPartitions("token", "id").mapInArrow(_in_two, "token long, id long")
    shared = scratch.keep(shared, "shared")
    # The texts by class; rows of one id are told apart by their sets only where there are such
    if same_id is None:
        texts = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    else:
        texts = _keyed(rows).join(own, ["doc_id", "k1", "k2", "n"]).select("id", "text")
    join = _Join(texts, scratch)

    # Shared shingles of each document in the order of their exact number of documents
    often = shared.groupBy("token").agg(F.count("*").alias("df"))
    mine = Window.partitionBy("id")
    placed = (
        shared.join(often, "token")
        .withColumn("pos", F.row_number().over(mine.orderBy("df", "token")).cast("long") - 1)
        .withColumn("t", F.count("*").over(mine))
        .join(classes.select("id", "n"), "id")
        .select("token", "id", "n", "t", "pos")
    )
    placed = scratch.keep(placed, "placed")
    scratch.drop("shared")

    # Each document against one hub a shingle: the one that has the fewest shingles of its own
    c = F.col
    own = _prefix_length_column(c("n")) - c("t")
    best = F.max(F.struct(-own, F.xxhash64("id", F.pmod("token", F.lit(HUBS))), "id", "n", "t", "pos")).alias("h")
    hubs = placed.groupBy("token").agg(best).select("token", *[c(f"h.{k}").alias(k + "2") for k in ("id", "n", "t", "pos")])
    star = placed.join(hubs, "token").where((c("id") != c("id2")) & _close("", "2"))
    links = join.links(_once(star, "", "2"), ranges, "star")
    label = connected(links, scratch, "star-component")

    # What is left: pairs that share a rare shingle and lie in different components.  Of a shingle's components the
    # largest is met by all others, so no pairs inside it are looked at.
    placed = placed.join(label, "id", "left").select(
        "token", "id", "n", "t", "pos", F.coalesce("component", "id").alias("component")
    )
    sizes = placed.groupBy("token", "component").count()
    main = sizes.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("count", "component"))["component"].alias("main"))
    open_ = placed.join(main.where("parts > 1").drop("parts"), "token")
    open_ = scratch.keep(open_, "open")
    left = open_.where("component <> main").drop("main")
    right = open_.select("token", "main", *[c(k).alias(k + "2") for k in ("id", "n", "t", "pos", "component")])
    cross = left.join(right, "token").where(
        (c("component") != c("component2")) & ((c("component2") == c("main")) | (c("id") < c("id2"))) & _close("", "2")
    )
    rest = _once(cross, "", "2")
    more = join.links(rest, ranges, "rest")
    both = links.unionAll(more)
    if same_id is not None:
        both = both.unionAll(same_id)
    label = connected(both, scratch, "component")
    scratch.drop("placed", "open", "id-sets", "several")

    labelled = classes.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if same_id is not None:  # ids of sets are not all ids of documents: the least of these names the component
        least = labelled.groupBy("component").agg(F.min("own").alias("least"))
        labelled = labelled.join(least, "component").drop("component").withColumnRenamed("least", "component")
    classed = docs.join(labelled.select("k1", "k2", "n", F.col("own").alias("id"), "component"), ["k1", "k2", "n"], "left")
    known = c("doc_id").isNotNull()
    return classed.select(
        "doc_id",
        c("n").alias("n_shingles"),
        F.when(known, F.coalesce("component", c("doc_id").cast("long"))).alias("component_id"),
        F.when(known, F.coalesce("id", c("doc_id").cast("long"))).alias("class_id"),
    )
