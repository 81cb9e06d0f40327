"""Benchmark decontamination by template windows and slot consistency.

Texts become templates: numbers, units after numbers, and names (capitalised words inside a sentence) turn into typed
placeholders.  Windows of template tokens are hash-joined between benchmark items and documents.  Matches on one
diagonal (document position minus item position) belong together where their slots agree.  Each slot is judged alone: a
name must meet its most frequent counterpart both ways; of a number or unit and its counterpart, one must be the
other's most frequent, since the values of two slots can coincide in either text.  Only windows that hold a conflicting
slot are dropped.  So a question with other numbers or names is caught, and a text that only shares a template's words
in disorder is not.

Beside the templates, windows of the plain lower-case words are joined, so that a verbatim copy is found whatever its
words look like: all capitals, mostly numbers and names, shorter than a window, or after a mark that ends no sentence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import BYTE, IN_LETTER_WORD, LOWER, mix, span_hashes, window_hashes
from .rows import slices, with_id

#: Tokens of a window, and the least that must be words rather than placeholders in a window of a template.
WINDOW, LEAST_WORDS = 8, 5
#: An item is leaked if half of its windows match, or this many of a long item.
SHARE, ENOUGH = 0.5, 12
#: Bits of the map that tells which window hashes the benchmark can have; its size is fixed.
MAP_BITS = 1 << 23
#: Unit words, as they follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb ml cl l s sec min h hr hrs ms hz khz mhz ghz b kb mb gb tb w kw v a k c f "
    "meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms ton tons liter "
    "liters litre litres inch inches foot feet yard yards mile miles pound pounds ounce ounces second seconds minute "
    "minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree "
    "degrees"
).split()
#: Windows of plain words have hashes of their own.
_PLAIN = np.uint64(0x94D049BB133111EB)
#: The lowest bits of a slot's value tell its kind.
_KIND, _KINDS = 3, {"number": 1, "unit": 2, "name": 3}
NUMBER, UNIT, NAME = (mix(np.array([k], dtype=np.uint64))[0] for k in (101, 102, 103))
_TABLES = {
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "point": np.isin(np.arange(256), [44, 46]),
    "stop": np.isin(np.arange(256), [10, 13, 33, 46, 58, 63]),
    "blank": np.isin(np.arange(256), [32, 9, 34, 39, 40, 41, 42, 91, 93]),
}


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join([*words, ""]).encode(), dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    return mix(span_hashes(BYTE[np.where(data == 32, 0, data)], np.r_[0, gaps[:-1] + 1], gaps))


def _spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of words."""
    flat = IN_LETTER_WORD[raw]
    digit = _TABLES["digit"][raw]
    inner = np.flatnonzero(_TABLES["point"][raw[1:-1]] & digit[:-2] & digit[2:]) + 1
    flat[inner] = True
    edge = np.flatnonzero(np.diff(np.r_[False, flat, False]))
    return edge[::2], edge[1::2]


_UNIT_HASHES = np.sort(_hash_words(UNITS))


class Templates:
    """Template tokens of texts: tokens (a hash or a placeholder), values (the word's hash and the kind where it is a slot, else 0).

    words: the hash of every token in lower case.  A point or comma between digits belongs to the number; a word that
    begins with a digit is a number.
    """

    def __init__(self, texts: list):
        data = [(t or "").encode() for t in texts]
        raw = np.frombuffer(b"\n".join([*data, b""]), dtype=np.uint8)
        is_ = {k: v[raw] for k, v in _TABLES.items()}
        starts, ends = _spans(raw)
        at = np.r_[0, np.cumsum([len(d) + 1 for d in data], dtype=np.int64)]
        self.first = np.searchsorted(starts, at)
        if (raw < 128).all():
            low, spans = LOWER[raw], (starts, ends)
        else:  # lower case can have other lengths, but has the same words
            low = np.frombuffer("\n".join([*((t or "").lower() for t in texts), ""]).encode(), np.uint8)
            spans = _spans(low)
        flat = np.where(_TABLES["point"][low], 46, np.where(IN_LETTER_WORD[low], low, 0))
        self.words = words = mix(span_hashes(BYTE[flat], *spans))
        number = is_["digit"][starts]
        place = np.minimum(np.searchsorted(_UNIT_HASHES, words), len(_UNIT_HASHES) - 1)
        unit = (_UNIT_HASHES[place] == words) & np.r_[False, number[:-1]]
        # A sentence begins where the last byte before the word that is neither blank nor quote is a stop
        solid = np.where(is_["blank"], -1, np.arange(len(raw)))
        before = np.maximum.accumulate(np.r_[-1, solid])[starts]
        opens = (before < 0) | is_["stop"][np.maximum(before, 0)]
        name = is_["upper"][starts] & ~opens
        unit[self.first[:-1][np.diff(self.first) > 0]] = False  # the number before it is another text's
        slot = number | unit | name
        self.tokens = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, words)))
        kind = np.where(number, _KINDS["number"], np.where(unit, _KINDS["unit"], _KINDS["name"])).astype(np.uint64)
        self.values = np.where(slot, words & ~np.uint64(_KIND) | kind, np.uint64(0))

    def windows(self, size: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and position of every window inside one text: of plain words, or of a template with words enough."""
        hashes = window_hashes(self.words ^ _PLAIN if plain else self.tokens, size)
        n = len(hashes)
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        good = owner[:n] == owner[size - 1 : size - 1 + n]
        if n and not plain:
            total = np.r_[0, np.cumsum(self.values == 0)]
            good &= total[size:] - total[:-size] >= LEAST_WORDS
        good = np.flatnonzero(good)
        return hashes[good], owner[good], good


def _window_rows(df: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...], bits=None) -> DataFrame:
    """(hash, id, pos, slots, size, plain) of windows; only those in the map if there is one.

    In the documents (where there is a map) the slots of a plain window are all its words, as any may be the item's slot.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    schema = T.StructType(
        [
            T.StructField("hash", T.LongType()),
            rows.schema["doc_id"],
            *T.StructType.fromDDL("pos int, slots array<long>, size int, plain boolean").fields,
        ]
    )

    # No template of fewer tokens has words enough
    ways = [(size, plain) for size in sizes for plain in (False, True) if plain or size >= LEAST_WORDS]

    def run(batches):
        known = bits.value if bits is not None else None
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                made = Templates(part.column(1).to_pylist())
                for size, plain in ways:
                    hashes, owner, at = made.windows(size, plain)
                    if known is None:  # an item has windows of one size
                        own = np.minimum(np.diff(made.first), WINDOW)[owner] == size
                        hashes, owner, at = hashes[own], owner[own], at[own]
                    else:
                        cell = hashes % np.uint64(MAP_BITS)
                        hit = (known[cell // np.uint64(64)] >> (cell % np.uint64(64))) & np.uint64(1) != 0
                        hashes, owner, at = hashes[hit], owner[hit], at[hit]
                    if plain and size < WINDOW:  # it is the whole item: one place in a text is enough
                        _, once = np.unique(np.c_[owner.astype(np.uint64), hashes], axis=0, return_index=True)
                        hashes, owner, at = hashes[once], owner[once], at[once]
                    values = made.words if plain and known is not None else made.values
                    slots = values[at[:, None] + np.arange(size)].view(np.int64) if len(at) else np.zeros((0, size), np.int64)
                    for k in range(0, len(at), 1 << 16):
                        cut = slice(k, k + (1 << 16))
                        few = slots[cut]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(hashes[cut].view(np.int64)),
                                part.column(0).take(pa.array(owner[cut])),
                                pa.array((at - made.first[owner])[cut].astype(np.int32)),
                                pa.ListArray.from_arrays(
                                    pa.array(np.arange(len(few) + 1, dtype=np.int32) * size), pa.array(few.ravel())
                                ),
                                pa.array(np.full(len(few), size, dtype=np.int32)),
                                pa.array(np.full(len(few), plain)),
                            ],
                            names=["hash", "doc_id", "pos", "slots", "size", "plain"],
                        )

    return rows.mapInArrow(run, schema)


def _sizes(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n): template tokens of each item."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    schema = with_id(rows.schema["item_id"], "n int")

    def run(batches):
        for batch in batches:
            n = np.diff(Templates(batch.column(1).to_pylist()).first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], names=["item_id", "n"])

    return rows.where("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, schema)


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    enough: int = ENOUGH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, n_slots, exact) for every document that holds a benchmark item.

    ``n_windows``: windows of the item found, as plain words or as templates whose slots agree on their diagonal;
    ``exact``: all slot values equal.  An item is found if windows enough are, of all or of those that can be templates.
    Rows without id or text are not matched.  A repeated document id is matched with all its texts together, a
    repeated item id likewise.  Items shorter than a window are one window and, where it has fewer than LEAST_WORDS
    words outside slots, found verbatim only; items without a word match nothing.  An empty table gives an empty
    result; extra columns are ignored.
    """
    spark = documents.sparkSession
    # At most WINDOW distinct sizes
    lengths = _sizes(benchmark, item_col, item_text_col).where("n > 0")
    sizes = tuple(sorted(r[0] for r in lengths.select(F.least("n", F.lit(WINDOW))).distinct().collect())) or (WINDOW,)
    items = _window_rows(benchmark, item_col, item_text_col, sizes).withColumnsRenamed(
        {"doc_id": "item_id", "pos": "item_pos", "slots": "item_slots"}
    )
    # The map of possible hashes: a fixed number of words, whatever the benchmark's size
    cell = F.pmod(F.col("hash"), F.lit(MAP_BITS))  # MAP_BITS is a power of two: the same for signed and unsigned
    cells = (
        items.select((cell / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(hash, 64) as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    table = np.zeros(MAP_BITS // 64, dtype=np.uint64)
    table[cells["word"].to_numpy(dtype=np.int64)] = cells["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    hits = _window_rows(documents, id_col, text_col, sizes, spark.sparkContext.broadcast(table))

    # Every slot of the item in a window, and what the document has there; the document's word is of the item's kind
    slots: Column = F.filter(
        F.transform(
            F.arrays_zip("item_slots", "slots"),
            lambda p, k: F.struct(
                (F.col("item_pos") + k).alias("at"),
                p["item_slots"].alias("item"),
                p["slots"].bitwiseAND(F.lit(~_KIND)).bitwiseOR(p["item_slots"].bitwiseAND(F.lit(_KIND))).alias("doc"),
            ),
        ),
        lambda s: s["item"] != 0,
    )
    line = ["doc_id", "item_id", "diagonal"]
    found = (
        hits.join(items, ["hash", "size", "plain"])
        .select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_pos", "plain", slots.alias("slots"))
        .repartition(*line)  # the windows below need no other exchange
        .select(*line, "item_pos", "plain", F.explode_outer("slots").alias("slot"))
        .select(*line, "item_pos", "plain", "slot.*")
    )
    # Weight of a pair of values: the places that have it, then the earlier one, so that a tie has one winner
    same = Window.partitionBy(*line, "item", "doc")
    weight = F.struct(F.size(F.collect_set("at").over(same)).alias("n"), (-F.min("at").over(same)).alias("first"), "item", "doc")
    found = found.withColumn("weight", weight)
    best_of_item = F.max("weight").over(Window.partitionBy(*line, "item")) == F.col("weight")
    best_of_doc = F.max("weight").over(Window.partitionBy(*line, "doc")) == F.col("weight")
    name = F.col("item").bitwiseAND(F.lit(_KIND)) == _KINDS["name"]
    agrees = F.when(name, best_of_item & best_of_doc).otherwise(best_of_item | best_of_doc)
    # A verbatim window stands whatever the others say
    windows = (
        found.withColumn("agrees", F.col("item").isNull() | agrees)
        .groupBy(*line, "item_pos", "plain")
        .agg(
            F.bool_and("agrees").alias("agrees"),
            F.collect_set(F.when(F.col("item").isNotNull(), F.struct("diagonal", "item", "doc"))).alias("slots"),
        )
        .where("plain OR agrees")
    )
    total = items.groupBy("item_id").agg(
        F.countDistinct("item_pos").alias("n_item_windows"),
        F.collect_set(F.when(~F.col("plain"), F.col("item_pos"))).alias("templates"),
    )
    of_templates = F.size(F.array_intersect("found", "templates"))

    def least(n: Column) -> Column:
        return F.least(F.ceil(n * F.lit(share)), F.lit(enough))

    return (
        windows.groupBy("doc_id", "item_id")
        .agg(
            F.collect_set("item_pos").alias("found"),
            F.size(F.array_distinct(F.flatten(F.collect_set("slots")))).cast("long").alias("n_slots"),
            F.bool_and(F.forall("slots", lambda s: s["item"] == s["doc"])).alias("exact"),
        )
        .withColumn("n_windows", F.size("found").cast("long"))
        .join(total, "item_id")
        .where(
            (F.col("n_windows") >= least(F.col("n_item_windows")))
            | ((F.size("templates") > 0) & (of_templates >= least(F.size("templates"))))
        )
        .select("doc_id", "item_id", "n_windows", "n_item_windows", "n_slots", "exact")
    )
