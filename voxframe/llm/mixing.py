"""Mixing of sources to target weights, in DataFrame functions alone.

Each source's share of all words follows its weight, but stops at ``MOST`` times the words that the source has.  A share is
taken copy by copy: whole copies first, then a part of one more.  That part is what lies under a threshold of a 60-bit
hash of the document.  The threshold is found without sorting: words are summed by source and hash bucket, the bucket in
which the budget runs out is split into finer buckets, and so on until that bucket holds one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .shared import Scratch

#: Weights of the sources in their order, repeating, and how often the words of a source are taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of a document's hash, and how many of them a round looks at.
HASH_BITS, ROUND_BITS = 60, 12
_WORD = "[^\\x20\\x09-\\x0D]+"


def n_words(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), F.lit(0)).cast("long")


def row_hash(row_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text, as a long."""
    whole = F.concat(F.coalesce(row_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("long")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def share_out(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (with source_size and weight) and target: all words shared by weight, no target above ``most`` times
    its source's words, the excess shared again by weight until none is above.

    A round adds up what is capped and which weights are left, so that any number of sources is shared out by a few sums.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, weights = int(total or 0), int(weights or 1)
    share, capped = (rest, weights), F.lit(False)
    while rest:
        capped = _exact("source_size") * most * F.lit(weights) < F.lit(rest) * _exact("weight")
        held, left = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * most)), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        share = (int(total) - int(held or 0), int(left))
        if share == (rest, weights):
            break
        rest, weights = share
    fair = F.lit(float(share[0])) * F.col("weight") / F.lit(share[1])
    return sources.withColumn("target", F.when(capped, F.col("source_size").cast("double") * most).otherwise(fair))


def _budgets(sources: DataFrame, most: int) -> DataFrame:
    """One row per source and copy of which a part is taken: key and the words to take of that copy.  As copies nest,
    a source has one such copy at most."""
    goal = F.col("target").cast("decimal(38,0)").cast("long")  # rounded half up
    copies = F.sequence(F.lit(0), F.lit(most - 1))
    each = sources.select("key", "source_size", F.explode(copies).alias("copy"), goal.alias("goal"))
    part = F.least(F.greatest(F.col("goal") - F.col("copy") * F.col("source_size"), F.lit(0)), F.col("source_size"))
    return each.select("key", "copy", "source_size", part.alias("budget"))


def _thresholds(sized: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """key, copy, budget and where it runs out: hash ``limit``, words ``before`` it, and words ``at`` it."""
    start = budgets.where("budget > 0 AND budget < source_size")
    zero = F.lit(0).cast("long")
    cells = scratch.keep(start.select("key", "copy", "budget", zero.alias("prefix"), zero.alias("before")), "cells-0")
    ended, shift, rounds = None, HASH_BITS, 0
    while ended is None or (shift and not cells.isEmpty()):
        prefix = F.shiftright("hash", shift)
        shift, rounds = shift - ROUND_BITS, rounds + 1
        # Only the bucket in which a budget runs out is looked into
        inside = sized.withColumn("prefix", prefix).join(cells, ["key", "prefix"])
        hist = inside.groupBy("key", "copy", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"),
            F.first("budget").alias("budget"), F.first("before").alias("below"),
        )
        upto = Window.partitionBy("key", "copy").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(upto), zero))
        found = hist.where("before <= budget AND budget < before + words")
        found = scratch.keep(found, f"found-{rounds}")
        done = found.where("low = high").select("key", "copy", "budget", F.col("low").alias("limit"), "before", F.col("words").alias("at"))
        ended = done if ended is None else ended.unionByName(done)
        cells = found.where("low < high").select("key", "copy", "budget", F.col("bucket").alias("prefix"), "before")
    return ended


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """doc_id, size (words), source_size, target (of the source) and taken: the words of the document in the mix.

    Sources stand by code point, null last, and have the weights by turns.  A document is taken as often as its hash lies
    under the thresholds of its source; of those at the threshold itself (one, or rows alike) only the part that is left
    of the budget is taken, rounded down.  So each source's words come to its target less a word a row at the threshold.
    Null and empty texts have size 0 and are not taken; a source of such texts alone has target 0.  Rows that repeat, and
    null ids, are rows each, and alike rows are taken alike.  Other columns are not read, whatever their names; an empty
    table gives an empty result.  Texts of any length are counted whole.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    sized = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("v"), source), F.lit("w")).alias("key"),  # null comes last
        n_words(text).alias("size"),
        row_hash(F.col(id_col), text).alias("hash"),
    )
    sized = scratch.keep(sized, "sized")
    sources = scratch.keep(sized.groupBy("key").agg(F.sum("size").alias("source_size")), "totals")
    sources = ranked(sources.withColumn("all", F.lit(0)), scratch, "sources", "all", "key")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("pos", F.lit(len(weights))).cast("int")).cast("long")
    sources = scratch.keep(sources.select("key", "source_size", weight.alias("weight")), "weights")
    sources = scratch.keep(share_out(sources, most), "targets")
    budgets = scratch.keep(_budgets(sources, most), "budgets")
    limits = _thresholds(sized, budgets, scratch)
    plan = (
        budgets.join(limits.drop("budget"), ["key", "copy"], "left")
        .groupBy("key")
        .agg(
            F.sum(F.when((F.col("budget") > 0) & F.col("limit").isNull(), 1).otherwise(0)).alias("copies"),
            F.max("limit").alias("limit"),
            F.max(F.when(F.col("limit").isNotNull(), F.col("budget") - F.col("before"))).alias("left"),
            F.max("at").alias("at"),
        )
    )
    plan = scratch.keep(sources.select("key", "source_size", "target").join(plan, "key"), "plan")
    part = F.expr("cast((cast(size AS decimal(19,0)) * cast(left AS decimal(19,0))) div at AS long)")
    more = F.when(F.col("hash") < F.col("limit"), F.col("size")).when(F.col("hash") == F.col("limit"), part)
    taken = F.col("size") * F.col("copies") + F.coalesce(more, F.lit(0))
    return sized.join(plan, "key").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


#: The same in DuckDB: sums over all hashes in order in place of histograms.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, ''))[1:15])::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::HUGEINT AS s,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(3 * s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_before,
    coalesce(sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM sources),
capped AS (SELECT *, 3 * s * (all_w - w_before) < (total - s_before) * w AS cap FROM ordered),
shares AS (
  SELECT *, total - sum(CASE WHEN cap THEN 3 * s ELSE 0 END) OVER () AS rest,
    sum(CASE WHEN cap THEN 0 ELSE w END) OVER () AS rest_w
  FROM capped),
targets AS (
  SELECT source, s, CASE WHEN cap THEN (3 * s)::DOUBLE ELSE rest::DOUBLE * w::DOUBLE / rest_w::DOUBLE END AS target FROM shares),
goals AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE round(target)::HUGEINT // s END AS copies,
    CASE WHEN s = 0 THEN 0 ELSE round(target)::HUGEINT % s END AS part
  FROM targets),
placed AS (
  SELECT d.*, g.s, g.target, g.copies, g.part,
    sum(d.size) OVER (PARTITION BY d.source, d.hash) AS at_hash,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
  (size * copies + CASE WHEN upto <= part THEN size WHEN upto - at_hash < part THEN size * (part - (upto - at_hash)) // at_hash
   ELSE 0 END)::BIGINT AS taken
FROM placed
"""
