"""Merkle manifest of a dataset: a tree of digests for each part of a table, and one over the parts.

Leaves are digests of rows in a canonical form.  Within a part they stand by id; every ``FANOUT`` consecutive nodes become
one, until one is left.  The work goes by aligned blocks of FANOUT ** BLOCK_LEVELS nodes: a block holds whole runs on each
of its levels, so its nodes lie in one matrix of hex bytes that is reshaped by the fanout and hashed level by level.  One
node a block goes on to the next tier, until each tree has one.  On the way back down, each block gets the siblings above
it and finds those within by index arithmetic.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .shared import Scratch

#: Nodes that become one, levels of a block, and length of a digest in hex.
FANOUT, BLOCK_LEVELS, DIGEST = 8, 4, 64
#: The fields of a row, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "left array<string>, right array<string>, subroot string, root string"


def field_form(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its length in UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field_form, values)), 256)


def _matrix(digests) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), dtype=np.uint8).reshape(-1, DIGEST)


def _hashed(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digest of the first ``size`` bytes of each row."""
    data, width = rows.tobytes(), rows.shape[1]
    spans = zip(range(0, len(data), width), sizes.tolist(), strict=True)
    return _matrix([hashlib.sha256(data[a : a + size]).hexdigest() for a, size in spans])


def _runs(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A level as runs of FANOUT nodes, the last one filled up with zeros; and how many nodes each run has."""
    n_runs = -(-len(nodes) // FANOUT)
    full = np.zeros((n_runs * FANOUT, DIGEST), dtype=np.uint8)
    full[: len(nodes)] = nodes
    return full.reshape(n_runs, FANOUT * DIGEST), np.minimum(FANOUT, len(nodes) - FANOUT * np.arange(n_runs))


def levels(nodes: np.ndarray, depth: int) -> list[np.ndarray]:
    """The nodes of a block and of the ``depth`` levels above them."""
    out = [nodes]
    for _ in range(depth):
        rows, held = _runs(out[-1])
        out.append(_hashed(rows, held * DIGEST))
    return out


def depth_of(n: int) -> int:
    """Levels above ``n`` leaves."""
    depth = 0
    while FANOUT**depth < n:
        depth += 1
    return depth


def _within(n: int, tier: int, height: int) -> int:
    """Levels that a block of this tier and of ``height`` levels adds in a tree of ``n`` leaves."""
    return min(max(depth_of(n) - tier * height, 0), height)


def _around(block: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level, of every leaf of the block: its run, its ancestor's slot in the run, and the run's length."""
    index, out = np.arange(len(block[0])), []
    for nodes in block[:-1]:
        rows, held = _runs(nodes)
        run, slot = index // FANOUT, index % FANOUT
        out.append((rows[run].reshape(-1, FANOUT, DIGEST), slot, held[run]))
        index = run
    return out


def _proofs(around: list, count: int, above: bytes) -> list[str]:
    """Digest of each leaf's siblings within the block, level by level, and of those above the block."""
    if not around:
        return [hashlib.sha256(above).hexdigest()] * count
    lanes = np.arange(FANOUT)[None, :]
    wanted = np.concatenate([(lanes != slot[:, None]) & (lanes < held[:, None]) for _, slot, held in around], axis=1)
    data = np.concatenate([rows for rows, _, _ in around], axis=1)[wanted].tobytes()
    ends = np.cumsum(wanted.sum(axis=1)) * DIGEST
    spans = zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)
    return [hashlib.sha256(data[a:b] + above).hexdigest() for a, b in spans]


def _folded(start: np.ndarray, around: list, path: list[tuple[bytes, bytes]]) -> list[str]:
    """The root that follows from each leaf in ``start`` and its siblings in the block and above it."""
    now, each = start, np.arange(len(start))
    for rows, slot, held in around:
        rows = rows.copy()
        rows[each, slot] = now
        now = _hashed(rows.reshape(len(each), -1), held * DIGEST)
    ends = [row.tobytes() for row in now]
    for left, right in path:
        ends = [hashlib.sha256(left + e + right).hexdigest().encode() for e in ends]
    return [e.decode() for e in ends]


def _blocked(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FANOUT**height}"))


def _climber(tier: int, height: int):
    def climb(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        tree, n, at = key
        top = levels(_matrix(block.sort_values("pos")["node"]), _within(n, tier, height))[-1]
        return pd.DataFrame({"tree": [tree], "n": [n], "pos": [at], "node": [top.tobytes().decode()]})

    return climb


def _tiers(leaves: DataFrame, scratch: Scratch, name: str, height: int) -> list[DataFrame]:
    """tree, n, pos, node of each tier: the leaves, one node a block, and so on until each tree has one node."""
    largest = leaves.agg(F.max("n")).first()[0] or 1
    out, tier = [leaves], 0
    while tier == 0 or FANOUT ** (tier * height) < largest:
        below = _blocked(out[-1].select("tree", "n", "pos", "node"), height).groupBy("tree", "n", "block")
        nodes = below.applyInPandas(_climber(tier, height), "tree string, n long, pos long, node string")
        tier += 1
        out.append(scratch.keep(nodes, f"{name}-tier-{tier}"))
    return out


def _descend(nodes: DataFrame, above: DataFrame, tier: int, height: int, columns: str, describe) -> DataFrame:
    """Cogroups each block with the path above it.  ``describe(rows, block levels, path row)`` makes the columns."""

    def run(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        block = levels(_matrix(rows["node"]), _within(int(rows["n"].iloc[0]), tier, height))
        return describe(rows, block, path.iloc[0])

    below = _blocked(nodes, height).groupBy("tree", "block")
    return below.cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(run, columns)


def _paths(rows: pd.DataFrame, block: list[np.ndarray], path: pd.Series) -> pd.DataFrame:
    """tree, pos and the siblings on the left and right of each node of the block, up to the root."""
    around = _around(block)
    made = {"left": [], "right": []}
    for k in range(len(rows)):
        runs = [(r[k].tobytes().decode(), int(s[k]) * DIGEST, int(h[k]) * DIGEST) for r, s, h in around]
        made["left"].append([r[:a] for r, a, _ in runs] + list(path["left"]))
        made["right"].append([r[a + DIGEST : end] for r, a, end in runs] + list(path["right"]))
    out = {"tree": rows["tree"].to_numpy(), "pos": rows["pos"].to_numpy()}
    return pd.DataFrame(out | made | {"subroot": path["subroot"], "root": path["root"]})


def _all_paths(tiers: list[DataFrame], top: DataFrame, scratch: Scratch, name: str, last: int, height: int) -> DataFrame:
    """The paths of the nodes of tier ``last``, from those of the highest tier downwards."""
    paths = top
    for tier in range(len(tiers) - 2, last - 1, -1):
        nodes = tiers[tier].select("tree", "n", "pos", "node")
        made = _descend(nodes, paths, tier, height, f"tree string, pos long, {_PATH}", _paths)
        paths = scratch.keep(made, f"{name}-paths-{tier}")
    return paths


def manifest(df: DataFrame, part_col: str = "lang", altered: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, position.

    ``df`` has the columns of documents; ``altered`` is a text that is checked in place of the row's own (null: the row is
    checked as it is).  A tree stands for each value of ``part_col``, null being one; the trees are ordered by it, null
    first, then by UTF-8 bytes, and within a tree leaves are ordered by id, null first, then by digest.  Rows that repeat
    are leaves each, side by side, with equal results.  Null and empty texts differ in their digests.  A tree of one leaf
    has no siblings: its subroot is the leaf.  An empty table gives an empty result.  Other columns are not read, whatever
    their names.  A block holds FANOUT ** block_levels digests, whatever the sizes of texts, parts and table.
    """
    scratch = Scratch(df.sparkSession, "manifest")
    values = {f: F.col(f) for f in FIELDS}
    changed = F.lit(None).cast("string") if altered is None else row_digest(*(values | {"text": altered}).values())
    checked = changed if altered is None else F.when(altered.isNotNull(), changed)
    part = F.col(part_col).cast("string")
    leaves = df.select(
        F.coalesce(F.concat(F.lit("v"), part), F.lit("n")).alias("tree"),
        "doc_id",
        row_digest(*values.values()).alias("node"),
        checked.alias("checked"),
        F.monotonically_increasing_id().alias("row"),  # splits rows that are alike
    )
    leaves = ranked(scratch.keep(leaves, "leaves"), scratch, "leaves", "tree", "doc_id", "node", "row").drop("row")
    tiers = _tiers(leaves, scratch, "leaves", block_levels)

    parts = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("part"), "node")
    parts = scratch.keep(ranked(parts, scratch, "parts", "tree", "part"), "parts")
    upper = _tiers(parts, scratch, "parts", block_levels)
    none = F.array().cast("array<string>")
    root = F.col("node").alias("root")
    top = upper[-1].select("tree", "pos", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), root)
    found = _all_paths(upper, top, scratch, "parts", 0, block_levels).drop("subroot")
    joined = found.join(parts.select("pos", "part", F.col("node").alias("subroot")), "pos")
    top = joined.select(F.col("part").alias("tree"), F.lit(0).cast("long").alias("pos"), "left", "right", "subroot", "root")
    top = scratch.keep(top, "subroots")

    def describe(rows: pd.DataFrame, block: list[np.ndarray], path: pd.Series) -> pd.DataFrame:
        around = _around(block)
        above = [(a.encode(), b.encode()) for a, b in zip(path["left"], path["right"], strict=True)]
        start = _matrix(rows["checked"].where(rows["checked"].notna(), rows["node"]))
        folded = _folded(start, around, above)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy(),
                "leaf": rows["node"].to_numpy(),
                "subroot": path["subroot"],
                "root": path["root"],
                "proof_sha256": _proofs(around, len(rows), b"".join(a + b for a, b in above)),
                "folded_root": folded,
                "verified": [f == path["root"] for f in folded],
                "position": rows["pos"].to_numpy(),
            }
        )

    columns = (
        "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"
    )
    paths = _all_paths(tiers, top, scratch, "leaves", 1, block_levels)
    # Ids travel as text, as frames would make numbers with nulls inexact
    made = _descend(leaves.withColumn("doc_id", F.col("doc_id").cast("string")), paths, 0, block_levels, columns, describe)
    return made.withColumn("doc_id", F.col("doc_id").cast(df.schema["doc_id"].dataType))


def tampered_manifest(df: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The manifest, checked against a table in which every third row or so, by the checksum of its id, has lost its
    capitals A-Z.  Null texts and rows without an id stay as they are."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest(df, altered=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower), block_levels=block_levels)


#: The same in DuckDB, level by level.
MANIFEST_SQL = r"""
WITH RECURSIVE forms AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
      || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
      || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS body,
    coalesce(strlen(text)::VARCHAR || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
  FROM documents),
crc(k, c) AS (
  SELECT k, list_reduce(list_concat([k], [1, 2, 3, 4, 5, 6, 7, 8]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  FROM (SELECT unnest(range(256)) AS k)),
crc_table AS (SELECT list(c ORDER BY k) AS t FROM crc),
leaves AS (
  SELECT doc_id, lang, sha256(head || body) AS leaf, sha256(head || lowered) AS tampered,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) % 3 = 0 AS hit,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM forms, crc_table),
nodes(lang, level, pos, n, node) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY lang, level, n, pos // 8),
subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes(level, pos, n, node) AS (
  SELECT 0, pos, n, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM upper_nodes WHERE n > 1 GROUP BY level, n, pos // 8),
all_nodes AS (
  SELECT lang, level, pos, n, node FROM nodes WHERE n > 1
  UNION ALL
  SELECT s.lang, 1000 + u.level, u.pos, u.n, u.node FROM upper_nodes u, subroots s WHERE u.n > 1),
steps AS (
  SELECT l.doc_id, a.lang, a.level, l.pos // (8 ** a.level)::BIGINT AS pos, row_number() OVER (PARTITION BY l.doc_id ORDER BY a.level) AS step
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM all_nodes WHERE level < 1000) a ON l.lang IS NOT DISTINCT FROM a.lang
  UNION ALL
  SELECT l.doc_id, s.lang, a.level, s.pos // (8 ** (a.level - 1000))::BIGINT, 1000 + row_number() OVER (PARTITION BY l.doc_id ORDER BY a.level)
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, (SELECT DISTINCT level FROM all_nodes WHERE level >= 1000) a),
around AS (
  SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.step) AS step,
    string_agg(a.node, '' ORDER BY a.pos) FILTER (a.pos < p.pos) AS before,
    string_agg(a.node, '' ORDER BY a.pos) FILTER (a.pos > p.pos) AS after
  FROM steps p JOIN all_nodes a ON p.lang IS NOT DISTINCT FROM a.lang AND p.level = a.level AND p.pos // 8 = a.pos // 8
  GROUP BY p.doc_id, p.step),
fold(doc_id, step, node) AS (
  SELECT doc_id, 0::BIGINT, CASE WHEN hit THEN tampered ELSE leaf END FROM leaves
  UNION ALL
  SELECT f.doc_id, a.step, sha256(coalesce(a.before, '') || f.node || coalesce(a.after, ''))
  FROM fold f JOIN around a ON f.doc_id = a.doc_id AND a.step = f.step + 1),
proofs AS (
  SELECT doc_id, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step)) AS proof, max(step) AS steps
  FROM around GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  f.node AS folded_root, f.node = r.node AS verified, l.pos AS position
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN fold f ON f.doc_id = l.doc_id AND f.step = coalesce(p.steps, 0),
(SELECT node FROM upper_nodes WHERE n = 1) r
"""
