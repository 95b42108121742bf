"""A Merkle manifest of a dataset, and proofs of its rows by octopus multiproofs.

Every row is a leaf, the leaves of a group (a language) form a tree, and the groups' roots form one more tree. A tree
is built in strides: tasks take aligned runs of 2^STRIDE nodes, derive the levels above them and hand on the top, so
a tree of n leaves takes log2(n) / STRIDE short jobs, and no task holds more than one run.

A proof of a row is the list of the siblings on its way to the root. Proofs of the rows of one run share nearly all of
them. So a run of leaves first computes the coordinates of the nodes that it can neither see nor derive: level by
level the siblings of what is known, less what is known. That union is fetched once, by one join; the interior nodes
that proofs share are derived once; and only then single proofs are expanded, in the task, from what it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm.hot_join import join_facts
from tarnwork.plans.shared import written

#: Nodes of a run: 2^STRIDE.
STRIDE = 10
#: Rows whose id has a checksum that this divides are tampered with.
TAMPERED = 7


def digest(parts: Iterable[str]) -> str:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def size_at(n: int, level: int) -> int:
    """Nodes at a level of a tree of n leaves."""
    return -(-n >> level) if level else n


def missing(n: int, held: np.ndarray) -> list[tuple[int, int]]:
    """Coordinates (level, index), fewest possible, of the nodes that the held leaves need to reach the root of n leaves.

    Siblings that are held themselves, or follow from what is held and fetched below, are not among them.
    """
    out, level, known = [], 0, np.unique(held)
    while size_at(n, level) > 1:
        beside = np.setdiff1d(known ^ 1, known)
        out += [(level, int(i)) for i in beside[beside < size_at(n, level)]]
        level, known = level + 1, np.unique(known >> 1)
    return out


class Multiproof:
    """The levels of a tree above some of its leaves, derived once from these and the fetched nodes."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.levels: list[dict[int, str]] = []
        level, known = 0, dict(leaves)
        while size_at(n, level) > 1:
            seen = known | {i: h for (at, i), h in fetched.items() if at == level}
            self.levels.append(seen)
            last = size_at(n, level) - 1
            known = {i: digest([seen[2 * i], seen[2 * i + 1]] if 2 * i < last else [seen[2 * i]]) for i in {k >> 1 for k in known}}
            level += 1
        self.root = known[0]

    def siblings(self, i: int) -> list[str | None]:
        """The sibling at each level on the way from leaf i, or None where a node stands alone."""
        return [seen.get((i >> level) ^ 1) for level, seen in enumerate(self.levels)]


def folded(leaf: str, i: int, siblings: list[str | None]) -> str:
    """The root that follows from leaf i and the siblings on its way."""
    for s in siblings:
        leaf = digest([leaf] if s is None else [s, leaf] if i & 1 else [leaf, s])
        i >>= 1
    return leaf


def positioned(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (gapless from 0 in each tree, by ``order``, nulls first) and ``n`` (rows of the tree), as longs.

    Rows are dealt by range and written once; a row's place is its place in its range after the ranges before it. So
    no task holds a tree. ``order`` should tell all rows apart, or many equal ones fall into one range.
    """
    ranges = written(rows.repartitionByRange(tree, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    by = Window.partitionBy(tree)
    counts = ranges.groupBy(tree, "__range").agg(F.count("*").alias("__k"))
    starts = counts.select(tree, "__range", (F.sum("__k").over(by.orderBy("__range")) - F.col("__k")).alias("__start"), F.sum("__k").over(by).alias("n"))
    inside = F.row_number().over(Window.partitionBy(tree, "__range").orderBy(*order))
    return ranges.join(starts, [tree, "__range"]).withColumn("pos", F.col("__start") + inside - 1).drop("__range", "__start")


def _subtrees(level: int, stride: int, least: int):
    """Reads a run of nodes (tree, n, idx, digest) at ``level``; the nodes above them, as far as the run's top."""

    def run(table: pa.Table) -> pa.Table:
        tree, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
        now = dict(zip(table.column("idx").to_pylist(), table.column("digest").to_pylist(), strict=True))
        out, at = [], level
        if size_at(n, at) == 1:
            out.append((tree, n, at, 0, now[0], True))
        while at < level + stride and size_at(n, at) > 1:
            now = {i: digest([now[2 * i], now[2 * i + 1]] if 2 * i + 1 in now else [now[2 * i]]) for i in sorted({k >> 1 for k in now})}
            at += 1
            if at >= least or size_at(n, at) == 1:
                out += [(tree, n, at, i, h, size_at(n, at) == 1) for i, h in now.items()]
        names = ["tree", "n", "level", "idx", "digest", "is_root"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def tree_nodes(leaves: DataFrame, least: int = 1, stride: int = STRIDE) -> DataFrame:
    """Nodes (tree, n, level, idx, digest, is_root) of the trees whose ``leaves`` are tree, n, pos and digest.

    Levels from ``least`` up are returned, the root always; a lone leaf is its tree's root, at level 0. No leaves give
    no nodes.
    """
    schema = "tree string, n long, level int, idx long, digest string, is_root boolean"
    now, level, out = leaves.select("tree", "n", F.col("pos").alias("idx"), "digest"), 0, None
    while True:
        found = now.groupBy("tree", F.shiftright("idx", stride).alias("run")).applyInArrow(_subtrees(level, stride, least if stride >= least else stride), schema)
        found = written(found, "nodes")
        out = found if out is None else out.unionByName(found)
        level += stride
        now = found.where((F.col("level") == level) & ~F.col("is_root")).select("tree", "n", "idx", "digest")
        if now.isEmpty():
            return out


def _wanted(stride: int):
    """Reads the leaves of a run; the coordinates that they miss."""

    def run(table: pa.Table) -> pa.Table:
        tree, n, pos = table.column("tree")[0].as_py(), table.column("n")[0].as_py(), table.column("pos").to_numpy()
        found = missing(n, pos)
        k = len(found)
        return pa.table([pa.array([tree] * k, pa.string()), pa.array([int(pos[0]) >> stride] * k, pa.int64()), pa.array([c[0] for c in found], pa.int32()), pa.array([c[1] for c in found], pa.int64())], ["tree", "run", "level", "idx"])

    return run


def fetched_nodes(leaves: DataFrame, nodes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """For each run (tree, run) of ``leaves`` (tree, n, pos) the nodes (level, idx, digest) that it misses, each once.

    Nodes near a root are asked for by very many runs and reach them in a broadcast of bounded size.
    """
    runs = leaves.select("tree", "n", "pos").groupBy("tree", F.shiftright("pos", stride).alias("run"))
    asked = written(runs.applyInArrow(_wanted(stride), "tree string, run long, level int, idx long").withColumn("node", F.struct("tree", "level", "idx")), "asked")
    facts = asked.groupBy("node").count().join(nodes.select(F.struct("tree", "level", "idx").alias("node"), "digest"), "node")
    found = join_facts(asked.select("tree", "run", "node"), written(facts, "answers"), "node", "count")
    return found.select("tree", "run", "node.level", "node.idx", "digest")


_PROOF = "tree string, pos long, siblings array<string>"


def _paths(left: pa.Table, right: pa.Table) -> pa.Table:
    proof = _multiproof(left, right)
    pos = left.column("pos").to_pylist()
    return pa.table([left.column("tree"), pa.array(pos, pa.int64()), pa.array([proof.siblings(i) for i in pos], pa.list_(pa.string()))], ["tree", "pos", "siblings"])


def _multiproof(left: pa.Table, right: pa.Table) -> Multiproof:
    leaves = dict(zip(left.column("pos").to_pylist(), left.column("digest").to_pylist(), strict=True))
    at = zip(right.column("level").to_pylist(), right.column("idx").to_pylist(), strict=True)
    known = {k: h for k, h in zip(at, right.column("digest").to_pylist(), strict=True) if k[0] is not None}
    return Multiproof(left.column("n")[0].as_py(), leaves, known)


def proofs(leaves: DataFrame, nodes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """tree, pos and siblings (level by level, null where a node stands alone) of any ``leaves`` (tree, n, pos, digest) of a tree.

    ``nodes`` need all levels from 0 where only some leaves are asked for, else those from ``stride``.
    """
    run = F.shiftright("pos", stride).alias("run")
    right = fetched_nodes(leaves, nodes, stride)
    return leaves.select("tree", "n", "pos", "digest").groupBy("tree", run).cogroup(right.groupBy("tree", "run")).applyInArrow(_paths, _PROOF)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (of its lang), leaf, and tampered: the leaf with 1 added to n_chars, where 7 divides the id's checksum.

    A null is told from every text. Rows with a null id are leaves too and stand first; without an id or n_chars
    nothing is tampered with. Other columns are ignored.
    """
    leaf = lambda n_chars: F.sha2(F.concat(*[_field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    return docs.select("doc_id", tree.alias("tree"), leaf(F.col("n_chars")).alias("leaf"), F.when(chosen, leaf(F.col("n_chars") + 1)).alias("tampered"), F.monotonically_increasing_id().alias("row"))


def _held(root: str):
    """Reads the leaves of a run and what it has fetched, with its tree's way to the root; each leaf's proof and fold."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        proof = _multiproof(left, right)
        head = next(r for r in right.to_pylist() if r["level"] is None)
        above, at = head["siblings"], head["top"]
        shared = folded(proof.root, at, above)
        proven, ends = [], []
        for i, tampered in zip(left.column("pos").to_pylist(), left.column("tampered").to_pylist(), strict=True):
            own = proof.siblings(i)
            proven.append(digest(s for s in own + above if s))
            ends.append(shared if tampered is None else folded(folded(tampered, i, own), at, above))
        n = left.num_rows
        columns = [left.column("doc_id"), left.column("digest"), pa.array([proof.root] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proven, pa.string()), pa.array(ends, pa.string()), pa.array([e == root for e in ends], pa.bool_())]
        return pa.table(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def document_proofs(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document.

    Trees are by lang, null first, their leaves by doc_id, null first; rows that share both are ordered by their leaf,
    and repeated rows are leaves of their own. A fold of an untouched leaf is the derived root of its run, folded on; a
    tampered leaf is folded alone. No rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    leaves = written(document_leaves(docs), "leaves").withColumnRenamed("leaf", "digest")
    leaves = written(positioned(leaves, "tree", ["doc_id", "digest", "row"]).drop("row"), "positioned")
    nodes = tree_nodes(leaves, stride, stride)
    tops = nodes.where("is_root").select(F.lit("").alias("top"), F.col("tree").alias("lang"), "digest")
    tops = written(positioned(tops, "top", ["lang"]).withColumnRenamed("top", "tree"), "subroots")
    top_nodes = tree_nodes(tops, stride, stride)
    root = top_nodes.where("is_root").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], schema)
    run = F.shiftright("pos", stride).alias("run")
    ways = tops.select("pos", F.col("lang").alias("tree")).join(proofs(tops, top_nodes, stride).select("pos", "siblings"), "pos")
    runs = leaves.select("tree", run).distinct()
    per_tree = runs.groupBy("tree").count().join(ways.select("tree", F.col("pos").alias("top"), "siblings"), "tree")
    heads = join_facts(runs, written(per_tree, "ways"), "tree", "count")
    right = fetched_nodes(leaves, nodes, stride).unionByName(heads, allowMissingColumns=True)
    return leaves.groupBy("tree", run).cogroup(right.groupBy("tree", "run")).applyInArrow(_held(root["digest"]), schema)


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves, each with the digest of its proof, folded after tampering with some."""
    return document_proofs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CHECKSUM = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
_LEAF = "sha256(concat({}))".format(", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END" for c in ("doc_id", "source", "lang", "{n}", "text")))

SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf,
    CASE WHEN {_CHECKSUM} % {TAMPERED} = 0 THEN {_LEAF.format(n="(n_chars + 1)")} ELSE {_LEAF.format(n="n_chars")} END AS changed
  FROM documents),
p AS (
  SELECT *, CASE WHEN lang IS NULL THEN '' ELSE concat('=', lang) END AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
nodes(tree, n, level, idx, h) AS (
  SELECT tree, n, 0, pos, leaf FROM p
  UNION ALL
  SELECT tree, n, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE (n - 1) >> level > 0 GROUP BY tree, n, level, idx // 2),
subroots AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE (n - 1) >> level = 0),
tops(trees, level, idx, h) AS (
  SELECT trees, 0, place, subroot FROM subroots
  UNION ALL
  SELECT trees, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE (trees - 1) >> level > 0 GROUP BY trees, level, idx // 2),
whole AS (SELECT h AS root FROM tops WHERE (trees - 1) >> level = 0),
q AS (SELECT p.*, subroot, place, trees, root, row_number() OVER () AS id FROM p JOIN subroots USING (tree), whole),
way AS (
  SELECT id, 0 AS part, level, h FROM q JOIN nodes ON nodes.tree = q.tree AND nodes.idx = xor(q.pos >> nodes.level, 1)
  UNION ALL
  SELECT id, 1, level, h FROM q JOIN tops ON tops.idx = xor(q.place >> tops.level, 1)),
proof AS (SELECT id, sha256(string_agg(h, '' ORDER BY part, level)) AS proof_sha256 FROM way GROUP BY id),
fold(id, part, level, i, n, h) AS (
  SELECT id, 0, 0, pos, n, changed FROM q
  UNION ALL
  SELECT f.id, CASE WHEN part = 0 AND (f.n - 1) >> f.level = 0 THEN 1 ELSE part END,
    CASE WHEN (f.n - 1) >> f.level = 0 THEN 0 ELSE f.level + 1 END,
    CASE WHEN (f.n - 1) >> f.level = 0 THEN q.place ELSE f.i // 2 END,
    CASE WHEN (f.n - 1) >> f.level = 0 THEN q.trees ELSE f.n END,
    CASE WHEN (f.n - 1) >> f.level = 0 THEN f.h
      WHEN f.i % 2 = 1 THEN sha256(concat(coalesce(s.h, t.h), f.h)) ELSE sha256(concat(f.h, coalesce(s.h, t.h, ''))) END
  FROM fold f JOIN q ON q.id = f.id
    LEFT JOIN nodes s ON f.part = 0 AND s.tree = q.tree AND s.level = f.level AND s.idx = xor(f.i, 1)
    LEFT JOIN tops t ON f.part = 1 AND t.level = f.level AND t.idx = xor(f.i, 1)
  WHERE f.part = 0 OR (f.n - 1) >> f.level > 0),
ends AS (SELECT id, h AS folded_root FROM fold WHERE part = 1 AND (n - 1) >> level = 0)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM q LEFT JOIN proof USING (id) JOIN ends USING (id)
"""
