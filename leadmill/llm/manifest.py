"""Merkle manifest of a dataset: postorder recursive traversal of aligned blocks of leaves.

1. ``leaves``: each row's digest, from native expressions.
2. ``numbered``: a place for each leaf inside its tree, from a range partitioning and the counts of
   its partitions; no tree is sorted in one task.
3. ``climb``: blocks of ``FAN ** height`` aligned leaves are traversed in tasks. The recursion returns
   the digest of a subtree; the digests of the blocks are the leaves of another distributed traversal,
   until one node is left in each tree.
4. ``descend``: from the roots down, each block meets the one row that holds its path to the root. Its
   traversal appends the siblings of every subtree to the leaves inside it while it unwinds.

What is shuffled is about a hundred bytes a row; texts are read once and never moved. Trees of
different languages are the leaves of one more tree, handled the same way, so neither a language with
most rows nor millions of languages meet in one task.

Defined results: null columns are hashed as ``-``; null ids come first in their tree, null languages
are a tree of their own; rows with equal ids are ordered by their digest, and equal rows have equal
digests, so their order is of no consequence. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.storage import broadcast_if_small, materialise, scratch

FAN, HEIGHT = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the value's bytes in UTF-8, counted, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row of documents, with another text if one is given."""
    return F.sha2(F.concat(*(field(text if c == "text" and text is not None else F.col(c)) for c in COLUMNS)), 256)


def _tree(lang: str) -> Column:
    """A name without nulls in the order of the languages, null first, so that no key is null."""
    return F.when(F.col(lang).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(lang).cast("string")))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows``, a written table, with ``index`` (from 0) and ``total`` inside each group, whose columns hold no nulls.
    Nulls of ``order`` come first.

    Rows equal in all columns of ``order`` are told apart by their place in the table, so that any
    number of them is dealt over several partitions."""
    rows = rows.withColumn("salt", F.monotonically_increasing_id())
    keys = [*group, *order, "salt"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    rows = materialise(rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    parts = rows.groupBy("part", *group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    same = Window.partitionBy(*group)
    before = F.coalesce(F.sum("rows").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p"), *(F.col(c).alias(f"g_{c}") for c in group), (before - F.col("first")).alias("shift"), F.sum("rows").over(same).alias("total"))
    parts = broadcast_if_small(materialise(parts, "offsets"))
    alike = F.col("part") == F.col("p")
    for c in group:
        alike = alike & (F.col(c) == F.col(f"g_{c}"))
    out = rows.join(parts, alike).withColumn("index", F.col("place") + F.col("shift"))
    return out.drop("part", "place", "p", "shift", *(f"g_{c}" for c in group))


def levels(total: int) -> int:
    """Levels above ``total`` nodes until one is left."""
    n = 0
    while total > 1:
        total, n = -(-total // FAN), n + 1
    return n


def traverse(digests: list[str], height: int) -> tuple[str, list[list[str]], list[list[int]]]:
    """Digest of an aligned block, and for each leaf, level by level, the other digests of its run in
    order and how many of them stand before it."""
    siblings: list[list[str]] = [[] for _ in digests]
    places: list[list[int]] = [[] for _ in digests]

    def visit(low: int, high: int, height: int) -> str:
        if height == 0:
            return digests[low]
        step = FAN ** (height - 1)
        cuts = range(low, high, step)
        parts = [visit(at, min(at + step, high), height - 1) for at in cuts]
        for i, at in enumerate(cuts):
            others = "".join(parts[:i] + parts[i + 1 :])
            for k in range(at, min(at + step, high)):
                siblings[k].append(others)
                places[k].append(i)
        return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()

    return visit(0, len(digests), height), siblings, places


def _block(nodes: pa.Table, height: int) -> tuple[pa.Table, int]:
    nodes = nodes.sort_by("index")
    return nodes, min(height, levels(nodes.column("total")[0].as_py()))


def _roots(group: list[str], most: int):
    names = [*group, "index", "total", "digest"]

    def run(nodes: pa.Table) -> pa.Table:
        nodes, height = _block(nodes, most)
        digest, _, _ = traverse(nodes.column("digest").to_pylist(), height)
        at, total = nodes.column("index")[0].as_py() // FAN**most, -(-nodes.column("total")[0].as_py() // FAN**most)
        head = [nodes.column(c).slice(0, 1).combine_chunks() for c in group]
        return pa.Table.from_arrays([*head, pa.array([at], pa.int64()), pa.array([total], pa.int64()), pa.array([digest])], names=names)

    return run


def climb(nodes: DataFrame, group: list[str], height: int) -> list[DataFrame]:
    """Tables of nodes (group, index, total, digest) from ``nodes`` up to one node in each group."""
    kind = "".join(f"{c} {nodes.schema[c].dataType.simpleString()}, " for c in group) + "index long, total long, digest string"
    out = [nodes]
    while (out[-1].agg(F.max("total")).first()[0] or 1) > 1:
        block = out[-1].select(*group, "index", "total", "digest").groupBy(*group, F.expr(f"index div {FAN**height}").alias("block"))
        out.append(materialise(block.applyInArrow(_roots(group, height), kind), "block_roots"))
    return out


def _paths(most: int):
    def run(nodes: pa.Table, path: pa.Table) -> pa.Table:
        nodes, height = _block(nodes, most)
        digests = nodes.column("digest").to_pylist()
        _, siblings, places = traverse(digests, height)
        above, stand = path.column("siblings")[0].as_py(), path.column("places")[0].as_py()
        out = nodes.append_column("siblings", pa.array([s + above for s in siblings], pa.list_(pa.string())))
        out = out.append_column("places", pa.array([p + stand for p in places], pa.list_(pa.int32())))
        return out.append_column("subroot", pa.array([path.column("subroot")[0].as_py()] * len(digests), pa.string()))

    return run


def descend(made: scratch, tables: list[DataFrame], tops: DataFrame, group: list[str], height: int) -> DataFrame:
    """The nodes of ``tables[0]`` with siblings and places up to the top of their group and beyond.

    ``tops``: group, index (0), siblings, places (of the group's root, further up) and subroot."""
    paths = tops
    for nodes in reversed(tables[:-1] or tables):
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", siblings array<string>, places array<int>, subroot string"
        blocks = nodes.groupBy(*group, F.expr(f"index div {FAN**height}").alias("block"))
        paths = blocks.cogroup(paths.select(*group, "index", "siblings", "places", "subroot").groupBy(*group, "index")).applyInArrow(_paths(height), kind)
        if nodes is not tables[0]:
            paths = made.keep(materialise(paths, "block_paths"))
    return paths


def manifest(docs: DataFrame, height: int = HEIGHT, **more: Column) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, siblings, places, and ``more`` columns made from the row.

    ``siblings``: for each level from the leaf's own up to the root, the digests of the run's other
    nodes laid end to end; ``places``: how many of them stand before the node on the way."""
    with scratch(docs.sparkSession) as made:
        rows = materialise(docs.select("doc_id", "lang", _tree("lang").alias("tree"), leaf().alias("digest"), *(c.alias(n) for n, c in more.items())), "leaves")
        nodes = made.keep(materialise(numbered(rows, ["tree"], ["doc_id", "digest"]), "numbered_leaves"))
        trees = climb(nodes, ["tree"], height)
        subroots = materialise(trees[-1].select("tree", "digest"), "subroots")
        forest = climb(materialise(numbered(subroots, [], ["tree"]).withColumn("forest", F.lit(0)), "forest"), ["forest"], height)
        found = forest[-1].first()
        if found is None:
            none = F.lit(None).cast("string")
            return nodes.select("doc_id", "lang", none.alias("leaf"), none.alias("subroot"), none.alias("root"), F.lit(None).cast("array<string>").alias("siblings"), F.lit(None).cast("array<int>").alias("places"), *more)
        none = docs.sparkSession.range(1).select(F.lit(0).alias("forest"), F.col("id").alias("index"), F.array().cast("array<string>").alias("siblings"), F.array().cast("array<int>").alias("places"), F.lit(None).cast("string").alias("subroot"))
        tops = descend(made, forest, materialise(none, "top"), ["forest"], height).select("tree", F.lit(0).cast("long").alias("index"), "siblings", "places", F.col("digest").alias("subroot"))
        tops = made.keep(materialise(tops, "tops"))
        paths = descend(made, trees, tops, ["tree"], height)
    return paths.select("doc_id", "lang", F.col("digest").alias("leaf"), "subroot", F.lit(found["digest"]).alias("root"), "siblings", "places", *more)


def fold(leaf: Column, siblings: Column, places: Column) -> Column:
    """The root that a leaf and its siblings give."""
    step = lambda node, s: F.sha2(F.concat(F.substr(s["siblings"], F.lit(1), 64 * s["place"]), node, F.substr(s["siblings"], 64 * s["place"] + 1)), 256)
    return F.aggregate(F.zip_with(siblings, places, lambda s, p: F.struct(s.alias("siblings"), p.alias("place"))), leaf, step)
