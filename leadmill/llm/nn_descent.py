"""Near-duplicate vectors by NN-descent.

1. Equal vectors fall together first; one *point* stands for all of them, with their number. A point
   carries its unit vector in bytes, with the exact length of what that leaves out, so a cosine of
   bytes has a known error.
2. First lists: points are sorted by the signs of random projections, in ``TABLES`` ways, and runs of
   ``LEAF`` neighbours compared. A run has one size whatever stands in it.
3. Rounds: the neighbours of a point, and those whose neighbour it is, are each other's candidates.
   They meet in one group per point, which gives back what is better than the worst entry of a list.
   Only pairs with a fresh entry are compared. Popular points are split into several groups.
4. A list that holds near-duplicates only is saturated and doubles, up to ``MOST`` entries. Groups
   with a list that is saturated even then are completed: their members are dealt into blocks, which
   are compared in tasks that give back counts, no pairs. So no list length caps what is counted.
5. Entries near the threshold are verified on the vectors in double precision.
6. Audit: about ``AUDIT`` points, by the hash of their key, are compared with all points. While fewer
   than ``RECALL`` of their links were found, all lists double and rounds go on.

Rounds end when they add less than a thousandth to the entries near the threshold.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries link with
nothing, and so do vectors under a null id; vectors of different lengths never link; repeated ids are
one node, which has the links of all its vectors, and each row is returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.components import components
from leadmill.llm.slices import runs
from leadmill.storage import broadcast_if_small, materialise, scratch

TABLES, LEAF, SIZE, MOST = 6, 64, 8, 64
GROUP = 256  # entries by which a popular point's group is split
BLOCK = 2048
AUDIT, RECALL = 256, 0.98
_NEAR = 1e-5  # what float32 products may be off by


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit = _unit(batch.column("v"))
        scale = np.abs(unit).max(axis=1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        lost = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays([*batch.select(["k", "m"]).columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(lost), batch.column("v")], names=["k", "m", "code", "scale", "lost", "v"])


def _decoded(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.int8).reshape(table.num_rows, -1)
    return codes.astype(np.float32) * table.column("scale").to_numpy().astype(np.float32)[:, None]


def _best(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, worst: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each row of ``sims`` its ``size`` best entries above ``worst``: a, b, sim. Left out: -2."""
    if not sims.size:
        return
    most = min(int(size.max()), sims.shape[1])
    at = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    found = np.take_along_axis(sims, at, axis=1)
    row, col = np.nonzero(found > np.maximum(worst, -1.5)[:, None])
    if len(row):
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(others[at[row, col]]), pa.array(found[row, col].astype(np.float32))], names=["a", "b", "sim"])


def _signs(dim: int):
    planes = np.random.default_rng(97).normal(size=(dim, TABLES * 32)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = ((_decoded(batch) @ planes) > 0).reshape(batch.num_rows, TABLES, 32)
            key = (above * (1 << np.arange(31, -1, -1, dtype=np.int64))).sum(axis=2)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(key[:, t]), *batch.select(["k", "code", "scale"]).columns], names=["t", "key", "k", "code", "scale"])

    return run


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def compare(rows: pa.Table):
        ids, unit = rows.column("k").to_numpy(), _decoded(rows)
        for low in range(0, len(ids), LEAF):
            own = slice(low, low + LEAF)
            sims = unit[own] @ unit[own].T
            sims[ids[own][:, None] == ids[own][None, :]] = -2  # a run may hold the end of one table and the start of the next
            yield from _best(ids[own], ids[own], sims, np.full(len(sims), -2.0), np.full(len(sims), SIZE))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 32 * LEAF:
            rows = pa.Table.from_batches(held)
            whole = rows.num_rows // LEAF * LEAF
            yield from compare(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
    if held:
        yield from compare(pa.Table.from_batches(held))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in runs(batches, ["at", "part"]):
        fresh = group.column("fresh").to_numpy()
        if len(fresh) < 2 or not fresh.any():
            continue
        ids, first, back = np.unique(group.column("id").to_numpy(), return_index=True, return_inverse=True)
        new = np.zeros(len(ids), dtype=bool)
        np.logical_or.at(new, back, fresh)
        unit = _decoded(group.take(pa.array(first)))
        worst, size = (group.column(c).to_numpy()[first] for c in ("worst", "size"))
        for low in range(0, len(ids), 1024):
            own = slice(low, low + 1024)
            sims = unit[own] @ unit.T
            sims[~(new[own][:, None] | new[None, :])] = -2
            sims[np.arange(len(sims)), np.arange(low, low + len(sims))] = -2
            yield from _best(ids[own], ids, sims, worst[own], size[own])


_FOUND = "a long, b long, sim float"


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = np.einsum("ij,ij->i", _unit(batch.column("va")), _unit(batch.column("vb"))) >= least if batch.num_rows else np.zeros(0, bool)
            yield batch.select(["a", "b", "ma", "mb"]).filter(pa.array(fine))

    return run


def _counts(least: float):
    """Of a block of a dense group: for each point the number of vectors linked with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ["component", "i", "j"]):
            side, ids, m = (cell.column(c).to_numpy() for c in ("side", "k", "m"))
            unit = _unit(cell.column("v"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            right = right if len(right) else left
            own, theirs = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
            for low in range(0, len(left), 512):
                part = left[low : low + 512]
                linked = unit[part] @ unit[right].T >= least
                linked &= ids[part][:, None] != ids[right][None, :]
                own[low : low + 512] = linked @ m[right]
                theirs += m[part] @ linked
            yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(own)], names=["k", "n"])
            if len(np.flatnonzero(side == 1)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[right]), pa.array(theirs)], names=["k", "n"])

    return run


def _audit(keys: np.ndarray, unit: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            linked = unit @ _unit(batch.column("v")).T >= least
            linked &= keys[:, None] != batch.column("k").to_numpy()[None, :]
            total += linked @ batch.column("m").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], names=["k", "n"])

    return run


class _Graph:
    """Neighbour lists of points of one length: ``edges`` (a, b, sim, fresh) and ``lists`` (k, size, worst, full)."""

    def __init__(self, points: DataFrame, dim: int, least: float):
        self.points, self.dim, self.least = points, dim, least
        keyed = materialise(points.mapInArrow(_signs(dim), "t int, key long, k long, code binary, scale double"), "projections")
        sort = ["t", "key", "k"]
        found = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_leaves, _FOUND)
        self.lists = points.select("k", F.lit(SIZE).alias("size"))
        self._merge(found.withColumn("fresh", F.lit(True)))

    def _merge(self, candidates: DataFrame) -> None:
        """Keeps the best of each list; a known entry is no longer fresh."""
        once = candidates.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        sized = once.join(self.lists.select(F.col("k").alias("a"), "size"), "a")
        order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        self.edges = materialise(sized.withColumn("rank", F.row_number().over(order)).where("rank <= size").select("a", "b", "sim", "fresh"), "edges")
        ends = self.edges.groupBy(F.col("a").alias("k")).agg(F.count(F.lit(1)).alias("held"), F.min("sim").alias("least"))
        full = F.coalesce(F.col("held") >= F.col("size"), F.lit(False))
        lists = self.lists.select("k", "size").join(ends, "k", "left").select("k", "size", F.when(full, F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        self.lists = materialise(lists.withColumn("full", F.col("worst") >= self.least - 0.01), "lists")

    def enlarge(self, every: bool = False) -> int:
        """Doubles saturated lists, or all; says how many were."""
        grow = (F.col("full") | F.lit(every)) & (F.col("size") < MOST)
        n = self.lists.where(grow).count()
        if n:
            # A list with room takes any entry.
            self.lists = self.lists.select("k", F.when(grow, 2 * F.col("size")).otherwise(F.col("size")).alias("size"), F.when(grow, F.lit(-2.0)).otherwise(F.col("worst")).cast("float").alias("worst"), (F.col("full") & ~grow).alias("full"))
            again = broadcast_if_small(materialise(self.lists.where("worst < -1.5").select(F.col("k").alias("a")), "grown"))
            self.edges = self.edges.join(again, "a", "left_semi").withColumn("fresh", F.lit(True)).unionByName(self.edges.join(again, "a", "left_anti"))
        return n

    def round(self) -> tuple[int, int]:
        """One round of neighbours of neighbours; how many entries near the threshold there are, and how many are new."""
        forward = self.edges.select(F.col("a").alias("at"), F.col("b").alias("id"), "fresh")
        back = self.edges.select(F.col("b").alias("at"), F.col("a").alias("id"), "fresh")
        popular = back.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("at", F.ceil(F.col("n") / GROUP).alias("parts"))
        popular = broadcast_if_small(materialise(popular, "popular"))
        parts = F.coalesce("parts", F.lit(1)).cast("long")
        forward = forward.join(popular, "at", "left").select("at", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "id", "fresh")
        back = back.join(popular, "at", "left").select("at", F.pmod(F.xxhash64("id"), parts).alias("part"), "id", "fresh")
        state = self.points.select(F.col("k").alias("id"), "code", "scale").join(self.lists.select(F.col("k").alias("id"), "size", "worst"), "id")
        members = forward.unionByName(back).join(state, "id")
        found = members.repartition("at", "part").sortWithinPartitions("at", "part").mapInArrow(_meet, _FOUND)
        self._merge(self.edges.withColumn("fresh", F.lit(False)).unionByName(found.withColumn("fresh", F.lit(True))))
        close = F.col("sim") >= self.least - 0.01
        row = self.edges.agg(F.coalesce(F.sum(close.cast("long")), F.lit(0)).alias("all"), F.coalesce(F.sum((close & F.col("fresh")).cast("long")), F.lit(0)).alias("new")).first()
        return row["all"], row["new"]

    def refine(self) -> None:
        rounds = 0
        while True:
            total, new = self.round()
            rounds += 1
            grown = self.enlarge()
            if rounds >= 2 and not grown and 1000 * new <= total:
                return

    def links(self) -> DataFrame:
        """Verified entries as pairs a < b with the points' numbers of vectors."""
        lost = lambda c: self.points.select(F.col("k").alias(c), F.col("lost").alias(f"lost_{c}"), F.col("v").alias(f"v{c}"), F.col("m").alias(f"m{c}"))
        pairs = self.edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))
        most = self.points.agg(F.max("lost")).first()[0] or 0.0
        pairs = pairs.where(F.col("sim") >= self.least - 2 * most * (1 + most) - _NEAR)  # nothing else can reach it
        near = pairs.join(lost("a"), "a").join(lost("b"), "b").where(F.col("sim") >= self.least - F.col("lost_a") * (1 + F.col("lost_b")) - F.col("lost_b") - _NEAR)
        return materialise(near.select("a", "b", "ma", "mb", "va", "vb").mapInArrow(_verify(self.least), "a long, b long, ma long, mb long"), "links")

    def counts(self, links: DataFrame, found: DataFrame) -> DataFrame:
        """k and n, the number of vectors linked with it, for all linked points."""
        ends = links.select(F.col("a").alias("k"), F.col("mb").alias("n")).unionByName(links.select(F.col("b").alias("k"), F.col("ma").alias("n")))
        named = found.select(F.col("id").alias("k"), "component")
        dense = materialise(self.lists.where("full").select("k").join(named, "k").select("component").distinct(), "dense_groups")
        members = materialise(named.join(broadcast_if_small(dense), "component", "left_semi"), "dense_members")
        few = ends.groupBy("k").agg(F.sum("n").alias("n")).join(broadcast_if_small(members.select("k")), "k", "left_anti")
        shares = broadcast_if_small(materialise(members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shares")), "dense_shares"))
        rows = members.join(shares, "component").join(self.points.select("k", "m", "v"), "k").withColumn("own", F.pmod(F.xxhash64("k"), F.col("shares")))
        others = F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)
        cells = F.transform(others, lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j"), (x < F.col("own")).cast("int").alias("side")))
        rows = rows.withColumn("cell", F.explode(cells)).select("component", "cell.*", "k", "m", "v")
        counted = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_counts(self.least), "k long, n long")
        return materialise(few.unionByName(counted.groupBy("k").agg(F.sum("n").alias("n"))), "counts")

    def recall(self, counts: DataFrame) -> float:
        """Share of the links of about AUDIT points that were found."""
        every = max(1, self.points.count() // AUDIT)
        queries = self.points.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).select("k", "v").toArrow()
        if not queries.num_rows:
            return 1.0
        keys = queries.column("k").to_numpy()
        true = self.points.select("k", "m", "v").mapInArrow(_audit(keys, _unit(queries.column("v")), self.least), "k long, n long").groupBy("k").agg(F.sum("n").alias("true"))
        row = true.join(counts, "k", "left").agg(F.sum("true").alias("true"), F.sum(F.coalesce("n", F.lit(0))).alias("found")).first()
        return row["found"] / row["true"] if row["true"] else 1.0


def neighbour_links(points: DataFrame, dim: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified links, components of their points, and counts of linked vectors."""
    graph = _Graph(points, dim, least)
    while True:
        graph.refine()
        links = graph.links()
        found = components(links.select("a", "b"))
        counts = graph.counts(links, found)
        if graph.recall(counts) >= RECALL or not graph.enlarge(every=True):
            return links, found, counts


def near_duplicates(embeddings: DataFrame, least: float = 0.95, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of ``least`` or more), component_id (the smallest id
    reachable over links), kept (it is that id), one row per vector."""
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    with scratch(embeddings.sparkSession) as made:
        rows = materialise(embeddings.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).withColumn("fine", fine), "vectors")
        distinct = materialise(rows.where("fine").groupBy("v").agg(F.count(F.lit(1)).alias("m")), "distinct_vectors")
        keyed = materialise(distinct.withColumn("k", F.monotonically_increasing_id()), "keyed_vectors")
        ids = materialise(rows.where("fine").join(keyed, "v").select("vec_id", "k", "m"), "ids")
        alone = made.keep(materialise(rows.where("not fine").select("vec_id"), "alone"))
        dims = [r[0] for r in keyed.groupBy(F.size("v")).count().collect()]
        found, counts = keyed.select(F.col("k").alias("id"), F.col("k").alias("component")).limit(0), keyed.select("k", F.col("m").alias("n")).limit(0)
        for dim in dims:
            points = materialise(keyed.where(F.size("v") == dim).mapInArrow(_encode, "k long, m long, code binary, scale double, lost double, v array<double>"), "points")
            _, own, n = neighbour_links(points, dim, least)
            found, counts = found.unionByName(own), counts.unionByName(n)
        named = ids.join(found.withColumnRenamed("id", "k"), "k", "left").join(counts, "k", "left")
        named = materialise(named.select("vec_id", F.coalesce("component", "k").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links")), "named")
        # An id with several vectors joins their components.
        several = named.groupBy("vec_id").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a < z").select("vec_id", "a")
        joined = materialise(named.join(several, "vec_id").select("a", F.col("component").alias("b")).distinct(), "joined")
        if joined.limit(1).count():
            moved = components(joined).select(F.col("id").alias("component"), F.col("component").alias("to"))
            named = materialise(named.join(moved, "component", "left").select("vec_id", F.coalesce("to", "component").alias("component"), "n_links"), "renamed")
        smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        out = made.keep(materialise(named.join(smallest, "component").select("vec_id", "n_links", "component_id"), "linked"))
    rest = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
