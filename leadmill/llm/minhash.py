"""Near-duplicate documents by b-bit MinHash, confirmed on full sets.

1. ``signatures``: each text becomes a set of hashed word shingles; 512 minima are taken, 24 bands of
   four minima are hashed, and of each minimum only ``BITS`` low bits are kept, packed into longs.
   Texts with equal sets fall together (a 128-bit sum of the set): one stands for all.
2. Representatives that share a band are candidates. Every bucket has a hub, the member that meets
   most others over all bands, as the origin of copies does. First each member meets its hubs only:
   candidates are scored on the packed bits, bits in common less those that agree by chance,
   ``(m - 2**-b) / (1 - 2**-b)``, and what is not 4.5 standard errors under the threshold is confirmed
   on full sets.
3. All members of a hub's buckets form the hub's group. A group that still holds several components
   is met in full, inside tasks, in blocks of bounded rows and bytes: the packed bits tell which members
   have a possible partner in another component; only these bring their full sets, which are then
   compared. A task gives back no pairs but the links that join components, so what leaves it is never
   more than its members. No pair that shares a band is left out, whatever the size of a bucket.

At a similarity of 0.8 a pair shares no band with chance 3e-6.

Defined results: null and empty texts and texts of white space have the empty set and link with
nothing; texts with fewer words than a shingle have their whole sequence as one shingle; repeated rows
with one id are one document, which has the links of all texts under that id and is returned for each row; rows with a null
id are kept and link with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.components import components
from leadmill.llm.slices import by_bytes, runs
from leadmill.storage import broadcast_if_small, materialise, scratch

BANDS, ROWS, BITS = 24, 4, 2
HASHES = 512  # the first BANDS * ROWS of them make the bands; all serve the estimate
WORDS64 = HASHES * BITS // 64
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20  # members of a block; larger groups are dealt into several
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.default_rng(2024).integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b))])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lowered) of texts laid end to end, and its text. ``ends``: text ends in bytes."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    letter = ~_SPACE[data]
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    first = np.concatenate([[0], ends[:-1]])
    first = first[first < len(data)]
    starts[first] = letter[first]
    lasts = letter.copy()
    lasts[:-1] &= ~letter[1:]
    final = ends[(ends > 0)] - 1
    lasts[final] = letter[final]
    s, e = np.flatnonzero(starts), np.flatnonzero(lasts) + 1
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    words = _mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return words, np.searchsorted(ends, s, side="right")


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, as (text, hash) in order of both."""
    words, text = word_hashes(data, ends)
    counts = np.bincount(text, minlength=len(ends))
    begin = np.cumsum(counts) - counts
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(ends)), windows)
    at = begin[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows)
    out = np.full(len(rows), np.uint64(size))
    padded = np.concatenate([words, np.zeros(size, dtype=np.uint64)])
    for i in range(size):
        part = np.where(i < counts[rows], padded[at + i], np.uint64(i + 1))
        out = _mix(out * np.uint64(_BASE) + part)
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    return rows[new], out[new]


def _laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts laid end to end and where each ends."""
    held = [t.encode("utf-8", "replace") if t else b"" for t in texts.to_pylist()]
    return np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(t) for t in held])


def _sign(size: int):
    listed = lambda cells: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(cells).ravel()), cells.shape[1]).cast(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            data, ends = _laid(batch.column("text"))
            rows, hashes = shingle_sets(data, ends, size)
            counts = np.bincount(rows, minlength=len(ends))
            full = np.flatnonzero(counts)
            heads = (np.cumsum(counts) - counts)[full]
            shown = np.zeros((len(ends), 2 + WORDS64 + BANDS), dtype=np.int64)
            if len(full):
                shown[full, 0] = np.add.reduceat(_mix(hashes), heads).view(np.int64)
                shown[full, 1] = np.add.reduceat(_mix(hashes * np.uint64(_BASE) + np.uint64(1)), heads).view(np.int64)
                packed, band = np.zeros((len(full), WORDS64), dtype=np.uint64), np.zeros(len(full), dtype=np.uint64)
                for j in range(HASHES):
                    low = np.minimum.reduceat(hashes * _FACTORS[j], heads)
                    bit = j * BITS
                    packed[:, bit // 64] |= (_mix(low) & np.uint64((1 << BITS) - 1)) << np.uint64(bit % 64)
                    if j >= BANDS * ROWS:
                        continue
                    band = _mix(band * np.uint64(_BASE) + low + np.uint64(j))
                    if j % ROWS == ROWS - 1:
                        shown[full, 2 + WORDS64 + j // ROWS] = band.view(np.int64)
                        band = np.zeros(len(full), dtype=np.uint64)
                shown[full, 2 : 2 + WORDS64] = packed.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(shown[:, 0]), pa.array(shown[:, 1]), listed(shown[:, 2 : 2 + WORDS64]), listed(shown[:, 2 + WORDS64 :])], names=["doc_id", "n_shingles", "set_a", "set_b", "bits", "bands"])

    return run


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (the set's sum), bits and bands for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sign(size), "doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, bands array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed bits, corrected for minima that agree in their low bits by chance."""
    differ = F.lit(0)
    odd = F.lit(0x5555555555555555)
    for i in range(WORDS64):
        x = a[i].bitwiseXOR(b[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    chance = 0.5**BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows, hashes = shingle_sets(*_laid(batch.column("text")), size)
            cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([hashes[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["id", "hashes"])

    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.select(["a", "b"])
            linked = []
            for x, y in zip(batch.column("set_x"), batch.column("set_y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                linked.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def _candidates(percent: int, margin: float):
    """Of a block: the members whose bits allow a link with a member of another component."""
    odd, chance = np.uint64(0x5555555555555555), 0.5**BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["hub", "i", "j"]):
            side, component, n = (block.column(c).to_numpy() for c in ("side", "component", "n"))
            bits = pa.concat_arrays(block.column("bits").chunks).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS64)
            heads, others = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            active = np.zeros(len(side), dtype=bool)
            for low in range(0, len(heads), 128):
                mine = heads[low : low + 128]
                apart = component[mine][:, None] != component[others][None, :]
                apart &= 100 * np.minimum(n[mine][:, None], n[others][None, :]) >= percent * np.maximum(n[mine][:, None], n[others][None, :])
                x, y = np.nonzero(apart)
                for at in range(0, len(x), 1 << 15):
                    a, b = mine[x[at : at + (1 << 15)]], others[y[at : at + (1 << 15)]]
                    differ = bits[a] ^ bits[b]
                    differ = np.bitwise_count((differ | (differ >> np.uint64(1))) & odd).sum(axis=1, dtype=np.int64)
                    close = ((1 - differ / HASHES) - chance) / (1 - chance) >= margin
                    active[a[close]] = active[b[close]] = True
            found = np.flatnonzero(active)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(block.column(c).to_numpy()[found]) for c in ("hub", "id")], names=["hub", "id"])

    return run


def _joining(percent: int):
    """Of a block: links between members of different components, as few as join the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["hub", "i", "j"]):
            side, ids, n = (block.column(c).to_numpy() for c in ("side", "id", "n"))
            _, root = np.unique(block.column("component").to_numpy(), return_inverse=True)
            heads, others = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            own = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in block.column("hashes")]
            distinct, code = np.unique(np.concatenate(own), return_inverse=True)
            begin = np.concatenate([[0], np.cumsum(n)])
            theirs = np.concatenate([code[begin[y] : begin[y + 1]] for y in others.tolist()])
            at = np.concatenate([[0], np.cumsum(n[others])])[:-1]
            marked = np.zeros(len(distinct), dtype=np.int32)
            links = []
            for x in heads.tolist():
                apart = root[others] != root[x]
                if not apart.any():
                    continue
                mine = code[begin[x] : begin[x + 1]]
                marked[mine] = 1
                same = np.add.reduceat(marked[theirs], at)
                marked[mine] = 0
                for y in others[apart & (100 * same >= percent * (n[x] + n[others] - same))].tolist():
                    if root[x] != root[y]:
                        links.append((ids[x], ids[y]))
                        root[root == root[y]] = root[x]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return run


def _blocks(members: DataFrame, weight: Column) -> DataFrame:
    """Members (hub, id, component and others) of groups that hold several components, dealt into blocks.

    A row stands in every block (i, j) where it is to be met. ``side``: 0, one of the i-th share of the
    group's members outside its largest component; 1, one of the j-th share of all members; 2, both.
    Every two members of different components meet, as one of them is outside the largest.
    """
    members = members.withColumn("weight", weight)
    parts = members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("bytes"))
    groups = parts.groupBy("hub").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max(F.struct("rows", "bytes", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    shares = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES))
    groups = groups.select("hub", F.col("main.component").alias("main"), shares(F.col("rows") - F.col("main.rows"), F.col("bytes") - F.col("main.bytes")).alias("heads"), shares(F.col("rows"), F.col("bytes")).alias("others"))
    rows = members.join(broadcast_if_small(materialise(groups, "mixed_groups")), "hub")
    minor = F.col("component") != F.col("main")
    i, j = (F.pmod(F.xxhash64("id"), F.col(c)) for c in ("heads", "others"))
    number = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cell = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    zero = F.lit(0).cast("long")
    as_other = F.transform(number("heads"), lambda k: cell(k, j, F.lit(1)))
    as_head = F.transform(number("others"), lambda k: cell(i, k, F.lit(0)))
    cells = F.when(F.col("heads") * F.col("others") == 1, F.array(cell(zero, zero, F.when(minor, 2).otherwise(1)))).otherwise(F.when(minor, F.concat(as_head, as_other)).otherwise(as_other))
    rows = rows.withColumn("cell", F.explode(cells)).select("cell.*", *(c for c in members.columns if c != "weight"))
    return rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that id).

    Two documents link if ``100 * intersection >= percent * union`` of their shingle sets.
    """
    with scratch(docs.sparkSession) as made:
        table, same, found = map(made.keep, _linked(docs, size, percent))
    linked = F.col("n_shingles") > 0
    full = table.where(linked & F.col("doc_id").isNotNull())
    members = full.select("doc_id", "n_shingles", "set_a", "set_b").join(same.select("set_a", "set_b", "id"), ["set_a", "set_b"])
    members = members.join(found, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    alone = table.where(~linked | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: the documents' signatures, the representatives of equal sets, the components of these."""
    table = materialise(signatures(docs, size), "signatures")
    # Without a text there is nothing to link; the others fall together by set.
    full = table.where("n_shingles > 0 and doc_id is not null")
    same = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    same = materialise(same, "representatives")
    banded = same.select("id", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialise(banded.join(buckets, ["band", "hash"]), "shared_bands")
    weights = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weights, "id").groupBy("band", "hash").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"))
    groups = materialise(shared.join(hubs, ["band", "hash"]).select("hub", "id").distinct(), "hub_groups")
    bits = same.select("id", "bits", "n")
    # No pair is similar enough if its sets differ too much in size.
    sized = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    agree = percent / 100 + (1 - percent / 100) * 0.5**BITS
    # A doc_id that has several texts is one document: it is linked with the representative of each of them.
    several = materialise(full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several_texts")
    own = full.join(broadcast_if_small(several), "doc_id").select("doc_id", "set_a", "set_b").distinct()
    own = materialise(own.join(same.select("set_a", "set_b", "id"), ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")), "links_of_ids")
    margin = percent / 100 - 4.5 * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - 0.5**BITS)

    pairs = groups.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    pairs = pairs.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("bits_a"), "n"), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("bits_b"), F.col("n").alias("m")), "b")
    pairs = materialise(pairs.where(sized & (estimate(F.col("bits_a"), F.col("bits_b")) >= margin)).select("a", "b"), "candidates")
    involved = materialise(groups.select("id").distinct(), "involved")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(broadcast_if_small(involved), "id", "left_semi")
    sets = materialise(texts.mapInArrow(_sets(size), "id long, hashes binary"), "shingle_sets")
    again = materialise(sets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated_ids")
    if again.limit(1).count():
        sets = materialise(sets.join(again, "id", "left_anti").unionByName(sets.join(again, "id", "left_semi").distinct()), "distinct_sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_y")), "b").join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_x")), "a")
    links = materialise(both.mapInArrow(_compare(percent), "a long, b long, linked boolean").where("linked").select("a", "b").unionByName(own), "links_to_hubs")
    found = components(links)
    # Groups that still hold several components: who may have a partner, then who has.
    named = groups.join(found, "id", "left").select("hub", "id", F.coalesce("component", "id").alias("component"))
    dealt = _blocks(named.join(bits, "id"), F.lit(8 * WORDS64))
    active = materialise(dealt.mapInArrow(_candidates(percent, margin), "hub long, id long").distinct(), "may_link")
    dealt = _blocks(named.join(active, ["hub", "id"]).join(sets.select("id", "hashes", (F.length("hashes") / 8).cast("long").alias("n")), "id"), F.length("hashes"))
    more = materialise(dealt.mapInArrow(_joining(percent), "a long, b long"), "links_of_groups")
    if more.limit(1).count():
        found = components(links.unionByName(more))
    return table, same, found
