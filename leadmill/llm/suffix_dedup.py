"""Removal of repeated passages by suffix sorting: external induced sorting of shards.

A byte goes if a string of ``length`` bytes covers it that also starts anywhere else. Strings are
judged on the input; matches never cross documents.

Equal strings must meet in one shard. Each string has a minimizer: of its pieces of ``length // 8`` bytes, the
one of the smallest hash. Consecutive strings with one minimizer form a segment. At least half of a string's
other bytes stand on one side of its minimizer; the strings of a segment that have them before it are its left
side, the others its right side, and equal strings are on the same side with the same minimizer and half. Only keys, hashes of halves and 128-bit digests of segments
are shuffled at first. A side that shares minimizer and half with no other segment cannot repeat, unless the
whole segment stands several times. What is left is fetched: sides that meet others, and segments that stand
several times as two copies (neighbours as one piece). These are dealt into shards by minimizer and half, and
each shard's suffixes are put in order by ``induced_sort``. A side's piece holds ``length - 1`` bytes beyond its strings,
mostly more than the strings themselves; so a minimizer and half that at most ``FEW`` segments share go to the shard of the
smallest such that stands within ``NEAR`` sides of one of them. Where it goes depends on minimizer and half alone, so equal
strings still meet, and neighbouring sides of a text that go to one shard are one piece. Neighbours with a common prefix of ``length`` bytes
are repeats; nothing else is. A half that more than ``HOT`` segments share is dealt further by the strings'
second minimizer, which equal strings share too. A shard's text goes to disk as it arrives, and a shard
larger than ``MEMORY`` is sorted there.

Of a class of equal segments only the first is fetched. Texts are shuffled twice at any size: to meet the
list of their segments to fetch, and to meet their repeated spans.

Defined results: a null text is empty; texts under ``length`` bytes keep all; repeated rows count as
copies of each other; null ids are allowed; an empty table gives no rows; extra columns are kept
by ``deduplicated`` and ignored by ``removals``.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.hashing import mix, powers
from leadmill.llm.induced_sort import AHEAD, Disk, suffixes
from leadmill.llm.slices import by_bytes
from leadmill.storage import broadcast_if_small, materialise, scratch

LENGTH = 400
SHARD_BYTES = 4 << 20
MEMORY = 8 << 20
HOT = 500
FEW = 16
NEAR = 2


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, from running minima of blocks of that width."""
    n = len(x) - width + 1
    whole = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    whole[: len(x)] = x
    blocks = whole.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def _piece_hashes(total: np.ndarray, down: np.ndarray, kmer: int) -> np.ndarray:
    """Hash of the ``kmer`` bytes that begin at each place."""
    return mix((total[kmer:] - total[:-kmer]) * down[: len(total) - kmer])


def minimizers(pieces: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` hashes, the leftmost of equal ones."""
    at = np.arange(len(pieces), dtype=np.uint64)
    bits = np.uint64(max(1, int(len(pieces)).bit_length()))
    least = _sliding_min(((pieces >> bits) << bits) | at, width)
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, first start (in its text), number of starts, number of those on the left
    side, key of the minimizer, 32 bits each of the hashes of the halves before and behind it (0 where no string holds it)."""
    begins = np.concatenate([[0], ends[:-1]])
    starts = np.maximum(0, ends - begins - length + 1)
    text = np.repeat(np.arange(len(ends)), starts)
    if not len(text):
        return (text,) * 4 + (np.zeros(0, dtype=np.uint64),) * 2
    kmer = length // 8
    half = (length - kmer) // 2
    total, down = _running(data)
    pieces = _piece_hashes(total, down, kmer)
    least = minimizers(pieces, length - kmer + 1)
    start = begins[text] + np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts)
    piece = least[start]
    new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(text)))
    first, text, piece = start[heads], text[heads], piece[heads]
    left = np.clip(piece - half - first + 1, 0, count)
    spelled = lambda i, j: mix((total[j] - total[i]) * down[i])
    before = np.where(left > 0, spelled(np.maximum(piece - half, 0), piece), np.uint64(0))
    behind = np.where(left < count, spelled(np.minimum(piece + kmer, len(data)), np.minimum(piece + kmer + half, len(data))), np.uint64(0))
    return text, first - begins[text], count, left, pieces[piece], (before >> np.uint64(32)) << np.uint64(32) | behind >> np.uint64(32)


def _digests(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in pieces), dtype=np.int64).reshape(-1, 2)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "bytes"):
            texts = batch.column("bytes").to_pylist()
            whole = b"".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            text, first, count, left, key, halves = segments(np.frombuffer(whole, dtype=np.uint8), ends, length)
            low = np.concatenate([[0], ends[:-1]]).astype(np.int64)[text] + first
            spelled = _digests([whole[i:j] for i, j in zip(low.tolist(), (low + count - 1 + length).tolist(), strict=True)])
            at = pa.array(text)
            columns = [batch.column("doc").take(at), pa.array(first.astype(np.int32)), *(pa.array(c.view(np.int64)) for c in (count << 32 | left, halves, key)), pa.array(spelled[:, 0]), pa.array(spelled[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SEGMENT.split(", ")])

    return run


_SEGMENT = "doc binary, first int, size long, halves long, key long, a long, b long"
_MEMBER = "struct<key: long, a: long, b: long, low: int, count: int>"
_FETCHED = f"key long, dealt long, a long, b long, low int, twice boolean, piece binary, members array<{_MEMBER}>"
_MEMBER_TYPE = pa.struct([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.int32()), ("count", pa.int32())])


def _second(piece: bytes, key: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of a piece by their second minimizer: where each run of one begins, and its hash."""
    kmer = length // 8
    hashes = _piece_hashes(*_running(np.frombuffer(piece, dtype=np.uint8)), kmer)
    hashes[hashes == np.int64(key).view(np.uint64)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = minimizers(hashes, length - kmer + 1)
    heads = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return heads, hashes[least[heads]].view(np.int64)


def _fetch(length: int):
    """Bytes of the wanted strings, and which strings of which classes they are. Those of a hot half are cut by
    the second minimizer; neighbours that stand ``twice``, or that go to one shard, are one piece."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(_MEMBER_TYPE))
    names = ["key", "dealt", "a", "b", "low", "twice", "piece", "members"]

    def pieces(text: bytes, wanted: list[dict]) -> Iterator[tuple]:
        run: list[dict] = []
        for w in sorted(wanted, key=lambda w: (w["twice"], w["first"], w["low"])):
            last = run[-1] if run else w
            joined = last["twice"] == w["twice"] and (w["twice"] or last["group"] == w["group"] and not w["hot"])
            if run and not (joined and last["first"] + last["high"] == w["first"] + w["low"]):
                yield from spelled(text, run)
                run = []
            run.append(w)
        if run:
            yield from spelled(text, run)

    def spelled(text: bytes, run: list[dict]) -> Iterator[tuple]:
        one, last = run[0], run[-1]
        whole = text[one["first"] + one["low"] : last["first"] + last["high"] - 1 + length]
        if not one["hot"]:
            yield one["group"], 0, one["a"], one["b"], one["low"], one["twice"], whole, [(m["key"], m["a"], m["b"], m["low"], m["high"] - m["low"]) for m in run]
            return
        heads, dealt = _second(whole, one["key"], length)
        for low, high, key in zip(heads.tolist(), [*heads[1:].tolist(), one["high"] - one["low"]], dealt.tolist(), strict=True):
            yield one["group"], key, one["a"], one["b"], one["low"] + low, False, whole[low : high - 1 + length], [(one["key"], one["a"], one["b"], one["low"] + low, high - low)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in by_bytes(batches, "bytes"):
            for text, wanted in zip(batch.column("bytes").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                for row in pieces(text, wanted):
                    rows.append(row)
                    held += len(row[6])
                if held > 1 << 20:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return work


class Shard:
    """Pieces that are sorted together. Their text is written to a file as they come."""

    def __init__(self, folder: str, length: int, memory: int):
        self.length, self.memory = length, memory
        self.folder = tempfile.mkdtemp(dir=folder)
        self.file = open(os.path.join(self.folder, "text"), "wb")  # noqa: SIM115
        self.sizes: list[np.ndarray] = []
        self.bytes, self.files = 0, 0

    def add(self, pieces: pa.Array) -> None:
        size = np.diff(np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset : pieces.offset + len(pieces) + 1])
        low = int(np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset])
        data = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[low : low + int(size.sum())]
        # UTF-8 has no bytes over 0xF4: each is one higher here, 0xFF stands behind each piece and 0 at the end.
        out = np.full(len(data) + len(size), 0xFF, dtype=np.uint8)
        out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data + 1
        self.file.write(out.tobytes())
        self.sizes.append(size.astype(np.int64))
        self.bytes += len(data)

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Piece, first and last of each run of starts whose strings also start elsewhere in the shard."""
        self.file.write(bytes(1 + AHEAD))  # the end, and room for reading ahead
        self.file.close()
        sizes = np.concatenate(self.sizes)
        begins = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(sizes) + 1
        text = np.memmap(self.file.name, dtype=np.uint8, mode="r").view(np.ndarray)
        disk = Disk(self.folder, self.memory)
        hit, carried = disk.array(n, bool), False
        for part in suffixes(text, n, 256, self.length, disk):  # from the last suffix to the first
            if not len(part):
                continue
            found = part[:, 1] >= self.length
            hit[part[found | np.append(carried, found[:-1]), 0]] = True
            carried = bool(found[-1])
        self.files = disk.files
        for low, high in disk.slices(len(sizes)):
            at = np.flatnonzero(hit[begins[low] : begins[high - 1] + sizes[high - 1]]) + begins[low]
            piece = np.searchsorted(begins, at, side="right") - 1
            start = at - begins[piece]
            inside = start + self.length <= sizes[piece]
            piece, start = piece[inside], start[inside]
            if len(piece):
                new = np.append(True, (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1))
                yield piece[new], start[new], start[np.append(new[1:], True)]


def _sort_shards(length: int, shard_bytes: int, memory: int):
    """Rows come in order of (key, dealt, a, b, low); whole groups (key, dealt) are sorted, about
    ``shard_bytes`` at a time, larger ones each as one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="suffixes") as folder:
            shard, about, last, seen = None, [], None, None

            def done() -> Iterator[pa.RecordBatch]:
                shown, many = (np.concatenate(c) for c in zip(*((x, n) for x, n, _ in about), strict=True))
                member = pa.concat_arrays([m for _, _, m in about])
                key, a, b, low, count = (member.field(i).to_numpy().astype(np.int64) for i in range(5))
                begins = np.cumsum(many) - many  # a piece's first member
                ends = np.cumsum(count)
                offset = ends - count - np.repeat((ends - count)[begins], many)  # of a member's first string in its piece
                place = np.repeat(np.arange(len(many)), many) * (1 << 40) + offset
                for piece, start, stop in shard.repeats():
                    own = shown[piece]
                    piece, start, stop = piece[own], start[own], stop[own]
                    one, last = (np.searchsorted(place, piece * (1 << 40) + x, side="right") - 1 for x in (start, stop))
                    run = np.repeat(np.arange(len(piece)), last - one + 1)
                    at = one[run] + np.arange(len(run)) - np.repeat(np.cumsum(last - one + 1) - (last - one + 1), last - one + 1)
                    first, final = np.maximum(start[run] - offset[at], 0), np.minimum(stop[run] - offset[at], count[at] - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[at], a[at], b[at], low[at] + first, low[at] + final)], names=["key", "a", "b", "start", "stop"])

            for batch in by_bytes(batches, "piece", 1 << 20, 4096):
                key, dealt, a, b, low = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "dealt", "a", "b", "low"))
                group = np.append(last is None or (key[0], dealt[0]) != last, (key[1:] != key[:-1]) | (dealt[1:] != dealt[:-1]))
                # One text that two rows with one id and text brought stands once.
                fresh = np.append(True, group[1:] | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (low[1:] != low[:-1]))
                fresh[0] = (key[0], dealt[0], a[0], b[0], low[0]) != seen
                last, seen = (key[-1], dealt[-1]), (key[-1], dealt[-1], a[-1], b[-1], low[-1])
                sizes = np.cumsum(np.diff(np.frombuffer(batch.column("piece").buffers()[1], dtype=np.int32)[batch.column("piece").offset :][: batch.num_rows + 1]))
                heads = np.flatnonzero(group).tolist()
                cuts, since = [0], 0
                for at in heads:  # a group that would begin beyond the shard's bytes begins a new one
                    held = (shard.bytes if shard and len(cuts) == 1 else 0) + (int(sizes[at - 1]) if at else 0) - since
                    if held >= shard_bytes:
                        cuts.append(at)
                        since = int(sizes[at - 1]) if at else 0
                for i, (first, stop) in enumerate(zip(cuts, [*cuts[1:], batch.num_rows])):
                    if i and shard:
                        yield from done()
                        shard, about = None, []
                    own = np.flatnonzero(fresh[first:stop]) + first
                    if not len(own):
                        continue
                    times = 1 + batch.column("twice").to_numpy(zero_copy_only=False)[own].astype(np.int64)
                    rows = np.repeat(own, times)
                    if shard is None:
                        shard = Shard(folder, length, memory)
                    shard.add(batch.column("piece").take(pa.array(rows)))
                    members = batch.column("members").take(pa.array(rows))
                    about.append((np.append(True, rows[1:] != rows[:-1]), pc.list_value_length(members).to_numpy().astype(np.int64), members.flatten()))
            if shard:
                yield from done()

    return run


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _homes(sides: DataFrame) -> DataFrame:
    """The sides, each group in the shard of a neighbouring one; ``new`` where a side does not follow another in its text."""
    few = F.col("n") <= min(FEW, HOT)
    along = Window.partitionBy("doc").orderBy("place")
    run = Window.partitionBy("doc", "run").orderBy("place")
    placed = sides.withColumns({"doc": F.substring("one", 1, 16), "place": F.col("first") + F.col("low")})
    placed = placed.withColumn("new", F.coalesce(F.lag(F.col("place") + F.col("high") - F.col("low")).over(along) != F.col("place"), F.lit(True)))
    placed = placed.withColumn("run", F.sum(F.col("new").cast("int")).over(along))
    near = materialise(placed.withColumn("near", F.min(F.when(few, F.col("group"))).over(run.rowsBetween(-NEAR, NEAR))).drop("doc", "place", "run"), "near")
    homes = near.where(few).groupBy("group").agg(F.min("near").alias("home")).where("home < group")
    return near.join(broadcast_if_small(homes), "group", "left").withColumn("group", F.coalesce("home", "group")).drop("home", "near")


def repeated_spans(docs: DataFrame, length: int, made: scratch) -> tuple[DataFrame, DataFrame]:
    """The rows with ``bytes`` and ``doc``, a digest of id and text; and for each doc with repeats its spans of bytes."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.withColumns({"bytes": text, "doc": F.unhex(F.md5(F.concat(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"), F.encode(F.lit(" "), "UTF-8"), text)))})
    whole = rows.where(F.length("bytes") >= length).select("doc", "bytes")
    cut = materialise(whole.mapInArrow(_cut(length), _SEGMENT), "segments")
    # A class is all segments with the same bytes; the first of them stands for it, as doc and place in one.
    site = F.concat("doc", F.unhex(F.lpad(F.hex("first"), 8, "0")))
    classes = cut.groupBy("key", "a", "b").agg(F.min(site).alias("one"), (F.count(F.lit(1)) > 1).alias("twice"), F.first("size").alias("size"), F.first("halves").alias("halves"))
    classes = materialise(classes, "classes")
    count, left, zero = F.shiftright("size", 32).cast("int"), F.col("size").bitwiseAND(0xFFFFFFFF).cast("int"), F.lit(0)
    side = lambda n, half, low, high: F.struct(F.xxhash64("key", F.lit(n), half).alias("group"), low.alias("low"), high.alias("high"))
    sides = F.filter(F.array(side(0, F.shiftright("halves", 32), zero, left), side(1, F.col("halves").bitwiseAND(0xFFFFFFFF), left, count)), lambda s: s["low"] < s["high"])
    # All strings of a segment that stands twice are found by its copies: it is met for the sake of others only.
    met = classes.select("twice", F.explode(F.transform(sides, lambda s: s["group"])).alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.bool_and("twice").alias("settled")).where("n > 1 and not settled")
    met = materialise(met.select("group", F.least("n", F.lit(1 << 30)).cast("int").alias("n")), "met")
    first = F.conv(F.hex(F.substring("one", 17, 4)), 16, 10).cast("int").alias("first")
    shared = classes.select("key", "a", "b", "one", first, F.inline(sides)).join(broadcast_if_small(met), "group").select("key", "a", "b", "one", "first", "low", "high", "group", F.lit(False).alias("twice"), "n")
    shared = _homes(shared).withColumn("hot", F.col("n") > HOT).drop("n")
    copied = classes.where("twice").select("key", "a", "b", "one", first, zero.alias("low"), count.alias("high"), F.xxhash64("key", "a", "b").alias("group"), "twice", F.lit(True).alias("new"), F.lit(False).alias("hot"))
    unsorted = materialise(shared.unionByName(copied), "unsorted")
    made.drop(classes)
    amount = unsorted.agg(F.sum(F.when(F.col("twice"), 2 * F.col("high")).otherwise(F.col("high") - F.col("low") + F.when(F.col("new"), length).otherwise(0)))).first()[0]
    wanted = unsorted.groupBy(F.substring("one", 1, 16).alias("doc")).agg(F.collect_list(F.struct("first", "low", "high", "key", "group", "a", "b", "hot", "twice")).alias("wanted"))
    pieces = whole.join(wanted, "doc").select("bytes", "wanted").mapInArrow(_fetch(length), _FETCHED)
    shards = max(1, int((amount or 0) // (2 * SHARD_BYTES)) + 1)
    ordered = pieces.repartition(shards, "key", "dealt").sortWithinPartitions("key", "dealt", "a", "b", "low")
    found = materialise(ordered.mapInArrow(_sort_shards(length, SHARD_BYTES, MEMORY), "key long, a long, b long, start long, stop long"), "repeated_strings")
    spans = cut.join(broadcast_if_small(found), ["key", "a", "b"]).select("doc", F.struct((F.col("first") + F.col("start")).alias("low"), (F.col("first") + F.col("stop") + length).alias("high")).alias("span"))
    return rows, materialise(spans.groupBy("doc").agg(F.collect_set("span").alias("spans")), "spans")


_COUNTED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(with_text: bool):
    """What is left of each text: the text itself, or its figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "bytes"):
            kept_rest = batch.drop_columns(["bytes", "spans"])
            out = []
            for text, spans in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                gone = _merged([(s["low"], s["high"]) for s in spans or []])
                edges = [0, *(e for span in gone for e in span), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else text
                out.append((kept.decode("utf-8", "ignore"),) if with_text else (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            names = ["kept_text"] if with_text else [c.split()[0] for c in _COUNTED.split(", ")]
            types = [pa.string()] if with_text else [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*kept_rest.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*kept_rest.schema.names, *names])

    return run


def _removed(docs: DataFrame, columns: list[str], length: int, with_text: bool) -> DataFrame:
    with scratch(docs.sparkSession) as made:
        rows, spans = repeated_spans(docs, length, made)
        made.keep(spans)
    joined = rows.select(*columns, "bytes", "doc").join(spans, "doc", "left").select(*columns, "bytes", "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*columns).schema.fields)
    return joined.mapInArrow(_remove(with_text), f"{fields}, {'kept_text string' if with_text else _COUNTED}")


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and shortened (something was removed) for each row of ``docs``."""
    out = _removed(docs.select("doc_id", "text"), ["doc_id"], length, False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("shortened"))


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` (doc_id, text and others) with the repeated passages cut out of ``text``.

    A character that a cut goes through is dropped; a null text stays null.
    """
    kept = [c for c in docs.columns if c != "text"]
    own = {c: f"own_{i}" for i, c in enumerate(kept)}
    held = docs.select("text", F.col("doc_id"), F.struct(*(F.col(c).alias(own[c]) for c in kept)).alias("held"), F.col("text").isNull().alias("no_text"))
    out = _removed(held, ["held", "no_text"], length, True)
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    return out.select(*(text.alias("text") if c == "text" else F.col("held")[own[c]].alias(c) for c in docs.columns))
