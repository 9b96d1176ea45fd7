"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over some consecutive tokens; the tokens at its 0s are ignored, so a seed still hits
where some of them have been replaced. Hashes of the benchmark's seeds are joined with those of
each document, and around a hit the two texts are laid side by side (same offset, no gaps): the
document is contaminated if some aligned stretch of ``min(STRETCH, item length)`` tokens or more,
has ``LEAST_SAME`` of its tokens equal.

No such stretch is missed: it holds one of STRETCH to 2 * STRETCH - 1 tokens that is as alike, and
whichever tokens of that are replaced, one of ``MASKS`` hits (for items under STRETCH tokens, one of
``SHORT_MASKS``); tests count this through.

The benchmark is the stated query set: it is dealt into blocks of at most ``BLOCK_TOKENS`` tokens,
and each block's seeds are sent to all tasks, which join them with the seeds of their documents.
Documents are never shuffled or collected. Findings of several blocks meet by the digest of the text,
so the number of blocks changes no result.

Tokens are runs of letters and digits, lower-cased. Items of ``LEAST_TOKENS`` to ``WHOLE`` tokens
match only as a whole, by a contiguous seed of their length; items with fewer tokens are no evidence
and match nothing. Null and empty texts and items match nothing; equal items count once (the
smallest id stands for them); repeated rows are judged each by their own text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.hashing import Running, mix
from leadmill.llm.slices import by_bytes
from leadmill.storage import broadcast_if_small, materialise, scratch

#: Fixed masks for items of STRETCH tokens or more, and for those of more than WHOLE.
MASKS = ("111011", "10010111", "111000101", "11111")
SHORT_MASKS = ("111011", "11001011", "11111", "100100111", "110101001")
STRETCH = 16
LEAST_SAME = 0.75
LEAST_TOKENS, WHOLE = 5, 8
BLOCK_TOKENS = 500_000
_TOKEN = re.compile(r"[^\W_]+")
_LUT: list[np.ndarray] = []


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of some texts, in order, and the number of its text."""
    if not _LUT:
        lut = np.zeros(sys.maxunicode + 1, dtype=bool)
        lut[: 0x33480] = [chr(c).isalnum() for c in range(0x33480)]  # none beyond
        _LUT.append(lut)
    texts = ["\0" + (t or "").lower() + "\0" for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = _LUT[0][points]
    starts, stops = np.flatnonzero(own[1:] & ~own[:-1]) + 1, np.flatnonzero(own[:-1] & ~own[1:]) + 1
    ends = np.cumsum([len(t) for t in texts])
    return Running(points).of(starts, stops), np.searchsorted(ends, starts, side="right")


def _seeds(tokens: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the tokens at a mask's 1s, for some positions."""
    out = np.full(len(at), np.uint64(int(mask, 2) | 1 << len(mask)))
    for i, bit in enumerate(mask):
        if bit == "1":
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + tokens[at + i])
    return out


class Block:
    """Some items of the benchmark, as hashes of tokens laid end to end, and their seeds in hash order."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [item for item, _ in items]
        self.sizes = np.array([len(t) for _, t in items], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.tokens = np.concatenate([t for _, t in items])
        self.words = np.unique(self.tokens)
        parts: dict[str, list] = {}
        for at, size in enumerate(self.sizes.tolist()):
            for mask in MASKS if size >= STRETCH else SHORT_MASKS if size > WHOLE else ("1" * size,):
                places = np.arange(size - len(mask) + 1)
                if len(places):
                    parts.setdefault(mask, []).append((_seeds(self.tokens, self.begins[at] + places, mask), np.full(len(places), at, dtype=np.int32), places.astype(np.int32)))
        self.seeds = {}
        for mask, found in parts.items():
            hashes, item, place = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.seeds[mask] = hashes[order], item[order], place[order]

    def hits(self, tokens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, where the item would start) of every seed that both have, each once."""
        known = self.words[np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)] == tokens
        found = [np.zeros((3, 0), dtype=np.int64)]
        for mask, (hashes, item, place) in self.seeds.items():
            n = len(tokens) - len(mask) + 1
            if n <= 0:
                continue
            whole = text[:n] == text[len(mask) - 1 :]
            for i, bit in enumerate(mask):
                if bit == "1":
                    whole &= known[i : i + n]
            at = np.flatnonzero(whole)
            seeds = _seeds(tokens, at, mask)
            low, high = np.searchsorted(hashes, seeds), np.searchsorted(hashes, seeds, side="right")
            count = high - low
            row = np.repeat(np.arange(len(at)), count)
            own = np.repeat(low, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.stack([text[at[row]], item[own].astype(np.int64), at[row] - place[own]]))
        text, item, start = np.concatenate(found, axis=1)
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        new = np.ones(len(text), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] != start[:-1])
        return text[new], item[new], start[new]

    def overlap(self, tokens: np.ndarray, item: int, start: int, low: int, high: int) -> int:
        """Equal tokens in the best aligned stretch that is long and similar enough; else 0."""
        need, begin = min(STRETCH, int(self.sizes[item])), int(self.begins[item])
        if high - low < need:
            return 0
        same = self.tokens[begin + low : begin + high] == tokens[start + low : start + high]
        # Of a stretch from i to j, above[j] - above[i] >= 0 says that LEAST_SAME of it is equal.
        above = np.concatenate([[0.0], np.cumsum(same - LEAST_SAME)])
        least = np.minimum.accumulate(above[: len(above) - need])
        gain = above[need:] - least
        if gain.max() < -1e-9:
            return 0
        end = int(gain.argmax()) + need
        first = int(above[: end - need + 1].argmin())
        return int(same[first:end].sum())

    def best(self, texts: list[str | None]) -> list[tuple[int, int, int] | None]:
        """For each text: number of items found, the item that shares most, equal tokens; or nothing."""
        tokens, text = token_hashes(texts)
        out: list[tuple[int, int, int] | None] = [None] * len(texts)
        if not len(tokens):
            return out
        own, item, start = self.hits(tokens, text)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        low, high = np.maximum(0, cuts[own] - start), np.minimum(self.sizes[item], cuts[own + 1] - start)
        need = np.minimum(STRETCH, self.sizes[item])
        enough = np.zeros(len(own), dtype=bool)
        for i in range(0, len(own), 4096):  # a stretch that will do has this many equal tokens in all
            size = (high - low)[i : i + 4096]
            row = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[i : i + 4096][row]
            same = self.tokens[self.begins[item[i : i + 4096]][row] + nth] == tokens[start[i : i + 4096][row] + nth]
            enough[i : i + 4096] = np.bincount(row, weights=same, minlength=len(size)) >= LEAST_SAME * need[i : i + 4096]
        found: dict[int, dict[int, int]] = {}
        for i in np.flatnonzero(enough).tolist():
            same = self.overlap(tokens, int(item[i]), int(start[i]), int(low[i]), int(high[i]))
            if same:
                items = found.setdefault(int(own[i]), {})
                items[int(item[i])] = max(items.get(int(item[i]), 0), same)
        for row, items in found.items():
            same, one = max((same, -self.ids[i]) for i, same in items.items())
            out[row] = len(items), -one, same
        return out


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark's distinct items, block by block; no more than a block is on the driver at a time."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id")).orderBy("item_id", "text")
    held, size = [], 0
    for row in items.toLocalIterator():
        words, _ = token_hashes([row["text"]])
        if len(words) < LEAST_TOKENS:
            continue
        if held and size + len(words) > BLOCK_TOKENS:
            yield Block(held)
            held, size = [], 0
        held.append((row["item_id"] if row["item_id"] is not None else -1, words))
        size += len(words)
    if held:
        yield Block(held)


def _digests(shared, nth: int):
    """Findings of a block as (digest of the text, number of the block, finding), one for each text of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = list({t for t in batch.column("text").to_pylist() if t})
            rows = [(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest(), nth, *f) for t, f in zip(texts, shared.value.best(texts)) if f]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), *(pa.int64(),) * 4), strict=True)], names=["digest", "block", "items", "item_id", "same"])

    return run


def _findings(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(digest, items, item_id, same) of the texts in which something was found.

    The blocks of the benchmark are taken one after the other: one is broadcast, all texts are searched for it, its
    findings are written, and it is gone before the next. So neither the driver nor an executor ever holds more than a
    block, of BLOCK_TOKENS tokens, however large the benchmark is."""
    spark = rows.sparkSession
    kind = "digest binary, block long, items long, item_id long, same long"
    with scratch(spark) as made:
        every = spark.createDataFrame([], kind)
        for nth, block in enumerate(blocks(benchmark)):
            shared = spark.sparkContext.broadcast(block)
            every = every.unionByName(materialise(rows.select("text").mapInArrow(_digests(shared, nth), kind), f"findings_{nth}"))
            shared.destroy()
        best = F.max(F.struct("same", (-F.col("item_id")).alias("item"), "items"))
        every = every.groupBy("digest", "block").agg(best.alias("best"), F.max("items").alias("items")).groupBy("digest").agg(F.sum("items").alias("items"), F.max("best").alias("best"))
        return made.keep(materialise(every.select("digest", "items", (-F.col("best.item")).alias("item_id"), F.col("best.same").alias("same")), "findings"))


def _digest():
    return F.unhex(F.md5(F.encode("text", "UTF-8")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items (benchmark items found), item_id (the one that shares most), n_same."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.select("doc_id", _digest().alias("digest")).join(broadcast_if_small(_findings(rows, benchmark)), "digest", "left")
    return found.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("same", F.lit(0)).cast("long").alias("n_same"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any others) in which nothing of the benchmark is found."""
    found = _findings(docs.select(F.col("text").cast("string").alias("text")), benchmark).select("digest")
    held = docs.withColumn("own_digest", _digest())
    return held.join(broadcast_if_small(found), held["own_digest"] == found["digest"], "left_anti").drop("own_digest")
