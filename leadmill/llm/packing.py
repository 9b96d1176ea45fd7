"""Mixture-controlled packing: deficit round-robin over one queue per source.

Every round is worth one window of tokens. A queue's deficit grows by its share of the round; it
serves whole grains (128 tokens) while the deficit allows, and carries the rest into the next
round. The rounds' tokens, put one after another, fill windows with no gap, so every window holds
each source within one grain of its target, and only the very last one is padded.

The deficit that a queue carries into round w is ``ideal(w) - grain * floor(ideal(w) / grain)``,
where ``ideal`` is piecewise linear in w. So a task that holds a slice of a queue knows the
deficits of all queues at its first round, and places its own tokens with no other task's help:
documents are tokenised once, where they lie, and never shuffled. By default the target is the
mixture of the corpus itself; with other targets a queue that runs dry leaves its share to the rest.

There may be any number of sources. Each is dealt to one of ``LANES`` lanes by its hash, those with a
target of their own to lanes of their own. The sources of a lane take turns by the same
deficit round-robin and make the lane's stream, and the lanes take turns to fill the windows, so a
source's share holds within one grain at each of the two levels; a source that is alone in its lane
is simply a queue. Only the lanes' totals come to the driver.

Defined results: a null text is empty (its end token alone); a null source is a queue of its own;
repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.llm.slices import by_bytes
from leadmill.storage import broadcast_if_small, materialise

LANES = 4096
END_OF_TEXT = 50256
_TOKENS = "doc_id long, queue string, slice int, local_start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A function from a list of texts to arrays of ids. The path names the vocabulary: a
    ``.json`` of tokenizers, read at its defaults, or a ``.tiktoken`` file of ranks, for which
    ``<|endoftext|>`` in a text is the one token ``END_OF_TEXT`` too, as the ``.json`` has it."""
    if path not in _ENCODERS:
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            own = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": END_OF_TEXT})
            _ENCODERS[path] = lambda texts: [np.asarray(own.encode(t, allowed_special="all"), dtype=np.uint32) for t in texts]
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            one = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda texts: [np.asarray(e.ids, dtype=np.uint32) for e in one.encode_batch_fast(texts, add_special_tokens=False)]
    return _ENCODERS[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, part = encoder(path), {}, TaskContext.get().partitionId()
        for batch in by_bytes(batches, "text"):
            doc_ids, texts, queues = (c.to_pylist() for c in batch.columns)
            ids = [np.append(x, np.uint32(end_id)) for x in encode([t or "" for t in texts])]
            starts = []
            for queue, x in zip(queues, ids, strict=True):
                starts.append(at.get(queue, 0))
                at[queue] = starts[-1] + len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids, pa.int64()), pa.array(queues, pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "queue", "slice", "local_start", "n", "ids"],
            )

    return run


class Rounds:
    """The deficit round-robin over queues of known lengths, in closed form."""

    def __init__(self, lengths: list[int], weights: list[float], window: int, grain: int):
        self.window, self.grain, self.lengths = window, grain, np.array(lengths, dtype=np.int64)
        self.whole = self.lengths // grain
        left, knots_w, knots = self.lengths.astype(float), [0.0], [np.zeros(len(lengths))]
        weights = np.where(self.lengths > 0, np.maximum(np.array(weights, dtype=float), 1e-12), 0)
        while (alive := left > 1e-6 * np.maximum(1, self.lengths)).any():
            rate = np.where(alive, weights, 0)
            rate *= window / rate.sum()
            span = (left[alive] / rate[alive]).min()  # rounds until the first queue runs dry
            left = np.maximum(0, left - rate * span)
            knots_w.append(knots_w[-1] + span)
            knots.append(knots[-1] + rate * span)
        self.knots_w, self.knots = np.array(knots_w), np.array(knots)
        self.last = int(self.knots_w[-1])  # from this round on, each queue serves all that is left

    def grains(self, queue: int, w: np.ndarray) -> np.ndarray:
        """Grains that a queue has served before round w (w <= last)."""
        ideal = np.interp(w, self.knots_w, self.knots[:, queue])
        return np.minimum((ideal / self.grain).astype(np.int64), self.whole[queue])

    def round_of(self, queue: int, k: np.ndarray) -> np.ndarray:
        """The round in which a queue serves its k-th grain."""
        ideal = self.knots[:, queue]
        w = np.ceil(np.interp((k + 1.0) * self.grain, ideal, self.knots_w)).astype(np.int64) - 1
        w = np.clip(w, 0, self.last)
        for _ in range(3):
            w = np.where((w > 0) & (self.grains(queue, w) > k), w - 1, w)
        for _ in range(3):
            w = np.where((w < self.last) & (self.grains(queue, w + 1) <= k), w + 1, w)
        return w

    def places(self, queue: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token position at which a queue's turn in round w begins, and its tokens served before it."""
        rounds, at = np.unique(w, return_inverse=True)
        n = len(self.lengths)
        before = np.empty((len(rounds), n), dtype=np.int64)
        after = np.empty_like(before)
        for s in range(n):
            before[:, s] = self.grains(s, rounds) * self.grain
            after[:, s] = np.where(rounds >= self.last, self.lengths[s], self.grains(s, np.minimum(rounds + 1, self.last)) * self.grain)
        turns = np.cumsum(after - before, axis=1) - (after - before)
        base = before.sum(axis=1)[:, None] + turns
        return base[at, queue], before[at, queue]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): rows (0, 0, 1, 1, 1) and positions (0, 1, 0, 1, 2)."""
    rows = np.repeat(np.arange(len(counts)), counts)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def served(rounds: Rounds, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the tokens at ``start`` of their queue go: row, first token of the row, length and position in
    the rounds' stream of each grain, or part of one."""
    g = rounds.grain
    first = start // g
    rows, nth = _spread((start + n - 1) // g - first + 1)
    k = first[rows] + nth
    low, high = np.maximum(k * g, start[rows]), np.minimum((k + 1) * g, (start + n)[rows])
    w, at = np.empty(len(k), dtype=np.int64), np.empty(len(k), dtype=np.int64)
    for s in np.unique(queue):
        mine = queue[rows] == s
        w[mine] = rounds.round_of(int(s), k[mine])
    some = max(16, (1 << 20) // len(rounds.lengths))
    for i in range(0, len(k), some):
        base, before = rounds.places(queue[rows[i : i + some]], w[i : i + some])
        at[i : i + some] = base + low[i : i + some] - before
    return rows, low - start[rows], high - low, at


def joined(rows: np.ndarray, first: np.ndarray, length: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of one row that follow each other both there and in the stream become one."""
    if not len(rows):
        return rows, first, length, at
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (first[1:] != (first + length)[:-1]) | (at[1:] != (at + length)[:-1])
    heads = np.flatnonzero(new)
    return rows[heads], first[heads], np.add.reduceat(length, heads), at[heads]


def place_pieces(rounds: Rounds, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For documents at ``start`` of their queue: row, first token, length and position of each piece, cut at windows' ends."""
    rows, first, length, at = joined(*served(rounds, queue, start, n))
    piece, nth = _spread((at + length - 1) // rounds.window - at // rounds.window + 1)
    cut = np.maximum(at[piece], (at[piece] // rounds.window + nth) * rounds.window)
    end = np.minimum(at[piece] + length[piece], (at[piece] // rounds.window + nth + 1) * rounds.window)
    return rows[piece], first[piece] + cut - at[piece], end - cut, cut


def _pack(rounds: Rounds, names: list[str]):
    number = {name: i for i, name in enumerate(names)}

    def in_lane(member: list, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, first token, length and position in its lane's stream of each piece of some documents."""
        alone = np.array([row for row, m in enumerate(member) if m is None], dtype=np.int64)
        parts = [(alone, np.zeros(len(alone), dtype=np.int64), n[alone], start[alone])]
        lanes: dict[tuple, list[int]] = {}
        for row, m in enumerate(member):
            if m is not None:
                lanes.setdefault(tuple(m["lengths"]), []).append(row)
        for lengths, own in lanes.items():
            turns = Rounds(list(lengths), list(lengths), rounds.window, rounds.grain)
            own = np.array(own)
            rows, *rest = joined(*served(turns, np.array([member[r]["nth"] for r in own]), start[own], n[own]))
            parts.append((own[rows], *rest))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "ids", 1 << 20):
            doc_id, sources, lanes, member = (b.column(c).to_pylist() for c in ("doc_id", "source", "lane", "member"))
            start, n = b.column("start").to_numpy(), b.column("n").to_numpy()
            own, begin, size, at = in_lane(member, start, n)
            rows, first, length, at = place_pieces(rounds, np.array([number[lanes[r]] for r in own.tolist()], dtype=np.int64), at, size)
            rows, first = own[rows], begin[rows] + first
            bodies = [memoryview(x.as_buffer()) for x in b.column("ids")]
            crc = [zlib.crc32(bodies[r][4 * f : 4 * (f + size)]) for r, f, size in zip(rows.tolist(), first.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()).take(pa.array(rows)), pa.array(first), pa.array(length), pa.array(crc, pa.int64()), pa.array(n).take(pa.array(rows)), pa.array(at // rounds.window), pa.array(at % rounds.window), pa.array(sources, pa.string()).take(pa.array(rows))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, grain: int = 128, end_id: int = 0, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets`` gives sources' weights; those it does not name keep their own share of the corpus.
    """
    targets = targets or {}
    queue = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # the null source is ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), queue.alias("queue"))
    tokens = materialise(rows.mapInArrow(_tokenise(tokenizer, end_id), _TOKENS), "tokens")
    slices = tokens.groupBy("queue", "slice").agg(F.sum("n").alias("n"))
    hashed = F.concat(F.lit("#"), F.pmod(F.xxhash64("queue"), F.lit(LANES)).cast("string"))
    lane = F.when(F.col("queue").isin([f"={name}" for name in targets]), F.col("queue")).otherwise(hashed) if targets else hashed
    queues = materialise(slices.groupBy("queue").agg(F.sum("n").alias("n")).withColumn("lane", lane), "queues")
    totals = sorted((r["lane"], r["n"]) for r in queues.groupBy("lane").agg(F.sum("n").alias("n")).collect())  # one row a lane
    names, lengths = [lane for lane, _ in totals], [n for _, n in totals]
    rounds = Rounds(lengths, [targets.get(lane[1:], 0) if lane.startswith("=") else n / max(1, sum(lengths)) for lane, n in totals], window, grain)
    members = queues.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("queue", "n"))).alias("all"))
    members = members.select("lane", F.posexplode("all").alias("nth", "one"), "all").select("lane", "one.queue", F.when(F.size("all") > 1, F.struct("nth", F.col("all.n").alias("lengths"))).alias("member"))
    before = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("queue", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).join(members, "queue")
    placed = tokens.join(broadcast_if_small(materialise(starts, "starts")), ["queue", "slice"])
    source = F.when(F.col("queue") != "", F.expr("substring(queue, 2)"))
    return placed.select("doc_id", source.alias("source"), "lane", "member", (F.col("before") + F.col("local_start")).alias("start"), "n", "ids").mapInArrow(_pack(rounds, names), PIECES)
