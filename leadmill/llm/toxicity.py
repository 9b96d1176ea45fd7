"""Toxicity by class-conditional Kneser-Ney models that spell words out.

Each label has a model of words, letter by letter: a letter's chance after what the word holds so
far is its discounted count among the label's texts, plus the label's left-over mass times a
shared chance. The shared chance is Kneser-Ney on continuation counts of 4-letter grams of the
whole corpus, and both labels back off to it; so a rare or inflected expression that a label
has never seen is judged by the stem it shares with those it has. Every distinct word of a text
counts once, and words are spelled to their end. A text's features are length-normalised
log-likelihood differences, toxic less ordinary: the mean over its words, and the mean over its
``PEAK_WORDS`` highest words, which a long text does not dilute. A logistic curve turns the two into
a score between 0 and 1.

The shared counts come from all documents and grow with them. The labels' models are a classifier
fitted on a bounded sample of labelled rows outside the held-out fold: about ``TRAINING_ROWS`` rows,
half of them of each label, with about ``TRAINING_BYTES`` of text; the curve is fitted on about
``CALIBRATION_ROWS`` other rows in their own proportions. These bounds also bound what is broadcast:
a key and two numbers for each beginning of a word in the sample, none of which is left out.

Defined results: null and empty texts get the score of a text without evidence; repeated rows are
scored each; labels that are null or name no document are ignored, contradicting ones count as
toxic; with labels of one kind only every score is 0; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.folds import HELD_OUT, fold
from leadmill.llm.hashing import Running, mix
from leadmill.llm.slices import by_bytes
from leadmill.storage import materialise, scratch

TRAINING_ROWS, TRAINING_BYTES = 24_000, 24 << 20
CALIBRATION_ROWS = 12_000
THRESHOLD = 0.3
PEAK_WORDS = 4
_BITS = 12
_ROOT = 0
_LUT: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: 0 unless a letter, else a number below 2 ** 12 (equal only far apart)."""
    if not _LUT:
        lut = np.zeros(sys.maxunicode + 1, dtype=np.uint16)
        for c in range(0x33480):  # no letters beyond, private planes aside
            if chr(c).isalpha():
                lut[c] = 1 + c % ((1 << _BITS) - 1)
        _LUT.append(lut)
    return _LUT[0]


class Laid:
    """Lower-cased texts laid end to end, each between two 0s, and their words."""

    def __init__(self, texts: list[str | None]):
        texts = ["\0" + (t or "").lower() + "\0" for t in texts]
        self.n = len(texts)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.codes = _letters()[points]
        self.text = np.repeat(np.arange(self.n), [len(t) for t in texts])
        letter = self.codes > 0
        self.starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.stops = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.hashes = Running(np.where(letter, points, 0))
        self.whole = self.hashes.of(self.starts, self.stops)

    def grams(self) -> np.ndarray:
        """5-grams of each text's letters, where every run of anything else is one 0, as longs."""
        kept = np.concatenate([[True], (self.codes[1:] > 0) | (self.codes[:-1] > 0) | (self.text[1:] != self.text[:-1])]) if len(self.codes) else np.zeros(0, dtype=bool)
        x, text = self.codes[kept].astype(np.int64), self.text[kept]
        out = np.zeros(max(0, len(x) - 4), dtype=np.int64)
        for i in range(5):
            out = (out << _BITS) | x[i : i + len(out)]
        return np.unique(out[text[: len(out)] == text[4 : 4 + len(out)]])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of all texts, as numbers of occurrences; and (text, its word) without repeats."""
        _, first, word = np.unique(self.whole, return_index=True, return_inverse=True)
        pairs = np.unique(self.text[self.starts].astype(np.int64) * max(1, len(first)) + word)
        return first, pairs // max(1, len(first)), pairs % max(1, len(first))

    def keys(self, word: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Keys of words' first ``depth`` letters; one more than a word has stands for its end."""
        start, stop = self.starts[word], self.stops[word]
        key = self.hashes.of(start, np.minimum(start + depth, stop))
        key = np.where(start + depth > stop, mix(key ^ np.uint64(0x5DEECE66D)), key)
        return np.where(depth == 0, np.uint64(_ROOT), key).view(np.int64)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 1 << 20, 4096):
        yield pa.RecordBatch.from_arrays([pa.array(Laid(batch.column("text").to_pylist()).grams())], names=["gram"])


_BEGINNINGS = ("begin", "before", "letters", "gram", "toxic", "ordinary")


def _beginning_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each beginning of a word of a slice: the beginning before it, its last letters, and in how
    many toxic and ordinary texts a word stands that it begins."""
    for batch in by_bytes(batches, "text", 1 << 18):
        laid = Laid(batch.column("text").to_pylist())
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        first, text, word = laid.distinct()
        counts = [np.bincount(word, weights=kind[text], minlength=len(first)) for kind in (toxic, 1 - toxic)]
        size = laid.stops[first] - laid.starts[first] + 1  # the end is a letter too
        row = np.repeat(np.arange(len(first)), size)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
        key = laid.keys(first[row], depth)
        begin, at, number = np.unique(key, return_index=True, return_inverse=True)
        row, depth = row[at], depth[at]
        place = laid.starts[first[row]] + depth - 1
        gram = np.zeros(len(row), dtype=np.int64)
        for back in (3, 2, 1, 0):  # the sign before a word is 0, and so is its end
            gram = (gram << _BITS) | np.where(depth > back, laid.codes[np.maximum(place - back, 0)], 0)
        sums = [np.bincount(number, weights=c[np.repeat(np.arange(len(first)), size)], minlength=len(begin)).astype(np.int64) for c in counts]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (begin, laid.keys(first[row], depth - 1), np.minimum(depth + 1, 4), gram, *sums)], names=_BEGINNINGS)


def shared_chances(texts: DataFrame, discount: float) -> DataFrame:
    """(letters, gram, p): Kneser-Ney chances of a gram's last letter after the others, for 2 to 4 letters."""
    mask = lambda n: F.lit((1 << (_BITS * n)) - 1)
    seen = materialise(texts.select("text").mapInArrow(_gram_batches, "gram long").distinct(), "grams")
    out, chance = None, None
    for n in (2, 3, 4):
        types = seen.select(F.col("gram").bitwiseAND(mask(n + 1)).alias("g")).distinct().groupBy(F.col("g").bitwiseAND(mask(n)).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        context = types.groupBy(F.shiftright("gram", _BITS).alias("before")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = types.withColumn("before", F.shiftright("gram", _BITS)).join(context, "before")
        lower = F.lit(1e-3)
        if chance is not None:
            rows = rows.join(chance.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), F.col("suffix") == rows["gram"].bitwiseAND(mask(n - 1)), "left")
            lower = F.coalesce("lower", lower)
        chance = materialise(rows.select(F.lit(n).alias("letters"), "gram", ((F.col("c") - discount + discount * F.col("kinds") * lower) / F.col("total")).alias("p")), f"chances{n}")
        out = chance if out is None else out.unionByName(chance)
    return out


class Model:
    """For each beginning of a word in the sample: the log ratio, toxic to ordinary, of its last letter,
    and of the mass that is left to letters not seen after it."""

    def __init__(self, keys: np.ndarray, ratio: np.ndarray, rest: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratio, self.rest = keys[order], ratio[order].astype(np.float32), rest[order].astype(np.float32)

    def word_ratios(self, laid: Laid, words: np.ndarray) -> np.ndarray:
        """Log-likelihood differences of words. Past the last beginning that the sample has, both
        labels give the shared chance, which cancels."""
        total = np.zeros(len(words))
        root = self.rest[self.keys == _ROOT].sum()
        alive, rest, depth = np.arange(len(words)), np.full(len(words), root), 1
        while len(alive) and len(self.keys):
            key = laid.keys(words[alive], np.full(len(alive), depth))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            total[alive] += np.where(known, self.ratio[at], rest)
            ended = laid.starts[words[alive]] + depth > laid.stops[words[alive]]
            onward = known & ~ended
            alive, rest, depth = alive[onward], self.rest[at[onward]], depth + 1
        return total


def beginnings_model(texts: DataFrame, labelled: DataFrame, discount: float = 0.75) -> Model:
    """The model of ``labelled`` (text, toxic 0 or 1), a bounded sample, over the shared chances of ``texts``."""
    kinds = ("toxic", "ordinary")
    begun = labelled.select("text", "toxic").mapInArrow(_beginning_batches, ", ".join(f"{c} long" for c in _BEGINNINGS))
    begun = materialise(begun.groupBy("begin").agg(*(F.first(c).alias(c) for c in ("before", "letters", "gram")), *(F.sum(c).alias(c) for c in kinds)), "beginnings")
    context = begun.groupBy("before").agg(*(F.sum(c).alias(f"total_{c}") for c in kinds), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in kinds))
    left = {c: F.when(F.col(f"total_{c}") > 0, discount * F.col(f"kinds_{c}") / F.col(f"total_{c}")).otherwise(1.0) for c in kinds}
    rows = begun.join(context, "before").join(shared_chances(texts, discount), ["letters", "gram"], "left")
    p = {c: F.when(F.col(f"total_{c}") > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / F.col(f"total_{c}")).otherwise(0.0) + left[c] * F.coalesce("p", F.lit(1e-3)) for c in kinds}
    ratio = rows.select("begin", F.log(p["toxic"] / p["ordinary"]).alias("ratio"))
    rest = context.select(F.col("before").alias("begin"), F.log(left["toxic"] / left["ordinary"]).alias("rest"))
    found = ratio.join(rest, "begin", "full").select("begin", F.coalesce("ratio", F.lit(0.0)).cast("float").alias("ratio"), F.coalesce("rest", F.lit(0.0)).cast("float").alias("rest")).toArrow()  # bounded by the sample
    return Model(*(found[c].to_numpy() for c in ("begin", "ratio", "rest")))


def text_features(texts: list[str | None], model: Model) -> np.ndarray:
    """Mean log-likelihood difference over a text's distinct words, and over the highest PEAK_WORDS of them."""
    laid = Laid(texts)
    first, text, word = laid.distinct()
    ratio = model.word_ratios(laid, first)[word]
    n = np.bincount(text, minlength=laid.n)
    mean = np.bincount(text, weights=ratio, minlength=laid.n) / np.maximum(1, n)
    order = np.lexsort((-ratio, text))
    rank = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    top = order[rank < PEAK_WORDS]
    return np.column_stack([mean, np.bincount(text[top], weights=ratio[top], minlength=laid.n) / PEAK_WORDS])


def _featurise(shared, weights=None, with_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            x = text_features(batch.column("text").to_pylist(), shared.value)
            out = {"mean": x[:, 0], "peak": x[:, 1]} if weights is None else {"score": 1 / (1 + np.exp(-np.clip(x @ weights[:2] + weights[2], -30, 30)))}
            kept = batch if with_text else batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, out.values())], names=[*kept.schema.names, *out])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the constant."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z, w, ridge = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(3), np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:2] / scale, w[2])


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    with scratch(docs.sparkSession):
        fitted = _fitted(rows, labels)
    if fitted is None:
        return rows.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = rows.mapInArrow(_featurise(*fitted), "doc_id long, score double")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that score below ``threshold``, each judged by its own text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        fitted = _fitted(rows, labels)
    if fitted is None:
        return docs
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    held = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(c).alias(n) for c, n in own.items())).alias("held"))
    scored = held.mapInArrow(_featurise(*fitted, with_text=True), f"text string, held {held.schema['held'].dataType.simpleString()}, score double").where(F.col("score") < threshold)
    return scored.select(*("text" if c == "text" else F.col("held")[own[c]].alias(c) for c in docs.columns))


def _fitted(rows: DataFrame, labels: DataFrame):
    """The broadcast model and the curve's weights; nothing if the labels are of one kind."""
    known = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialise(known.where(fold(F.col("doc_id")) != HELD_OUT), "known_labels")
    classes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return None
    part = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = lambda n, most: F.when(F.col("toxic") == 1, min(1.0, most / max(1, n[1]))).otherwise(min(1.0, most / max(1, n[0])))
    known = known.withColumn("part", part(0))
    train = (F.col("part") < 0.75) & (F.col("part") / 0.75 < rate({k: 0.75 * n for k, n in classes.items()}, TRAINING_ROWS / 2))
    fit = F.col("part") >= 1 - min(0.25, CALIBRATION_ROWS / sum(classes.values()))
    sample = known.where(train | fit).select("doc_id", "toxic", fit.alias("fit"))  # about TRAINING_ROWS + CALIBRATION_ROWS rows
    drawn = materialise(rows.join(F.broadcast(sample), "doc_id"), "labelled_sample")
    sizes = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in drawn.where("not fit").groupBy("toxic").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()}
    counted = drawn.where("not fit").where(part(1) < rate(sizes, TRAINING_BYTES / 2))
    model = rows.sparkSession.sparkContext.broadcast(beginnings_model(rows, counted))
    sample = drawn.where("fit").select("text", F.col("toxic").cast("double").alias("toxic"))
    sample = sample.mapInArrow(_featurise(model), "toxic double, mean double, peak double").toArrow()  # about CALIBRATION_ROWS rows
    x, y = np.column_stack([sample["mean"].to_numpy(), sample["peak"].to_numpy()]), sample["toxic"].to_numpy()
    weights = _logistic(x, y) if len(set(y)) == 2 else np.array([1.0, 1.0, -3.0])
    return model, weights
