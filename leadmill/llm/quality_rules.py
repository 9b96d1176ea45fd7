"""Quality rules as a learned decision list, emitted as one ordered Spark conditional expression.

Statistics of every whole text are taken first (``text_statistics``). On a bounded sample of
labelled rows outside the held-out fold (``TRAINING_ROWS``), sequential covering learns rules for
rejecting: a rule grows threshold conditions by information gain on two thirds of the rows, is
pruned on the other third, and is kept if it is right there more often than not; the rows that it covers leave,
and the next rule is learned. ``verdict`` turns the list into nested ``when`` calls.

Defined results: a null or empty text has all statistics 0 (and so fails the base rule); labels
that are null or name no document are ignored, contradicting ones count as bad; with no usable
labels there are no rules and all that passes the base rule stays; repeated rows are judged each;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.folds import HELD_OUT, fold
from leadmill.storage import broadcast_if_small, materialise

TRAINING_ROWS = 20_000
_SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct", "n_upper", "n_digits", "n_ends", "longest_word")


def repeated_positions(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which stands twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    n = len(number)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * n + ids[2:]
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[at] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(3):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of COUNTS."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    spaces = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return (
        len(words),
        len(text) - spaces,
        len(_SYMBOL.findall(text)),
        len(lines) - len(set(lines)),
        repeated_positions(words),
        len(text),
        len(lines),
        len(set(words)),
        len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text)),
        len(re.findall(r"[0-9]", text)),
        len(re.findall(r"[.!?]", text)),
        max(map(len, words), default=0),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([counts_of(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], names=["doc_id", *COUNTS])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS as longs, for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """What rules may ask about, as columns over COUNTS."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.col("n_distinct") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "end_share": F.col("n_ends") / words,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
        "longest_word": F.col("longest_word").cast("double"),
    }


Rule = list[tuple[str, str, float]]  # a conjunction of (feature, "<=" or ">", threshold)


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for name, sign, cut in rule:
        hit &= x[name] <= cut if sign == "<=" else x[name] > cut
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    """Adds the condition of the highest gain (FOIL's) until only bad rows are covered."""
    rule: Rule = []
    hit = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (~bad[hit]).any() and bad[hit].any():
        p0, n0 = bad[hit].sum(), (~bad[hit]).sum()
        best, chosen = 1e-9, None
        for name, values in x.items():
            v = values[hit]
            order = np.argsort(v, kind="stable")
            v, b = v[order], bad[hit][order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            if not len(ends):
                continue
            p, total = np.cumsum(b)[ends], ends + 1
            for sign, pos, size in (("<=", p, total), (">", p0 - p, len(v) - total)):
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1) / size) - np.log2(p0 / (p0 + n0))), 0)
                i = int(gain.argmax())
                if gain[i] > best:
                    best, chosen = float(gain[i]), (name, sign, float((v[ends[i]] + v[ends[i] + 1]) / 2))
        if chosen is None:
            break
        rule.append(chosen)
        hit = _covers(rule, x, len(bad))
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of a rule with the best (right - wrong) / covered; the shortest among equals."""
    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(bad))
        return (2.0 * bad[hit].sum() - hit.sum()) / hit.sum() if hit.any() else -1.0

    return max((rule[: i + 1] for i in range(len(rule))), key=lambda r: (round(worth(r), 3), -len(r)), default=[])


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, longest: int = 3, most: int = 12, least_right: float = 0.75, least_covered: int = 3) -> list[Rule]:
    """Rules for rejecting, in order."""
    rules: list[Rule] = []
    prune = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most and bad[left].any():
        pick = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        rule = _prune(_grow(*pick(left & ~prune), longest), *pick(left & prune))
        hit = left & _covers(rule, x, len(bad))
        if not rule or hit.sum() < least_covered or bad[hit].mean() < least_right or (hit & prune).any() and bad[hit & prune].mean() < least_right:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression over ``features()``: the first rule that holds rejects."""
    out, known = None, features()
    for rule in rules:
        test = F.lit(True)
        for name, sign, cut in rule:
            test = test & (known[name] <= cut if sign == "<=" else known[name] > cut)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def rules_from_labels(statistics: DataFrame, labels: DataFrame) -> list[Rule]:
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(fold(F.col("doc_id")) != HELD_OUT)
    known = materialise(known, "quality_labels")
    share = min(1.0, TRAINING_ROWS / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    passed = statistics.where(~base_failed())
    rows = passed.join(broadcast_if_small(known), "doc_id").select(*(c.alias(k) for k, c in features().items()), (F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("at")).orderBy("at").toArrow()  # about TRAINING_ROWS rows
    return learn_rules({k: rows[k].to_numpy() for k in features()}, rows["bad"].to_numpy(zero_copy_only=False).astype(bool))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept for each row of ``docs``."""
    statistics = materialise(text_statistics(docs), "text_statistics")
    rules = rules_from_labels(statistics, labels)
    return statistics.select("*", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
