"""Token counts by dynamic programming over a trie of pre-tokens.

A text is cut at white space; a pre-token is a word behind the sign "▁". A task puts the distinct
pre-tokens that it meets into a trie. Each node holds the best unigram score of the spelling from
the root down to it and the number of pieces on that best path, so a prefix that many pre-tokens
share is scored once; the count at a pre-token's last node is its token count. A character that no
piece covers costs one piece for each of its UTF-8 bytes. Equal scores go to the last piece that
is longest.

The vocabulary's file is a parameter. A BPE file holds merge ranks, not log-probabilities, so a piece's
score is taken from its rank by Zipf's law, ``-log(rank + 2)``; ``scores`` may give others.

The trie is emptied when it holds ``MOST_NODES`` nodes, and a word of over ``LONG_WORD`` letters is counted by the same
rule without it, which bounds memory and changes no count.
Defined results: null and empty texts count 0; repeated rows are counted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 2_000_000
LONG_WORD = 10_000  # letters; longer words are counted beside the trie
BYTE_SCORE = -14.0
MARK = "▁"
_SCORES: dict[str, dict[str, float]] = {}


def piece_scores(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a sentencepiece model."""
    if path not in _SCORES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        _SCORES[path] = {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(ids)}
    return _SCORES[path]


class Trie:
    """Nodes are numbers; ``counts[node]`` is the number of pieces of the spelling down to it."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.best, self.counts, self.terminals = [0.0], [0], {}

    def count(self, word: str) -> int:
        """Pieces of a pre-token; its new nodes are scored from the nodes above them."""
        found = self.terminals.get(word)
        if found is not None:
            return found
        if len(word) > LONG_WORD:
            return self.count_alone(word)
        if len(self.best) > MOST_NODES:
            self.clear()
        path, children, best, counts, scores = [0], self.children, self.best, self.counts, self.scores
        for i, char in enumerate(word):
            node = children.get((path[-1], char))
            if node is None:
                node = len(best)
                children[(path[-1], char)] = node
                high, pieces = -math.inf, 0
                for start in range(max(0, i + 1 - self.longest), i + 1):
                    score = scores.get(word[start : i + 1])
                    if score is not None and best[path[start]] + score > high:
                        high, pieces = best[path[start]] + score, counts[path[start]] + 1
                if char not in scores:
                    size = len(char.encode("utf-8", "replace"))
                    if best[path[i]] + size * BYTE_SCORE > high:
                        high, pieces = best[path[i]] + size * BYTE_SCORE, counts[path[i]] + size
                best.append(high)
                counts.append(pieces)
            path.append(node)
        self.terminals[word] = counts[path[-1]]
        return counts[path[-1]]


    def count_alone(self, word: str) -> int:
        """The same count for a very long word, from the last ``longest`` prefixes only; the trie does not keep it."""
        held = deque([(0.0, 0)], maxlen=self.longest)  # best score and pieces of the prefixes that end before i
        for i, char in enumerate(word):
            high, pieces = -math.inf, 0
            for back, (best, count) in enumerate(held):
                score = self.scores.get(word[i + 1 - len(held) + back : i + 1])
                if score is not None and best + score > high:
                    high, pieces = best + score, count + 1
            if char not in self.scores:
                size = len(char.encode("utf-8", "replace"))
                if held[-1][0] + size * BYTE_SCORE > high:
                    high, pieces = held[-1][0] + size * BYTE_SCORE, held[-1][1] + size
            held.append((high, pieces))
        return held[-1][1]


def _count(path: str | None, scores: dict[str, float] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(scores or piece_scores(path))
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            words, tokens = [], []
            for text in texts:
                own = (text or "").split()
                known = trie.terminals
                total = 0
                for word in own:
                    n = known.get(MARK + word)
                    total += trie.count(MARK + word) if n is None else n
                words.append(len(own))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(path, scores), "doc_id long, n_pretokens long, n_tokens long")
