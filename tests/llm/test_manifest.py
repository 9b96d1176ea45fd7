"""The Merkle manifest against a tree that is built level by level in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from leadmill.llm import manifest, queries


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def field(value):
    text = None if value is None else str(value)
    return "-" if text is None else f"{len(text.encode('utf-8'))}:{text}"


def leaf(row, text):
    return sha("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree, at, node=None):
    """Siblings of a leaf and what its tree's root becomes with another leaf."""
    said = ""
    for nodes in tree[:-1]:
        run = list(nodes[at // 8 * 8 : at // 8 * 8 + 8])
        said += "".join(run[: at % 8] + run[at % 8 + 1 :])
        if node:
            run[at % 8] = node
            node = sha("".join(run))
        at //= 8
    return said, node


def expected(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((-1 if r["doc_id"] is None else r["doc_id"], leaf(r, r["text"]), r))
    langs = sorted(by_lang, key=lambda c: (c is not None, (c or "").encode("utf-8")))
    trees = {}
    for c in langs:
        by_lang[c].sort(key=lambda x: x[:2])
        trees[c] = levels([x[1] for x in by_lang[c]])
    forest = levels([trees[c][-1][0] for c in langs])
    out = []
    for i, c in enumerate(langs):
        for k, (_, own, r) in enumerate(by_lang[c]):
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            lowered = r["text"] if r["text"] is None else "".join(x.lower() if "A" <= x <= "Z" else x for x in r["text"])
            said, node = climb(trees[c], k, leaf(r, lowered) if touched else own)
            above, node = climb(forest, i, node)
            root = forest[-1][0]
            out.append((r["doc_id"], own, trees[c][-1][0], root, sha(said + above), node, node == root))
    return out


def same(got, rows):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected([r.asDict() for r in rows]), key=key)


def run(monkeypatch, spark, docs):
    monkeypatch.setattr(queries, "_table", lambda *_: docs)
    return queries.op12_manifest(spark, "").collect()


def test_odd_documents(monkeypatch, spark, odd_docs, no_docs):
    same(run(monkeypatch, spark, odd_docs), odd_docs.collect())
    assert run(monkeypatch, spark, no_docs) == []
    clashing = odd_docs.withColumns({c: F.lit("x") for c in ("leaf", "root", "index", "total", "digest", "siblings")})
    same(run(monkeypatch, spark, clashing), odd_docs.collect())


@pytest.mark.parametrize("height", [1, 2])
def test_many_rounds_of_small_blocks(monkeypatch, spark, height):
    monkeypatch.setattr(manifest.manifest, "__defaults__", (height,))
    rows = [(i % 400 if i % 7 else None, f"Text {i % 50}", f"l{i % 9}" if i % 3 else None, "s", i % 50) for i in range(900)] + [(i, "One", f"x{i}", None, 3) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(run(monkeypatch, spark, docs), docs.collect())


def test_whole_table(monkeypatch, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(run(monkeypatch, spark, docs), docs.collect())


def test_a_hundred_equal_rows(monkeypatch, spark):
    docs = spark.range(100).select(F.lit(5).cast("long").alias("doc_id"), F.lit("Same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(4).cast("long").alias("n_chars"))
    got = run(monkeypatch, spark, docs)
    same(got, docs.collect())
    assert len(got) == 100


def test_block_traversal_equals_levels():
    for n in (1, 2, 8, 9, 64, 65, 500):
        leaves = [sha(str(i)) for i in range(n)]
        tree = levels(leaves)
        digest, siblings, places = manifest.traverse(leaves, manifest.levels(n))
        assert digest == tree[-1][0]
        assert ["".join(s) for s in siblings] == [climb(tree, i)[0] for i in range(n)]
        assert all(p == [i // 8**k % 8 for k in range(len(p))] for i, p in enumerate(places))
