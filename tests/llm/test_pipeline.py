"""The pipeline's stages on their own input, and the registered queries."""

import hashlib
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from leadmill.llm import queries, toxicity

from .test_corpus_operators import _groups, _removed
from .test_text_operators import _plain_overlap


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]


def test_stages_return_the_columns_of_documents(spark, odd_docs, sf_dir):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows = out.collect()
        assert {r.doc_id for r in rows} >= {1, 2, 3, 6, 7, 8}, name
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert 5 not in kept and 4 in kept and None in kept


def _made_documents():
    """Rows with copies, shared passages, benchmark passages, null and repeated ids, and null texts."""
    rng = random.Random(21)
    word = lambda: f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(300)}"
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(0, prose(20)), (1, prose(40)), (2, None)]
    passage, other = prose(60), prose(45)
    docs = []
    for i in range(60):
        text = prose(rng.randint(5, 120))
        if i % 9 == 0:
            text += " " + passage
        if i % 13 == 0:
            text = prose(30) + " " + other[: 150 + i] + " " + text
        if i % 15 == 2:
            text += "\n" + items[i % 2][1]
        docs.append((i if i % 8 else 5, text))
    docs += [(70, docs[3][1]), (3, docs[3][1]), (71, docs[10][1] + " x"), (None, docs[10][1]), (None, None), (None, ""), (72, ""), (72, None)]
    return [(i, t, "en" if n % 3 else None, f"s{n % 4}" if n % 5 else None, len(t or "")) for n, (i, t) in enumerate(docs)], items


def test_stages_against_plain_versions(spark, tmp_path):
    rows, items = _made_documents()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 == 1)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash")).coalesce(1)

    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    assert Counter(tuple(r) for r in out.collect()) == Counter(row for row, r in zip(rows, scored, strict=True) if r.predicted == 0)

    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    groups = _groups([(n, row[1]) for n, row in enumerate(rows)], 5, 80)
    assert Counter(tuple(r) for r in out.collect()) == Counter(row for n, row in enumerate(rows) if groups[n][1] == n)
    assert len(rows) - out.count() >= 4

    out = corpus_pipeline.cut_repeated_passages(spark, docs, str(tmp_path)).collect()
    texts = [(row[1] or "").encode() for row in rows]
    plain = [digest for *_, digest in _removed(texts, corpus_pipeline.PASSAGE_BYTES)]
    assert Counter((r.doc_id, r.lang, r.source, hashlib.sha256((r.text or "").encode()).hexdigest(), r.text is None) for r in out) == Counter((row[0], row[2], row[3], digest, row[1] is None) for row, digest in zip(rows, plain))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out) and sum(len(r.text or "") for r in out) < sum(row[4] for row in rows)

    out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in out) == Counter(row for row in rows if not any(_plain_overlap(row[1], item) for _, item in items))
    assert len(out) < len(rows)


def test_stages_on_an_empty_table(spark, no_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name


def test_pipeline_runs_whole(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    rows.sort(key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert r.sequence_id * 1024 + r.offset == at
        at += r.length
    assert at > 0


def test_chat_query_against_sql(spark, sf_dir):
    found = queries.op7_chat_format(spark, sf_dir).toPandas()
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = db.execute(queries.ORACLE_SQL["op7_chat_format"]).df()
    columns = sorted(found.columns)
    assert sorted(map(tuple, found[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))
