"""One thin query per operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.llm import chat_format, decontamination, html_extract, manifest, minhash, nn_descent, packing, quality_rules, sharding, suffix_dedup, token_counts, toxicity, whitening

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("t")).select("t.*")
    turns = table.unionByName(probe).withColumn("parts", chat_format.text_parts(F.col("text")))
    back = chat_format.read_back(chat_format.format_chats(turns).select("conv_id", "formatted", "loss_spans"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    w = whitening.fit(table)
    if w is None or not len(w.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = whitening.identity_error(table, w)
    rows = whitening.whiten(table, w).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, w.explained.tolist()))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(3)) == 0
    lowered = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest.manifest(_table(spark, sf_dir, "documents"), tampered=F.when(touched, manifest.leaf(lowered)))
    out = out.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("places")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_chat_format": op7_chat_format,
    "op8_minhash": op8_minhash,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_manifest": op12_manifest,
    "op13_nn_descent": op13_nn_descent,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op7_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (
            SELECT *, length(regexp_replace(role, '(<|\[)(~*)(\||/?s>|/?INST\]|/?SYS>)', '\1~\2\3', 'g'))
                    + length(regexp_replace(text, '(<|\[)(~*)(\||/?s>|/?INST\]|/?SYS>)', '\1~\2\3', 'g'))
                    + length('<|turn|><|body|><|end|>') AS chars
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op12_manifest": r"""
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang,
                   CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
                   || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
                   || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
                   || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
                   text, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS said,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
            FROM documents),
        leaves AS (
            SELECT doc_id, lang, sha256(head || said) AS leaf,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda x, bit: xor(x >> 1, 3988292384 * (x & bit)))), 4294967295) AS crc,
                   sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(lowered) || ':' || lowered END) AS lowered
            FROM fields),
        placed AS (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
            FROM leaves),
        nodes(lvl, tree, i, digest) AS (
            SELECT 0, tree, i, leaf FROM placed
            UNION ALL
            SELECT lvl + 1, tree, i // 8, sha256(string_agg(digest, '' ORDER BY i))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY lvl, tree, i // 8),
        tops AS (SELECT tree, max(lvl) AS lvl, max_by(digest, lvl) AS subroot FROM nodes GROUP BY tree),
        forest(lvl, i, digest) AS (
            SELECT 0, tree, subroot FROM tops
            UNION ALL
            SELECT lvl + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i))
            FROM (SELECT *, count(*) OVER () AS n FROM forest) WHERE n > 1 GROUP BY lvl, i // 8),
        summit AS (SELECT max(lvl) AS lvl, max_by(digest, lvl) AS root FROM forest),
        runs AS (
            SELECT tree, lvl, i // 8 AS run, list(digest ORDER BY i) AS digests FROM nodes JOIN (SELECT tree, lvl AS top FROM tops) USING (tree) WHERE lvl < top GROUP BY tree, lvl, i // 8
            UNION ALL
            SELECT -1, lvl, i // 8, list(digest ORDER BY i) FROM forest WHERE lvl < (SELECT lvl FROM summit) GROUP BY lvl, i // 8),
        steps AS (
            SELECT p.tree, p.i, r.lvl, list_aggregate(r.digests[: (p.i // (8 ** r.lvl)::BIGINT) % 8], 'string_agg', '') AS ahead,
                   list_aggregate(r.digests[(p.i // (8 ** r.lvl)::BIGINT) % 8 + 2 :], 'string_agg', '') AS behind
            FROM placed p JOIN runs r ON r.tree = p.tree AND r.run = p.i // (8 ** (r.lvl + 1))::BIGINT
            UNION ALL
            SELECT p.tree, p.i, t.lvl + r.lvl, list_aggregate(r.digests[: (p.tree // (8 ** r.lvl)::BIGINT) % 8], 'string_agg', ''),
                   list_aggregate(r.digests[(p.tree // (8 ** r.lvl)::BIGINT) % 8 + 2 :], 'string_agg', '')
            FROM placed p JOIN tops t USING (tree) JOIN runs r ON r.tree = -1 AND r.run = p.tree // (8 ** (r.lvl + 1))::BIGINT),
        proofs AS (SELECT tree, i, string_agg(coalesce(ahead, '') || coalesce(behind, ''), '' ORDER BY lvl) AS proof FROM steps GROUP BY tree, i),
        folded(lvl, tree, i, node) AS (
            SELECT 0, tree, i, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END FROM placed
            UNION ALL
            SELECT f.lvl + 1, f.tree, f.i, sha256(coalesce(ahead, '') || node || coalesce(behind, ''))
            FROM folded f JOIN steps s ON s.tree = f.tree AND s.i = f.i AND s.lvl = f.lvl),
        last AS (SELECT tree, i, max_by(node, lvl) AS folded_root FROM folded GROUP BY tree, i)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed JOIN tops USING (tree) JOIN last USING (tree, i) LEFT JOIN proofs USING (tree, i), summit""",
}
