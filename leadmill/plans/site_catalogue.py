"""Queries of qualification, content of sites and upkeep, registered beside those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import activity, content, qualification, store
from leadmill.plans.catalogue import AS_OF, _as_of, query
from leadmill.sources.fixtures import LEADS_SQL, table
from leadmill.sources.fixtures import leads as lead_table

_STOPPING = "('FAILED', 'SKIPPED', 'CANCELLED')"


@query(f"""WITH {LEADS_SQL}, v AS (SELECT id, website_status <> 'FOUND' OR coalesce(website, '') = '' AS no_site, * EXCLUDE (id) FROM leads),
  w AS (SELECT id, CASE WHEN manual_review_status = 'BAD' THEN '|manually_rejected' WHEN website_status = 'FAILED' THEN '|website_unreachable'
    WHEN no_site AND enrichment_status IN {_STOPPING} THEN '|enrichment_' || lower(enrichment_status) WHEN no_site AND enrichment_status <> 'SUCCESS' AND id % 10 <> 1 THEN 'enrich|' WHEN no_site THEN '|no_website'
    WHEN audit_status IN {_STOPPING} THEN '|audit_' || lower(audit_status) WHEN audit_status <> 'SUCCESS' THEN CASE WHEN id % 10 = 2 THEN '|already_active' ELSE 'audit|' END WHEN lighthouse_status IS NULL THEN 'lighthouse|'
    WHEN visual_status IN {_STOPPING} THEN '|visual_' || lower(visual_status) WHEN visual_status IS DISTINCT FROM 'SUCCESS' THEN CASE WHEN id % 10 = 3 THEN '|already_active' ELSE 'ai|' END
    WHEN score_status IN {_STOPPING} THEN '|score_' || lower(score_status) WHEN score_status <> 'SUCCESS' THEN 'scoring|' ELSE '|ready_for_review' END AS v FROM v)
  SELECT id, nullif(split_part(v, '|', 1), '') AS stage, nullif(split_part(v, '|', 2), '') AS reason FROM w""")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.col("id") % 10
    active = F.when(rest == 1, F.array(F.lit("ENRICH_LEAD"))).when(rest == 2, F.array(F.lit("AUDIT_WEBSITE"))).when(rest == 3, F.array(F.lit("RUN_VISUAL_ANALYSIS")))
    return lead_table(spark, sf_dir).select("id", qualification.next_action(active).alias("a")).select("id", "a.*")


@query(f"""WITH {LEADS_SQL}, v AS (SELECT id, CASE WHEN manual_review_status = 'BAD' THEN 'SKIPPED|rejected' WHEN website_status = 'FAILED' OR coalesce(website, '') = '' THEN 'SKIPPED|no_viable_website'
    WHEN audit_status <> 'SUCCESS' THEN 'SKIPPED|audit_not_success' WHEN id % 10 = 3 THEN 'SKIPPED|ai_running' WHEN visual_status = 'SUCCESS' THEN 'STARTED|rerun' WHEN visual_status = 'FAILED' THEN 'STARTED|retry' ELSE 'STARTED|first_run' END AS v FROM leads)
  SELECT id, split_part(v, '|', 1) AS result, split_part(v, '|', 2) AS reason FROM v""")
def bulk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.when(F.col("id") % 10 == 3, F.array(F.lit("RUN_VISUAL_ANALYSIS")))
    return lead_table(spark, sf_dir).select("id", qualification.bulk_eligibility(active).alias("a")).select("id", "a.*")


@query(f"""WITH {LEADS_SQL}, s AS (SELECT id, 0 AS ord, 'website' AS stage, website_status AS status FROM leads UNION ALL SELECT id, 1, 'audit', coalesce(audit_status, 'PENDING') FROM leads
    UNION ALL SELECT id, 2, 'screenshots', CASE WHEN audit_status IN ('SUCCESS', 'FAILED') THEN audit_status ELSE 'PENDING' END FROM leads UNION ALL SELECT id, 3, 'lighthouse', coalesce(lighthouse_status, 'PENDING') FROM leads
    UNION ALL SELECT id, 4, 'ai', coalesce(visual_status, 'PENDING') FROM leads UNION ALL SELECT id, 5, 'scoring', coalesce(score_status, 'PENDING') FROM leads),
  o AS (SELECT *, coalesce(string_agg(CASE WHEN status NOT IN ('SUCCESS', 'SKIPPED', 'FOUND') THEN stage END, ',') OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS open FROM s)
  SELECT id, ord, stage, CASE WHEN status = 'PENDING' AND open <> '' THEN 'WAITING' ELSE status END AS status, CASE WHEN status = 'PENDING' THEN open ELSE '' END AS waiting_for FROM o""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualification.stage_rows(lead_table(spark, sf_dir)).withColumn("waiting_for", F.array_join("waiting_for", ","))


_PIPELINE_SQL = r"""'CRAWLED', 'EXTRACTED', 'CONTENT_VALIDATED', 'GRAPH_BUILT', 'CMS_IMPORT_READY', 'CMS_IMPORTED', 'RENDERED', 'RENDER_VALIDATED', 'VISUAL_VALIDATED', 'PREVIEW_PUBLISHED', 'HUMAN_REVIEW_READY'"""


@query(f"""WITH r AS (SELECT o_custkey AS run_id, [{_PIPELINE_SQL}][1 + o_orderkey % 11] AS stage, o_orderkey AS finished_at, o_orderstatus = 'F' AS bad, o_orderpriority LIKE '5%' AS warned FROM orders),
  l AS (SELECT run_id, stage, max(finished_at) AS finished_at, arg_max(bad, finished_at) AS bad, arg_max(warned, finished_at) AS warned FROM r GROUP BY 1, 2)
  SELECT run_id, stage, finished_at, CASE WHEN bad THEN 'FAIL' WHEN warned THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, CASE WHEN bad THEN stage ELSE [{_PIPELINE_SQL}][least(11, 1 + list_position([{_PIPELINE_SQL}], stage))] END AS retry_from FROM l""")
def stage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), F.get(F.array(*map(F.lit, qualification.PIPELINE)), (F.col("o_orderkey") % 11).cast("int")).alias("stage"), F.col("o_orderkey").alias("finished_at"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("broken"))).otherwise(none).alias("errors"), F.when(F.col("o_orderpriority").startswith("5"), F.array(F.lit("slow"))).otherwise(none).alias("warnings"),
    )
    return qualification.stage_gate(qualification.latest_gates(rows)).select("run_id", "stage", "finished_at", "status", "retry_from")


@query(f"""WITH {LEADS_SQL} SELECT id, CASE WHEN audit_status = 'PENDING' AND id % 2 = 0 THEN 'FAILED' ELSE audit_status END AS audit_status, CASE WHEN score_status = 'PENDING' AND lead_score_v2 IS NOT NULL THEN 'SUCCESS' ELSE score_status END AS score_status,
  CASE WHEN visual IS NULL THEN NULL WHEN visual = 'PENDING' AND id % 5 = 0 THEN 'FAILED' WHEN visual = 'PENDING' AND id % 3 = 0 THEN 'SUCCESS' ELSE visual END AS visual_status FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'PENDING' ELSE visual_status END AS visual FROM leads)""")
def repaired_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = lead_table(spark, sf_dir).withColumns({"visual_status": F.when(k % 4 == 0, "PENDING").otherwise(F.col("visual_status")), "audit_error": F.when(k % 2 == 0, "timeout"), "visual_error": F.when(k % 5 == 0, "quota"), "visual_summary": F.when(k % 3 == 0, "fine").otherwise("")})
    return qualification.repair_statuses(rows).select("id", "audit_status", "score_status", "visual_status")


@query("""SELECT l_orderkey AS id, arg_min('p' || CAST(l_suppkey % 4 AS VARCHAR), l_linenumber) FILTER (l_returnflag = 'R') AS provider, arg_min(CAST(l_partkey AS VARCHAR), l_linenumber) FILTER (l_returnflag = 'R') AS value, count(*) AS attempts
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) GROUP BY 1""")
def first_eligible_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("l"))
    rows = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("p"), (F.col("l.l_suppkey") % 4).cast("string")).alias("provider"), F.col("l.l_partkey").cast("string").alias("value"), (F.col("l.l_returnflag") == "R").alias("eligible"))
    return qualification.first_eligible(rows)


_MESSAGES = ("page.goto: Timeout 30000ms exceeded", "getaddrinfo ENOTFOUND host", "Chrome binary not found, no chrome binary here", "429 Too Many Requests", "fetch of image failed: download fail", "render has failed", "connect ECONNREFUSED 127.0.0.1:5432", "something else", "browserType.launch: no", "cms import broke")
_MESSAGES_SQL = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + "]"
_ERRORS_SQL = r"""WHEN regexp_matches(m, '(?i)Executable doesn''t exist at|chromium.*not.*install|playwright.*chromium|browserType\.launch') THEN 'PLAYWRIGHT_BROWSER_MISSING'
  WHEN regexp_matches(m, '(?i)chrome.*not.*found|chromium.*lighthouse|no.*chrome.*binary') THEN 'LIGHTHOUSE_BROWSER_MISSING'
  WHEN regexp_matches(m, '(?i)page\.goto.*timeout|navigation.*timeout|net::ERR_CONNECTION_TIMED_OUT|ETIMEDOUT') THEN 'SOURCE_TIMEOUT'
  WHEN regexp_matches(m, '(?i)net::ERR_NAME_NOT_RESOLVED|getaddrinfo.*ENOTFOUND|DNS.*lookup') THEN 'SOURCE_DNS_FAILED'
  WHEN regexp_matches(m, '(?i)rate limit|too many requests|429|insufficient_quota') THEN 'AI_RATE_LIMIT'
  WHEN regexp_matches(m, '(?i)ai.*provider|gemini.*error|openai.*error|vision.*provider') THEN 'AI_PROVIDER_ERROR'
  WHEN regexp_matches(m, '(?i)download.*fail|media.*download|fetch.*image') THEN 'MEDIA_DOWNLOAD_FAILED'
  WHEN regexp_matches(m, '(?i)cms.*import|importToCms|import.*fail') THEN 'CMS_IMPORT_FAILED'
  WHEN regexp_matches(m, '(?i)render.*fail|showcase.*render|site.*render') THEN 'RENDER_FAILED'
  WHEN regexp_matches(m, '(?i)database.*connect|prisma.*connect|ECONNREFUSED.*5432|connection.*postgres') THEN 'DATABASE_UNAVAILABLE'"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % len(_MESSAGES)).cast("int")).alias("message"))


@query(f"""SELECT m AS message, CASE {_ERRORS_SQL} ELSE 'UNKNOWN_ERROR' END AS code, CASE WHEN regexp_matches(m, '(?i)(timeout|ECONNRESET|ECONNREFUSED|socket hang up|net::ERR_NETWORK|temporar)') THEN 'RETRYABLE' ELSE 'HARD' END AS class, count(*) AS n
  FROM (SELECT {_MESSAGES_SQL}[1 + event_id % {len(_MESSAGES)}] AS m FROM events) GROUP BY ALL""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).groupBy("message").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("message", qualification.error_code(F.col("message")).alias("code"), activity.error_class(F.col("message")).alias("class"), "n")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "service").when(k % 3 == 1, "project").otherwise("product")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("site"), k.alias("ord"), kind.alias("kind"), F.concat(F.initcap("p_name"), F.when(k % 2 == 0, " | Acme").otherwise("")).alias("title"),
        F.when(k % 4 == 0, F.concat(F.lit("https://x.by/p"), (k % 25).cast("string"), F.when(k % 8 == 0, "/").otherwise(""))).alias("detail_url"), ((k % 10) / F.lit(10.0)).alias("confidence"), F.concat(F.lit("u"), (k % 7).cast("string")).alias("source_url"), (F.col("p_retailprice") > 1200).alias("catalogue"),
    )


@query("""WITH e AS (SELECT 's' || CAST(p_size AS VARCHAR) AS site, p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'service' WHEN 1 THEN 'project' ELSE 'product' END AS kind, p_name AS t,
    array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || CASE WHEN p_partkey % 2 = 0 THEN ' | Acme' ELSE '' END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'https://x.by/p' || CAST(p_partkey % 25 AS VARCHAR) END AS url,
    (p_partkey % 10) / 10.0::DOUBLE AS confidence, 'u' || CAST(p_partkey % 7 AS VARCHAR) AS source_url, p_retailprice > 1200 AS catalogue FROM part),
  k AS (SELECT *, site || chr(1) || CASE WHEN url IS NOT NULL THEN 'u:' || url ELSE 't:' || t END AS entity_key FROM e),
  v AS (SELECT entity_key, kind, sum(CASE WHEN confidence >= 0.75 THEN 2 ELSE 1 END) AS w FROM k GROUP BY ALL), won AS (SELECT entity_key, kind AS voted FROM v QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY w DESC, kind) = 1),
  b AS (SELECT k.*, voted FROM k JOIN won USING (entity_key) QUALIFY row_number() OVER (PARTITION BY entity_key ORDER BY (kind = voted) DESC, confidence DESC, ord) = 1),
  s AS (SELECT entity_key, max(confidence) AS sure, bool_or(catalogue) AS cat, count(*) AS members, string_agg(DISTINCT source_url, ',' ORDER BY source_url) AS source_urls FROM k GROUP BY 1)
  SELECT entity_key, site, CASE WHEN sure < 0.75 AND cat AND members > 1 THEN 'product' ELSE voted END AS kind, title, members, source_urls FROM b JOIN s USING (entity_key)""")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.canonical_entities(_entities(spark, sf_dir), "Acme").withColumn("source_urls", F.array_join("source_urls", ","))


_WORDS_SQL = "CASE WHEN p_partkey % 5 < 2 THEN 'цена от 10 руб' ELSE 'наш объект' END"


@query(f"""WITH m AS (SELECT p_size AS collection, p_partkey AS entity, CASE WHEN p_size % 4 = 0 THEN 'service' WHEN p_partkey % 3 = 0 THEN 'product' ELSE 'project' END AS kind, {_WORDS_SQL} AS text FROM part),
  s AS (SELECT collection, count(DISTINCT entity) AS n, list_sort(list(DISTINCT kind)) AS kinds, count(*) FILTER (text LIKE 'цена%') AS products, count(*) FILTER (kind = 'product') AS p, count(*) FILTER (kind = 'project') AS q FROM m GROUP BY 1)
  SELECT m.collection, entity, CASE WHEN n >= 3 AND kinds = ['product', 'project'] THEN CASE WHEN products * 2 >= n THEN 'product' WHEN q > p THEN 'project' ELSE 'product' END ELSE kind END AS kind FROM m JOIN s USING (collection)""")
def sibling_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(F.col("p_size") % 4 == 0, "service").when(k % 3 == 0, "product").otherwise("project")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("collection"), k.alias("entity"), kind.alias("kind"), F.when(k % 5 < 2, "цена от 10 руб").otherwise("наш объект").alias("text"))
    return content.unify_siblings(rows).select("collection", "entity", "kind")


@query("""WITH r AS (SELECT p_size AS site, p_partkey AS ord, p_name AS t, CASE WHEN p_partkey % 3 > 0 THEN 'text ' || CAST(p_partkey % 4 AS VARCHAR) END AS d FROM part),
  w AS (SELECT *, first_value(d IGNORE NULLS) OVER (PARTITION BY site, t ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS told, min(ord) OVER (PARTITION BY site, t) AS first, min(ord) OVER (PARTITION BY site, t, d) AS same, first_value(d IS NULL) OVER (PARTITION BY site, t ORDER BY ord) AS bare FROM r)
  SELECT site, ord, CASE WHEN bare OR d IS NULL OR d = told THEN first ELSE same END AS of FROM w""")
def distinct_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("site"), k.alias("ord"), F.upper("p_name").alias("title"), F.when(k % 3 > 0, F.concat(F.lit("Text  "), (k % 4).cast("string"))).alias("description"))
    return content.distinct_products(rows).select("site", "ord", "of")


@query("""WITH s AS (SELECT l_suppkey AS site, l_orderkey AS ord, '/p' || CAST(l_orderkey % 9 AS VARCHAR) AS url, ['SERVICES', 'REVIEWS', 'NEWS'][1 + l_orderkey % 3] AS kind, 'Heading ' || CAST(l_orderkey % 2 AS VARCHAR) AS heading, list('Title ' || CAST(l_partkey % 30 AS VARCHAR) ORDER BY l_partkey, l_linenumber) AS titles
    FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_partkey, l_linenumber FROM lineitem) GROUP BY 1, 2),
  k AS (SELECT *, kind || '|' || lower(heading) || '|' || array_to_string(list_sort(list_transform(titles, lambda t: lower(t))), '|') AS key, list_filter(titles, lambda t: t NOT LIKE 'none%') AS items FROM s),
  o AS (SELECT site, kind, key, min(ord) AS ord, arg_min(heading, ord) AS heading, arg_min(items, ord) AS items, string_agg(DISTINCT url, ',' ORDER BY url) AS source_pages FROM k GROUP BY 1, 2, 3),
  b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY site, kind ORDER BY len(items) DESC, ord) = 1)
  SELECT site, kind, heading, array_to_string(items, ',') AS items, source_pages FROM b WHERE len(items) >= CASE WHEN kind = 'REVIEWS' THEN 1 ELSE 2 END""")
def dynamic_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    # Every step groups by the site and more, so lines are dealt once, by site.
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").repartition("l_suppkey")
    lines = lines.groupBy("l_suppkey", "l_orderkey").agg(F.array_sort(F.collect_set(F.struct("l_partkey", "l_linenumber"))).alias("all"))
    titles = F.transform("all", lambda x: F.concat(F.lit("Title "), (x["l_partkey"] % 30).cast("string")))
    rows = lines.select(F.col("l_suppkey").alias("site"), k.alias("ord"), F.concat(F.lit("/p"), (k % 9).cast("string")).alias("url"), F.get(F.array(*map(F.lit, ("SERVICES", "REVIEWS", "NEWS"))), (k % 3).cast("int")).alias("kind"), F.concat(F.lit("Heading "), (k % 2).cast("string")).alias("heading"), titles.alias("titles"))
    return content.dynamic_sections(rows).withColumns({"items": F.array_join("items", ","), "source_pages": F.array_join("source_pages", ",")})


@query("""WITH routes AS (SELECT DISTINCT o_custkey % 20 AS site, CASE o_orderkey % 6 WHEN 0 THEN '/' WHEN 1 THEN '/services/s' || CAST(o_orderkey % 12 AS VARCHAR) WHEN 2 THEN '/s' || CAST(o_orderkey % 12 AS VARCHAR) || '/' WHEN 3 THEN '/news' WHEN 4 THEN '/about/p' || CAST(o_orderkey % 9 AS VARCHAR) ELSE '/nothing' END AS path FROM orders),
  ent AS (SELECT s_suppkey % 20 AS site, CASE WHEN s_suppkey % 3 = 0 THEN 'service' ELSE 'news' END AS kind, 's' || CAST(s_suppkey % 12 AS VARCHAR) AS slug, s_suppkey AS id FROM supplier),
  pg AS (SELECT s_suppkey % 20 AS site, 'p' || CAST(s_suppkey % 9 AS VARCHAR) AS slug, s_suppkey AS id, s_suppkey % 9 = 4 AS home FROM supplier),
  r AS (SELECT site, path, regexp_replace(path, '^/+|/+$', '', 'g') AS f FROM routes), k AS (SELECT *, f AS slug, 0 AS tail FROM r UNION ALL SELECT *, string_split(f, '/')[-1], 1 FROM r),
  hit AS (SELECT k.site, path, CASE kind WHEN 'service' THEN 11 ELSE 13 END AS pre, tail, upper(kind) || '_DETAIL' AS kind, CAST(id AS VARCHAR) AS target FROM k JOIN ent ON ent.site = k.site AND ent.slug = k.slug
    UNION ALL SELECT k.site, path, 50, tail, CASE WHEN home THEN 'HOME' ELSE 'PAGE' END, CAST(id AS VARCHAR) FROM k JOIN pg ON pg.site = k.site AND pg.slug = k.slug
    UNION ALL SELECT site, path, 60, 0, 'COLLECTION', 'NEWS' FROM k WHERE tail = 0 AND slug = 'news' UNION ALL SELECT site, path, 0, 0, 'HOME', NULL FROM r WHERE f IN ('', 'index', 'home')),
  b AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY pre, tail, target) = 1)
  SELECT r.site, r.path, coalesce(kind, 'NOT_FOUND') AS kind, target FROM r LEFT JOIN b ON b.site = r.site AND b.path = r.path""")
def resolved_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    tail = lambda n: (k % n).cast("string")
    path = F.when(k % 6 == 0, "/").when(k % 6 == 1, F.concat(F.lit("/services/s"), tail(12))).when(k % 6 == 2, F.concat(F.lit("/s"), tail(12), F.lit("/"))).when(k % 6 == 3, "/news").when(k % 6 == 4, F.concat(F.lit("/about/p"), tail(9))).otherwise("/nothing")
    routes = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("site"), path.alias("path"))
    suppliers = table(spark, sf_dir, "supplier")
    entities = suppliers.select((s % 20).alias("site"), F.when(s % 3 == 0, "service").otherwise("news").alias("kind"), F.concat(F.lit("s"), (s % 12).cast("string")).alias("slug"), s.alias("id"))
    pages = suppliers.select((s % 20).alias("site"), F.concat(F.lit("p"), (s % 9).cast("string")).alias("slug"), s.alias("id"), (s % 9 == 4).alias("is_homepage"))
    return content.resolve_routes(routes, entities, pages, spark.createDataFrame([("news", "NEWS")], "slug string, collection string"))


@query("""WITH RECURSIVE items AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 20 THEN c_custkey // 5 END AS parent_id, CASE WHEN c_custkey % 7 < 2 THEN '/p' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 7 = 2 THEN '#' ELSE '' END AS href, c_custkey % 11 <> 0 AS visible FROM customer),
  shown AS (SELECT * FROM items WHERE visible), alive AS (SELECT id, parent_id FROM shown WHERE href NOT IN ('', '#') UNION SELECT s.id, s.parent_id FROM shown s JOIN alive a ON a.parent_id = s.id)
  SELECT id, parent_id, CASE WHEN href = '#' THEN '' ELSE href END AS href FROM shown WHERE id IN (SELECT id FROM alive)""")
def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k >= 20, F.floor(k / 5)).alias("parent_id"), F.when(k % 7 < 2, F.concat(F.lit("/p"), k.cast("string"))).when(k % 7 == 2, "#").otherwise("").alias("href"), (k % 11 != 0).alias("visible"), k.alias("sort_order"))
    return content.pruned_menu(rows).select("id", "parent_id", "href")


@query("""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ps FROM documents),
  w AS (SELECT doc_id, ps, 1 AS i, CAST(0 AS BIGINT) AS blocks, CAST(0 AS BIGINT) AS held FROM p
    UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN held > 0 AND held + 2 + length(ps[i]) > 900 OR held = 0 THEN blocks + 1 ELSE blocks END, CASE WHEN held > 0 AND held + 2 + length(ps[i]) <= 900 THEN held + 2 + length(ps[i]) ELSE length(ps[i]) END FROM w WHERE i <= len(ps))
  SELECT doc_id, blocks AS n_blocks, held AS last_chars FROM w WHERE i = len(ps) + 1""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", content.paragraph_blocks(F.col("text")).alias("b"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n_blocks"), F.coalesce(F.length(F.get(F.reverse("b"), 0)), F.lit(0)).cast("long").alias("last_chars"))


@query("""WITH r AS (SELECT o_custkey AS page, o_orderkey AS ord, o_orderstatus <> 'F' AS f FROM orders), m AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY ord) AS island FROM r)
  SELECT page, min(ord) AS first_at, count(*) AS length FROM m WHERE f GROUP BY page, island HAVING count(*) >= 4""")
def anonymous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    return content.run_lengths(rows, "page", F.col("o_orderstatus") != "F", 4)


_PROBES = ("price is undefined", "[object Object] here", "plain", "Lorem Ipsum dolor", "{{ name }} TODO", "NaN rubles")
_PROBES_SQL = "[" + ", ".join(f"'{m}'" for m in _PROBES) + "]"


@query(f"""WITH t AS (SELECT {_PROBES_SQL}[1 + event_id % {len(_PROBES)}] AS text FROM events UNION ALL SELECT text FROM documents UNION ALL SELECT html FROM pages), l AS (SELECT text, unnest(['undefined', '[object Object]', 'NaN', 'lorem ipsum', '{{{{', 'TODO']) AS leak FROM t)
  SELECT leak, count(*) AS n FROM l WHERE contains(lower(text), lower(leak)) GROUP BY 1""")
def leaked_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, _PROBES)), (F.col("event_id") % len(_PROBES)).cast("int"))
    rows = table(spark, sf_dir, "events").select(text.alias("text")).unionByName(table(spark, sf_dir, "documents").select("text")).unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return rows.select(F.explode(content.leaks(F.col("text"))).alias("leak")).groupBy("leak").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 OR (o_orderkey % 5 = 3 AND month(o_orderdate) = 2 AND day(o_orderdate) > 31) THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS found_at FROM orders""")
def source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "dd.MM.yyyy")).when(k == 2, F.date_format(at, "d/M/yyyy")).when(k == 3, F.concat(F.lit(" "), F.date_format(at, "d-M-yyyy"), F.lit(" "))).otherwise("no date at all")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(content.source_date(raw), "yyyy-MM-dd").alias("found_at"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '+375 29 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '1') WHEN 1 THEN '8 029 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '2') WHEN 2 THEN NULL ELSE '+7 (495) 123-45-67' END AS phone FROM customer""")
def best_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pad = lambda fill: F.lpad(k.cast("string"), 7, fill)
    text = F.when(k % 4 == 0, F.concat(F.lit("tel 1234567, +375  29 "), pad("1"))).when(k % 4 == 1, F.concat(F.lit("1234567; 8 029 "), pad("2"))).when(k % 4 == 2, "call 12345").otherwise("a 80291112233445 or +7 (495) 123-45-67 or +375 29")
    return table(spark, sf_dir, "customer").select(k.alias("id"), content.best_phone(text).alias("phone"))


@query("""WITH n AS (SELECT o_custkey AS site, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, CAST(ceil(count(*) OVER (PARTITION BY o_custkey) / 6) AS BIGINT) AS page_count FROM orders) SELECT site, ord, page_count FROM n WHERE nth BETWEEN 7 AND 12""")
def site_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.page_of(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("ord")), 2)


@query("""WITH ids AS (SELECT o_custkey AS site, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ids FROM orders GROUP BY 1), w AS (SELECT site, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM ids)
  SELECT site, id, pos - 1 AS pos FROM (SELECT w.* FROM w JOIN orders ON o_orderkey = id WHERE o_orderstatus <> 'F') QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos) <= 4""")
def picked_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ids = orders.groupBy(F.col("o_custkey").alias("site")).agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), F.col("o_orderkey").alias("id")))).alias("all")).select("site", F.col("all.id").alias("ids"))
    rows = orders.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("id"))
    return content.picked(rows, ids, 4).select("site", "id", F.col("pos").cast("long").alias("pos"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'old title' ELSE 'new title' END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'old phone' ELSE 'new phone' END AS phone, 'old note' AS note, 'new address' AS address FROM customer""")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    made = lambda **kv: F.create_map(*(F.lit(x) for pair in kv.items() for x in pair))
    owners = F.create_map(F.lit("title"), F.when(k % 2 == 0, "EDITOR").otherwise("IMPORT"), F.lit("phone"), F.when(k % 3 == 0, "EDITOR").otherwise("IMPORT"))
    out = table(spark, sf_dir, "customer").select(k.alias("id"), content.field_merge(made(title="old title", phone="old phone", note="old note"), made(title="new title", phone="new phone", address="new address"), owners).alias("f"))
    return out.select("id", *(F.element_at("f", f).alias(f) for f in ("title", "phone", "note", "address")))


@query(f"""SELECT event_id AS id, (CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 5 SECOND END IS NOT NULL AND ts + INTERVAL 5 SECOND >= TIMESTAMP '{AS_OF}' - INTERVAL 90 SECOND) OR (event_id % 3 = 0 AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 90 SECOND) AS alive FROM events""")
def alive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.make_dt_interval(secs=F.lit(5))).alias("heartbeat_at"))
    return activity.alive(rows, _as_of()).select("id", "alive")


@query("""SELECT event_id AS id, '[REDACTED]' AS api_key, CASE WHEN event_id % 2 = 0 THEN '[REDACTED]' ELSE event_type END AS note FROM events""")
def redacted_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("my Password is "), "event_type")).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), activity.redacted(F.create_map(F.lit("api_key"), F.lit("x1"), F.lit("note"), note)).alias("d"))
    return rows.select("id", F.element_at("d", "api_key").alias("api_key"), F.element_at("d", "note").alias("note"))


@query("SELECT o_orderkey AS id, o_custkey AS lead_id, count(*) OVER (PARTITION BY o_custkey) - (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1) AS run_number FROM orders")
def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead_id"), F.col("o_orderdate").alias("created_at"))
    return activity.numbered_runs(rows, "lead_id").select("id", "lead_id", F.col("run_number").cast("long").alias("run_number"))


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN c_custkey // 3 END AS into_ FROM customer), w(id, "at", into_) AS (SELECT id, id, into_ FROM l UNION ALL SELECT w.id, l.id, l.into_ FROM w JOIN l ON l.id = w.into_)
  SELECT id, "at" AS survivor_id FROM w WHERE into_ IS NULL""")
def merge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return store.follow_survivors(table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 2, F.floor(k / 3)).alias("merged_into")))


@query("SELECT p_brand AS site, p_name AS slug, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicate_keys(table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), F.col("p_name").alias("slug")), "site", "slug")


@query("""WITH s AS (SELECT l_partkey AS entity, l_returnflag AS kind, sum(CASE WHEN l_quantity / 50 >= 0.75 THEN 2 ELSE 1 END) AS weight FROM lineitem GROUP BY 1, 2)
  SELECT entity, kind, weight FROM s QUALIFY row_number() OVER (PARTITION BY entity ORDER BY weight DESC, kind) = 1""")
def majority_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("kind"), (F.col("l_quantity") / 50).alias("confidence"))
    return store.weighted_vote(rows, "entity", "kind", "confidence")


@query("SELECT o_orderkey AS id, o_custkey AS site FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderpriority LIKE '1%'")
def after_stale_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site"), F.col("o_orderpriority").startswith("1").alias("edited"))
    return store.drop_stale(old, old.where("id % 4 <> 0").select("id"), ["id"], F.col("edited")).select("id", "site")


NAMES = tuple(name for name, f in list(globals().items()) if getattr(f, "__module__", None) == __name__ and not name.startswith("_"))
