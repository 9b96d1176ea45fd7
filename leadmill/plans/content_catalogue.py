"""Queries of addresses, covers, ledes and content blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import facts, ledes
from leadmill.operators import activity, blocks, media, quality
from leadmill.plans.catalogue import query
from leadmill.sources.fixtures import table


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'ул. Цвирко, д. ' || o_custkey WHEN 1 THEN 'Main street ' || o_custkey || ', Minsk' WHEN 6 THEN 'улица ' || o_custkey || ', вход' END AS value,
  CASE o_orderkey % 8 WHEN 2 THEN 'TOO_SHORT' WHEN 3 THEN 'OPENING_HOURS' WHEN 4 THEN 'BANK_ACCOUNT' WHEN 5 THEN 'CONTAINS_PHONE' WHEN 7 THEN 'NO_ADDRESS_SIGNAL' END AS reason FROM orders""")
def address_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    forms = ("Ждем: вас: ул. Цвирко, д. {}. Прием до пятницы", "Main street {},  Minsk", "at {}", "ул. Ленина {}, пн-пт 9:00 - 18:00", "IBAN BY00, street {} here", "Main street {}, call 80 29 123-45-67", "Каталог: улица {}, вход", "somewhere in town number {}")
    raw = F.get(F.array(*(F.replace(F.lit(f), F.lit("{}"), c) for f in forms)), (k % 8).cast("int"))
    found = table(spark, sf_dir, "orders").select(k.alias("id"), F.lit("ADDRESS").alias("kind"), raw.alias("raw"))
    return facts.gate(found).select("id", "value", "reason")


@query("""WITH r AS (SELECT l_orderkey AS page, ((CAST(l_linenumber AS BIGINT) * 100000 + l_partkey) * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS ord, l_partkey AS p, l_partkey % 7 * 300 AS w, l_suppkey % 4 * 400 AS h, l_returnflag AS flag FROM lineitem WHERE l_partkey % 5 <> 1),
  o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page, p ORDER BY ord) = 1),
  s AS (SELECT page, ord, CASE p % 5 WHEN 0 THEN 'https://static.tildacdn.biz/t' || p || '/pic' || p || '.jpg' WHEN 2 THEN 'https://x.by/img/logo-' || p || '.png' ELSE 'https://x.by/img/' || p || '.jpg' END AS src, CASE WHEN w > 0 AND h > 0 THEN w::DOUBLE / h END AS ratio,
    CASE WHEN flag = 'R' THEN 'role:LOGO' WHEN p % 5 = 2 THEN 'logo/icon filename or alt' WHEN w > 0 AND h > 0 AND (w < 320 OR h < 200) THEN 'too-small:' || w || 'x' || h WHEN w > 0 AND h > 0 AND (w::DOUBLE / h > 4 OR w::DOUBLE / h < 0.25) THEN 'extreme-aspect:' || printf('%.2f', w::DOUBLE / h) END AS no, w, flag FROM o),
  t AS (SELECT *, CASE WHEN no IS NOT NULL THEN 0::DOUBLE ELSE CASE WHEN flag = 'A' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END + (CASE WHEN w >= 1200 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN ratio BETWEEN 1.2 AND 2.2 THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN ratio < 0.8 THEN 0.15::DOUBLE ELSE 0 END) END AS score,
    coalesce(no, CASE WHEN ratio IS NULL THEN 'unknown-dimensions' WHEN ratio < 0.8 THEN 'portrait:' || printf('%.2f', ratio) END, '') AS why FROM s),
  u AS (SELECT *, no IS NULL AND score >= 0.5::DOUBLE AS fit, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN no IS NULL AND score >= 0.5::DOUBLE THEN score ELSE -1 END DESC, ord) AS n FROM t)
  SELECT page, max(CASE WHEN n = 1 AND fit THEN src END) AS cover, max(CASE WHEN n = 1 AND fit THEN score END) AS score, CASE WHEN bool_or(fit) THEN 'SELECTED' ELSE 'TEXT_ONLY' END AS mode, string_agg(src || ' ' || CASE WHEN fit THEN 'yes' ELSE 'no' END || ' ' || why, ';' ORDER BY ord) AS log FROM u GROUP BY page""")
def cover_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, text = F.col("l_partkey"), F.col("l_partkey").cast("string")
    src = F.when(p % 5 == 0, F.concat(F.lit("//thb.tildacdn.com/t"), text, F.lit("/-/resize/20x/pic"), text, F.lit(".jpg.webp"))).when(p % 5 == 1, F.concat(F.lit("https://mc.yandex.ru/watch/"), text)).when(p % 5 == 2, F.concat(F.lit("https://x.by/img/logo-"), text, F.lit(".png"))).otherwise(F.concat(F.lit("https://x.by/img/"), text, F.lit(".jpg")))
    ord_ = ((F.col("l_linenumber").cast("long") * 100000 + p) * 1000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")
    images = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), ord_.alias("ord"), src.alias("src"), F.lit(None).cast("string").alias("alt"), (p % 7 * 300).alias("width"), (F.col("l_suppkey") % 4 * 400).alias("height"), F.when(F.col("l_returnflag") == "R", "LOGO").when(F.col("l_returnflag") == "A", "HERO_CANDIDATE").alias("role"))
    told = lambda c: F.concat(c["src"], F.when(c["suitable"], " yes ").otherwise(" no "), F.array_join(c["reasons"], ","))
    return media.covers(images, "page").select("page", "cover", "score", "mode", F.array_join(F.transform("candidates", told), ";").alias("log"))


_LINE_SQL = "trim(regexp_replace(regexp_replace(CASE WHEN lang IS NULL THEN {0} ELSE replace({0}, lang, ' ') END, '\\+?[0-9\\s()\\-]{{6,}}', ' ', 'g'), '\\s+', ' ', 'g'))".format("CASE WHEN source IS NULL THEN lower(x) ELSE replace(lower(x), lower(source), ' ') END")


@query(f"""WITH d AS (SELECT doc_id, lower(lang) AS lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND length({_LINE_SQL}) >= 3 AND NOT regexp_matches(lower(x), '^\\+?[0-9\\s()\\-]{{6,}}$|^[A-Za-z0-9_.]+@[A-Za-z0-9_.]+\\.[A-Za-z0-9_]+$')) AS lines FROM documents),
  f AS (SELECT doc_id, list_filter(lines, lambda t: length(t) >= 40 AND lower(t) <> coalesce(lower(source), '') AND lower(t) <> lower(regexp_replace(lines[1], '\\s+', ' ', 'g')) AND NOT regexp_matches(t, '(?i)^(закажите|заказать|оставьте|оставить|получите|получить|свяжитесь|обсудите|обсудим|позвоните|напишите|запишитесь|рассчитайте|отправьте|оформите|уточните)($|[^а-яёa-z])') AND NOT regexp_matches(lower(t), '^[а-яa-zё]+ите($|[^а-яёa-z0-9])')) AS c, lines[1] AS head, source FROM d),
  b AS (SELECT doc_id, list_filter(c, lambda t: regexp_matches(t, '[.!?…]$'))[1] AS ended, coalesce(list_filter(c, lambda t: length(t) >= 45)[1], c[1], CASE WHEN length(regexp_replace(head, '\\s+', ' ', 'g')) >= 40 AND lower(regexp_replace(head, '\\s+', ' ', 'g')) <> coalesce(lower(source), '') THEN regexp_replace(head, '\\s+', ' ', 'g') END) AS other FROM f),
  e AS (SELECT doc_id, coalesce(ended, other) AS t FROM b)
  SELECT doc_id, md5(CASE WHEN length(t) > 280 THEN regexp_replace(substr(t, 1, 280), '\\s+\\S*$', '') || '…' ELSE t END) AS lede, length(t) > 280 AS cut FROM e""")
def entity_ledes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = F.array_compact(F.array(F.lower("source"), F.lower("lang")))
    rows = docs.select("doc_id", "source", ledes.content_lines(F.col("text"), tokens, machine_text=True).alias("lines"))
    rows = rows.select("doc_id", ledes.lede(F.col("lines"), F.col("source"), F.slice("lines", 1, 1)).alias("lede"))
    return rows.select("doc_id", F.md5("lede").alias("lede"), F.endswith("lede", F.lit("…")).alias("cut"))


@query("""SELECT event_id AS id, '{"type": "' || ['list', 'richText', 'quote', 'odd'][1 + event_id % 4] || '","heading" : ' || CASE WHEN event_id % 4 < 2 THEN '"N' || user_id || '"' ELSE '"H\\u0041 ' || event_id || '"' END || ' , "unknown":' || props || ',"n": 1.50e1' || CASE WHEN event_id % 4 IN (1, 2) THEN ',"content":"c"' ELSE '' END || ' }' AS block, event_id % 4 = 3 AS unsupported, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS known FROM events""")
def edited_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, ("list", "richText", "quote", "odd"))), (k % 4).cast("int"))
    block = F.concat(F.lit('{"type": "'), kind, F.lit('","heading" : "H\\u0041 '), k.cast("string"), F.lit('" , "unknown":'), "props", F.lit(',"n": 1.50e1 }'))
    edits = F.create_map(F.lit("heading"), F.concat(F.lit('"N'), F.col("user_id").cast("string"), F.lit('"')), F.lit("content"), F.lit('"c"'), F.lit("unknown"), F.lit("0"), F.lit("caption"), F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "events").select(k.alias("id"), block.alias("block"), edits.alias("edits"))
    state = blocks.editor_state(rows, "id").select("id", "unsupported", F.size("fields").alias("known"))
    return blocks.apply_edits(rows, "id").join(state, "id")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def replay_of_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.replay(table(spark, sf_dir, "events")).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_id > 1000")
def replay_after_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.replay(table(spark, sf_dir, "events"), last_id=1000).select("event_id", "event_type")


_NORM_SQL = "lower(trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{A0}}]+', ' ', 'g')))"
_LINT_SQL = """list_concat(list_filter([
    CASE WHEN length(trim({0})) >= 6 AND (length(trim({0})) >= 8 AND regexp_matches(trim({0}), '(?s)^[\\[{{].*[\\]}}]$') AND json_valid(trim({0}))
      OR regexp_matches(trim({0}), '^[\\[{{<]') AND len(regexp_extract_all({0}, '"[A-Za-z0-9_.-]+"\\s*:')) + len(regexp_extract_all({0}, '&quot;[A-Za-z0-9_.-]+&quot;\\s*:')) >= 3
      OR regexp_matches({0}, '(?i)(^|[^A-Za-z0-9_])(li_type|li_ph|li_mask|li_nm|li_req|li_parent_id|lid|formservices|dataLayer|gtag|ym\\s*\\(|_tmr|fbq\\s*\\(|tildaspec|recid|tn-atom__inputs|data-field-type|data-input-lid)($|[^A-Za-z0-9_])')
      OR regexp_matches({0}, '(?i)(mail@example\\.(com|ru|net)|\\+375\\s*\\(99\\)\\s*999-99-99|\\+7\\s*\\(9[0-9][0-9]\\)\\s*9[0-9][0-9]-[0-9][0-9]-[0-9][0-9]|example\\.(com|org|net)/)')
      OR regexp_matches({0}, '([.#][A-Za-z0-9_-]+\\s*\\{{[^}}]*:)|((^|[^A-Za-z0-9_])function\\s*\\()|((^|[^A-Za-z0-9_])var\\s+[A-Za-z0-9_]+\\s*=)|(\\.push\\s*\\(\\s*\\{{)|(\\}}\\)\\s*;\\s*$)') AND len(regexp_extract_all({0}, '[{{}}();]')) >= 4) THEN 'technical-payload' END,
    CASE WHEN regexp_matches({0}, '(?i)mail@example\\.|example\\.(com|org|ru|by|net)|\\+375\\s*\\(99\\)\\s*999-99-99|999-99-99|xxx+') THEN 'placeholder-contact' END,
    CASE WHEN length({0}) >= 60 AND list_max(list_transform(string_split({0}, chr(10)), lambda p: len(regexp_extract_all(p, '[а-яёa-z][ ]+[А-ЯЁA-Z][а-яёa-z]')))) >= 3 THEN 'glued-description' END,
    CASE WHEN regexp_matches({0}, '(?m)  |\\t| $|^ ') THEN 'whitespace' END, CASE WHEN length({0}) > 3000 THEN 'oversized-content' END], lambda x: x IS NOT NULL),
  list_transform(list_filter(range(2, 1 + len(paras)), lambda i: paras[i] = paras[i - 1]), lambda i: 'duplicate-adjacent-paragraph'))"""


@query(f"""WITH e AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'news' ELSE 'service' END AS kind, source, text, substr(text, 1, 400) AS summary, CASE WHEN doc_id % 5 > 0 THEN TIMESTAMP '2024-01-31' + to_minutes(doc_id % 40 - 20) END AS day FROM documents),
  s AS (SELECT doc_id, kind || '.summary' AS field, CASE WHEN trim(summary) <> '' THEN {_LINT_SQL.format('summary')} ELSE [] END AS kinds FROM (SELECT *, list_filter(list_transform(string_split(summary, chr(10)), lambda p: {_NORM_SQL.format('p')}), lambda p: p <> '') AS paras FROM e)),
  b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
  c AS (SELECT doc_id, ord, CASE ord % 3 WHEN 0 THEN 'richText' WHEN 1 THEN 'richText' ELSE 'list' END AS type, CASE WHEN ord % 7 = 0 THEN trim(substr(line, 1, 30)) ELSE '' END AS heading, CASE WHEN ord % 3 < 2 THEN trim(line) ELSE '' END AS body, CASE WHEN ord % 3 = 2 THEN line ELSE '' END AS item FROM b),
  parts AS (SELECT doc_id, 'block.' || type || '.heading' AS field, heading AS t FROM c UNION ALL SELECT doc_id, 'block.' || type || '.content', body FROM c UNION ALL SELECT doc_id, 'block.' || type || '.items', item FROM c),
  p AS (SELECT doc_id, field, CASE WHEN trim(t) <> '' THEN {_LINT_SQL.format('t')} ELSE [] END AS kinds FROM (SELECT *, [{_NORM_SQL.format('t')}] AS paras FROM parts)),
  w AS (SELECT *, nullif({_NORM_SQL.format("heading || ' ' || body || ' ' || item")}, '') AS whole, type = 'richText' AND heading = '' AS anon FROM c),
  x AS (SELECT *, last_value(whole IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(type) OVER (PARTITION BY doc_id ORDER BY ord) AS type_before, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - row_number() OVER (PARTITION BY doc_id, anon ORDER BY ord) AS island FROM w),
  y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, anon, island ORDER BY ord) AS run FROM x),
  z AS (SELECT doc_id, 'block.' || type AS field, list_filter([CASE WHEN heading <> '' AND body <> '' AND {_NORM_SQL.format('heading')} = {_NORM_SQL.format('body')} THEN 'duplicate-heading-body' END, CASE WHEN heading <> '' AND body = '' AND item = '' AND type = 'richText' THEN 'empty-heading' END, CASE WHEN item <> '' AND heading = '' THEN 'orphan-list' END,
    CASE WHEN whole = before THEN CASE WHEN type = type_before THEN 'duplicate-responsive-section' ELSE 'duplicate-adjacent-paragraph' END END, CASE WHEN anon AND run = 4 THEN 'excessive-fragmentation' END, CASE WHEN length(body) > 12000 THEN 'oversized-content' END], lambda k: k IS NOT NULL) AS kinds FROM y),
  o AS (SELECT doc_id, kind AS field, list_filter([CASE WHEN trim(coalesce(source, '')) = '' THEN 'empty-title' END, CASE WHEN kind = 'news' AND day IS NULL THEN 'missing-date' END, CASE WHEN day > TIMESTAMP '2024-01-31' THEN 'suspicious-date' WHEN kind = 'news' AND day > TIMESTAMP '2024-01-31' - INTERVAL 10 MINUTE THEN 'fabricated-date' END], lambda k: k IS NOT NULL) AS kinds FROM e),
  d AS (SELECT doc_id, kind || '.source_url' AS field, ['duplicate-entity'] AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY kind, md5(text) ORDER BY doc_id) AS n FROM e WHERE text IS NOT NULL) WHERE n > 1),
  h AS (SELECT doc_id, 'hero' AS field, ['invalid-hero-media'] AS kinds FROM documents WHERE n_chars % 3 = 0),
  a AS (SELECT doc_id, field, unnest(kinds) AS kind FROM (SELECT * FROM s UNION ALL SELECT * FROM p UNION ALL SELECT * FROM z UNION ALL SELECT * FROM o UNION ALL SELECT * FROM d UNION ALL SELECT * FROM h))
  SELECT doc_id, field, kind, CASE WHEN kind IN ('whitespace', 'orphan-list', 'missing-date') THEN 'info' WHEN kind IN ('technical-payload', 'placeholder-contact', 'duplicate-responsive-section', 'empty-title', 'suspicious-date', 'fabricated-date', 'duplicate-entity', 'invalid-hero-media') THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM a GROUP BY ALL""")
def content_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities, their lines as blocks in turn of text and list."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    day = F.lit("2024-01-31").cast("timestamp")
    entities = docs.select(k.alias("entity_id"), k.alias("ord"), F.when(F.col("lang") == "en", "news").otherwise("service").alias("kind"), F.lit(None).cast("string").alias("slug"), F.col("source").alias("title"), F.substring("text", 1, 400).alias("summary"), F.md5("text").alias("source_url"), F.array(F.when(k % 5 > 0, day + F.make_dt_interval(mins=(k % 40 - 20).cast("int")))).alias("dates"))
    lines = docs.select(k.alias("entity_id"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    place = F.col("ord")
    rows = lines.select("entity_id", "ord", F.when(place % 3 < 2, "richText").otherwise("list").alias("type"), F.when(place % 7 == 0, F.substring("line", 1, 30)).alias("heading"), F.when(place % 3 < 2, F.col("line")).alias("body"), F.when(place % 3 == 2, F.array("line")).alias("items"))
    hero = docs.select(k.alias("entity_id"), F.concat(F.lit("/img/"), (F.col("n_chars") % 3).cast("string")).alias("src"))
    media_ = docs.select(F.concat(F.lit("/img/"), (F.col("n_chars") % 3).cast("string")).alias("src"), (F.col("n_chars") % 3 > 0).alias("suitable")).distinct()
    found = quality.content_findings(entities, rows, day, day, hero=hero, media=media_)
    return found.groupBy(F.col("entity_id").alias("doc_id"), "field", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))
