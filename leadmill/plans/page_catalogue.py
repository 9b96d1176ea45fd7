"""Queries over pages as trees, on the crawled pages and on shop pages that Spark writes from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import dom, repairs, semantics
from leadmill.plans.catalogue import query
from leadmill.sources.fixtures import table


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: one page per order with its lines as cards, questions, controls and stated dates.

    Ids are beyond those of ``pages``."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_returnflag"))).alias("lines"))
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))

    def card(i):
        part, rest = i["l_partkey"].cast("string"), i["l_linenumber"] % 3
        return text('<div class="card">', F.when(rest == 0, text('<a href="/part/', part, '"><img src="/img/', part, '.jpg" alt="part > whole"><h3>Part ', part, "</h3></a><p>Quantity &amp; mode: ", i["q"].cast("string"), " ", i["l_returnflag"], " of the stock.</p>")).when(rest == 1, text("<h3>Part ", part, "</h3>\n<p>Sent by ", i["l_returnflag"], " from the store</p>")).otherwise(text('<a href="#popup">Part ', part, "</a>")), "</div>")

    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    clerk = F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string"))
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    json_ld = text('{"@type": "Order", "datePublished": "', date, '", "name": "Order ', key, '", "address": {"streetAddress": "', clerk, '", "addressLocality": "Minsk"}}')
    json_ld = F.when(k % 3 == 0, text('{"@graph": [', json_ld, ', {"@type": "Thing", "legalName": "Shop ', key, '"}]}')).when(k % 3 == 1, text("[", json_ld, "]")).otherwise(text(json_ld, F.when(k % 5 == 0, ",").otherwise("")))
    page = text(
        "<!DOCTYPE html><html><head><title>Order ", key, ' | Shop</title><script type="application/ld+json">', json_ld, '</script><meta property="article:published_time" content="', date, 'T00:00:00"></head>',
        '<body><header class="top"><nav><ul><li><a href="/">Home</a><li><a href="/news">News</a></ul></nav></header><main><h1>Order ', key, "</h1><section><h2>", F.when(F.col("o_orderstatus") == "F", "Our services").when(F.col("o_orderstatus") == "O", "Completed projects").otherwise("Latest news"), "</h2>", '<div class="products">', F.array_join(F.transform("lines", card), ""), "</div></section>",
        '<ul class="items"><li><a href="/priority/', F.substring("o_orderpriority", 1, 1), '">Same priority</a><li><a href="/status/', F.col("o_orderstatus"), '">Same status</a></ul>',
        "<details><summary>When was it placed?</summary>On ", date, ".</details>", F.when(k % 2 == 0, "<details open><summary>WHEN WAS IT PLACED?</summary>Long ago.</details>").otherwise(""),
        '<button aria-controls="who">Who wrote it?</button><button data-target="#menu">Menu</button><div id="who">', clerk, '</div><div id="menu">Nothing</div>',
        '<div class="faq-list"><div class="faq-item"><h4>How urgent is it?</h4><div class="answer">', F.col("o_orderpriority"), "</div></div></div>",
        F.when(k % 4 == 0, '<span class="sr-only">Toggle navigation</span>').otherwise(""), F.when(k % 4 == 1, '<div class="slick-next"><i>Next</i></div>').otherwise("<p>Next</p>"), F.when(k % 4 == 2, '<div role="toolbar"><div><span>1 / 7</span></div></div>').otherwise(""),
        '<time datetime="', date, '">that day</time></main><footer>&copy; Shop</footer></body></html>',
    )
    host = F.concat(F.lit("https://shop"), (k % 7).cast("string"), F.lit(".example.by/order/"), key)
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey").select((k + 1_000_000_000).alias("page_id"), host.alias("url"), page.alias("html"))


def _trees(spark: SparkSession, sf_dir: str, fields: tuple[str, ...]) -> DataFrame:
    """Crawled pages are dealt out, as they may lie in one file; those of the shop come from a join, which has dealt them."""
    return dom.trees(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fields=fields).unionByName(dom.trees(shop_pages(spark, sf_dir), dealt=False, fields=fields))


#: What the shop's pages must give; the crawled pages hold no lists, questions or labels outside their frame.
_ITEMS_SQL = """own AS (SELECT 1000000000 + l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS ord, count(*) OVER (PARTITION BY l_orderkey) AS n,
    'Part ' || l_partkey AS title, CASE l_linenumber % 3 WHEN 0 THEN 'Quantity & mode: ' || CAST(l_quantity AS INT) || ' ' || l_returnflag || ' of the stock.' WHEN 1 THEN 'Sent by ' || l_returnflag || ' from the store' ELSE '' END AS description,
    CASE WHEN l_linenumber % 3 = 0 THEN '/part/' || l_partkey END AS href, CASE WHEN l_linenumber % 3 = 0 THEN '/img/' || l_partkey || '.jpg' END AS image FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
  more AS (SELECT 1000000000 + o_orderkey AS page_id, unnest([0, 1]) AS ord, unnest(['Same priority', 'Same status']) AS title, '' AS description, unnest(['/priority/' || o_orderpriority[1], '/status/' || o_orderstatus]) AS href, CAST(NULL AS VARCHAR) AS image FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query(f"WITH {_ITEMS_SQL} SELECT page_id, CAST(ord AS INT) AS ord, title, description, href, image FROM own WHERE n >= 2 UNION ALL SELECT page_id, CAST(ord AS INT), title, description, href, image FROM more")
def card_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.card_items(_trees(spark, sf_dir, dom.CARD_FIELDS)).select("page_id", "ord", "title", "description", "href", "image")


@query(f"""WITH {_ITEMS_SQL}, lists AS (SELECT page_id, string_agg(title || '>' || coalesce(href, ''), ';' ORDER BY title || chr(1) || coalesce(href, '')) AS s FROM own WHERE n >= 2 GROUP BY page_id UNION ALL SELECT page_id, string_agg(title || '>' || href, ';' ORDER BY title) FROM more GROUP BY page_id),
  hosts AS (SELECT DISTINCT 'shop' || (page_id - 1000000000) % 7 || '.example.by' AS host, s, page_id FROM lists)
  SELECT host, pages, count(*) AS lists FROM (SELECT host, s, count(*) AS pages FROM hosts GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1, 2""")
def shared_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lists stand on how many pages of a host: what stands on three or more is its frame."""
    return dom.shared_lists(dom.card_lists(_trees(spark, sf_dir, dom.CARD_FIELDS))).groupBy("host", "pages").agg(F.count(F.lit(1)).alias("lists"))


_SHOP_SQL = "shop AS (SELECT *, 1000000000 + o_orderkey AS page_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"


@query(f"""WITH {_SHOP_SQL} SELECT page_id, 0 AS ord, 'When was it placed?' AS question, 'On ' || day || '.' AS answer, 'details' AS found_by FROM shop
  UNION ALL SELECT page_id, 1, 'Who wrote it?', 'Clerk ' || o_custkey, 'trigger' FROM shop UNION ALL SELECT page_id, 2, 'How urgent is it?', o_orderpriority, 'accordion' FROM shop""")
def question_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.question_pairs(_trees(spark, sf_dir, dom.QUESTION_FIELDS))


@query(f"""WITH {_SHOP_SQL} SELECT page_id, 'strong' AS tier, 'Toggle navigation' AS text, 1 AS elements FROM shop WHERE o_orderkey % 4 = 0
  UNION ALL SELECT page_id, 'weak', 'Next', 2 FROM shop WHERE o_orderkey % 4 = 1 UNION ALL SELECT page_id, 'weak', '1 / 7', 3 FROM shop WHERE o_orderkey % 4 = 2""")
def chrome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.chrome_texts(_trees(spark, sf_dir, dom.LABEL_FIELDS)).groupBy("page_id", "tier", "text").agg(F.count(F.lit(1)).cast("int").alias("elements"))


@query(f"""WITH {_SHOP_SQL}, read AS (SELECT *, NOT (o_orderkey % 3 = 2 AND o_orderkey % 5 = 0) AS valid FROM shop),
  e AS (SELECT page_id, 'date' AS kind, day AS value, 'jsonld' AS source, 'Order/datePublished' AS context, 0 AS s FROM read WHERE valid UNION ALL SELECT page_id, 'name', 'Order ' || o_orderkey, 'jsonld', 'Order', 0 FROM read WHERE valid
    UNION ALL SELECT page_id, 'address', 'Clerk ' || o_custkey || ', Minsk', 'jsonld', 'Order', 0 FROM read WHERE valid UNION ALL SELECT page_id, 'name', 'Shop ' || o_orderkey, 'jsonld', 'Thing', 1 FROM read WHERE o_orderkey % 3 = 0
    UNION ALL SELECT page_id, 'date', day, 'time', 'time', 2 FROM read UNION ALL SELECT page_id, 'date', day || 'T00:00:00', 'meta', 'article:published_time', 3 FROM read UNION ALL SELECT page_id, 'name', 'Order ' || o_orderkey, 'title', 'title', 4 FROM read)
  SELECT page_id, kind, value, source, context, CAST(row_number() OVER (PARTITION BY page_id, kind ORDER BY s) - 1 AS INT) AS rank FROM e""")
def dated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the shop's pages: the crawled ones state a title only."""
    return dom.evidence(dom.trees(shop_pages(spark, sf_dir), dealt=False, fields=dom.EVIDENCE_FIELDS, tags=dom.EVIDENCE_TAGS))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  k AS (SELECT doc_id, i, trim(l) AS t, CASE WHEN length(trim(l)) >= 8 THEN lower(trim(l)) END AS key FROM l), f AS (SELECT * FROM k QUALIFY key IS NULL OR row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1)
  SELECT d.doc_id, f.lines, f.hash FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS lines, md5(string_agg(t, chr(10) ORDER BY i)) AS hash FROM f GROUP BY 1) f USING (doc_id)""")
def single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", repairs.deduplicated_lines(F.col("text")).alias("kept"))
    return rows.select("doc_id", F.size(F.split("kept", "\n")).cast("long").alias("lines"), F.md5("kept").alias("hash"))


@query()
def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, step, ord, kind, start, length, replacement: the log of all repairs of all texts, whose first sentence stands for a summary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repairs.repair(docs, summary=F.regexp_extract("text", r"^([^.!?]{12,})[.!?]", 1)).select("doc_id", F.inline("log"))


@query("""WITH shop AS (SELECT o.*, count(*) AS n, count(*) FILTER (l_linenumber % 3 = 1) AS c1, bool_or(l_linenumber % 3 = 0) AS img, bool_or(l_linenumber % 3 <> 2) AS told, bool_or(l_linenumber % 3 = 0 AND l_partkey BETWEEN 1900 AND 2099) AS url_year,
    CASE WHEN o_orderkey BETWEEN 1900 AND 2099 THEN 1 ELSE 0 END AS year FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  s AS (SELECT 1000000000 + o_orderkey AS page_id, 0 AS place, n >= 2 AS shown, CASE WHEN img THEN 2 ELSE 0 END AS pic, CASE WHEN c1 > 0 THEN 1 ELSE 0 END AS d, c1, o_orderstatus AS status, year + CASE WHEN url_year THEN 1 ELSE 0 END AS years, 2 AS sel, img OR told AS body, img AS urls FROM shop
    UNION ALL SELECT 1000000000 + o_orderkey, 1, TRUE, 0, 0, 0, o_orderstatus, year, 0, FALSE, TRUE FROM shop),
  t AS (SELECT *, pic + CASE WHEN status = 'F' THEN 8 ELSE 0 END AS services, pic + CASE WHEN status = 'O' THEN 16 ELSE 0 END AS projects, pic + years + CASE WHEN status NOT IN ('F', 'O') THEN 8 ELSE 0 END AS news, pic AS vacancies,
    pic + 3 + 2 * d + sel + c1 + 2 + 2 * d + 2 * c1 AS products FROM s WHERE shown),
  b AS (SELECT *, greatest(services, projects, news, products) AS best FROM t),
  r AS (SELECT *, CASE WHEN NOT (body OR urls) THEN NULL ELSE list_max(list_filter([CASE WHEN status = 'F' AND services >= 6 AND services >= 0.7 * best THEN {'score': services, 'place': 0, 'kind': 'SERVICES'} END, CASE WHEN status = 'O' AND projects >= 6 AND projects >= 0.7 * best AND projects > products THEN {'score': projects, 'place': -1, 'kind': 'PROJECTS'} END,
      CASE WHEN status NOT IN ('F', 'O') AND news >= 6 AND news >= 0.7 * best THEN {'score': news, 'place': -2, 'kind': 'NEWS'} END, CASE WHEN c1 > 0 AND products >= 6 AND products >= 0.7 * best AND products > projects THEN {'score': products, 'place': -4, 'kind': 'PRODUCTS'} END], lambda x: x IS NOT NULL)) END AS hit FROM b)
  SELECT page_id, place, CASE WHEN hit IS NOT NULL OR body THEN 'CONTENT_COLLECTION' ELSE 'UNKNOWN' END AS type, CASE WHEN hit IS NOT NULL THEN hit.kind WHEN body THEN 'OTHER' END AS subtype,
    CASE WHEN hit IS NOT NULL THEN least(CASE WHEN hit.kind IN ('NEWS', 'PRODUCTS') THEN 0.88::DOUBLE ELSE 0.9::DOUBLE END, 0.55::DOUBLE + hit.score::DOUBLE / 30) WHEN body THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS confidence, services, projects, news, vacancies, products FROM r""")
def collection_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place is 0 for the list of an order's lines, 1 for its list of links; crawled pages hold neither."""
    found = semantics.collection_types(semantics.page_collections(_trees(spark, sf_dir, (*dom.CARD_FIELDS, "up"))), keep=("element",)).where(F.rlike("element", F.lit(r"^(ul|div)\.(.*\s)?(items|products)(\s|$)")) & (F.col("page_id") >= 1_000_000_000))
    return found.select("page_id", F.startswith("element", F.lit("ul.")).cast("int").alias("place"), "type", "subtype", "confidence", "scores.*")
