"""Queries of ownership, summaries, markup, relations and audits, registered beside those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import markup, ownership, summaries, texts
from leadmill.functions.compat import once
from leadmill.operators import activity, audit, content, leads, pages, relations, scoring, security
from leadmill.plans.catalogue import AS_OF, _as_of, query
from leadmill.sources.fixtures import LEADS_SQL, table
from leadmill.sources.fixtures import leads as lead_table


def _pick(values: tuple, number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def _list_sql(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_URLS = ("https://www.deal.by/cs/12/x", "https://firma.by/companies/azhur", "https://site.by/16851-flaydero.html", "https://good.by/catalog/doors", "https://shop.rubrikator.by/place/x", "not a url", "https://news.by/tag/stroika")
_BODIES = ("Добавить компанию. Каталог организаций", "Мы строим дома", "Продавец: ООО Ромашка, бесплатное размещение", None, "ООО, ОАО, ЗАО и ЧТУП рядом", "Add your company to the business directory", "Поиск компании по городам")
_PATHS_SQL = r"""CASE WHEN regexp_matches(path, '(?i)/(companies|company|firms?|org|orgs|organizations|place|places|catalog-companies|spravochnik|katalog-kompanij)/[\w-]+') THEN 'url:company-listing-pattern' END,
  CASE WHEN regexp_matches(path, '(?i)/\d{3,}-[\w-]+\.(html?|php)$') THEN 'url:numbered-company-page' END,
  CASE WHEN regexp_matches(path, '(?i)/cs/\d+/') THEN 'url:seller-storefront' END,
  CASE WHEN regexp_matches(path, '(?i)/(tag|tags|rubric|rubrics|category-directory|razdel)/[\w-]+') THEN 'url:tag-directory' END"""
_TEXTS_SQL = r"""CASE WHEN regexp_matches(body, '(?i)добавить\s+(компанию|организацию|фирму|предприятие)') THEN 'text:add-company-flow' END,
  CASE WHEN regexp_matches(body, '(?i)добавить\s+(товар|услугу|объявление|продукцию)') THEN 'text:add-product-service-flow' END,
  CASE WHEN regexp_matches(body, '(?i)каталог\s+(компаний|организаций|предприятий|фирм)') THEN 'text:company-catalog' END,
  CASE WHEN regexp_matches(body, '(?i)справочник\s+(организаций|предприятий|компаний)') THEN 'text:org-directory' END,
  CASE WHEN regexp_matches(body, '(?i)(разместить|зарегистрировать)\s+(компанию|организацию|свою фирму)') THEN 'text:business-registration-flow' END,
  CASE WHEN regexp_matches(body, '(?i)(все|поиск)\s+(компании|организации|поставщики|продавцы)\s+(в|по)\s+(рубрик|категор|город)') THEN 'text:directory-search' END,
  CASE WHEN regexp_matches(body, '(?i)бесплатн[0-9A-Za-z_]*\s+(размещени|добавлени)[0-9A-Za-z_]*') THEN 'text:free-listing-offer' END,
  CASE WHEN regexp_matches(body, '(?i)organizations?\s+catalog|business\s+directory|add\s+(your\s+)?(company|business|listing)') THEN 'text:en-directory' END,
  CASE WHEN regexp_matches(body, '(?i)(поставщик|продавец|компания|организация|смотреть все (товары|услуги) (компании|продавца))\s*[::]') THEN 'text:seller-attribution' END"""
_WEIGHTS_SQL = r"""WHEN 'text:add-company-flow' THEN 3
  WHEN 'text:add-product-service-flow' THEN 2
  WHEN 'text:company-catalog' THEN 3
  WHEN 'text:org-directory' THEN 3
  WHEN 'text:business-registration-flow' THEN 3
  WHEN 'text:directory-search' THEN 2
  WHEN 'text:free-listing-offer' THEN 2
  WHEN 'text:en-directory' THEN 3
  WHEN 'text:seller-attribution' THEN 2"""


@query(f"""WITH r AS (SELECT event_id AS id, {_list_sql(_URLS)}[1 + event_id % 7] AS url, coalesce({_list_sql(_BODIES)}[1 + event_id // 7 % 7], '') AS body FROM events
    UNION ALL SELECT 1000000000 + page_id, url, coalesce(html, '') FROM pages UNION ALL SELECT 2000000000 + doc_id, 'https://site.by/text/' || doc_id, coalesce(text, '') FROM documents),
  h AS (SELECT *, CASE WHEN contains(url, '://') THEN array_to_string(list_slice(string_split(regexp_extract(url, '^[a-z]+://(?:www[.])?([^/]+)', 1), '.'), -2, -1), '.') END AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM r),
  s AS (SELECT *, list_filter([{_PATHS_SQL}, {_TEXTS_SQL}, CASE WHEN len(list_distinct(list_transform(regexp_extract_all(body, '(?i)оао|ооо|зао|ип\\s|чтуп|уп\\s|llc|ltd'), lambda x: lower(x)))) >= 4 THEN 'text:many-distinct-org-forms' END], lambda x: x IS NOT NULL) AS signals FROM h),
  w AS (SELECT *, CAST(coalesce(list_sum(list_transform(signals, lambda x: CASE x {_WEIGHTS_SQL} ELSE 1 END)), 0) AS INT) AS w, CASE host WHEN 'deal.by' THEN 'MARKETPLACE' WHEN 'rubrikator.by' THEN 'DIRECTORY' END AS known FROM s)
  SELECT id, CASE WHEN known IS NOT NULL THEN known WHEN w >= 4 THEN CASE WHEN list_has_any(signals, ['url:seller-storefront', 'text:seller-attribution']) THEN 'MARKETPLACE' ELSE 'DIRECTORY' END WHEN w >= 2 OR len(list_filter(signals, lambda x: prefix(x, 'url:'))) > 0 THEN 'UNCERTAIN' ELSE 'DIRECT_COMPANY_SITE' END AS decision,
    CASE WHEN known IS NOT NULL THEN 0.98::DOUBLE WHEN w >= 4 THEN least(0.9::DOUBLE, 0.5::DOUBLE + w * 0.08::DOUBLE) WHEN w >= 2 THEN 0.4::DOUBLE WHEN len(list_filter(signals, lambda x: prefix(x, 'url:'))) > 0 THEN 0.35::DOUBLE WHEN host IS NULL THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
    CASE WHEN known IS NOT NULL THEN 'policy:' || host ELSE array_to_string(signals, ',') END AS signals FROM w""")
def website_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _pick(_URLS, F.col("event_id")).alias("url"), _pick(_BODIES, F.floor(F.col("event_id") / 7)).alias("body"))
    rows = rows.unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("id"), "url", F.col("html").alias("body")))
    rows = rows.unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 2_000_000_000).alias("id"), F.concat(F.lit("https://site.by/text/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("body")))
    # A plain column would be copied into each branch of the union.
    return rows.select("id", once(ownership.ownership(F.col("url"), F.col("body")))).select("id", "decision", "confidence", F.array_join("signals", ",").alias("signals"))


_KINDS_SQL = r"""WHEN contains(u, 'vacancies') OR contains(t, 'vacancies') OR contains(u, 'vacancy') OR contains(t, 'vacancy') OR contains(u, 'career') OR contains(t, 'career') OR contains(u, 'careers') OR contains(t, 'careers') OR contains(u, 'job') OR contains(t, 'job') OR contains(u, 'jobs') OR contains(t, 'jobs') OR contains(u, 'вакансии') OR contains(t, 'вакансии') OR contains(u, 'вакансия') OR contains(t, 'вакансия') OR contains(u, 'rabota') OR contains(t, 'rabota') OR contains(u, 'работа') OR contains(t, 'работа') OR contains(u, 'vakansii') OR contains(t, 'vakansii') THEN 'vacancies'
  WHEN contains(u, 'contact') OR contains(t, 'contact') OR contains(u, 'contacts') OR contains(t, 'contacts') OR contains(u, 'контакты') OR contains(t, 'контакты') OR contains(u, 'контакт') OR contains(t, 'контакт') OR contains(u, 'kontakty') OR contains(t, 'kontakty') OR contains(u, 'kontakt') OR contains(t, 'kontakt') THEN 'contacts'
  WHEN contains(u, 'about') OR contains(t, 'about') OR contains(u, 'about-us') OR contains(t, 'about-us') OR contains(u, 'о компании') OR contains(t, 'о компании') OR contains(u, 'о нас') OR contains(t, 'о нас') OR contains(u, 'о предприятии') OR contains(t, 'о предприятии') OR contains(u, 'o-kompanii') OR contains(t, 'o-kompanii') OR contains(u, 'o-nas') OR contains(t, 'o-nas') THEN 'about'
  WHEN contains(u, 'news') OR contains(t, 'news') OR contains(u, 'blog') OR contains(t, 'blog') OR contains(u, 'press') OR contains(t, 'press') OR contains(u, 'новости') OR contains(t, 'новости') OR contains(u, 'новость') OR contains(t, 'новость') OR contains(u, 'novosti') OR contains(t, 'novosti') OR contains(u, 'novost') OR contains(t, 'novost') THEN 'news'
  WHEN contains(u, 'service') OR contains(t, 'service') OR contains(u, 'услуга') OR contains(t, 'услуга') OR contains(u, 'usluga') OR contains(t, 'usluga') OR contains(u, 'прайс') OR contains(t, 'прайс') OR contains(u, 'preiskurant') OR contains(t, 'preiskurant') THEN 'service'
  WHEN contains(u, 'services') OR contains(t, 'services') OR contains(u, 'catalog') OR contains(t, 'catalog') OR contains(u, 'all-services') OR contains(t, 'all-services') OR contains(u, 'услуги') OR contains(t, 'услуги') OR contains(u, 'каталог') OR contains(t, 'каталог') OR contains(u, 'каталог услуг') OR contains(t, 'каталог услуг') OR contains(u, 'uslugi') OR contains(t, 'uslugi') THEN 'services'
  WHEN contains(u, 'project') OR contains(t, 'project') OR contains(u, 'portfolio') OR contains(t, 'portfolio') OR contains(u, 'object') OR contains(t, 'object') OR contains(u, 'objects') OR contains(t, 'objects') OR contains(u, 'проект') OR contains(t, 'проект') OR contains(u, 'проекты') OR contains(t, 'проекты') OR contains(u, 'объект') OR contains(t, 'объект') OR contains(u, 'объекты') OR contains(t, 'объекты') OR contains(u, 'портфолио') OR contains(t, 'портфолио') OR contains(u, 'proekty') OR contains(t, 'proekty') OR contains(u, 'obekty') OR contains(t, 'obekty') THEN 'project'"""


@query(f"""WITH r AS (SELECT p_partkey AS id, lower('https://x.by/' || {_list_sql(('services/roof', 'o-kompanii', 'blog/1', 'a/b', '%D0%BD%D0%BE%D0%B2%D0%BE%D1%81%D1%82%D0%B8', '', 'kontakt'))}[1 + p_partkey % 7]) AS v, lower({_list_sql(('Наши объекты', 'Прайс', 'Дом', 'Вакансия сварщика', 'О нас'))}[1 + p_partkey % 5] || ' ' || p_name) AS t FROM part),
  d AS (SELECT *, CAST(url_decode(v) AS VARCHAR) AS u FROM r) SELECT id, CASE WHEN u = 'https://x.by/' THEN 'home' {_KINDS_SQL} ELSE 'page' END AS kind FROM d""")
def legacy_page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://x.by/"), _pick(("services/roof", "o-kompanii", "blog/1", "a/b", "%D0%BD%D0%BE%D0%B2%D0%BE%D1%81%D1%82%D0%B8", "", "kontakt"), k))
    title = _pick(("Наши объекты", "Прайс", "Дом", "Вакансия сварщика", "О нас"), k)
    return table(spark, sf_dir, "part").select(k.alias("id"), ownership.page_kind(url, title, F.col("p_name"), url == "https://x.by/").alias("kind"))


@query("""WITH r AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x{A0}]+', ' ', 'g')) AS raw FROM documents), h AS (SELECT *, substr(raw, 1, 119) AS head FROM r),
  m AS (SELECT *, reverse(head) AS rev FROM h),
  p AS (SELECT *, greatest(CASE WHEN contains(head, '. ') THEN length(head) - instr(rev, ' .') - 1 ELSE -1 END, CASE WHEN contains(head, '! ') THEN length(head) - instr(rev, ' !') - 1 ELSE -1 END, CASE WHEN contains(head, '? ') THEN length(head) - instr(rev, ' ?') - 1 ELSE -1 END) AS s, CASE WHEN contains(head, ' ') THEN length(head) - instr(rev, ' ') ELSE -1 END AS w FROM m),
  c AS (SELECT *, greatest(CASE WHEN s > 30 THEN s + 1 ELSE -1 END, CASE WHEN w > 30 THEN w ELSE -1 END) AS cut FROM p)
  SELECT doc_id, CASE WHEN length(raw) <= 120 THEN raw ELSE rtrim(CASE WHEN cut > 0 THEN substr(head, 1, cut) ELSE head END, ' ') || '…' END AS summary FROM c""")
def shortened_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", summaries.shortened(F.col("text"), 120).alias("summary"))


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' for every house' ELSE p_type || ' tiny' END AS s, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' FOR  every house and more' ELSE ' and more' END AS b FROM part),
  n AS (SELECT id, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS s, lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))) AS b FROM r) SELECT id, length(s) >= 12 AND length(b) >= 12 AND (contains(b, s) OR contains(s, b)) AS repeated FROM n""")
def repeated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    summary = F.when(k % 3 == 0, F.concat("p_name", F.lit(" for every house"))).otherwise(F.concat("p_type", F.lit(" tiny")))
    body = F.concat("p_name", F.when(k % 2 == 0, " FOR  every house and more").otherwise(" and more"))
    return table(spark, sf_dir, "part").select(k.alias("id"), summaries.summary_repeated(summary, body).alias("repeated"))


_TITLES = ("«Дом»  Ёлка - Пазл Хаус", "от Дизайнера Кухня", "ЖК Минска Маяк | Пазл Хаус", "Тренды лета", "Пазл Хаус", "Баня—Пазл хаус")


@query(f"""WITH r AS (SELECT event_id AS id, {_list_sql(_TITLES)}[1 + event_id % 6] AS title FROM events UNION ALL SELECT 1000000000 + page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages), n AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(title), 'ё', 'е'), '[«»"“”''‘’`]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM r)
  SELECT id, t AS plain, regexp_replace(regexp_replace(t, '[\\s\\-–—|]+пазл хаус$', ''), '^(от\\s+\\S+\\s+|жк\\s+\\S+\\s+|тренды\\s+)', '') AS bare FROM n""")
def bare_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _pick(_TITLES, F.col("event_id")).alias("title"))
    rows = rows.unionByName(table(spark, sf_dir, "pages").select((F.col("page_id") + 1_000_000_000).alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")))
    return rows.select("id", summaries.plain_title(F.col("title")).alias("plain"), summaries.without_brand(F.col("title"), F.lit("Пазл Хаус")).alias("bare"))


_CARDS = ("Строим дома из бруса. Звоните нам прямо сейчас! Гарантия десять лет на все работы.", "1. теплая встреча\n2) договор\nСрок строительства три месяца от начала работ", "Заказать", "Дом Ёлка это дом для семьи. Площадь сто двадцать метров. Этажей два и мансарда. Еще текст тут есть.", None, "Телефон +375 29 123-45-67 для связи. Монтаж кровли под ключ, подробнее на сайте")
_CUT_SQL = "trim(regexp_replace(trim(s), '(?i)(получить консультац\\S*|заказать|закажите|узнать (цену|стоимость)|оставить заявку|подробнее|читать далее|✔|➔|✓|тариф\\s*«[^»]*»).*$', ''))"


@query(f"""WITH r AS (SELECT event_id AS id, coalesce({_list_sql(_CARDS).replace(chr(10), "' || chr(10) || '")}[1 + event_id % 6], '') AS raw FROM events UNION ALL SELECT 1000000000 + doc_id, coalesce(text, '') FROM documents),
  s AS (SELECT id, unnest(regexp_split_to_array(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) AS s, generate_subscripts(regexp_split_to_array(regexp_replace(raw, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), 1) AS i FROM r),
  c AS (SELECT id, i, {_CUT_SQL} AS s FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM c WHERE length(s) >= 12 AND NOT regexp_matches(s, '{summaries.JUNK.replace("(?iu)", "(?i)")}') AND NOT regexp_matches(s, '{summaries.PHONE}') AND NOT contains(replace(lower(s), 'ё', 'е'), 'дом елка') AND NOT regexp_matches(s, '^\\d+\\s*[.)]')),
  o AS (SELECT r.id, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (n <= 2), '') AS o FROM r LEFT JOIN k ON k.id = r.id GROUP BY 1) SELECT id, CASE WHEN length(o) >= 20 THEN substr(o, 1, 200) END AS summary FROM o""")
def card_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _pick(_CARDS, F.col("event_id")).alias("raw"))
    rows = rows.unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("id"), F.col("text").alias("raw")))
    return rows.select("id", summaries.card_summary(F.col("raw"), F.lit("Дом «Ёлка»")).alias("summary"))


_HEADINGS = ("Частые ВОПРОСЫ", "Отзывы клиентов", "Наш прайс", "Этапы работ", "Команда", "Партнеры", "Почему мы", "Скидки", "Разное", None)
_SECTION_SQL = r"""WHEN regexp_matches(coalesce(heading, ''), '(?i)вопрос|часто спрашивают|faq|q&a') THEN 'FAQ'
  WHEN regexp_matches(coalesce(heading, ''), '(?i)отзыв|review|testimonial') THEN 'REVIEWS'
  WHEN regexp_matches(coalesce(heading, ''), '(?i)цен|прайс|стоимост|тариф|price|pricing|cost') THEN 'PRICING'
  WHEN regexp_matches(coalesce(heading, ''), '(?i)этап|как мы работаем|порядок|процесс|стадии|process|how we work') THEN 'PROCESS'
  WHEN regexp_matches(coalesce(heading, ''), '(?i)команда|сотрудник|team') THEN 'TEAM'
  WHEN regexp_matches(coalesce(heading, ''), '(?i)партнер|partner|клиенты') THEN 'PARTNERS'
  WHEN regexp_matches(coalesce(heading, ''), '(?i)преимуществ|почему мы|advantage|benefit|наши плюсы') THEN 'ADVANTAGES'
  WHEN regexp_matches(coalesce(heading, ''), '(?i)акци|скидк|promo|promotion|спецпредлож') THEN 'PROMOTION'"""


@query(f"""WITH r AS (SELECT event_id AS id, {_list_sql(_HEADINGS)}[1 + event_id % 10] AS heading, event_id // 10 % 5 AS k FROM events)
  SELECT id, CASE {_SECTION_SQL} WHEN k = 0 THEN 'FAQ' WHEN k = 1 THEN 'STATS' WHEN k = 2 THEN 'REVIEWS' WHEN k = 3 THEN 'PRICING' ELSE 'OTHER' END AS kind FROM r""")
def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.floor(F.col("event_id") / 10) % 5
    listed = lambda *values: F.array(*map(F.lit, values))
    titles = F.when(k == 0, listed("Сколько?", "Когда?", "Так")).when(k == 1, listed("10 лет опыта", "25+", "просто слова")).otherwise(listed("Один", "Два"))
    prices = F.when(k == 3, listed("от 10 руб", "20 $", "даром")).otherwise(listed("даром"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), summaries.section_kind(_pick(_HEADINGS, F.col("event_id")), titles, prices, k == 2).alias("kind"))


_LEADS = ("СтройМастер", "Acme Clean Room", "  ", "Контакты", "QA build", None)


@query(f"""WITH r AS (SELECT c_custkey AS id, trim({_list_sql(_LEADS)}[1 + c_custkey % 6]) AS lead, CASE WHEN c_custkey % 4 = 0 THEN 'Extracted Name' WHEN c_custkey % 4 = 1 THEN 'A sentence. Here' END AS ex, CASE WHEN c_custkey % 5 = 0 THEN 'Brand' END AS br, CASE WHEN c_custkey % 7 > 0 THEN 'www.site' || CAST(c_custkey % 9 AS VARCHAR) || '.by' END AS dom FROM customer),
  v AS (SELECT id, CASE WHEN lead = 'СтройМастер' THEN 'lead|СтройМастер' WHEN ex = 'Extracted Name' THEN 'extracted|' || ex WHEN lead = 'Acme Clean Room' THEN 'lead-stripped|Acme' WHEN br IS NOT NULL THEN 'branding|Brand' WHEN dom IS NOT NULL THEN 'domain|S' || substr(split_part(dom, '.', 2), 2) ELSE 'fallback|Fallback' END AS v FROM r)
  SELECT id, split_part(v, '|', 2) AS name, split_part(v, '|', 1) AS source FROM v""")
def public_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    extracted = F.when(k % 4 == 0, "Extracted Name").when(k % 4 == 1, "A sentence. Here")
    domain = F.when(k % 7 > 0, F.concat(F.lit("www.site"), (k % 9).cast("string"), F.lit(".by")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), summaries.public_brand(_pick(_LEADS, k), extracted, F.when(k % 5 == 0, "Brand"), domain, F.lit("Fallback")).alias("b")).select("id", "b.*")


@query(r"""SELECT page_id, length(html) AS n, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)on\w+\s*=\s*["''][^"'']*["'']', '', 'g'), '(?i)javascript:', 'blocked:', 'g'), ' ')) AS data FROM pages""")
def safe_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.length(html).cast("long").alias("n"), F.md5(markup.escaped(html)).alias("escaped"), F.md5(markup.as_data(html)).alias("data"))


@query("""SELECT l_orderkey AS id, sha256('[' || string_agg('"p' || CAST(l_partkey AS VARCHAR) || '"', ',' ORDER BY 'p' || CAST(l_partkey AS VARCHAR)) || ']') AS hash FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(parts.alias("parts")).select("id", markup.stable_hash(F.col("parts")).alias("hash"))


@query("""WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ['#fff', 'rgb(200, 30, ' || CAST(c_custkey % 200 AS VARCHAR) || ')'] WHEN 1 THEN ['#123'] ELSE [] END AS marks, CASE WHEN c_custkey % 4 = 2 THEN '<p style="color:#0a0b0c;background:#1E90FF">' ELSE '' END AS html, c_custkey % 200 AS b FROM customer)
  SELECT id, CASE id % 4 WHEN 0 THEN printf('#c81e%02x', b) WHEN 1 THEN '#112233' WHEN 2 THEN '#1e90ff' ELSE '#2563EB' END AS primary_colour, CASE id % 4 WHEN 0 THEN printf('#a018%02x', CAST(floor(b * 0.8::DOUBLE + 0.5) AS BIGINT)) WHEN 1 THEN '#0e1b29' WHEN 2 THEN '#1873cc' ELSE '#1e4fbc' END AS secondary, CASE id % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'extracted' WHEN 2 THEN 'inferred' ELSE 'default' END AS source FROM r""")
def theme_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    marks = F.when(k % 4 == 0, F.array(F.lit("#fff"), F.concat(F.lit("rgb(200, 30, "), (k % 200).cast("string"), F.lit(")")))).when(k % 4 == 1, F.array(F.lit("#123"))).otherwise(F.array().cast("array<string>"))
    html = F.when(k % 4 == 2, '<p style="color:#0a0b0c;background:#1E90FF">').otherwise("")
    return table(spark, sf_dir, "customer").select(k.alias("id"), markup.theme(marks, html).alias("t")).select("id", F.col("t.primary").alias("primary_colour"), "t.secondary", "t.source")


_ALTS = ("Promo offer", "search button", "flag of en", "Company logo", "our thumb", "hero", "project house", "latest news", "service", "family")
_WORD_SQL = "regexp_matches(alt, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({0})($|[^\\p{{L}}\\p{{N}}_])')"


@query(f"""WITH r AS (SELECT event_id AS id, {_list_sql(_ALTS)}[1 + event_id % 10] || ' ' AS alt, event_id % 3 * 40 AS w, event_id % 11 = 0 AS hero, CASE WHEN event_id % 4 > 0 THEN event_id % 4 - 1 END AS sec FROM events)
  SELECT id, CASE WHEN {_WORD_SQL.format('|'.join(markup.AD_MARKS))} OR id % 13 = 0 THEN 'ADVERTISEMENT' WHEN {_WORD_SQL.format('|'.join(markup.TOOL_MARKS))} AND w < 64 THEN 'UTILITY_ICON' WHEN {_WORD_SQL.format('|'.join(m.replace(chr(39), chr(39) * 2) for m in markup.LANGUAGES))} THEN 'LANGUAGE_ICON' WHEN contains(alt, 'logo') THEN 'LOGO'
    WHEN w BETWEEN 1 AND 200 AND contains(alt, 'thumb') THEN 'UTILITY_ICON' WHEN hero THEN 'HERO_CANDIDATE' WHEN sec IS NULL THEN 'UNKNOWN' WHEN contains(alt, 'service') THEN 'SERVICE_IMAGE' WHEN contains(alt, 'project') THEN 'PROJECT_IMAGE' WHEN contains(alt, 'news') THEN 'ARTICLE_IMAGE' ELSE 'UNKNOWN' END AS role FROM r""")
def image_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    src = F.when(k % 13 == 0, "https://doubleclick.net/x.png").otherwise("https://x.org/a.png")
    role = markup.image_role(src, _pick(_ALTS, k), F.lit(""), k % 3 * 40, k % 3 * 40, F.lit(False), k % 11 == 0, F.when(k % 4 > 0, k % 4 - 1))
    return table(spark, sf_dir, "events").select(k.alias("id"), role["role"].alias("role"))


@query("""WITH one AS (SELECT o_custkey, max(o_orderkey) AS audit_id FROM orders GROUP BY 1) SELECT c_custkey AS id, a.audit_id, n_name AS nation FROM customer LEFT JOIN one a ON a.o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""")
def leads_with_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    audits = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("audit_id"))
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = relations.with_one(relations.with_one(rows, "id", audit=audits), "c_nationkey", place=nations)
    return out.select("id", F.col("audit.audit_id").alias("audit_id"), F.col("place.n_name").alias("nation"))


@query("""WITH l AS (SELECT DISTINCT o_custkey AS site, l_partkey AS media, min(l_linenumber) AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT c_custkey AS site, count(p_partkey) AS n, coalesce(string_agg(p_name, '|' ORDER BY ord, p_partkey) FILTER (p_partkey IS NOT NULL), '') AS names FROM customer LEFT JOIN l ON site = c_custkey LEFT JOIN part ON p_partkey = media AND p_size > 25 GROUP BY 1""")
def project_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("media"), "l_linenumber")
    links = table(spark, sf_dir, "orders").join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("site"), "media").agg(F.min("l_linenumber").alias("ord"))
    media = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("media"), "p_name")
    out = relations.with_many(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site")), links, media, "site", "media", "ord", "media_list")
    return out.select("site", F.size("media_list").cast("long").alias("n"), F.array_join(F.transform("media_list", lambda m: m["p_name"]), "|").alias("names"))


@query("""SELECT event_id AS id, c_name AS lead_name, s_name AS site_name, n_name AS variant_name FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN supplier ON s_suppkey = CASE WHEN event_id % 2 = 0 THEN event_id % 150 END LEFT JOIN nation ON n_nationkey = CASE WHEN event_id % 3 = 0 THEN event_id % 40 END""")
def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select(k.alias("id"), F.col("user_id").alias("lead_id"), F.when(k % 2 == 0, k % 150).alias("site_id"), F.when(k % 3 == 0, k % 40).alias("variant_id"))
    lookup = lambda name, key, title: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(title).alias("name"))
    out = relations.with_names(events, lead=lookup("customer", "c_custkey", "c_name"), site=lookup("supplier", "s_suppkey", "s_name"), variant=lookup("nation", "n_nationkey", "n_name"))
    return out.select("id", "lead_name", "site_name", "variant_name")


@query(f"""WITH c(provider, enabled) AS (VALUES ('click', TRUE), ('view', FALSE), ('osm', TRUE)), r(provider, title) AS (VALUES ('click', 'Clicks'), ('osm', 'Open maps'), ('error', 'Errors')),
  n AS (SELECT event_type AS provider, count(*) AS runs FROM events WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}' GROUP BY 1)
  SELECT c.provider, enabled, title, title IS NOT NULL AS known, coalesce(runs, 0) AS runs FROM c LEFT JOIN r USING (provider) LEFT JOIN n USING (provider)""")
def discovery_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = spark.createDataFrame([("click", True), ("view", False), ("osm", True)], "provider string, enabled boolean")
    registry = spark.createDataFrame([("click", "Clicks"), ("osm", "Open maps"), ("error", "Errors")], "provider string, title string")
    recent = activity.recent_counts(table(spark, sf_dir, "events").withColumnRenamed("event_type", "provider"), _as_of())
    return relations.providers_with_counts(config, registry, recent)


@query("""WITH u AS (SELECT c_custkey AS user_id, c_custkey % 50 = 0 AS super FROM customer), g(role, scope) AS (VALUES ('F', 'GLOBAL'), ('O', 'SITE')),
  a AS (SELECT o_custkey AS user_id, o_orderstatus AS role, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 25 END AS site FROM orders),
  may AS (SELECT a.user_id, CASE WHEN scope = 'GLOBAL' THEN -1 ELSE a.site END AS site FROM a JOIN g ON g.role = a.role UNION SELECT user_id, -1 FROM u WHERE super)
  SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 23 AS site, EXISTS (SELECT 1 FROM may m WHERE m.user_id = o_custkey AND (m.site = -1 OR m.site = o_orderkey % 23)) AS allowed FROM orders""")
def site_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 50 == 0, "SUPER_ADMIN").otherwise("USER").alias("global_role"))
    assigned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("role"), F.when(k % 3 > 0, k % 25).alias("site"))
    grants = spark.createDataFrame([("F", "publish", "GLOBAL"), ("O", "publish", "SITE"), ("P", "read", "GLOBAL")], "role string, permission string, scope string")
    requests = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("user_id"), (k % 23).alias("site"))
    return relations.may(requests, relations.allowed(users, assigned, grants, "publish")).select("id", "user_id", "site", "allowed")


_SETTINGS = ('{"fixture": true}', '{"fixture": false}', '{"fixture": null}', "{}", None, '{"other": [], "fixture": "true"}', '{"other": ""}')


@query(f"SELECT event_id AS id FROM events WHERE event_id % 7 NOT IN (0, 5)")
def shown_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.shown_sites(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), _pick(_SETTINGS, F.col("event_id")).alias("settings"))).select("id")


@query("""SELECT CASE WHEN event_id % 7 IN (3, 4, 6) THEN 'missing' WHEN event_id % 7 = 2 THEN 'null' ELSE 'present' END AS state, TRUE AS any_present, count(*) AS n FROM events GROUP BY 1""")
def key_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(_pick(_SETTINGS, F.col("event_id")).alias("settings"))
    return relations.key_states(rows, "settings", "fixture").groupBy("state", "any_present").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id AS id FROM events WHERE event_type = 'view' AND (event_id % 4 = 0 OR ts <= TIMESTAMP '{AS_OF}')")
def published_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "PUBLISHED").otherwise("DRAFT").alias("status"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("published_at"))
    return relations.published(rows, _as_of()).select("id")


@query("SELECT o_custkey AS page, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 > 0 THEN 1 ELSE 0 END, o_orderkey) AS place FROM orders")
def sections_finale_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", "CTA").otherwise("TEXT").alias("kind"), (F.col("o_orderkey") % 4 > 0).alias("enabled"))
    return relations.finale_last(rows).select("page", "ord", F.col("place").cast("long").alias("place"))


@query("SELECT s_suppkey AS id, s_name AS title, NULL AS price, 'service' AS kind FROM supplier UNION ALL SELECT p_partkey, p_name, p_retailprice, 'product' FROM part UNION ALL SELECT n_nationkey, n_name, NULL, 'project' FROM nation")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.entity_list(
        service=table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title")),
        product=table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price")),
        project=table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title")),
    ).select("id", "title", "price", "kind")


@query("""WITH h AS (SELECT o_custkey AS site, '/p' || CAST(o_orderkey % 30 AS VARCHAR) AS url, o_orderkey AS ord FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT o_custkey AS site, '/p' || CAST(o_orderkey % 20 AS VARCHAR) AS url, o_orderkey AS ord FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 5 = 0)
  SELECT site, url, ord, 'header' AS place FROM h UNION ALL SELECT site, url, ord, 'footer' FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.site = f.site AND h.url = f.url)""")
def merged_menu_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    links = lambda n, test: table(spark, sf_dir, "orders").where(test).select(F.col("o_custkey").alias("site"), F.concat(F.lit("/p"), (k % n).cast("string")).alias("url"), k.alias("ord"))
    return relations.merged_links(links(30, k % 2 == 0), links(20, (k % 2 == 1) | (k % 5 == 0)))


@query("""WITH d AS (SELECT s_suppkey AS doc, '/docs/d' || CAST(s_suppkey AS VARCHAR) AS path FROM supplier), i AS (SELECT l_suppkey AS doc, CASE WHEN l_suppkey % 2 = 0 THEN 'NEWS' ELSE 'PROJECT' END AS subtype, '/docs/d' || CAST(l_partkey % 150 AS VARCHAR) AS path FROM lineitem)
  SELECT DISTINCT i.doc AS from_doc, d.doc AS to_doc, 'HAS_' || subtype AS type FROM i JOIN d USING (path) WHERE i.doc <> d.doc""")
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    items = table(spark, sf_dir, "lineitem").groupBy(s.alias("doc")).agg(F.collect_set(F.concat(F.lit("HTTPS://X.by/docs/d"), (F.col("l_partkey") % 150).cast("string"), F.lit("/?a=1"))).alias("urls")).withColumn("subtype", F.when(F.col("doc") % 2 == 0, "news").otherwise("project"))
    return relations.relation_edges(items, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.concat(F.lit("https://x.by/Docs/d"), F.col("s_suppkey").cast("string")).alias("url")))


def _section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    items = F.transform(F.sequence(p * 7 % 60, p * 7 % 60 + 4), lambda i: F.concat(F.lit("i"), i.cast("string")))
    return table(spark, sf_dir, "part").select(F.floor(p / 40).alias("doc_id"), p.alias("section"), (p % 3).alias("scope"), items.alias("items"))


_SECTION_PAIRS_SQL = """s AS (SELECT p_partkey // 40 AS doc_id, p_partkey AS section, p_partkey % 3 AS scope, p_partkey * 7 % 60 AS low FROM part),
  pairs AS (SELECT a.doc_id, a.section, b.section AS other, (5 - abs(a.low - b.low)) / 5 AS overlap FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.section < b.section AND a.scope <> b.scope WHERE 5 - abs(a.low - b.low) >= 2)"""


@query(f"WITH {_SECTION_PAIRS_SQL} SELECT doc_id, section, other, CAST(overlap AS DOUBLE) AS overlap FROM pairs")
def similar_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.similar_sections(_section_items(spark, sf_dir), 0.4)


@query(f"""WITH RECURSIVE {_SECTION_PAIRS_SQL}, e AS (SELECT doc_id, section, other FROM pairs UNION ALL SELECT doc_id, other, section FROM pairs), r AS (SELECT doc_id, section, section AS name FROM s UNION SELECT e.doc_id, e.other, r.name FROM r JOIN e ON e.doc_id = r.doc_id AND e.section = r.section),
  g AS (SELECT doc_id, section, min(name) AS name FROM r GROUP BY 1, 2)
  SELECT doc_id, name AS group_name, arg_min(section, section % 4 * 1000000 - section % 7 * 10000 + section) AS kept, count(*) AS copies FROM g GROUP BY 1, 2""")
def grouped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _section_items(spark, sf_dir)
    s = F.col("section")
    return relations.grouped_sections(content.similar_sections(rows, 0.4), rows.select("doc_id", "section", (s % 4).alias("scope_rank"), (s % 7).alias("px"), s.alias("ord")))


@query(f"""WITH {LEADS_SQL} SELECT 'bad-still-working' AS rule, count(*) FILTER (manual_review_status = 'BAD' AND id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS n, FALSE AS allowed FROM leads
  UNION ALL SELECT 'pipeline-without-good', count(*) FILTER (redesign_stage <> 'NOT_SELECTED' AND manual_review_status <> 'GOOD'), TRUE FROM leads
  UNION ALL SELECT 'early-reviewed', count(*) FILTER (manual_review_status <> 'UNREVIEWED' AND NOT coalesce(website_status = 'FOUND' AND audit_status = 'SUCCESS' AND lighthouse_status = 'SUCCESS' AND visual_status = 'SUCCESS' AND score_status = 'SUCCESS', FALSE)), TRUE FROM leads""")
def broken_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.broken_invariants(lead_table(spark, sf_dir), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("lead_id")))


@query("""WITH e AS (SELECT p_type AS kind, lower(p_name) AS t, CASE WHEN p_partkey % 3 > 0 THEN '/n/' || CAST(p_partkey % 70 AS VARCHAR) END AS url, p_partkey % 5 = 0 AS idx FROM part)
  SELECT 'duplicate-title' AS finding, kind || ':' || t AS key, count(*) AS n FROM e GROUP BY kind, t HAVING count(*) > 1 UNION ALL SELECT 'index-and-detail', url, count(*) FROM e WHERE url IS NOT NULL GROUP BY url HAVING bool_or(idx) AND bool_or(NOT idx)
  UNION ALL SELECT 'type', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'rejected', CASE WHEN s_suppkey % 3 = 0 THEN 'UNKNOWN' ELSE 'R' || CAST(s_suppkey % 3 AS VARCHAR) END, count(*) FROM supplier GROUP BY 2""")
def graph_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    entities = table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.initcap("p_name").alias("title"), F.when(k % 3 > 0, F.concat(F.lit("/n/"), (k % 70).cast("string"))).alias("url"), (k % 5 == 0).alias("is_index"))
    return audit.graph_audit(entities, table(spark, sf_dir, "supplier").select(F.when(s % 3 > 0, F.concat(F.lit("R"), (s % 3).cast("string"))).alias("reason")))


@query("SELECT source, doc_id, length(text) AS n FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id) = 1")
def longest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.longest(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", "text", "doc_id").select("source", "doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT o_custkey AS site, count(*) FILTER (o_orderpriority LIKE '1%') AS n, min(o_orderkey) FILTER (o_orderpriority LIKE '1%') AS first FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority LIKE '1%') <> 1")
def preferred_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.one_marked(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "site"), "site", F.col("o_orderpriority").startswith("1"), "o_orderkey")


@query(f"""WITH {LEADS_SQL}, v AS (SELECT id, ineligibility_reason AS before, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 > 0 THEN 'NONE' END ELSE ineligibility_reason END AS after FROM leads)
  SELECT before, after, count(*) AS n FROM v WHERE before IS DISTINCT FROM after GROUP BY ALL""")
def eligibility_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lead_table(spark, sf_dir)
    verdicts = rows.select("id", F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 3 > 0, "NONE")).otherwise(F.col("ineligibility_reason")).alias("verdict"))
    return audit.backfill(rows, verdicts, "ineligibility_reason").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT o_custkey % 9 AS product, o_orderkey AS taken_at, sha256(string_agg('p' || CAST(l_partkey % 3 AS VARCHAR) || '@' || CAST(l_linenumber % 2 AS VARCHAR), chr(10) ORDER BY 'p' || CAST(l_partkey % 3 AS VARCHAR) || '@' || CAST(l_linenumber % 2 AS VARCHAR))) AS hash FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
  SELECT product, hash, min(taken_at) AS taken_at FROM s WHERE taken_at % 2 = 0 AND NOT EXISTS (SELECT 1 FROM s t WHERE t.taken_at % 2 = 1 AND t.product = s.product AND t.hash = s.hash) GROUP BY 1, 2""")
def new_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct(F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("name"), (F.col("l_linenumber") % 2).cast("string").alias("version"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(part).alias("parts"))
    every = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select((F.col("o_custkey") % 9).alias("product"), F.col("o_orderkey").alias("taken_at"), audit.snapshot_hash(F.col("parts")).alias("hash"))
    return audit.new_snapshots(every.where("taken_at % 2 = 0"), every.where("taken_at % 2 = 1"))


@query("""WITH r AS (SELECT o_custkey AS site, o_orderkey AS revision, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'CANDIDATE' ELSE 'OLD' END AS status, o_orderkey % 3 = 0 AS lacks FROM orders)
  SELECT site, coalesce(max(revision) FILTER (status = 'CANDIDATE' AND NOT lacks), max(revision) FILTER (status = 'ACTIVE')) AS active_revision, count(*) FILTER (status = 'CANDIDATE' AND NOT lacks) > 0 AS promoted, count(*) FILTER (status = 'CANDIDATE' AND lacks) AS blocked FROM r GROUP BY 1""")
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("revision"), F.when(k == "F", "ACTIVE").when(k == "O", "CANDIDATE").otherwise("OLD").alias("status"))
    return audit.promotions(rows, rows.where("revision % 3 = 0").select("site", "revision"))


@query("""WITH q AS (SELECT event_id AS id, event_type AS operation, user_id AS entity FROM events WHERE event_id % 2 = 0), r AS (SELECT DISTINCT event_type AS operation, user_id AS entity FROM events WHERE event_id % 2 = 1 AND event_id % 9 < 2)
  SELECT q.id, q.operation, q.entity, r.entity IS NULL AND id = min(id) OVER (PARTITION BY q.operation, q.entity) AS started FROM q LEFT JOIN r ON r.operation = q.operation AND r.entity = q.entity""")
def startable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("id"), F.col("event_type").alias("operation"), F.col("user_id").alias("entity"), F.when(k % 9 == 0, "QUEUED").when(k % 9 == 1, "RUNNING").otherwise("DONE").alias("status"))
    return audit.startable(rows.where("id % 2 = 0").select("id", "operation", "entity"), rows.where("id % 2 = 1"))


@query("""WITH c AS (SELECT p_name || p_type AS key, arg_max(p_brand, p_partkey) AS decision FROM part WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT p_partkey AS id, decision, decision IS NOT NULL AS hit FROM part LEFT JOIN c ON c.key = p_name || p_type""")
def cached_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), markup.stable_hash(F.array("p_name", "p_type")).alias("key"), "p_brand")
    return audit.cached_decisions(rows.select("id", "key"), rows.where("id % 3 = 0").select("key", F.col("p_brand").alias("decision"), F.col("id").alias("made_at"))).select("id", "decision", "hit")


@query("""WITH r AS (SELECT c_nationkey AS site, c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN '+7 (495) ' WHEN 1 THEN '8 495 ' ELSE '' END || CAST(100 + c_custkey % 17 AS VARCHAR) || '-11-22' AS value FROM customer), k AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM r),
  o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY site, regexp_replace(d, '^8', '7') ORDER BY ord) = 1) SELECT site, string_agg(value, '|' ORDER BY -length(d), ord) AS phones FROM o GROUP BY 1""")
def site_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.concat(F.when(k % 3 == 0, "+7 (495) ").when(k % 3 == 1, "8 495 ").otherwise(""), (F.lit(100) + k % 17).cast("string"), F.lit("-11-22"))
    return audit.contacts(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), k.alias("ord"), value.alias("value"))).withColumn("phones", F.array_join("phones", "|"))


@query(f"""WITH {LEADS_SQL} SELECT id FROM leads WHERE merge_status = 'NONE' AND NOT archived AND coalesce(website_status = 'FOUND' AND audit_status = 'SUCCESS' AND lighthouse_status = 'SUCCESS' AND visual_status = 'SUCCESS' AND score_status = 'SUCCESS', FALSE)
  ORDER BY created_at DESC NULLS FIRST, id LIMIT 100""")
def ready_overrides_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In compatible mode READY replaces the statuses asked for."""
    p = leads.LeadFilter(qualification="READY", website_status="NOT_FOUND", audit_status="FAILED", compat=True, sort="created_desc", limit=100)
    return leads.lead_page(lead_table(spark, sf_dir), p).select("id")


@query(f"""WITH {LEADS_SQL} SELECT id FROM leads WHERE merge_status = 'NONE' AND NOT archived AND (contains(lower(company_name), '7') OR contains(lower(website), '7') OR contains(lower(phone), '7') OR contains(lower(address), '7')) ORDER BY company_name NULLS LAST, id LIMIT 50""")
def one_word_drops_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In compatible mode a search of one word takes the place of the FAILED conditions."""
    return leads.lead_page(lead_table(spark, sf_dir), leads.LeadFilter(text="7", qualification="FAILED", compat=True, sort="company_asc")).select("id")


@query(f"""WITH {LEADS_SQL} SELECT id, redesign_stage FROM leads WHERE merge_status = 'NONE' AND NOT archived AND website_status = 'FOUND' AND redesign_stage IN ({", ".join(f"'{x}'" for x in leads.GENERATION_STAGES[sorted(leads.GENERATION_STAGES)[0]])}) ORDER BY business_score DESC NULLS FIRST, lead_score_v2 DESC NULLS FIRST, id LIMIT 60""")
def generation_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = leads.LeadFilter(generation=sorted(leads.GENERATION_STAGES)[0], qualification="ALL", sort="biz_desc", limit=60)
    return leads.lead_page(lead_table(spark, sf_dir), p).select("id", "redesign_stage")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def lead_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return leads.lead_changes(rows, F.lit("1997-01-01").cast("timestamp")).select("id")


@query("""WITH a AS (SELECT user_id AS id, string_agg(event_type, ',' ORDER BY event_type) AS operations FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 4 < 2) GROUP BY 1) SELECT c_custkey AS id, coalesce(operations, '') AS operations FROM customer LEFT JOIN a ON id = c_custkey""")
def page_with_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    running = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("operation"), F.when(k == 0, "QUEUED").when(k == 1, "RUNNING").otherwise("DONE").alias("status")).distinct()
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return leads.with_operations(rows, running).select("id", F.array_join(F.array_distinct("operations"), ",").alias("operations"))


_ADDRESSES = ("10.1.2.3", "8.8.8.8", "172.20.0.1", "172.32.0.1", "192.168.1.1", "169.254.0.9", "100.64.0.1", "100.128.0.1", "224.0.0.1", "300.1.1.1", "not an ip", "127.0.0.1", "0.1.2.3")


@query(f"""WITH r AS (SELECT DISTINCT {_list_sql(_ADDRESSES)}[1 + event_id % 13] AS ip FROM events) SELECT ip, CASE WHEN ip IN ('300.1.1.1', 'not an ip') THEN NULL ELSE ip NOT IN ('8.8.8.8', '172.32.0.1', '100.128.0.1') END AS private FROM r""")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(_pick(_ADDRESSES, F.col("event_id")).alias("ip")).distinct()
    return rows.select("ip", security.private_address(F.col("ip")).alias("private"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 12 = 11 THEN NULL WHEN p_partkey % 12 >= 9 THEN 'CRITICAL' WHEN p_partkey % 12 >= 7 THEN 'HIGH' WHEN p_partkey % 12 >= 4 THEN 'MEDIUM' WHEN p_partkey % 12 > 0 THEN 'LOW' END AS severity,
  CASE WHEN p_size % 3 = 0 THEN 'DEVELOPMENT' WHEN p_size % 5 = 0 THEN 'OPTIONAL' ELSE 'PRODUCTION' END AS environment, CASE WHEN p_partkey % 2 = 0 THEN 'DIRECT' ELSE 'TRANSITIVE' END AS reachability FROM part""")
def dependency_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    score = F.when(k % 12 == 11, "none").otherwise((k % 12).cast("string"))
    reach = security.reachable_environment(F.col("p_size") % 3 == 0, F.col("p_size") % 5 == 0, k % 2 == 0)
    return table(spark, sf_dir, "part").select(k.alias("id"), security.severity_of(score).alias("severity"), reach.alias("r")).select("id", "severity", "r.*")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'RESOLVED' ELSE 'FIXING' END AS status FROM events""")
def failed_scan_resolves_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    findings = table(spark, sf_dir, "events").select(k.alias("id"), k.cast("string").alias("fingerprint"), F.lit("osv").alias("scanner"), F.when(k % 4 == 0, "OPEN").when(k % 4 == 1, "RESOLVED").otherwise("FIXING").alias("status"))
    return security.reconcile(findings, findings.limit(0), "osv", ok=False).select("id", "status")


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 90 END, CASE WHEN c_custkey % 3 = 1 THEN CAST(floor((c_custkey % 80 + c_custkey % 70 + c_custkey % 60 + c_custkey % 50) / 4 + 0.5) AS BIGINT) END, 0) AS technical_quality,
  coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 100 END, CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 10 * 10 END, 0) AS visual_quality, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 95 END, CASE WHEN c_custkey % 5 = 1 THEN c_custkey % 9 * 10 END, 0) AS business_confidence, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 * 10 END, 0) AS redesign_potential FROM customer""")
def score_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda m, rest, n: F.when(k % m == rest, k % n)
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), part(3, 0, 90).alias("website_quality_score"), part(3, 1, 80).alias("performance"), (k % 70).alias("seo"), (k % 60).alias("accessibility"), (k % 50).alias("best_practices"), part(4, 0, 100).alias("visual_quality_score"), part(4, 1, 10).alias("overall_visual"), part(5, 0, 95).alias("business_score"), part(5, 1, 9).alias("trust"), part(2, 0, 10).alias("redesign_potential_score"),
    )
    return scoring.v2_inputs(rows).select("id", *(F.col(c).cast("long").alias(c) for c in ("technical_quality", "visual_quality", "business_confidence", "redesign_potential")))


_NAMED = ("Двери & Окна -- 2024!", "  Über Größe  ", "---", "A b", "Наши РАБОТЫ: дома")


@query(f"""WITH r AS (SELECT event_id AS id, {_list_sql(_NAMED)}[1 + event_id % 5] AS t FROM events), w AS (SELECT *, regexp_replace(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS w FROM r) SELECT id, CASE WHEN w = '' THEN substr(sha256(t), 1, 8) ELSE w END AS slug FROM w""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), texts.slug(_pick(_NAMED, F.col("event_id"))).alias("slug"))


@query("""WITH t AS (SELECT o_custkey % 100 AS site, '/p' || CAST(o_orderkey % 7 AS VARCHAR) AS url, sum(o_orderkey % 11) AS points, bool_or(o_orderstatus = 'F') AS crawled FROM orders GROUP BY 1, 2) SELECT site, url, points, crawled FROM t QUALIFY row_number() OVER (PARTITION BY site ORDER BY points DESC, crawled DESC, url) = 1""")
def homepages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("site"), F.concat(F.lit("/p"), (k % 7).cast("string")).alias("url"), (k % 11).alias("points"), (F.col("o_orderstatus") == "F").alias("crawled"))
    return pages.homepage(rows)


@query("""WITH p AS (SELECT page_id, page_id % 3 AS nth, page_id // 3 AS parent, CASE page_id % 4 WHEN 0 THEN 'NEWS_INDEX' WHEN 1 THEN 'OTHER' ELSE 'PROJECTS_INDEX' END AS t FROM pages) SELECT a.page_id, CASE WHEN a.nth > 0 THEN coalesce(b.t, a.t) ELSE a.t END AS page_type FROM p a LEFT JOIN p b ON b.parent = a.parent AND b.nth = 0""")
def paginated_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = F.concat(F.lit("https://x.by/list"), F.floor(k / 3).cast("string"), F.when(k % 3 > 0, F.concat(F.lit("/page/"), (k % 3 + 1).cast("string"), F.lit("/"))).otherwise(""))
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    types = rows.select("page_id", F.when(k % 4 == 0, "NEWS_INDEX").when(k % 4 == 1, "OTHER").otherwise("PROJECTS_INDEX").alias("page_type"))
    return pages.inherit_from_pagination(rows, types)


_CRAWLED = {
    "https://www.X.by/a/index.html?utm_source=1#x": ("https://www.x.by/a", False, False), "https://x.by/list?page=3&ref=2": ("https://x.by/list?page=3", True, True), "https://x.by/login/me": ("https://x.by/login/me", False, True),
    "https://x.by/file.PDF": ("https://x.by/file.PDF", False, False), "http://x.by/b///": ("http://x.by/b/", True, False), "https://x.by/c?sort=asc&tag=q": ("https://x.by/c?tag=q", True, True), "https://x.by/news/page/12/": ("https://x.by/news/page/12/", True, True), "https://x.by": ("https://x.by/", True, False),
}
_CRAWLED_SQL = ", ".join(f"({i}, '{url}', '{kept}', {ok}, {low})" for i, (url, (kept, ok, low)) in enumerate(_CRAWLED.items()))


@query(f"""WITH v(i, url, crawl_url, crawled, low_value) AS (VALUES {_CRAWLED_SQL}) SELECT v.url, crawl_url, crawled, low_value, count(*) AS n FROM events JOIN v ON i = event_id % {len(_CRAWLED)} GROUP BY ALL""")
def crawl_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(_pick(tuple(_CRAWLED), F.col("event_id")).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    url = F.col("url")
    return rows.select("url", pages.crawl_url(url).alias("crawl_url"), pages.should_crawl(url).alias("crawled"), pages.low_value(url).alias("low_value"), "n")


NAMES = tuple(name for name, f in list(globals().items()) if getattr(f, "__module__", None) == __name__ and not name.startswith("_"))
