import json
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from leadmill.functions import facts, texts
from leadmill.operators import activity, content, pages, security, store
from leadmill.plans import catalogue
from leadmill.sources import files
from leadmill.streaming import events as stream


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sentences_and_repeats(spark):
    docs = spark.createDataFrame([(1, "A sentence long enough here. Another one stands there! A sentence long enough here.\nshort. Something between. Another one stands there!"), (2, None), (3, ""), (4, "Tiny one. Tiny one. Tiny one.")], "doc_id long, text string")
    found = {(r.doc_id, r.sentence): r.occurrences for r in texts.repeated_sentences(docs).collect()}
    assert found == {(1, "a sentence long enough here."): 2, (1, "another one stands there!"): 2, (4, "tiny one."): 3}
    runs = texts.repeated_runs(docs).collect()
    assert [(r.doc_id, r.run_length, r.occurrences) for r in runs] == [(4, 2, 2)]
    lines = spark.createDataFrame([(1, "x\nX \n\nx\ny"), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.ord) for r in texts.adjacent_duplicates(lines).orderBy("ord").collect()] == [(1, 1), (1, 3)]


def test_technical_payloads(spark):
    cases = {'{"a": 1, "b": [2]}': "json-payload", '{"a": 1, "b": 2, "c": ': "config-kv-density", "push to dataLayer now": "config-key-vocabulary", "ask mail@example.com": "placeholder-contact", "function (x) { y(); z(); }": "code-fragment", "plain words": None, "": None, "[1]": None}
    for text, rule in cases.items():
        assert _one(spark, texts.technical_payload(F.lit(text))["rule"]) == rule, text


def test_fact_gate(spark):
    phone = lambda raw, context="": _one(spark, facts.phone(F.lit(raw), F.lit(context)))
    assert phone("+375 (29) 123-45-67").ok and phone("").reason == "EMPTY" and phone("call me").reason == "CONTAINS_NON_PHONE_CHARS" and phone("2010-2020").reason == "YEAR_RANGE"
    assert phone("123456789").reason == "AMBIGUOUS_NINE_DIGIT" and phone("123456789", "унп").reason == "REGISTRATION_ID" and phone("12345").reason == "TOO_FEW_DIGITS" and phone("+1234567890123456").reason == "TOO_MANY_DIGITS" and phone("1234567, 7654321").reason == "CONCATENATED"
    email = lambda raw: _one(spark, facts.email(F.lit(raw)))
    assert email("Info@Acme.by").value == "info@acme.by" and email("100-38-88info@x.com").value == "info@x.com" and email("logo@2x.png").reason == "IMAGE_FILENAME" and email("12-34@x.com").reason == "NUMERIC_LOCAL" and email("me@example.com").reason == "PLACEHOLDER" and email("none").reason == "NOT_AN_EMAIL"
    assert _one(spark, facts.employees(F.lit("0 сотрудников"))).reason == "COUNTER_ZERO" and _one(spark, facts.employees(F.lit("120 employees"))).ok
    assert _one(spark, facts.registration_id(F.lit("191234567"), F.lit("унп"))).ok and _one(spark, facts.registration_id(F.lit("191234567"), F.lit(""))).reason == "REGISTRATION_WITHOUT_LABEL"
    assert _one(spark, facts.founding_date(F.lit("since 1998"), F.lit("2024-01-01").cast("timestamp"))).value == "1998"


def test_crawl_rules_and_plan(spark):
    crawl = lambda u: _one(spark, pages.should_crawl(F.lit(u)))
    assert crawl("https://a.by/x") and not crawl("https://a.by/login/x") and not crawl("https://a.by/f.pdf") and not crawl("https://a.by/?utm_a=1") and not crawl("ftp://a.by/")
    assert _one(spark, pages.crawl_url(F.lit("https://A.by/x/index.html?page=2&z=1#f"))) == "https://a.by/x?page=2" and _one(spark, pages.page_key(F.lit("https://www.a.by/x/index.htm"))) == "a.by/x"
    found = spark.createDataFrame([("https://a.by/", "root", 0, 0), ("https://www.a.by/index.html", "body", 1, 1), ("https://a.by/cat/one", "body", 1, 2), ("https://a.by/cat/two", "body", 1, 3), ("https://a.by/cat", "footer", 1, 4), ("https://a.by/tag/x", "nav", 1, 5)], "url string, source string, depth int, ord int")
    plan = {r.key: (r.source, r.priority, r.result) for r in pages.crawl_plan(found, budget=3).collect()}
    assert plan["a.by/"] == ("root", -1000, "PLANNED") and plan["a.by/cat"][1:] == (-74, "PLANNED") and plan["a.by/tag/x"][1:] == (-40, "PLANNED") and plan["a.by/cat/two"][2] == "BUDGET_EXHAUSTED" and len(plan) == 5


def test_page_documents_and_links(spark):
    html = '<html lang="en"><head><title>Our  services</title><meta name="description" content="D"><meta property="og:title" content="T"><meta property="og:title" content="U"><script type="application/ld+json">{"@type": "Product"}</script></head><body><h1>Web <b>services</b></h1><h2>H</h2><p>One</p><p>Two<ul><li>i</li></ul><a href="/services/web">w</a><a href="tel:1">t</a><a href="#">x</a><form></form> &copy; 2021'
    rows = spark.createDataFrame([(1, "https://a.by/services", html), (2, "https://a.by/services/web", '<a href="/">home</a>'), (3, None, None)], "page_id long, url string, html string")
    d = pages.documents(rows).orderBy("page_id").first()
    assert (d.title, d.h1, d.meta_description, d.paragraphs, d.headings, d.items, d.open_graph, d.structured_types) == ("Our services", "Web services", "D", ["One", "Twoiwtx © 2021".replace("©", "&copy;")], ["H"], ["i"], {"title": "T"}, ["product"])
    s = pages.signals(rows).orderBy("page_id").first()
    assert (s.n_forms, s.n_links, s.n_tel, s.latest_year, s.lang) == (1, 3, 1, 2021, "en")
    classes = {r.page_id: r.page_type for r in pages.classify(pages.documents(rows.where("page_id < 3"))).collect()}
    assert classes == {1: "SERVICES_INDEX", 2: "SERVICE_DETAIL"}
    assert [(r.target_id, r.source_id, r.n_links) for r in pages.backlinks(rows).collect()] == [(2, 1, 1)]
    kinds = {h: _one(spark, pages.link_class(F.lit(h), F.lit(None).cast("boolean"))) for h in ("", "#", "#a", "/#a", "javascript:x", "tel:1", "https://x", "/in")}
    assert list(kinds.values()) == ["EMPTY", "PLACEHOLDER", "ANCHOR", "VALID_HOME_ANCHOR", "BAD_PROTOCOL", "VALID_ACTION", "EXTERNAL", "UNKNOWN"]


def test_content_plan(spark):
    rows = [("s", 1, "project", "House A | Acme", "https://a.by/h/", 0.9, "p1", False), ("s", 2, "product", "House A", "https://a.by/h", 0.5, "p2", True), ("s", 3, "product", "Lamp", None, 0.4, "p1", True), ("s", 4, "project", "lamp | Acme", None, 0.4, "p3", False), ("s", 5, "news", "N", "", 0.4, "p4", False)]
    found = {(r.kind, r.members) for r in content.canonical_entities(spark.createDataFrame(rows, "site string, ord int, kind string, title string, detail_url string, confidence double, source_url string, catalogue boolean"), "Acme").collect()}
    assert found == {("project", 2), ("product", 2), ("news", 1)}
    products = [("s", 1, "A", None), ("s", 2, "a", "x"), ("s", 3, "B", "x"), ("s", 4, "B", "y"), ("s", 5, "B", None), ("s", 6, "B", "Y")]
    of = {r.ord: r.of for r in content.distinct_products(spark.createDataFrame(products, "site string, ord int, title string, description string")).collect()}
    assert of == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 4}
    sections = [("s", "u1", "FAQ", "Q", ["What is it?", "Why so?"], 1), ("s", "u2", "FAQ", "q", ["Why so?", "What is it?"], 2), ("s", "u1", "FAQ", "More", ["x", "Long question?"], 3), ("s", "u1", "TEAM", "T", ["Solo person"], 4), ("s", "u1", "REVIEWS", "R", ["Fine work"], 5)]
    best = {r.kind: (r.heading, r.source_pages) for r in content.dynamic_sections(spark.createDataFrame(sections, "site string, url string, kind string, heading string, titles array<string>, ord int")).collect()}
    assert best == {"FAQ": ("Q", ["u1", "u2"]), "REVIEWS": ("R", ["u1"])}
    assert _one(spark, content.paragraph_blocks(F.lit("aaa\nbbb\n\nccc"), 8)) == ["aaa\n\nbbb", "ccc"] and _one(spark, content.paragraph_blocks(F.lit(None).cast("string"))) == []
    overlap = spark.createDataFrame([(1, 1, "desktop", ["a", "b", "c"]), (1, 2, "mobile", ["a", "b", "c", "d"]), (1, 3, "mobile", ["z"])], "doc_id int, section int, scope string, items array<string>")
    assert [(r.section, r.other, r.overlap) for r in content.similar_sections(overlap).collect()] == [(1, 2, 1.0)]
    assert str(_one(spark, content.source_date(F.lit("05.03.24")))) == "2024-03-05 00:00:00" and _one(spark, content.source_date(F.lit("soon"))) is None
    assert _one(spark, content.best_phone(F.lit("8 029 1234567 or +375 29 123-45-67"))) == "+375 29 123-45-67"


def test_routes_and_menu(spark):
    entities = spark.createDataFrame([("s", "service", "web", 1), ("s", "project", "web", 2), ("s", "news", "n1", 3)], "site string, kind string, slug string, id long")
    sheets = spark.createDataFrame([("s", "about", 10, False), ("s", "main", 11, True), ("s", "news", 12, False)], "site string, slug string, id long, is_homepage boolean")
    hints = spark.createDataFrame([("services", "SERVICES")], "slug string, collection string")
    asked = ["/", "x/web", "/about/", "main", "services", "nope", "news/n1"]
    routes = spark.createDataFrame([("s", a) for a in asked], "site string, path string")
    found = {r.path: (r.kind, r.target) for r in content.resolve_routes(routes, entities, sheets, hints).collect()}
    assert found == {"/": ("HOME", None), "x/web": ("SERVICE_DETAIL", "1"), "/about/": ("PAGE", "10"), "main": ("HOME", "11"), "services": ("COLLECTION", "SERVICES"), "nope": ("NOT_FOUND", None), "news/n1": ("NEWS_DETAIL", "3")}
    menu = spark.createDataFrame([(1, None, "#", True, 1), (2, 1, "", True, 1), (3, 2, "/x", True, 1), (4, None, "", True, 2), (5, None, "/y", False, 3)], "id int, parent_id int, href string, visible boolean, sort_order int")
    assert {(r.id, r.href) for r in content.pruned_menu(menu).collect()} == {(1, ""), (2, ""), (3, "/x")}


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None), (3, "b", None), (None, "n", None)], "k int, v string, w string")
    found = {r.k: (r.v, r.w, r.action) for r in store.upsert(old, new, ["k"]).collect()}
    assert found == {1: ("a", "x", "kept"), 2: ("b", "y", "updated"), 3: ("c", None, "created"), None: ("n", None, "created")}
    assert {r.k for r in store.drop_stale(old, new, ["k"], F.col("v") == "q").collect()} == {2} and store.drop_stale(old, new, ["k"], F.col("v") == "a").count() == 2
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, None), (9, None)], "id int, merged_into int")
    assert {r.id: r.survivor_id for r in store.follow_survivors(chain).collect()} == {1: 3, 2: 3, 3: 3, 9: 9}
    votes = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "b", 0.5)], "k int, v string, c double")
    assert store.weighted_vote(votes, "k", "v", "c").first().v == "a"
    runs = content.run_lengths(spark.createDataFrame([(1, i, i not in (2, 7)) for i in range(9)], "d int, ord int, f boolean"), "d", F.col("f"), 4)
    assert [(r.first_at, r.length) for r in runs.collect()] == [(3, 4)]


def test_security(spark):
    schema = "id long, fingerprint string, severity string, status string, scanner string, dependency string, canonical_id string"
    rows = [(1, "a", "HIGH", "RESOLVED", "s", None, None), (2, "b", "HIGH", "OPEN", "s", None, "c"), (3, "c", "LOW", "ACCEPTEDRISK", "s", None, "c"), (4, "d", "LOW", "OPEN", "t", "x@1", None), (5, "e", "LOW", "FALSEPOSITIVE", "s", None, None)]
    table = spark.createDataFrame(rows, schema)
    seen = spark.createDataFrame([("a", "HIGH"), ("c", "LOW"), ("new", "LOW"), ("new", "LOW")], "fingerprint string, severity string")
    state = lambda **k: {r.fingerprint: r.status for r in security.reconcile(table, seen, "s", **k).collect()}
    gone = spark.createDataFrame([("y@1",)], "dependency string")
    assert state(ok=True) == {"a": "OPEN", "b": "RESOLVED", "c": "ACCEPTEDRISK", "d": "OPEN", "e": "FALSEPOSITIVE", "new": "OPEN"}
    assert state(ok=True, present=gone)["d"] == "RESOLVED" and state(ok=False)["b"] == "OPEN" and state(ok=False, present=gone)["d"] == "OPEN"
    counts = security.gate_status(security.gate_counts(table)).first()
    assert (counts.high, counts.low, counts.gate) == (1, 1, "WARN")
    addresses = {a: _one(spark, security.private_address(F.lit(a))) for a in ("10.1.1.1", "172.20.0.1", "8.8.8.8", "300.1.1.1", "x")}
    assert list(addresses.values()) == [True, True, False, None, None]


def test_activity(spark):
    rows = [(i, datetime(2024, 1, 1 + i // 4, i % 24), i % 3, ("INFO", "WARN", "DEBUG", "ERROR")[i % 4], "m") for i in range(100)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, level string, module string")
    as_of = F.lit("2024-01-25").cast("timestamp")
    page = activity.page(log, F.lit("2024-01-20").cast("timestamp"), "WARN", limit=5).collect()
    assert len(page) == 5 and [r.ts for r in page] == sorted(r.ts for r in page) and {r.level for r in page} <= {"WARN", "ERROR"}
    kept = activity.retained(log, as_of).collect()
    assert {r.level for r in kept if r.ts < datetime(2024, 1, 18)} == {"DEBUG"} and len(activity.retained(log, as_of, most=7).collect()) == 7 and activity.retained(log.limit(0), as_of).count() == 0
    assert {r.user_id: r.event_id for r in activity.latest_per_entity(log).collect()} == {0: 99, 1: 97, 2: 98} or activity.latest_per_entity(log).count() == 3
    details = spark.range(1).select(activity.redacted(F.create_map(F.lit("api_key"), F.lit("v"), F.lit("note"), F.lit("my token is x"), F.lit("ok"), F.lit("fine"))).alias("m")).first().m
    assert details == {"api_key": "[REDACTED]", "note": "[REDACTED]", "ok": "fine"}


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    first = spark.createDataFrame([(1, datetime(2024, 1, 1), 7, "view"), (2, datetime(2024, 1, 3), 7, "click")], schema)
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: stream.read_events(spark, f"{tmp_path}/in", first.schema)
    stream.append(read(), f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    seen = []
    run = lambda: stream.into(stream.latest_state(read()), lambda df, i: seen.extend(df.collect()), f"{tmp_path}/c2").awaitTermination()
    run()
    assert [(r.user_id, r.event_id) for r in seen] == [(7, 2)]
    late = spark.createDataFrame([(3, datetime(2024, 1, 2), 7, "late"), (4, datetime(2024, 1, 2), 8, "view")], schema)
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert [(r.user_id, r.event_id) for r in seen] == [(7, 2), (8, 4)]  # the late row of 7 changes nothing
    assert stream.delta(spark.read.parquet(f"{tmp_path}/in"), datetime(2024, 1, 2)).count() == 1


def test_files(spark, tmp_path):
    item = {"id": "1", "name": "N", "rubrics": [{"name": "r"}], "contacts": [{"type": "phone", "value": "9"}], "contact_groups": [{"name": "g", "contacts": [{"type": "website", "url": " ", "value": "w.by"}]}]}
    (tmp_path / "items.json").write_text(json.dumps(item) + "\nbroken\n")
    got = files.leads_from_items(files.provider_items(spark, str(tmp_path / "items.json")).where("id is not null")).first()
    assert (got.source_id, got.website, got.phone, got.categories) == ("1", "w.by", "9", ["r"])
    (tmp_path / "manual.txt").write_text("Acme|acme.by;+1\n\n  \nSolo\n")
    assert [(r.company_name, r.website, r.phone) for r in files.manual_leads(spark, str(tmp_path / "manual.txt")).orderBy("company_name").collect()] == [("Acme", "acme.by", "+1"), ("Solo", None, None)]
    (tmp_path / "lock.json").write_text(json.dumps({"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1", "dev": True}, "node_modules/a/node_modules/b": {"version": "2"}}}, indent=1))
    assert {(r.name, r.version, r.dev) for r in files.lockfile_packages(spark, str(tmp_path / "lock.json")).collect()} == {("a", "1", True), ("b", "2", False)}
    maps = spark.createDataFrame([("u", "<loc> https://a.by/1 </loc><LOC>https://a.by/2</LOC>"), ("r", "x\nSitemap: https://a.by/s.xml")], "url string, body string")
    assert files.sitemap_urls(maps).count() == 2 and files.robots_sitemaps(maps).first().sitemap == "https://a.by/s.xml"
    table = spark.createDataFrame([(1, 'say "hi", all', ["a", "b"]), (2, None, [])], "id int, t string, c array<string>")
    files.write_csv(table, f"{tmp_path}/csv")
    back = {r.id: (r.t, r.c) for r in spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(f"{tmp_path}/csv").collect()}
    assert back == {1: ('say "hi", all', "a"), 2: (None, None)}


def test_paragraphs_and_lists_lose_spaces_and_no_digits_at_their_ends(spark, tmp_path):
    assert _one(spark, content.paragraph_blocks(F.lit("0 first 0\n 1 second 1 "), 8)) == ["0 first 0", "1 second 1"]
    (tmp_path / "manual.txt").write_text("Firm 2000; 1acme.by |+375 22\n")
    assert [(r.company_name, r.website, r.phone) for r in files.manual_leads(spark, str(tmp_path / "manual.txt")).collect()] == [("Firm 2000", "1acme.by", "+375 22")]


def test_backlinks_equal_their_sql_on_more_pages(spark, tmp_path):
    spark.range(1000).selectExpr("id AS page_id", "'u' AS url", "'' AS html").write.parquet(f"{tmp_path}/pages.parquet")
    expected = duckdb.sql(catalogue.ORACLE_SQL["backlinks"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert len(expected) > 1000 and sorted((r.target_id, r.source_id, r.n_links) for r in catalogue.QUERIES["backlinks"](spark, str(tmp_path)).collect()) == sorted(expected)
