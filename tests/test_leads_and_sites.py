from datetime import datetime

from pyspark.sql import functions as F

from leadmill.functions import compat, urls
from leadmill.operators import dedupe, gate, leads, qualification, scoring

LEAD = "id long, company_name string, website string, phone string, address string, categories array<string>, has_site boolean, has_active_runs boolean, manual_review_status string, created_at timestamp, merge_status string"


def _lead(i, name, website=None, phone=None, address=None, site=False, runs=False, review="UNREVIEWED", day=1, categories=None):
    return (i, name, website, phone, address, categories or [], site, runs, review, datetime(2024, 1, day), "NONE")


def test_rounding_nulls_and_space(spark):
    row = spark.range(1).select(compat.round_half_up(F.lit(-2.5)).alias("a"), compat.round_half_up(F.lit(2.5)).alias("b"), compat.one_space(F.lit(" a  b\n")).alias("c"), compat.clamp(F.lit(140.2), 0, 100).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (-2, 3, "a b", 100)
    ordered = spark.createDataFrame([(1,), (None,), (3,)], "v int").orderBy(compat.descending("v")).collect()
    assert [r.v for r in ordered] == [None, 3, 1]


def test_canonical_urls(spark):
    cases = {
        "http://www.Acme.BY//a//b/?utm_source=x&b=2&a=1#frag": ("https://acme.by/a/b?a=1&b=2", "acme.by", "acme.by", "acme.by/a/b"),
        "shop.acme.com.by": ("https://shop.acme.com.by/", "shop.acme.com.by", "acme.com.by", "acme.com.by/"),
        "https://x.org/?fbclid=1": ("https://x.org/", "x.org", "x.org", "x.org/"),
        "localhost:3000": (None, None, None, None),
        "   ": (None, None, None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()
    for r in rows:
        assert (r.c.url, r.c.host, r.c.domain, r.c.url_key) == cases[r.u], r.u


def test_policy_takes_the_first_rule(spark):
    sites = [(1, "https://minsk.jsprav.ru/x"), (2, "vk.com"), (3, "m.vk.com"), (4, None), (5, "nodots"), (6, "http://www.gov.by"), (7, "notgov.by"), (8, "market.yandex.ru"), (9, "https://firm.by")]
    found = {r.id: (r.eligible, r.reason, r.matched_rule) for r in urls.eligibility(spark.createDataFrame(sites, "id long, site string"), "id", "site").collect()}
    assert found[1] == (False, "DIRECTORY", "suffix:jsprav.ru (AGGREGATOR)") and found[2][1] == "SOCIAL_NETWORK" and found[3] == (True, None, None)
    assert found[4][1] == "NO_WEBSITE" and found[5][1] == "INVALID_URL" and found[6][1] == "GOVERNMENT" and found[7][0] and found[8][1] == "SEARCH_ENGINE" and found[9][0]


def test_same_organisation(spark):
    pairs = {("студия дизайна елены", "студия дизайна интерьера елены"): True, ("минск", "минск арена"): True, ("alpha beta", "alpha gamma"): False, ("", "x"): False, ("acme", "acme"): True}
    for (a, b), want in pairs.items():
        assert spark.range(1).select(dedupe.same_org(F.lit(a), F.lit(b)).alias("v")).first().v == want
    name = lambda text, mode: spark.range(1).select(dedupe.org_name(F.lit(text), mode).alias("v")).first().v
    assert name('ООО «Acme» Ltd', "strict") == "ооо acme" and name('ООО «Acme» Ltd', "fixed") == "acme"


def test_duplicate_groups_and_merge(spark):
    rows = [
        _lead(1, "Acme", "https://acme.by", phone="80291234567", day=3), _lead(2, "Acme LLC", "http://www.acme.by/about", address="x", day=2), _lead(3, "Studio Elena Design", phone="+375 29 111-22-33"), _lead(4, "Studio Design Elena", phone="8029 1112233", day=2, categories=["b"]),
        _lead(5, "Other", phone="+375291112233"), _lead(6, "A B", "https://two.by", site=True), _lead(7, "A B", "https://two.by", site=True), _lead(8, "Cafe One", "https://venue.by"), _lead(9, "Gym Two", "https://venue.by"), _lead(10, "Short", phone="1234"), _lead(11, "Short", phone="1234"),
    ]
    table = spark.createDataFrame(rows, LEAD)
    plan = {r.group_key: r for r in dedupe.merge_plan(table).collect()}
    assert set(plan) == {"acme.by", "phone:375291112233", "two.by", "venue.by"}
    assert plan["acme.by"].survivor_id == 2 and plan["acme.by"].merge_ids == [1] and not plan["acme.by"].blocked
    assert plan["two.by"].block_reason == "CONFLICTING_GENERATED_SITES" and plan["venue.by"].block_reason == "DIFFERENT_ORGANISATIONS_SAME_DOMAIN" and plan["venue.by"].survivor_id is None
    assert plan["phone:375291112233"].survivor_id == 4
    queries = spark.createDataFrame([(1, "q"), (2, "q"), (1, "r"), (10, "s")], "id long, query string")
    after, pointed = dedupe.apply_merge(table, dedupe.merge_plan(table), queries)
    state = {r.id: r for r in after.collect()}
    assert state[1].merge_status == "MERGED" and state[1].merged_into == 2 and state[2].phone == "80291234567" and state[8].merge_status == "BLOCKED"
    assert sorted((r.id, r.query) for r in pointed.collect()) == [(2, "q"), (2, "r"), (10, "s")]
    again = dedupe.merge_plan(after.where("merge_status = 'NONE'").drop("merged_into"))
    assert again.where("not blocked").count() == 0


def test_gate_depends_on_what_was_accepted(spark):
    # A is accepted; B is refused for its name and phone; C shares B's domain, which nobody holds.
    rows = [(0, "x.by", "Firm", "1", None), (1, "y.by", "firm", "1", None), (2, "y.by", "Another", "2", None), (3, "y.by", "Third", None, "s"), (4, "z.by", "Third", None, "S"), (5, "w.by", None, "1", None)]
    schema = "ord long, domain string, company_name string, phone string, address string"
    found = {r.ord: (r.decision, r.reason, r.of) for r in gate.deduplicate_in_order(spark.createDataFrame(rows, schema)).collect()}
    assert found[0] == ("ACCEPT", None, None) and found[1] == ("REJECT", "DUPLICATE_ORGANISATION", 0) and found[2][0] == "ACCEPT"
    assert found[3] == ("REJECT", "DUPLICATE_CANONICAL_DOMAIN", 2) and found[4][0] == "ACCEPT" and found[5][0] == "ACCEPT"
    old = spark.createDataFrame([("w.by", "Old", "9", None)], "domain string, company_name string, phone string, address string")
    found = {r.ord: r.of for r in gate.deduplicate_in_order(spark.createDataFrame(rows, schema), old).collect()}
    assert found[5] == -1
    assert gate.deduplicate_in_order(spark.createDataFrame([], schema)).count() == 0


def _greedy(rows):
    out, leads_ = {}, []
    for ord_, domain, name, phone, address in rows:
        hit = [o for o, d, *_ in leads_ if d == domain]
        if hit:
            out[ord_] = ("DUPLICATE_CANONICAL_DOMAIN", hit[0])
            continue
        same = [o for o, d, n, p, a in leads_ if d != domain and n.lower() == name.lower() and (p == phone if phone else bool(address) and (a or "").lower() == address.lower())] if phone or address else []
        if same:
            out[ord_] = ("DUPLICATE_ORGANISATION", same[0])
            continue
        out[ord_] = (None, None)
        leads_.append((ord_, domain, name, phone, address))
    return out


def test_gate_against_the_plain_loop(spark):
    import random

    rng = random.Random(6)
    rows = [(i, f"d{rng.randrange(12)}.by", f"Name {rng.randrange(4)}", rng.choice([None, "1", "2"]), rng.choice([None, "s", "t"])) for i in range(120)]
    found = gate.deduplicate_in_order(spark.createDataFrame(rows, "ord long, domain string, company_name string, phone string, address string")).collect()
    assert {r.ord: (r.reason, r.of) for r in found} == _greedy(rows)


def test_gate_counts_every_candidate_once(spark, sf_dir):
    from leadmill.plans import catalogue

    c = catalogue.QUERIES["run_counters"](spark, sf_dir).first()
    assert c.collected == c.created + c.duplicates + c.rejected + c.uncertain == 50


def test_relevance(spark):
    rows = spark.createDataFrame([("Строитель Плюс", ["ремонт"]), ("Ресторан", ["ремонт"]), ("Acme", None)], "n string, c array<string>")
    found = rows.select(gate.relevance(F.col("n"), F.col("c"), None, "подряд").alias("r")).collect()
    assert [r.r.decision for r in found] == ["ACCEPT", "REJECT", "UNCERTAIN"]


def test_search_and_filters(spark):
    schema = "id long, company_name string, website string, phone string, address string, website_status string, audit_status string, score_status string, lighthouse_status string, visual_status string, enrichment_status string, manual_review_status string, redesign_stage string, merge_status string, archived boolean, lead_score long, lead_score_v2 long, business_score long, website_quality_score long, created_at timestamp, has_site boolean"
    ready = ("FOUND", "SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS", "GOOD", "NOT_SELECTED", "NONE", False)
    day = datetime(2024, 1, 1)
    rows = [
        (1, "50% Off Shop", "a.by", "1", "Minsk", *ready, 10, 1, 5, 50, day, True), (2, "Other", None, None, None, *ready, None, 2, 5, 50, day, False), (3, "Failed", "f.by", None, "Minsk", "FOUND", "FAILED", *ready[2:], 90, 3, 5, 50, day, None),
        (4, "Missing report", "m.by", None, None, "FOUND", "SUCCESS", "SUCCESS", None, "SUCCESS", *ready[5:], 20, 4, 5, 50, day, False), (5, "Gone", "g.by", None, None, *ready[:8], "MERGED", False, 99, 5, 5, 50, day, True),
    ]
    table = spark.createDataFrame(rows, schema)
    ids = lambda **p: [r.id for r in leads.lead_page(table, leads.LeadFilter(**p)).collect()]
    assert ids() == [2, 1]  # an unknown score sorts first
    assert ids(qualification="PENDING") == [3, 4] and ids(qualification="FAILED") == [3]
    assert ids(text="50%") == [1] and ids(text="off, minsk") == [1] and ids(text="_") == []
    assert ids(qualification="FAILED", text="minsk") == [3] and ids(qualification="FAILED", text="minsk", compat=True, include_excluded=True) == [3, 1]
    assert ids(min_lead=5) == [1] and ids(limit=0) == [2] and ids(sort="company_asc") == [1, 2] and ids(offset=1) == [1]
    f = leads.funnel(table).first()
    assert (f.total, f.ready_for_review, f.qualification_pending, f.failed, f.generated) == (4, 2, 2, 1, 1)


def test_scores(spark):
    base = {"performance": 50, "seo": 50, "accessibility": 50, "best_practices": 50, "company_name": "Acme Build", "website": "w", "phone": "p", "address": None, "has_crawl": False, "title": None, "meta_description": None, "h1": None, "viewport": None, "footer_years": None, "latest_content_date": None, "has_news": False, "n_forms": 0, "n_buttons": 0, "n_links": 0, "n_tel": 0, "n_mailto": 0, "n_social": 0}
    schema = "performance int, seo int, accessibility int, best_practices int, company_name string, website string, phone string, address string, has_crawl boolean, title string, meta_description string, h1 string, viewport string, footer_years array<int>, latest_content_date timestamp, has_news boolean, n_forms int, n_buttons int, n_links int, n_tel int, n_mailto int, n_social int"
    full = base | {"has_crawl": True, "title": "Acme Build company", "meta_description": "m" * 20, "h1": "Acme", "viewport": "v", "footer_years": [2024], "latest_content_date": datetime(2024, 1, 1), "has_news": True, "n_forms": 1, "n_buttons": 1, "n_links": 50, "n_tel": 1, "n_mailto": 1, "n_social": 1}
    rows = spark.createDataFrame([tuple(r.values()) for r in (base, full)], schema)
    plain, rich = scoring.lead_score_v1(rows, F.lit("2024-01-31").cast("timestamp")).collect()
    assert (plain.website_quality_score, plain.business_score, plain.lead_score, plain.primary_weakness) == (50, 40, 20, "quality")
    assert (rich.website_quality_score, rich.business_score) == (50 + 6 + 3 + 3 + 1, 100)
    v2 = scoring.lead_score_v2(spark.createDataFrame([(20, 30, 80, 90)], "technical_quality int, visual_quality int, business_confidence int, redesign_potential int")).first()
    assert (v2.redesign_opportunity, v2.lead_score_v2) == (75, 60) and len(v2.reasons) == 4


def test_qualification_order_and_stops(spark):
    schema = "id long, website string, website_status string, audit_status string, lighthouse_status string, visual_status string, score_status string, enrichment_status string, manual_review_status string, active array<string>"
    ok = ("w", "FOUND", "SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS", "GOOD", [])
    cases = [
        (ok, (None, "ready_for_review")), ((*ok[:7], "BAD", []), (None, "manually_rejected")), (("w", "FAILED", *ok[2:]), (None, "website_unreachable")), ((None, "UNKNOWN", *ok[2:6], "PENDING", "GOOD", []), ("enrich", None)), ((None, "UNKNOWN", *ok[2:6], "FAILED", "GOOD", []), (None, "enrichment_failed")),
        ((None, "UNKNOWN", *ok[2:]), (None, "no_website")), (("w", "FOUND", "PENDING", *ok[3:]), ("audit", None)), (("w", "FOUND", "PENDING", *ok[3:8], ["AUDIT_WEBSITE"]), (None, "already_active")), (("w", "FOUND", "FAILED", *ok[3:]), (None, "audit_failed")), (("w", "FOUND", "SUCCESS", None, *ok[4:]), ("lighthouse", None)),
        (("w", "FOUND", "SUCCESS", "SUCCESS", None, *ok[5:]), ("ai", None)), (("w", "FOUND", "SUCCESS", "SUCCESS", "SUCCESS", "PENDING", *ok[6:]), ("scoring", None)),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], schema)
    for r in rows.select("id", qualification.next_action(F.col("active")).alias("a")).collect():
        assert (r.a.stage, r.a.reason) == cases[r.id][1], r.id
    stages = {(r.id, r.stage): (r.status, r.waiting_for) for r in qualification.stage_rows(rows).collect()}
    assert stages[(6, "screenshots")] == ("WAITING", ["audit"]) and stages[(6, "audit")][0] == "PENDING"


def test_stage_gates(spark):
    rows = spark.createDataFrame([("CRAWLED", [], []), ("RENDERED", ["e"], []), ("HUMAN_REVIEW_READY", [], ["w"])], "stage string, errors array<string>, warnings array<string>")
    assert [(r.status, r.retry_from) for r in qualification.stage_gate(rows).collect()] == [("PASS", "EXTRACTED"), ("FAIL", "RENDERED"), ("PASS_WITH_WARNINGS", "HUMAN_REVIEW_READY")]
    codes = spark.createDataFrame([("page.goto: Timeout 30000ms",), ("HTTP 429",), (None,)], "m string").select(qualification.error_code(F.col("m")).alias("c"))
    assert [r.c for r in codes.collect()] == ["SOURCE_TIMEOUT", "AI_RATE_LIMIT", "UNKNOWN_ERROR"]
