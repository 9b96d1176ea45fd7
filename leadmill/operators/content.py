"""Content of a site: canonical entities, sibling types, dynamic sections, routes, menus, blocks, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.functions.compat import one_space, yes
from leadmill.operators.store import weighted_vote
from leadmill.storage import broadcast_if_small, materialise, scratch

# What a catalogue entry says, marks of chrome in titles, patterns of leaks.
CATALOGUE = r"(?iu)(площадь|м2|м²|цен|стоимост|price|area|срок|размер|этаж)"
PRODUCT = r"(?iu)(м2|м²|площадь|цен|руб|стоимост|конфигур|меняйте|выберите|вариант|комплектац)"
TITLE_MARKS = r"[✔➔✓→]"
PHONE_LIKE = r"\+?[0-9][0-9\s()\-]{6,}"
LEAKS = ("undefined", "[object Object]", "NaN", "lorem ipsum", "{{", "TODO")
DETAIL_KINDS = ("service", "project", "news", "vacancy", "product")
BLOCK_CHARS = 900


def canonical_entities(entities: DataFrame, brand: str = "") -> DataFrame:
    """One row per real thing: entity_key, kind, title, members, source_urls.

    ``entities``: site, ord, kind, title, detail_url, confidence, source_url, catalogue (it has such
    attributes). They meet by detail page, else by title without the brand. Kinds are voted on, sure
    members (0.75 or more) counting twice; where none is sure and some look like a catalogue, product.
    """
    title = F.lower(one_space(F.regexp_replace(F.coalesce("title", F.lit("")), F.lit(f"(?i)\\s*[|–—-]\\s*{brand}\\s*$") if brand else F.lit("$^"), F.lit(""))))
    key = F.when(F.coalesce("detail_url", F.lit("")) != "", F.concat(F.lit("u:"), F.regexp_replace("detail_url", "/+$", ""))).otherwise(F.concat(F.lit("t:"), title))
    rows = entities.withColumn("entity_key", F.concat("site", F.lit("\u0001"), key))
    vote = weighted_vote(rows, "entity_key", "kind", "confidence").select("entity_key", F.col("kind").alias("voted"))
    stats = rows.groupBy("entity_key").agg(F.max("confidence").alias("sure"), F.bool_or("catalogue").alias("catalogue"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set("source_url")).alias("source_urls"))
    best = rows.join(vote, "entity_key").withColumn("match", (F.col("kind") == F.col("voted")).cast("int"))
    order = Window.partitionBy("entity_key").orderBy(F.desc("match"), F.desc("confidence"), "ord")
    best = best.withColumn("n", F.row_number().over(order)).where("n = 1").select("entity_key", "site", "title", "voted")
    kind = F.when((F.col("sure") < 0.75) & yes(F.col("catalogue")) & (F.col("members") > 1), "product").otherwise(F.col("voted"))
    return best.join(stats, "entity_key").select("entity_key", "site", kind.alias("kind"), "title", "members", "source_urls")


def unify_siblings(members: DataFrame) -> DataFrame:
    """Members (collection, entity, kind, text) with one kind per mixed project/product collection of three or more.

    Product if at least half of them read like one; else the majority, the smaller name on ties.
    """
    stats = members.groupBy("collection").agg(F.count_distinct("entity").alias("n"), F.collect_set("kind").alias("kinds"), F.count_if(F.rlike("text", F.lit(PRODUCT)) | F.rlike("text", F.lit(CATALOGUE))).alias("products"), F.count_if(F.col("kind") == "product").alias("p"), F.count_if(F.col("kind") == "project").alias("q"))
    mixed = stats.where((F.col("n") >= 3) & (F.array_sort("kinds") == F.array(F.lit("product"), F.lit("project"))))
    winner = F.when(F.col("products") * 2 >= F.col("n"), "product").when(F.col("q") > F.col("p"), "project").otherwise("product")
    return members.join(mixed.select("collection", winner.alias("winner")), "collection", "left").withColumn("kind", F.coalesce("winner", "kind")).drop("winner")


def distinct_products(products: DataFrame) -> DataFrame:
    """Adds ``of``: the ord of the row that stands for a product.

    Rows of one title are one product unless two different descriptions say otherwise; a row without one
    joins the first of its title. (site, ord, title, description)
    """
    rows = products.withColumns({"t": F.lower(one_space(F.col("title"))), "d": F.nullif(F.lower(one_space(F.coalesce("description", F.lit("")))), F.lit(""))})
    title = Window.partitionBy("site", "t").orderBy("ord")
    first_told = F.first("d", ignorenulls=True).over(title.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.first("ord").over(title)
    same = F.min("ord").over(Window.partitionBy("site", "t", "d"))
    starts_bare = F.first(F.col("d").isNull()).over(title)
    # A bare first row takes in everything of its title; else a bare row joins the first, others their equals.
    of = F.when(starts_bare | F.col("d").isNull() | (F.col("d") == first_told), first).otherwise(same)
    return rows.withColumn("of", of).drop("t", "d")


def title_ok(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return (F.length(t) >= 4) & ~F.rlike(t, F.lit(TITLE_MARKS)) & ~F.rlike(t, F.lit(PHONE_LIKE))


def dynamic_sections(sections: DataFrame) -> DataFrame:
    """The best section of each kind: kind, heading, items, source_pages.

    ``sections``: site, url, kind, heading, titles array<string>, ord. Equal ones (kind, heading, sorted
    titles) are one with several pages; of a kind the one with most usable titles stays, the first on ties, if
    it has two of them (reviews: one). Sections that lie together by site are not shuffled again.
    """
    titles = F.filter("titles", title_ok)
    key = F.unhex(F.sha2(F.concat_ws("|", "kind", F.lower(one_space(F.coalesce("heading", F.lit("")))), F.array_join(F.array_sort(F.transform("titles", lambda t: F.lower(one_space(t)))), "|")), 256))
    rows = sections.withColumns({"key": key, "items": titles})
    first = F.min_by(F.struct("heading", "items"), "ord").alias("first")
    one = rows.groupBy("site", "kind", "key").agg(F.min("ord").alias("ord"), first, F.array_sort(F.collect_set("url")).alias("source_pages"))
    best = one.groupBy("site", "kind").agg(F.min_by(F.struct("first.heading", "first.items", "source_pages"), F.struct(-F.size("first.items"), "ord")).alias("best")).select("site", "kind", "best.*")
    return best.where(F.size("items") >= F.when(F.col("kind") == "REVIEWS", 1).otherwise(2))


def resolve_routes(routes: DataFrame, entities: DataFrame, pages: DataFrame, hints: DataFrame) -> DataFrame:
    """path, kind, target: the first of home, an entity's detail, a page, a collection's name, not found.

    ``routes``: site, path. ``entities``: site, kind, slug, id. ``pages``: site, slug, id, is_homepage.
    ``hints``: slug, collection. Kinds of entities go in the order of DETAIL_KINDS, full paths before last segments.
    """
    path = F.regexp_replace(F.coalesce("path", F.lit("")), "^/+|/+$", "")
    rows = routes.select("site", F.col("path").alias("asked"), path.alias("full")).withColumn("last", F.substring_index("full", "/", -1)).distinct()
    keyed = rows.select("site", "asked", "full", F.explode(F.array(F.struct(F.lit(0).alias("tail"), F.col("full").alias("slug")), F.struct(F.lit(1).alias("tail"), F.col("last").alias("slug")))).alias("k")).select("site", "asked", "full", "k.*")
    rank = F.array_position(F.array(*map(F.lit, DETAIL_KINDS)), F.col("kind"))
    detail = keyed.join(entities, ["site", "slug"]).select("site", "asked", (F.lit(10) + rank).alias("precedence"), "tail", F.concat(F.upper("kind"), F.lit("_DETAIL")).alias("kind"), F.col("id").cast("string").alias("target"))
    page = keyed.join(pages, ["site", "slug"]).select("site", "asked", F.lit(50).alias("precedence"), "tail", F.when(yes(F.col("is_homepage")), "HOME").otherwise("PAGE").alias("kind"), F.col("id").cast("string").alias("target"))
    hinted = keyed.where("tail = 0").join(broadcast_if_small(hints), "slug").select("site", "asked", F.lit(60).alias("precedence"), "tail", F.lit("COLLECTION").alias("kind"), F.col("collection").alias("target"))  # a fixed list
    home = rows.where(F.col("full").isin("", "index", "home")).select("site", "asked", F.lit(0).alias("precedence"), F.lit(0).alias("tail"), F.lit("HOME").alias("kind"), F.lit(None).cast("string").alias("target"))
    every = detail.unionByName(page).unionByName(hinted).unionByName(home)
    best = every.groupBy("site", "asked").agg(F.min_by(F.struct("kind", "target"), F.struct("precedence", "tail", "target")).alias("hit"))
    return rows.select("site", "asked").join(best, ["site", "asked"], "left").select("site", F.col("asked").alias("path"), F.coalesce("hit.kind", F.lit("NOT_FOUND")).alias("kind"), "hit.target")


def pruned_menu(items: DataFrame) -> DataFrame:
    """Menu rows (id, parent_id, href, visible, sort_order) that a header shows.

    An item with no way to go survives only above one that has. Levels are settled from below, one
    written table a level, until none has a new parent.
    """
    rows = items.where(F.coalesce("visible", F.lit(True))).withColumn("routable", (F.coalesce("href", F.lit("")) != "") & (F.col("href") != "#"))
    with scratch(items.sparkSession) as made:
        links = materialise(rows.select("id", "parent_id", "routable"), "menu_links")
        alive = new = materialise(links.where("routable").select("id", "parent_id"), "alive")
        while new.limit(1).count():
            above = new.select(F.col("parent_id").alias("id")).where("id is not null").distinct().join(alive, "id", "left_anti")
            new = materialise(links.select("id", "parent_id").join(above, "id", "left_semi"), "alive")
            alive = alive.unionByName(new)
        alive = made.keep(materialise(alive.select("id"), "alive"))
    return rows.join(alive, "id", "left_semi").withColumn("href", F.when(F.col("routable"), F.col("href")).otherwise("")).drop("routable")


def paragraph_blocks(text: Column, most: int = BLOCK_CHARS) -> Column:
    """Paragraphs gathered into blocks of about ``most`` characters; one paragraph is never cut."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+"), lambda p: F.trim(p)), lambda p: p != "")
    none = F.array().cast("array<string>")
    return F.aggregate(
        paragraphs,
        F.struct(none.alias("done"), F.lit("").alias("held")),
        lambda acc, p: F.when((acc["held"] != "") & (F.length(acc["held"]) + 2 + F.length(p) > most), F.struct(F.concat(acc["done"], F.array(acc["held"])).alias("done"), p.alias("held"))).otherwise(
            F.struct(acc["done"].alias("done"), F.when(acc["held"] == "", p).otherwise(F.concat(acc["held"], F.lit("\n\n"), p)).alias("held"))
        ),
        lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))),
    )


def run_lengths(rows: DataFrame, key: str, flag: Column, least: int) -> DataFrame:
    """Runs of ``least`` or more consecutive rows (by ord) for which ``flag`` holds: key, first_at, length."""
    order = Window.partitionBy(key).orderBy("ord")
    marked = rows.select(key, "ord", yes(flag).alias("f")).withColumn("island", F.sum(F.when(~F.col("f"), 1).otherwise(0)).over(order)).where("f")
    return marked.groupBy(key, "island").agg(F.min("ord").alias("first_at"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("island")


def similar_sections(sections: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of one document's sections, of different scope, whose items overlap by ``least`` of the smaller.

    ``sections``: doc_id, section, scope, items array<string>. Of two alike sections the smaller one has a shared item
    among its rarest: all but ``least`` of its items, and one more. Only these are joined, so an item that every
    section has brings no pairs; what is left is compared in full.
    """
    rows = materialise(sections.select("doc_id", "section", "scope", F.array_distinct("items").alias("items")), "section_items").hint("merge")  # its files are far smaller than its rows, which must not be broadcast
    items = rows.select("doc_id", "section", "scope", F.size("items").alias("size"), F.explode("items").alias("item"))
    counts = items.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("doc_id", "section").orderBy("n", "item")
    rare = items.join(counts, ["doc_id", "item"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1)
    other = items.select("doc_id", "item", F.col("section").alias("other"), F.col("scope").alias("other_scope"), F.col("size").alias("other_size"))
    met = rare.join(other, ["doc_id", "item"]).where("section <> other and scope <> other_scope and (size < other_size or size = other_size and section < other)")
    pairs = met.select("doc_id", F.least("section", "other").alias("section"), F.greatest("section", "other").alias("other")).distinct()
    pairs = pairs.join(rows.drop("scope"), ["doc_id", "section"]).join(rows.select("doc_id", F.col("section").alias("other"), F.col("items").alias("theirs")), ["doc_id", "other"])
    overlap = F.size(F.array_intersect("items", "theirs")) / F.least(F.size("items"), F.size("theirs"))
    return pairs.withColumn("overlap", overlap).where(F.col("overlap") >= least).select("doc_id", "section", "other", "overlap")


def leaks(text: Column) -> Column:
    """Which leak patterns a rendered text holds."""
    return F.filter(F.array(*map(F.lit, LEAKS)), lambda p: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(p)))


def source_date(raw: Column) -> Column:
    """A date from ISO forms, then day.month.year with two or four digits of year; else null."""
    raw = F.trim(raw)
    parts = F.regexp_extract(raw, r"^([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})", 3)
    year = F.when(F.length(parts) == 2, F.concat(F.lit("20"), parts)).otherwise(parts)
    day, month = (F.lpad(F.regexp_extract(raw, r"^([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})", i), 2, "0") for i in (1, 2))
    return F.coalesce(F.try_to_timestamp(raw), F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")))


def best_phone(text: Column) -> Column:
    """The number most like a phone: with a plus, then most digits, then the shortest spelling."""
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\+[0-9][0-9\s()\-]{5,}|[0-9][0-9\s()\-]{6,})"), 1), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 7)
    keyed = F.array_sort(F.transform(found, lambda p, i: F.struct((~F.startswith(F.trim(p), F.lit("+"))).alias("bare"), (-F.length(F.regexp_replace(p, "[^0-9]", ""))).alias("digits"), F.length(F.trim(p)).alias("size"), i.alias("i"), F.trim(p).alias("p"))))
    return one_space(F.get(keyed, 0)["p"])


def page_of(rows: DataFrame, page: int, size: int = 6, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """One page of a site's list: the size is held inside 1..24, a page beyond the end is empty. Adds page_count."""
    size = min(24, max(1, size))
    nth = F.row_number().over(Window.partitionBy("site").orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy("site"))
    low = (max(1, page) - 1) * size
    return rows.withColumns({"nth": nth, "page_count": F.ceil(total / size)}).where(F.col("nth").between(low + 1, low + size)).drop("nth")


def picked(rows: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Rows by an explicit list (site, ids array) in its order, ``most`` per site; unknown ids are passed over."""
    wanted = ids.select("site", F.posexplode("ids").alias("pos", "id"))
    return rows.join(wanted, ["site", "id"]).withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("pos"))).where(F.col("n") <= most).drop("n")


def field_merge(old: Column, new: Column, owners: Column) -> Column:
    """Maps of fields: those that the editor owns keep their old value, the others take the new one."""
    kept = F.map_filter(old, lambda k, v: yes(F.element_at(owners, k) == "EDITOR"))
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(new, lambda k, v: ~F.map_contains_key(kept, k))), F.map_entries(F.map_filter(old, lambda k, v: F.map_contains_key(kept, k) | ~F.map_contains_key(new, k)))))
