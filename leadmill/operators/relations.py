"""Nested reads over related tables: one row each, many to many, names by lookup, roles, edges, lists put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadmill.functions.compat import yes
from leadmill.storage import broadcast_if_small, materialise, scratch


def with_one(rows: DataFrame, key: str, **tables: DataFrame) -> DataFrame:
    """Rows with the one row that each table has for them, as a struct of its name; null where it has none."""
    out = rows
    for name, table in tables.items():
        held = [c for c in table.columns if c != key]
        out = out.join(table.select(key, F.struct(*held).alias(name)), key, "left")
    return out


def with_many(rows: DataFrame, links: DataFrame, targets: DataFrame, key: str, target: str, order: str, name: str) -> DataFrame:
    """Rows with an array of what a link table ties to them, in the order of the link's ``order``.

    ``links``: key, target, order. Targets that are gone are left out; a row without any has an empty array.
    """
    held = [c for c in targets.columns if c != target]
    tied = links.join(targets, target).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, target, *held))).alias("_all"))
    tied = tied.select(key, F.transform("_all", lambda x: F.struct(x[target].alias(target), *(x[c].alias(c) for c in held))).alias(name))
    return rows.join(tied, key, "left").withColumn(name, F.coalesce(name, F.array().cast(tied.schema[name].dataType)))


def with_names(events: DataFrame, **lookups: DataFrame) -> DataFrame:
    """Events with a name for each optional id: ``lead=frame`` looks up lead_id in (id, name) and adds lead_name."""
    out = events
    for kind, table in lookups.items():
        named = table.select(F.col("id").alias(f"{kind}_id"), F.col("name").alias(f"{kind}_name"))
        out = out.join(named, f"{kind}_id", "left")
    return out


def providers_with_counts(config: DataFrame, registry: DataFrame, recent: DataFrame) -> DataFrame:
    """Configured providers (provider, enabled) beside what the registry knows (provider, title) and their recent runs."""
    out = config.join(registry, "provider", "left").join(recent, "provider", "left")
    return out.withColumns({"known": F.col("title").isNotNull(), "runs": F.coalesce("runs", F.lit(0))})


def allowed(users: DataFrame, assignments: DataFrame, grants: DataFrame, permission: str) -> DataFrame:
    """user_id, scope, site: where a user may do something; one row of scope GLOBAL (no site) stands for all sites. A
    super administrator may anywhere, others through a role's grant, anywhere if it is global, else on the site it is given on.

    ``users``: user_id, global_role. ``assignments``: user_id, role, site (null: none). ``grants``: role, permission, scope.
    """
    roles = grants.where(F.col("permission") == permission).select("role", "scope").distinct()
    own = assignments.join(broadcast_if_small(roles), "role")
    everywhere = users.where("global_role = 'SUPER_ADMIN'").select("user_id").unionByName(own.where("scope = 'GLOBAL'").select("user_id")).distinct()
    one = own.where("scope = 'SITE' and site is not null").select("user_id", "site").distinct().join(everywhere, "user_id", "left_anti")
    return everywhere.select("user_id", F.lit("GLOBAL").alias("scope"), F.lit(None).cast("long").alias("site")).unionByName(one.select("user_id", F.lit("SITE").alias("scope"), F.col("site").cast("long").alias("site")))


def may(requests: DataFrame, held: DataFrame) -> DataFrame:
    """Adds ``allowed`` to requests (user_id, site): the user holds the permission everywhere, or on that site."""
    anywhere = held.where("scope = 'GLOBAL'").select("user_id", F.lit(True).alias("anywhere"))
    there = held.where("scope = 'SITE'").select("user_id", "site", F.lit(True).alias("there"))
    out = requests.join(anywhere, "user_id", "left").join(there, ["user_id", "site"], "left")
    return out.withColumn("allowed", yes(F.col("anywhere")) | yes(F.col("there"))).drop("anywhere", "there")


def shown_sites(sites: DataFrame, settings: str = "settings") -> DataFrame:
    """Sites whose settings (JSON) do not mark them as a fixture: a missing key, a JSON null and no JSON at all are shown."""
    return sites.where(~F.coalesce(F.get_json_object(settings, "$.fixture") == "true", F.lit(False)))


def key_states(rows: DataFrame, column: str, key: str) -> DataFrame:
    """Adds ``state`` of a JSON key: missing, null, empty or present, and ``any_present`` over all rows."""
    value = F.get_json_object(column, f"$.{key}")
    has = F.array_contains(F.json_object_keys(column), F.lit(key))
    state = F.when(~F.coalesce(has, F.lit(False)), "missing").when(value.isNull(), "null").when(value.isin("", "[]", "{}"), "empty").otherwise("present")
    stated = rows.withColumn("state", state)
    any_present = stated.agg(F.coalesce(F.bool_or(F.col("state") == "present"), F.lit(False)).alias("any_present"))
    return stated.crossJoin(F.broadcast(any_present))  # one row


def published(rows: DataFrame, as_of: Column) -> DataFrame:
    """Rows that visitors see: published, and not before their date."""
    return rows.where(yes(F.col("status") == "PUBLISHED") & F.coalesce(F.col("published_at") <= as_of, F.lit(True)))


def finale_last(sections: DataFrame) -> DataFrame:
    """Sections (page, ord, kind, enabled) in order, numbered anew: an enabled call to action moves behind the others."""
    order = Window.partitionBy("page").orderBy((yes(F.col("kind") == "CTA") & yes(F.col("enabled"))).cast("int"), "ord")
    return sections.withColumn("place", F.row_number().over(order))


def entity_list(**kinds: DataFrame) -> DataFrame:
    """Rows of several tables in one list, with ``kind``; columns that a table lacks are null."""
    out = None
    for kind, table in kinds.items():
        part = table.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merged_links(header: DataFrame, footer: DataFrame) -> DataFrame:
    """Links (site, url, ord) of the header, then those of the footer that the header lacks."""
    rest = footer.join(header.select("site", "url").distinct(), ["site", "url"], "left_anti")
    return header.withColumn("place", F.lit("header")).unionByName(rest.withColumn("place", F.lit("footer")))


def relation_edges(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges (from_doc, to_doc, type) from a collection's items (doc, subtype, urls) to documents of the same path."""
    path = lambda url: F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://[^/?#]*", ""), r"/*([?#].*)?$", "")
    links = items.select("doc", "subtype", F.explode("urls").alias("url")).select("doc", "subtype", path(F.col("url")).alias("path"))
    targets = documents.select(F.col("doc").alias("to_doc"), path(F.col("url")).alias("path"))
    return links.join(targets, "path").where(F.col("doc") != F.col("to_doc")).select(F.col("doc").alias("from_doc"), "to_doc", F.concat(F.lit("HAS_"), F.upper("subtype")).alias("type")).distinct()


def grouped_sections(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """Similar sections of one document fall together, however long the chain: the best of each group stays.

    ``pairs``: doc_id, section, other. ``sections``: doc_id, section, scope_rank, px, ord. Group names spread along the
    pairs until none changes, one written table a round. Best: the smallest rank, most pixels, first.
    """
    with scratch(pairs.sparkSession) as made:
        # Files of numbers are far smaller than their rows, which must not be broadcast.
        ways = F.inline(F.array(F.struct(F.col("section"), F.col("other")), F.struct(F.col("other").alias("section"), F.col("section").alias("other"))))
        both = materialise(pairs.select("doc_id", ways).distinct(), "section_pairs").hint("merge")
        named = materialise(sections.select("doc_id", "section", F.col("section").alias("name")), "section_names").hint("merge")
        while True:
            heard = both.join(named.select("doc_id", F.col("section").alias("other"), F.col("name").alias("heard")), ["doc_id", "other"]).groupBy("doc_id", "section").agg(F.min("heard").alias("heard"))
            # The name's own name is followed too, which halves the rounds of long chains.
            after = named.join(heard, ["doc_id", "section"], "left").select("doc_id", "section", F.col("name").alias("before"), F.least("name", F.coalesce("heard", "name")).alias("name"))
            further = after.hint("merge").select("doc_id", F.col("section").alias("name"), F.col("name").alias("further"))
            after = materialise(after.join(further, ["doc_id", "name"], "left").select("doc_id", "section", "before", F.least("name", F.coalesce("further", "name")).alias("name")), "section_names")
            named = after.select("doc_id", "section", "name").hint("merge")
            if not after.where("name <> before").limit(1).count():
                break
        made.keep(after)
    rows = sections.join(named, ["doc_id", "section"])
    best = rows.groupBy("doc_id", "name").agg(F.min_by("section", F.struct("scope_rank", -F.col("px"), "ord")).alias("kept"), F.count(F.lit(1)).alias("copies"))
    return best.select("doc_id", F.col("name").alias("group_name"), "kept", "copies")
