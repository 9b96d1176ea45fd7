"""Duplicate organisations: groups, survivor choice, merge plan and its application.

Groups form by registered domain first; leads outside those form groups by phone, of members that
have some namesake among them. "Same organisation" is not transitive and is applied pairwise, within a
group only, to names that share something rare. A plan is written once, as its readers join it with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import urls
from leadmill.functions.compat import SPACE, bound, yes
from leadmill.storage import materialise

# Legal forms. The Cyrillic ones are stripped in "fixed" mode only, because an ASCII
# word boundary never matches beside a Cyrillic letter.
LATIN_FORMS = ("llc", "ltd", "inc", "gmbh")
CYRILLIC_FORMS = ("оао", "ооо", "зао", "чао", "уп", "чтуп", "чуп", "ип", "гуп", "рдуп")
REVIEW_RANK = {"GOOD": 3, "UNSURE": 2, "UNREVIEWED": 1, "BAD": 0}


def org_name(name: Column, mode: str = "strict") -> Column:
    """Lower-cased words of an organisation's name without legal forms and punctuation."""
    forms = "|".join(LATIN_FORMS if mode == "strict" else (*CYRILLIC_FORMS, *LATIN_FORMS))
    edge = ("(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])") if mode == "strict" else (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")
    out = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[«»\"'`]", " ")
    out = F.regexp_replace(out, f"{edge[0]}(?:{forms}){edge[1]}", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\s\x{00A0}]", " ")
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


def phone_digits(phone: Column) -> Column:
    """Digits only; a leading 80 becomes 375."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", ""), "^80", "375")


def same_org(a: Column, b: Column) -> Column:
    """Of two normalised names: equal, or the shorter one's words are all in the other; a single
    word must be contained as text."""
    ta, tb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    small, big = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb), F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)
    by_words = F.when(F.size(small) < 2, F.contains(a, b) | F.contains(b, a)).otherwise(F.size(F.array_except(small, big)) == 0)
    return (a != "") & (b != "") & ((a == b) | by_words)


def _alike(names: DataFrame, key: str) -> DataFrame:
    """(key, org): distinct names of a key that are the same organisation as another one of it.

    Candidates share something rare, so no group is joined with itself. Of two names with several words the
    smaller one's words are all in the other, so its rarest word is; a name of one word is contained as text, so its
    first three letters are.
    """
    names = materialise(names.where("org <> ''").select(key, "org", F.array_distinct(F.split("org", " ")).alias("words")), "names")  # read five times
    words = names.where(F.size("words") > 1).select(key, "org", "words", F.explode("words").alias("word"))
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(counts, [key, "word"]).groupBy(key, "org").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.first("words").alias("small"))
    by_word = rarest.join(words.select(key, "word", F.col("org").alias("other"), "words"), [key, "word"]).where((F.col("org") != F.col("other")) & (F.size(F.array_except("small", "words")) == 0)).select(key, "org", "other")
    single = names.where(F.size("words") == 1).select(key, "org", F.substring("org", 1, 3).alias("part"))
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("org") - n + 1)), lambda i: F.substr("org", i, n))))
    held = names.join(single.select(key).distinct(), key, "left_semi").select(key, F.col("org").alias("other"), F.explode(F.array_distinct(parts)).alias("part"))
    by_text = single.join(held, [key, "part"]).where((F.col("org") != F.col("other")) & F.contains("other", "org")).select(key, "org", "other")
    pairs = by_word.unionByName(by_text)
    return pairs.select(key, "org").unionByName(pairs.select(key, F.col("other").alias("org"))).distinct()


def with_namesake(members: DataFrame, key: str) -> DataFrame:
    """Adds ``has_namesake``: another member of the key is the same organisation. Equal names are settled by counting."""
    names = materialise(members.groupBy(key, "org").agg(F.count(F.lit(1)).alias("copies")), "name_counts")
    alike = _alike(names, key).withColumn("alike", F.lit(True))
    names = names.join(alike, [key, "org"], "left").select(key, "org", (yes(F.col("alike")) | ((F.col("copies") > 1) & (F.col("org") != ""))).alias("has_namesake"))
    return members.join(names, [key, "org"])


def duplicate_groups(leads: DataFrame, mode: str = "strict") -> DataFrame:
    """id, group_key, kind (DOMAIN or PHONE_NAME), matched_key, org for each lead in a group of two or more."""
    named = leads.select("id", org_name(F.col("company_name"), mode).alias("org"), bound(urls.host(F.col("website")), urls.registrable).alias("domain"), phone_digits(F.col("phone")).alias("digits"))
    rows = materialise(named, "normalised_leads")  # read by each kind of group
    counted = rows.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("domain")
    by_domain = rows.join(counted, "domain", "left_semi").select("id", F.col("domain").alias("group_key"), F.lit("DOMAIN").alias("kind"), F.col("domain").alias("matched_key"), "org")
    left = rows.join(counted, "domain", "left_anti").where(F.length("digits") >= 9)
    paired = with_namesake(left.select("id", "digits", "org"), "digits").where("has_namesake")
    by_phone = paired.select("id", F.concat(F.lit("phone:"), "digits").alias("group_key"), F.lit("PHONE_NAME").alias("kind"), F.col("digits").alias("matched_key"), "org")
    return by_domain.unionByName(by_phone)


def survivor_order() -> Column:
    """A struct that is smallest for the survivor: has a site, review rank, completeness, oldest, smallest id."""
    filled = lambda name: F.when(F.length(F.coalesce(F.col(name), F.lit(""))) > 0, 1).otherwise(0)
    complete = filled("phone") + filled("address") + filled("website") + F.when(F.size(F.coalesce("categories", F.array().cast("array<string>"))) > 0, 1).otherwise(0)
    rank = F.lit(1)
    for status, value in REVIEW_RANK.items():
        rank = F.when(F.col("manual_review_status") == status, value).otherwise(rank)
    return F.struct((~yes(F.col("has_site"))).alias("no_site"), (-rank).alias("rank"), (-complete).alias("complete"), "created_at", "id")


def merge_plan(leads: DataFrame, mode: str = "strict") -> DataFrame:
    """One row per group: group_key, kind, members, survivor_id, merge_ids, blocked, block_reason.

    Checked in this order: several members with a site, several with active runs, members with no namesake.
    """
    groups = duplicate_groups(leads, mode)
    members = materialise(groups.select("id", "group_key", "kind", "org").join(leads, "id"), "group_members")
    members = with_namesake(members, "group_key")
    plan = members.groupBy("group_key", "kind").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(yes(F.col("has_site"))).alias("sites"),
        F.count_if(yes(F.col("has_active_runs"))).alias("runs"),
        F.count_distinct("org").alias("orgs"),
        F.bool_and("has_namesake").alias("all_named"),
        F.min_by("id", survivor_order()).alias("first"),
        F.array_sort(F.collect_list("id")).alias("ids"),
    )
    reason = F.when(F.col("sites") > 1, "CONFLICTING_GENERATED_SITES").when(F.col("runs") > 1, "MULTIPLE_ACTIVE_FACTORY_RUNS").when((F.col("orgs") > 1) & ~F.col("all_named"), "DIFFERENT_ORGANISATIONS_SAME_DOMAIN")
    plan = plan.withColumn("block_reason", reason).withColumn("survivor_id", F.when(yes(F.col("block_reason") == "DIFFERENT_ORGANISATIONS_SAME_DOMAIN"), None).otherwise(F.col("first")))
    merge = F.when(F.col("survivor_id").isNull(), F.col("ids")).otherwise(F.array_remove("ids", F.col("first")))
    return materialise(plan.select("group_key", "kind", "members", "survivor_id", merge.alias("merge_ids"), F.col("block_reason").isNotNull().alias("blocked"), "block_reason"), "merge_plan")


def apply_merge(leads: DataFrame, plan: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leads after the merge, and their queries repointed to survivors.

    A merged lead is marked MERGED with its survivor, one of a blocked group BLOCKED. A survivor
    fills an empty phone and address from its merged leads in order of id, and unites categories.
    Queries (id, query) that a survivor has already are dropped.
    """
    gone = plan.select("survivor_id", "blocked", F.explode("merge_ids").alias("id"))
    merged = gone.where("not blocked").select("id", "survivor_id")
    filled = lambda name: F.nullif(F.coalesce(F.col(name), F.lit("")), F.lit(""))
    given = leads.join(merged, "id").groupBy("survivor_id").agg(
        F.min_by("phone", F.when(filled("phone").isNotNull(), F.col("id"))).alias("new_phone"),
        F.min_by("address", F.when(filled("address").isNotNull(), F.col("id"))).alias("new_address"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("new_categories"),
    )
    out = leads.join(gone.select("id", F.col("survivor_id").alias("merged_into"), "blocked"), "id", "left").join(given.withColumnRenamed("survivor_id", "id"), "id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({
        "phone": F.coalesce(filled("phone"), F.col("new_phone")),
        "address": F.coalesce(filled("address"), F.col("new_address")),
        "categories": F.array_union(F.coalesce("categories", none), F.coalesce("new_categories", none)),
        "merge_status": F.when(F.col("blocked"), "BLOCKED").when(~F.col("blocked"), "MERGED").otherwise(F.col("merge_status")),
        "merged_into": F.when(~F.col("blocked"), F.col("merged_into")),
    }).select(*leads.columns, "merged_into")
    pointed = queries.join(merged, "id", "left").select(F.coalesce("survivor_id", "id").alias("id"), "query").distinct()
    return out, pointed
