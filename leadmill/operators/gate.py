"""The discovery gate: row-local stages, then duplicates inside the ordered run.

Relevance and eligibility look at one candidate. The duplicate stage depends on order: a candidate
is a duplicate of a lead *accepted* before it, by domain, or by name and phone (by address where it has no
phone) under another domain; one that was rejected makes nobody a duplicate. It is solved
in rounds over keys, not pairs: a candidate is decided when no undecided earlier one holds a key
that it looks up, and whoever meets an accepted domain falls at once. A group of any size costs
one aggregation a round, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import urls
from leadmill.functions.compat import SPACE
from leadmill.storage import materialise, scratch

# What each kind of search wants and does not want.
PROFILES = {
    "construction": {
        "positive": ["строитель", "строи", "подряд", "генподряд", "ремонт", "мост", "дорог", "фасад"],
        "negative": ["клуб", "спорт", "хокке", "футбол", "баскетбол", "теннис", "плаван", "ресторан", "кафе", "бар", "школ", "универ", "государствен", "администрац", "портал", "справочник", "каталог", "афиша", "новост", "газет"],
    },
    "sports": {
        "positive": ["клуб", "спорт", "хокке", "футбол", "баскетбол", "теннис", "плаван"],
        "negative": ["строитель", "подряд", "генподряд", "ремонт", "ресторан", "кафе", "бар"],
    },
    "default": {"positive": [], "negative": ["портал", "справочник", "каталог", "афиша", "новост"]},
}
_KIND_WORDS = (("sports", ("спорт", "клуб")), ("construction", ("подряд", "строит", "сварка", "сантех")))


def plain(text: Column) -> Column:
    """Lower-cased letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), SPACE + "+", " "))


def business_kind(intent: str | None, query: str) -> str:
    asked = " ".join(x for x in (intent, query) if x).lower()
    return next((kind for kind, words in _KIND_WORDS if any(w in asked for w in words)), "default")


def relevance(name: Column, categories: Column, intent: str | None, query: str, profiles: dict = PROFILES) -> Column:
    """struct(decision, reason, concepts, confidence). Any unwanted concept rejects, else any wanted one accepts."""
    profile = profiles.get(business_kind(intent, query), profiles["default"])
    text = plain(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " ")))
    none = F.array().cast("array<string>")
    held = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else none
    against, for_ = held(profile["negative"]), held(profile["positive"])
    verdict = lambda decision, reason, concepts, confidence: F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), concepts.alias("concepts"), F.lit(confidence).alias("confidence"))
    return F.when(F.size(against) > 0, verdict("REJECT", "IRRELEVANT_BUSINESS_CATEGORY", against, 0.9)).when(F.size(for_) > 0, verdict("ACCEPT", "RELEVANT_TO_QUERY", for_, 0.8)).otherwise(verdict("UNCERTAIN", "UNCERTAIN_RELEVANCE", none, 0.5))


def _keys(frame: DataFrame, ids: list[str]) -> DataFrame:
    """The keys under which a lead is found, one row each."""
    name = F.lower(F.col("company_name"))
    keys = F.array_compact(F.array(
        F.concat(F.lit("d:"), "domain"),
        F.when(F.coalesce(F.col("phone"), F.lit("")) != "", F.concat(F.lit("p:"), name, F.lit("\u0001"), "phone")),
        F.when(F.coalesce(F.col("address"), F.lit("")) != "", F.concat(F.lit("a:"), name, F.lit("\u0001"), F.lower("address"))),
    ))
    return frame.select(*ids, "domain", F.explode(keys).alias("key"))


def _lookup() -> Column:
    name = F.lower(F.col("company_name"))
    by_phone = F.when(F.coalesce(F.col("phone"), F.lit("")) != "", F.concat(F.lit("p:"), name, F.lit("\u0001"), "phone"))
    return F.coalesce(by_phone, F.when(F.coalesce(F.col("address"), F.lit("")) != "", F.concat(F.lit("a:"), name, F.lit("\u0001"), F.lower("address"))))


def deduplicate_in_order(candidates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``candidates``: ord, domain, company_name, phone, address. Adds decision, reason, of.

    ``of`` is the ord of the accepted candidate that it duplicates, or -1 for an existing lead.
    ``existing``: domain, company_name, phone, address of active leads. Domains must not be null; ord is unique.
    """
    columns = ["ord", "domain", "company_name", "phone", "address"]
    with scratch(candidates.sparkSession) as made:
        open_ = materialise(candidates.select(*columns), "candidates")
        old = (existing if existing is not None else candidates.limit(0)).select(*columns[1:]).withColumn("ord", F.lit(-1).cast("long"))
        held = materialise(_keys(old, ["ord"]), "registry")
        done = None
        while open_.limit(1).count():
            waiting = _keys(open_, ["ord"]).groupBy("key").agg(F.min("ord").alias("first"))
            by_key = held.groupBy("key").agg(F.min("ord").alias("of"))
            own = open_.withColumns({"d_key": F.concat(F.lit("d:"), "domain"), "n_key": _lookup()})
            own = own.join(by_key.select(F.col("key").alias("d_key"), F.col("of").alias("of_domain")), "d_key", "left")
            others = held.where("not startswith(key, 'd:')").groupBy("key").agg(F.min(F.struct("ord", "domain")).alias("one"), F.min("domain").alias("low"), F.max("domain").alias("high"))
            own = own.join(others.select(F.col("key").alias("n_key"), "one", "low", "high"), "n_key", "left")
            own = own.join(waiting.select(F.col("key").alias("d_key"), F.col("first").alias("d_first")), "d_key", "left").join(waiting.select(F.col("key").alias("n_key"), F.col("first").alias("n_first")), "n_key", "left")
            namesake = F.coalesce((F.col("low") != F.col("domain")) | (F.col("high") != F.col("domain")), F.lit(False))
            settled = (F.col("d_first") >= F.col("ord")) & F.coalesce(F.col("n_first") >= F.col("ord"), F.lit(True))
            fate = F.when(F.col("of_domain").isNotNull(), "DUPLICATE_CANONICAL_DOMAIN").when((F.col("d_first") >= F.col("ord")) & namesake, "DUPLICATE_ORGANISATION").when(settled, "ACCEPTED")
            own = materialise(own.select(*columns, fate.alias("fate"), F.when(fate == "DUPLICATE_CANONICAL_DOMAIN", F.col("of_domain")).when(fate == "DUPLICATE_ORGANISATION", F.col("one.ord")).alias("of")), "round")
            fresh = own.where("fate is not null")
            done = fresh if done is None else done.unionByName(fresh)
            held = materialise(held.unionByName(_keys(fresh.where("fate = 'ACCEPTED'"), ["ord"])), "registry")
            open_ = own.where("fate is null").select(*columns)
        if done is None:
            done = open_.select(*columns, F.lit(None).cast("string").alias("fate"), F.lit(None).cast("long").alias("of"))
        done = made.keep(materialise(done.select("ord", "fate", "of"), "decided"))
    out = candidates.join(done, "ord")
    return out.select(candidates["*"], F.when(F.col("fate") == "ACCEPTED", "ACCEPT").otherwise("REJECT").alias("decision"), F.when(F.col("fate") != "ACCEPTED", F.col("fate")).alias("reason"), "of")


def run_gate(candidates: DataFrame, query: str, intent: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Each candidate (ord, company_name, website, phone, address, categories) with decision, reason, domain, of."""
    rows = candidates.select("ord", "company_name", "website", "phone", "address", "categories")
    judged = rows.join(urls.eligibility(rows, "ord", "website").drop("canonical_url"), "ord").withColumn("seen", relevance(F.col("company_name"), F.col("categories"), intent, query)).withColumn("domain", urls.registrable(F.col("canonical_domain")))
    early = F.when(~F.col("eligible"), F.col("reason")).when(F.col("seen.decision") != "ACCEPT", F.col("seen.reason"))
    judged = judged.select("ord", "company_name", "phone", "address", "domain", early.alias("early"), F.when(early.isNotNull(), F.when(F.col("eligible") & (F.col("seen.decision") == "UNCERTAIN"), "UNCERTAIN").otherwise("REJECT")).alias("early_decision"))
    rest = deduplicate_in_order(judged.where("early is null").select("ord", "domain", "company_name", "phone", "address"), existing)
    none = F.lit(None).cast("long")
    return rest.select("ord", "domain", "decision", "reason", "of").unionByName(judged.where("early is not null").select("ord", "domain", F.col("early_decision").alias("decision"), F.col("early").alias("reason"), none.alias("of")))


def run_counters(decided: DataFrame) -> DataFrame:
    """collected, created, duplicates, rejected, uncertain; a duplicate that points at a lead is not rejected."""
    points = F.col("of").isNotNull()
    return decided.agg(F.count(F.lit(1)).alias("collected"), F.count_if(F.col("decision") == "ACCEPT").alias("created"), F.count_if(points).alias("duplicates"), F.count_if((F.col("decision") == "REJECT") & ~points).alias("rejected"), F.count_if(F.col("decision") == "UNCERTAIN").alias("uncertain"))


def reason_histogram(decided: DataFrame) -> DataFrame:
    """reason_bucket, n: reasons folded into buckets; accepted rows count as ACCEPTED."""
    folded = F.when(F.col("decision") == "ACCEPT", "ACCEPTED").when(F.col("reason").isin("DIRECTORY", "AGGREGATOR"), "DIRECTORY").when(F.startswith("reason", F.lit("DUPLICATE")), "DUPLICATE").otherwise(F.col("reason"))
    return decided.groupBy(folded.alias("reason_bucket")).agg(F.count(F.lit(1)).alias("n"))
