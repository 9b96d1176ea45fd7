"""Text expressions: sentences, repeated content, technical payloads, extracted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions.compat import bound, one_space, yes

LEAST_SENTENCE = 8
# How a warranty's length is claimed.
WARRANTY = (r"(?iu)гаранти[0-9A-Za-z_]*[^.\n]{0,40}?([0-9]+)\s*(лет|года|год|months?|месяц[0-9A-Za-z_]*)", r"(?iu)гаранти[0-9A-Za-z_]*\s+до\s+([0-9]+)\s*(лет|года|год)")


def sentences(text: Column) -> Column:
    """Sentences of at least 8 characters, white space single. Lines end sentences as well as . ! ? and … do."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n+", "\u0001"), r"([.!?…])[ \t\r\f\x{00A0}]+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), one_space), lambda s: F.length(s) >= LEAST_SENTENCE)


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, sentence: one row per sentence."""
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("ord", "sentence"))


def _repeats(items: Column) -> Column:
    """struct(item, ord) of the items that stand several times in an array without nulls: neighbours once sorted."""
    sort = F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("ord"))))

    def alike(s: Column) -> Column:
        after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: yes(a["item"] == b["item"]))
        return F.array_compact(F.zip_with(s, F.zip_with(after, F.concat(F.array(F.lit(False)), after), lambda a, b: yes(a) | yes(b)), lambda x, same: F.when(yes(same), x)))

    return F.when(F.size(F.array_distinct(items)) < F.size(items), bound(sort, alike))


def repeated_sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sentences that a text says again: 20 characters or longer twice, any three times. Case is ignored.

    Repeats are found inside the row; only these are counted by key."""
    found = docs.select(key, F.inline(bound(F.transform(sentences(F.col("text")), F.lower), _repeats)))
    found = found.groupBy(key, F.col("item").alias("sentence")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("ord").alias("first_at"))
    return found.where("length(sentence) >= 20 or occurrences >= 3")


def _joined(items: Column, n: int) -> Column:
    """Every n neighbouring items joined by a space."""
    later = [F.slice(items, k + 1, F.greatest(F.size(items) - (n - 1), F.lit(0))) for k in range(n)]
    out = later[0]
    for other in later[1:]:
        out = F.zip_with(out, other, lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def repeated_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of three sentences, or else of two, that a text repeats: key, run_length, occurrences, first_at, run.

    Of a text's repeated runs of the greater length, the one that begins first is reported. All is found
    inside the row: there is no shuffle.
    """

    def first(found: Column, length: int) -> Column:
        """The repeated run that begins first, null if there is none."""
        def told(run: Column) -> Column:
            return F.struct(F.lit(length).alias("run_length"), F.size(F.filter(found, lambda r: r["item"] == run["item"])).cast("long").alias("occurrences"), run["ord"].alias("first_at"), run["item"].alias("run"))

        return F.when(F.size(found) > 0, bound(F.array_min(F.transform(found, lambda r: F.struct(r["ord"].alias("ord"), r["item"].alias("item")))), told))

    def longest(s: Column) -> Column:
        two = bound(_joined(s, 2), _repeats)
        # A repeated run of three begins with a repeated run of two.
        return bound(two, lambda t: F.when(F.size(t) > 0, F.coalesce(bound(bound(_joined(s, 3), _repeats), lambda three: first(three, 3)), first(t, 2))))

    rows = docs.select(key, F.explode(F.array_compact(F.array(bound(F.transform(sentences(F.col("text")), F.lower), longest)))).alias("r"))
    return rows.select(key, "r.*")


def adjacent_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines equal to the line before them, case and white space aside; empty lines do not count. No shuffle."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("ord"), F.lower(one_space(x)).alias("line")))
    rows = docs.select(key, F.filter(lines, lambda x: x["line"] != "").alias("l"))
    same = F.zip_with("l", F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: F.when(a["line"] == b["line"], b))
    return rows.select(key, F.explode(F.array_compact(same)).alias("r")).select(key, "r.ord", "r.line")


# Vocabularies of machine text.
CONFIG_KEYS = r"(?i)(^|[^A-Za-z0-9_])(li_type|li_ph|li_mask|li_nm|li_req|li_parent_id|lid|formservices|dataLayer|gtag|ym\s*\(|_tmr|fbq\s*\(|tildaspec|recid|tn-atom__inputs|data-field-type|data-input-lid)($|[^A-Za-z0-9_])"
PLACEHOLDER_CONTACTS = r"(?i)(mail@example\.(com|ru|net)|\+375\s*\(99\)\s*999-99-99|\+7\s*\(9[0-9][0-9]\)\s*9[0-9][0-9]-[0-9][0-9]-[0-9][0-9]|example\.(com|org|net)/)"
CODE_FRAGMENT = r"([.#][A-Za-z0-9_-]+\s*\{[^}]*:)|((^|[^A-Za-z0-9_])function\s*\()|((^|[^A-Za-z0-9_])var\s+[A-Za-z0-9_]+\s*=)|(\.push\s*\(\s*\{)|(\}\)\s*;\s*$)"


def technical_payload(text: Column) -> Column:
    """struct(technical, rule, confidence): the first of five rules that takes the text for machine content."""
    t = F.trim(F.coalesce(text, F.lit("")))
    pairs = F.regexp_count(t, F.lit(r'"[A-Za-z0-9_.-]+"\s*:')) + F.regexp_count(t, F.lit(r"&quot;[A-Za-z0-9_.-]+&quot;\s*:"))
    json = (F.length(t) >= 8) & F.rlike(t, F.lit(r"(?s)^[\[{].*[\]}]$")) & F.try_parse_json(t).isNotNull()
    rules = (
        ("json-payload", 0.97, json),
        ("config-kv-density", 0.9, F.rlike(t, F.lit(r"^[\[{<]")) & (pairs >= 3)),
        ("config-key-vocabulary", 0.9, F.rlike(t, F.lit(CONFIG_KEYS))),
        ("placeholder-contact", 0.75, F.rlike(t, F.lit("[@(/]")) & F.rlike(t, F.lit(PLACEHOLDER_CONTACTS))),  # none is without one of these
        ("code-fragment", 0.8, F.rlike(t, F.lit(r"[{};]")) & (F.regexp_count(t, F.lit(r"[{}();]")) >= 4) & F.rlike(t, F.lit(CODE_FRAGMENT))),  # the cheap tests first
    )
    rule, confidence = None, None
    for name, value, test in rules:
        rule = F.when(yes(test), name) if rule is None else rule.when(yes(test), name)
        confidence = F.when(yes(test), value) if confidence is None else confidence.when(yes(test), value)
    rule, confidence = F.when(F.length(t) >= 6, rule), F.when(F.length(t) >= 6, confidence)
    return F.struct(rule.isNotNull().alias("technical"), rule.alias("rule"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))


def slug(text: Column) -> Column:
    """Lower-cased letters and digits joined by single hyphens, 80 characters at most; a hash where nothing is left."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(words, 1, 80), "-+$", ""), F.lit("")), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 8))


def first_sentences(text: Column, n: int, most: int) -> Column:
    """The first n sentences, joined, cut to ``most`` characters."""
    return F.substring(F.array_join(F.slice(sentences(text), 1, n), " "), 1, most)


def duration_conflicts(docs: DataFrame) -> DataFrame:
    """duration, claims, documents, first_doc: what whole texts (doc_id, text) say of warranties, where the corpus holds
    more than one duration; no rows where all agree. Counted by duration; one number a claim is all that is shuffled."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1)) for pattern in WARRANTY))
    claims = docs.select("doc_id", F.explode(found).alias("n"))
    groups = claims.groupBy(F.col("n").try_cast("long").alias("duration")).agg(F.count(F.lit(1)).alias("claims"), F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))
    several = groups.agg((F.count(F.lit(1)) > 1).alias("several"))  # one row
    return groups.crossJoin(F.broadcast(several)).where("several").drop("several")
