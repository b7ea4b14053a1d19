"""Gates: rules over registries, taxonomies and records that give a table of problems, one row each (label, problem). No row means clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import sized

# Policy lists.
REQUIRED = ["source_id", "language", "role", "license", "provenance", "status"]
STATUSES = ["approved", "conditional_review", "pending_provenance", "rejected"]
LICENSES = ["Apache-2.0", "MIT", "CC0", "Public Domain", "ODC-By-1.0", "CC-BY-4.0"]
CONDITIONAL = ["CC-BY-SA-4.0"]
FORBIDDEN = ["NC", "ND", "RESEARCH", "NON-COMMERCIAL", "UNKNOWN"]
UNVERIFIED = ["UNVERIFIED", "", "UNKNOWN"]
REQUIRED_OF_RECORDS = ["record_id", "domain", "subdomain", "language", "source_id", "license", "provenance", "text_sha256", "text_chars", "pilot", "intended_use"]
INTENDED_USE = "pipeline_validation_only"


#: What the gates say, with places for what they found.
MESSAGES = {
    "missing": "missing required field '{}'",
    "source again": "duplicate source_id",
    "status": "invalid status '{}'",
    "conditional": "approved with conditional license '{}'",
    "forbidden": "approved with forbidden license '{}'",
    "unapproved": "approved with unapproved license '{}'",
    "unverified": "approved with unverified provenance '{}'",
    "never": "forbidden license '{}' must not be approved",
    "no domains": "'domains' must be a non-empty list",
    "no domain id": "domain without id",
    "domain again": "duplicate domain id",
    "weight": "weight must be a positive number",
    "no subdomains": "subdomains must be a non-empty list",
    "no subdomain id": "subdomain without id",
    "subdomain again": "duplicate subdomain id",
    "no languages": "languages must be a non-empty list",
    "undeclared": "language '{}' not declared in taxonomy languages",
    "weights": "domain weights sum to {}, expected ~1.0",
    "pilot": "records without 'pilot': true are refused",
    "use": "intended_use must be '{}'",
    "record again": "duplicate record_id",
    "no digest": "text_sha256 is not a 64-char lowercase hex digest",
    "digest again": "duplicate text_sha256 (exact dedup violation)",
    "place": "unknown domain/subdomain '{}/{}'",
    "language": "language '{}' not allowed for '{}/{}'",
    "source": "source_id '{}' not found in source registry",
    "license": "license '{}' does not match registry license '{}' for source '{}'",
    "provenance": "unverified provenance '{}'",
    "text": "text does not hash to text_sha256",
    "positive": "text_chars must be a positive integer",
    "length": "text_chars ({}) != len(text) ({})",
}


def license_allowed(license: Column) -> Column:
    return F.coalesce(X.strip(license).isin(LICENSES), F.lit(False))


def license_forbidden(license: Column) -> Column:
    return F.coalesce(X.any_of(F.translate(F.upper(license), "_", "-"), FORBIDDEN), F.lit(False))


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def say(key: str, *found: Column | str) -> Column:
    """The gate's message with what was found in its places; null shows as nothing."""
    texts = MESSAGES[key].split("{}")
    return joined(*[x for pair in zip(texts, found) for x in pair], texts[-1])


def problems(rows: DataFrame, label: Column, rules: list[tuple[Column, Column]]) -> DataFrame:
    """A row for each rule (condition, what to say) that a row breaks."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), what) for c, what in rules]), lambda x: x.isNotNull())
    return rows.select(label.alias("label"), F.explode(found).alias("problem"))


def missing(rows: DataFrame, keys: list[str]) -> list[tuple[Column, Column]]:
    """A key that a table lacks is missing in every row."""
    gone = lambda k: (F.col(k).isNull() | (F.col(k).cast("string") == "")) if k in rows.columns else F.lit(True)
    return [(gone(k), say("missing", k)) for k in keys]


def not_first(key: str, order: list[str]) -> Column:
    """Whether a row isn't the first of its key. Null keys aren't compared."""
    return F.col(key).isNotNull() & (F.col(key).cast("string") != "") & (F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def label_of(key: str, number: str) -> Column:
    return F.coalesce(F.nullif(F.col(key), F.lit("")), joined("record#", F.col(number)))


def registry_gate(registry: DataFrame, number: str = "line_no") -> DataFrame:
    """Problems of source records: missing fields, repeated ids, unknown status, and approval that license or provenance don't bear out."""
    rows = registry.withColumn("__again", not_first("source_id", [number]))
    license, provenance = F.coalesce("license", F.lit("")), X.strip(F.coalesce("provenance", F.lit("")))
    approved, free, conditional, forbidden = F.col("status") == "approved", license_allowed(license), X.strip(license).isin(CONDITIONAL), license_forbidden(license)
    rules = [
        *missing(registry, REQUIRED),
        (F.col("__again"), say("source again")),
        (F.col("status").isNotNull() & ~F.col("status").isin(STATUSES), say("status", F.col("status"))),
        (approved & ~free & conditional, say("conditional", license)),
        (approved & ~free & ~conditional & forbidden, say("forbidden", license)),
        (approved & ~free & ~conditional & ~forbidden, say("unapproved", license)),
        (approved & F.upper(provenance).isin(UNVERIFIED), say("unverified", provenance)),
        (approved & forbidden, say("never", license)),
    ]
    return problems(rows, label_of("source_id", number), rules)


def registry_split(registry: DataFrame) -> DataFrame:
    """One row: approved and not_ingestable source ids, sorted."""
    ids = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("source_id"))))
    return registry.agg(ids(F.col("status") == "approved").alias("approved"), ids(F.col("status").isin(STATUSES[1:])).alias("not_ingestable"))


def may_ingest(requested: DataFrame, registry: DataFrame, known: list[str]) -> DataFrame:
    """requested with granted: in the list of known sources, and approved in the registry."""
    approved = registry.where(F.col("status") == "approved").select("source_id").distinct().withColumn("__ok", F.lit(True))
    return requested.join(approved, "source_id", "left").withColumn("granted", F.coalesce(F.col("__ok"), F.lit(False)) & F.col("source_id").isin(known)).drop("__ok")


def subdomains(taxonomy: DataFrame) -> DataFrame:
    """A row for each subdomain: domain, weight, subdomain, languages, and where each stands. taxonomy: one row with domains (an array)."""
    d = taxonomy.select(F.posexplode("domains").alias("d_at", "d")).select("d_at", F.col("d.id").alias("domain"), F.col("d.weight").alias("weight"), "d.subdomains")
    return d.select("d_at", "domain", "weight", F.posexplode("subdomains").alias("s_at", "s")).select("d_at", "domain", "weight", "s_at", F.col("s.id").alias("subdomain"), F.col("s.languages").alias("languages"))


def taxonomy_gate(taxonomy: DataFrame) -> DataFrame:
    """Problems of a mix taxonomy (one row: languages as a map, domains as an array)."""
    languages = F.map_keys("languages")
    empty = taxonomy.where(F.coalesce(F.size("domains"), F.lit(-1)) <= 0).select(F.lit("taxonomy").alias("label"), say("no domains").alias("problem"))
    domains = taxonomy.select(F.posexplode("domains").alias("d_at", "d")).select("d_at", F.col("d.id").alias("domain"), F.col("d.weight").alias("weight"), F.col("d.subdomains").alias("subdomains"))
    named = F.col("domain").isNotNull() & (F.col("domain") != "")
    of_domains = problems(
        domains.withColumn("__again", not_first("domain", ["d_at"])),
        F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("taxonomy")),
        [
            (~named | F.col("domain").isNull(), say("no domain id")),
            (F.col("__again"), say("domain again")),
            (named & (F.col("weight").isNull() | (F.col("weight") <= 0)), say("weight")),
            (named & (F.coalesce(F.size("subdomains"), F.lit(-1)) <= 0), say("no subdomains")),
        ],
    )
    subs = taxonomy.select(languages.alias("declared"), "domains").select("declared", F.posexplode("domains").alias("d_at", "d")).where("d.id <> ''").select("declared", "d_at", F.col("d.id").alias("domain"), F.posexplode("d.subdomains").alias("s_at", "s"))
    subs = subs.select("declared", "d_at", "s_at", "domain", F.col("s.id").alias("subdomain"), F.col("s.languages").alias("languages"))
    sub_named = F.coalesce(F.col("subdomain") != "", F.lit(False))
    of_subs = problems(
        subs.withColumn("__again", not_first("subdomain", ["d_at", "s_at"])),
        F.when(sub_named, joined(F.col("domain"), "/", F.col("subdomain"))).otherwise(F.col("domain")),
        [
            (~sub_named, say("no subdomain id")),
            (F.col("__again"), say("subdomain again")),
            (sub_named & (F.coalesce(F.size("languages"), F.lit(-1)) <= 0), say("no languages")),
        ],
    )
    undeclared = subs.where(sub_named).select(joined(F.col("domain"), "/", F.col("subdomain")).alias("label"), F.explode(F.array_except("languages", "declared")).alias("l"))
    undeclared = undeclared.select("label", say("undeclared", F.col("l")).alias("problem"))
    found = empty.unionByName(of_domains).unionByName(of_subs).unionByName(undeclared)
    # the sum is only looked at if all else is well
    off = domains.agg(F.sum("weight").alias("w")).where(F.abs(F.col("w") - 1) > 0.01).select(F.lit("taxonomy").alias("label"), say("weights", F.format_number("w", 4)).alias("problem"), F.lit(1).alias("one"))
    any_other = found.select(F.lit(1).alias("one")).distinct()
    return found.unionByName(off.join(any_other, "one", "left_anti").drop("one"))


def taxonomy_size(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select(F.size("domains").cast("long").alias("domains"), F.aggregate("domains", F.lit(0).cast("long"), lambda a, d: a + F.size(d["subdomains"])).alias("subdomains"))


def record_gate(records: DataFrame, taxonomy: DataFrame, registry: DataFrame, number: str = "line_no") -> DataFrame:
    """Problems of pilot records: fields, flags, ids, digests, and what taxonomy and registry say of them. Of sources that share an id the registry's last counts."""
    places = sized(subdomains(taxonomy).select("domain", "subdomain", F.col("languages").alias("__languages")).dropDuplicates(["domain", "subdomain"]))
    sources = registry.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.max_by("license", number).alias("__license"), F.lit(True).alias("__known"))
    rows = records.join(places, ["domain", "subdomain"], "left").join(sized(sources), "source_id", "left")
    hex_ok = X.is_hex_digest(F.col("text_sha256"))
    rows = rows.withColumn("__id_again", not_first("record_id", [number])).withColumn("__sha_again", not_first("text_sha256", [number]) & hex_ok)
    text, chars, known = F.col("text"), F.col("text_chars"), F.coalesce("__known", F.lit(False))
    given = lambda k: F.coalesce(F.col(k) != "", F.lit(False))
    placed = given("domain") & given("subdomain")
    rules = [
        *missing(records, REQUIRED_OF_RECORDS),
        (~F.coalesce(F.col("pilot"), F.lit(False)), say("pilot")),
        (~F.coalesce(F.col("intended_use") == INTENDED_USE, F.lit(False)), say("use", INTENDED_USE)),
        (F.col("__id_again"), say("record again")),
        (F.col("text_sha256").isNotNull() & ~hex_ok, say("no digest")),
        (F.col("__sha_again"), say("digest again")),
        (placed & F.col("__languages").isNull(), say("place", F.col("domain"), F.col("subdomain"))),
        (placed & F.col("__languages").isNotNull() & given("language") & ~F.array_contains("__languages", F.col("language")), say("language", F.col("language"), F.col("domain"), F.col("subdomain"))),
        (F.col("source_id").isNotNull() & ~known, say("source", F.col("source_id"))),
        (known & given("license") & (F.col("license") != F.coalesce("__license", F.lit(""))), say("license", F.col("license"), F.col("__license"), F.col("source_id"))),
        (known & F.upper(X.strip(F.coalesce("provenance", F.lit("")))).isin(UNVERIFIED), say("provenance", F.col("provenance"))),
        (text.isNotNull() & (F.char_length("text_sha256") == 64) & (X.fingerprint(text) != F.col("text_sha256")), say("text")),
        (chars <= 0, say("positive")),
        (text.isNotNull() & (F.char_length(text) != chars), say("length", chars, F.char_length(text))),
    ]
    return problems(rows, label_of("record_id", number), rules)


def status(found: DataFrame) -> DataFrame:
    """One row: how many problems, PASS or FAIL."""
    return found.agg(F.count("*").alias("problems")).withColumn("status", F.when(F.col("problems") == 0, "PASS").otherwise("FAIL"))
