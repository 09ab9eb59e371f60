"""Posture of a catalog: what its rules protect and where they are blind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.operators.policy import Rule, Scope, substitutes

# Words that mark a column name as sensitive.
SENSITIVE_WORDS = {
    "email": "email address",
    "ssn": "national identifier",
    "phone": "phone number",
    "msisdn": "phone number",
    "dob": "date of birth",
    "birthdate": "date of birth",
    "salary": "compensation",
    "compensation": "compensation",
    "iban": "bank account",
    "passport": "government identifier",
    "latitude": "precise location",
    "longitude": "precise location",
}
# Runs of words that do so only together.
SENSITIVE_PHRASES = {
    "date of birth": "date of birth",
    "credit card": "payment instrument",
    "card number": "payment instrument",
    "home address": "postal address",
    "street address": "postal address",
    "tax id": "government identifier",
    "account number": "bank account",
}


def suspicion(name: Column) -> Column:
    """Why a column name reads as sensitive, or null: the first sensitive word, else the first phrase."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for kv in SENSITIVE_WORDS.items() for x in kv])
    word = F.get(F.filter(F.transform(words, lambda w: known[w]), lambda r: r.isNotNull()), F.lit(0))
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrases = [F.when(F.contains(line, F.lit(f" {p} ")), why) for p, why in SENSITIVE_PHRASES.items()]
    return F.coalesce(word, *phrases)


def gaps(outcomes: DataFrame) -> DataFrame:
    """Columns no rule masks or denies whose name reads as sensitive."""
    why = outcomes.where(~F.col("action").isin("mask", "deny")).withColumn("reason", suspicion(F.col("column")))
    return why.where("reason IS NOT NULL").select("dataset_urn", "dataset", "column", "data_type", "reason")


def proposals(gap_rows: DataFrame) -> DataFrame:
    """dataset_urn, proposal: the gaps of a data set in one text, in column order."""
    lines = F.concat(F.col("column"), F.lit(": looks like "), F.col("reason"))
    return gap_rows.groupBy("dataset_urn").agg(F.array_join(F.array_sort(F.collect_set(lines)), "; ").alias("proposal"))


def unowned(datasets: DataFrame) -> DataFrame:
    return datasets.where(F.size("owners") == 0).select("urn", "name")


def unreachable(datasets: DataFrame, scopes: list[Scope]) -> DataFrame:
    """Data sets outside every named principal's scope; none named, none unreachable."""
    if not scopes:
        return datasets.select("urn", "name").limit(0)
    seen = F.lit(False)
    for s in scopes:
        seen = seen | s.permits(F.col("domain"), F.col("platform"))
    return datasets.where(~seen).select("urn", "name")


def orphan_deprecated(datasets: DataFrame, lineage: DataFrame) -> DataFrame:
    """Deprecated data sets without a certified direct downstream."""
    return datasets.where("lifecycle = 'DEPRECATED'").join(substitutes(datasets, lineage).select("urn"), "urn", "left_anti").select("urn", "name")


def dead_rules(columns: DataFrame, datasets: DataFrame, rules: list[Rule]) -> DataFrame:
    """id of rules that act on nothing: column rules match columns, substitutions match data sets."""
    of_column = {"tag": F.col("tags"), "term": F.col("terms"), "domain": F.col("domain")}
    of_set = of_column | {"lifecycle": F.col("lifecycle"), "certification": F.col("certification")}
    table_rules = [r for r in rules if r.action == "substitute_certified"]
    counts = [(columns, rules, of_column), (datasets, table_rules, of_set)]
    fired = None
    for rows, some, facts in counts:
        # One row per rule; the counts come from one aggregate over the facts.
        one = rows.agg(*[F.count_if(r.matches(facts)).alias(r.id) for r in some])
        tall = one.select(F.explode(F.array(*[F.struct(F.lit(r.id).alias("id"), F.col(f"`{r.id}`").alias("n")) for r in some])).alias("x")).select("x.*") if some else None
        if tall is not None:
            fired = tall if fired is None else fired.unionByName(tall)
    return fired.groupBy("id").agg(F.sum("n").alias("n")).where("n = 0").select("id")


def summary(outcomes: DataFrame) -> DataFrame:
    """Per domain ('' for none): columns, classified, masked, denied, governed share."""
    classified = (F.size("tags") > 0) | (F.size("terms") > 0)
    out = outcomes.groupBy(F.coalesce("domain", F.lit("")).alias("domain")).agg(
        F.countDistinct("dataset_urn").alias("n_datasets"),
        F.count("*").alias("n_columns"),
        F.count_if(classified).alias("n_classified"),
        F.count_if(F.col("action") == "mask").alias("n_masked"),
        F.count_if(F.col("action") == "deny").alias("n_denied"),
    )
    return out.withColumn("governed_pct", F.round(100.0 * (F.col("n_masked") + F.col("n_denied")) / F.col("n_columns"), 6))


def grade(n_gaps: int, n_dead: int, n_orphan: int, n_unowned: int) -> str:
    """Posture in one word; unreachable data sets do not count."""
    if n_gaps:
        return "at-risk"
    return "gaps" if n_dead or n_orphan or n_unowned else "clear"
