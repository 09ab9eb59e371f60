"""Rules over catalog facts, as projections and joins.

A rule list is short configuration, so matching it is an expression on each
column's row (no join with the rules, no loop over rows): all matching rules
are collected in an array of structs whose order is the precedence, and the
least one wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.functions.columns import label_name, loose_upper
from quillgate.operators import hierarchy
from quillgate.operators.skew import join_groups
from quillgate.session import cut

# Precedence of actions, the strictest first.
RANK = {"deny": 0, "mask": 1, "allow": 2, "substitute_certified": 3}


@dataclass(frozen=True)
class Rule:
    """All conditions that are set must hold; a rule without any never applies."""

    id: str
    action: str
    strategy: str | None = None
    tag: str | None = None
    term: str | None = None
    lifecycle: str | None = None
    certification: str | None = None
    domain: str | None = None

    @property
    def conditions(self) -> dict[str, str]:
        return {k: v for k in ("tag", "term", "lifecycle", "certification", "domain") if (v := getattr(self, k)) is not None}

    def matches(self, columns: dict[str, Column]) -> Column:
        """Condition on Columns for tag and term (arrays) and the rest; absent facts never match."""
        out = F.lit(bool(self.conditions))
        for k, v in self.conditions.items():
            if k not in columns:
                return F.lit(False)
            hit = F.array_contains(columns[k], v) if k in ("tag", "term") else columns[k] == v
            out = out & F.coalesce(hit, F.lit(False))
        return out


@dataclass(frozen=True)
class Scope:
    """Principal's reach; None leaves an axis open, a set confines it (and bars null)."""

    principal: str
    domains: frozenset[str] | None = None
    platforms: frozenset[str] | None = None

    def permits(self, domain: Column, platform: Column) -> Column:
        out = F.lit(True)
        for allowed, c in ((self.domains, domain), (self.platforms, platform)):
            if allowed is not None:
                out = out & F.coalesce(c.isin(*sorted(allowed)), F.lit(False))
        return out


def current(facts: DataFrame, key: str = "urn") -> DataFrame:
    """The newest fact of each key: greatest compiled_at, then fact_id. Rows without either are left out."""
    rest = [c for c in facts.columns if c != key]
    at = F.struct("compiled_at", "fact_id")
    rows = facts.where(F.col(key).isNotNull() & F.col("compiled_at").isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("f")).select(key, "f.*")


def _labels(c: str) -> Column:
    names = F.transform(F.coalesce(F.col(c), F.array()), lambda x: label_name(x))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda x: F.lower(x)), lambda x: x.isNotNull() & (x != ""))))


def catalog_datasets(dataset_facts: DataFrame) -> DataFrame:
    """Current data sets: urn, platform, name, env, lifecycle, certification, domain, owners, tags, terms."""
    owners = F.array_distinct(F.filter(F.coalesce("owners", F.array()), lambda x: x.isNotNull() & (x != "")))
    return current(dataset_facts).select(
        "urn", "platform", "name", "env", loose_upper(F.col("lifecycle")).alias("lifecycle"), loose_upper(F.col("certification")).alias("certification"),
        F.when(F.col("domain") != "", F.col("domain")).alias("domain"), owners.alias("owners"), _labels("tags").alias("tags"), _labels("terms").alias("terms"),
    )


def catalog_columns(column_facts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Current columns with their data set's name, platform and domain."""
    cols = current(column_facts).select("urn", "dataset_urn", F.col("name").alias("column"), "data_type", _labels("tags").alias("tags"), _labels("terms").alias("terms"))
    sets = datasets.select(F.col("urn").alias("dataset_urn"), F.col("name").alias("dataset"), "platform", "domain")
    return cols.join(sets, "dataset_urn", "left")


def _best(rules: list[Rule], facts: dict[str, Column]) -> Column:
    hits = [
        F.when(
            r.matches(facts),
            F.struct(F.lit(RANK[r.action]).alias("rank"), F.lit(-len(r.conditions)).alias("breadth"), F.lit(r.id).alias("id"), F.lit(r.action).alias("action"), F.lit(r.strategy).cast("string").alias("strategy")),
        )
        for r in rules
    ]
    return F.array_min(F.array_compact(F.array(*hits)))


def column_rules(columns: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``own``: the winning rule by the column's tags and terms and its data set's domain."""
    return columns.withColumn("own", _best(rules, {"tag": F.col("tags"), "term": F.col("terms"), "domain": F.col("domain")}))


def _strictest(ruled: DataFrame, lineage: DataFrame) -> DataFrame:
    """urn, given, source: what each ungoverned column inherits, the strictest of its nearest governed ancestors.

    Columns with one known upstream form trees that end in governed columns,
    in columns with several upstreams or in nothing, and the hierarchy operator
    finds that end for all of them at once. What is left are the columns with
    several upstreams, each linked to the ends of theirs: there the strictest
    label (then the smallest source) moves along the links, from changed
    columns only, until nothing changes. A loop has no effect on a least label.
    """
    known = ruled.select("urn", "governs")
    edges = (
        lineage.where("field_urn IS NOT NULL AND upstream_urn IS NOT NULL").select("field_urn", "upstream_urn").distinct()
        .join(known.where("NOT governs").select(F.col("urn").alias("field_urn")), "field_urn", "left_semi")
        .join(known.select(F.col("urn").alias("upstream_urn")), "upstream_urn", "left_semi")
    )
    edges = cut(edges.join(edges.groupBy("field_urn").agg(F.count("*").alias("n_up")), "field_urn"), "upstreams")
    ends = cut(hierarchy.solve(edges.where("n_up = 1"), "upstream_urn", "field_urn").where("depth >= 0").select(F.col("node").alias("urn"), F.col("root").alias("top"), "depth"), "ends")
    given = ruled.where("governs").select("urn", F.struct(F.col("own.rank").alias("rank"), F.concat_ws(".", "dataset", "column").alias("source"), "own").alias("label"))
    several = edges.where("n_up > 1").select(F.col("field_urn").alias("urn"), F.col("upstream_urn").alias("up"))
    if not several.isEmpty():
        looped = edges.where("n_up = 1").select(F.col("field_urn").alias("up")).join(ends.select(F.col("urn").alias("up")), "up", "left_anti")
        links = several.join(looped, "up", "left_anti").join(ends.select(F.col("urn").alias("up"), "top"), "up", "left").select("urn", F.coalesce("top", "up").alias("top")).distinct()
        links, given = cut(links, "links"), cut(given, "labels")
        changed = given
        while True:  # at most as many rounds as a path has columns with several upstreams
            offered = links.join(changed.select(F.col("urn").alias("top"), "label"), "top").groupBy("urn").agg(F.min("label").alias("offer"))
            changed = offered.join(given, "urn", "left").where(F.col("label").isNull() | (F.col("offer") < F.col("label"))).select("urn", F.col("offer").alias("label"))
            changed = cut(changed, "changed")
            if changed.isEmpty():
                break
            given = cut(given.join(changed.select("urn"), "urn", "left_anti").unionByName(changed), "labels")
    below = ends.where("depth > 0").select("urn", "top")
    sizes = below.groupBy("top").agg(F.count("*").alias("_n"))
    heads = cut(given.withColumnRenamed("urn", "top").join(sizes, "top"), "heads")
    inherited = join_groups(below, heads, ["top"], "_n", below.count()).select("urn", "label")
    own_several = given.join(several.select("urn").distinct(), "urn", "left_semi")
    return inherited.unionByName(own_several).select("urn", F.col("label.own").alias("given"), F.col("label.source").alias("source"))


def outcomes(columns: DataFrame, lineage: DataFrame, rules: list[Rule], inherit: bool = True) -> DataFrame:
    """urn, dataset_urn, dataset, column, data_type, action, rule_id, strategy, source.

    A column without an own mask or deny inherits the strictest of its nearest
    governed ancestors, of equally strict ones the one of the smallest source;
    unknown upstreams are skipped, and loops alone give nothing. Without
    ``inherit`` only own rules count.
    """
    ruled = column_rules(columns, rules).withColumn("governs", F.coalesce(F.col("own.action").isin("mask", "deny"), F.lit(False)))
    if inherit:
        ruled = cut(ruled, "ruled")
        ruled = ruled.join(_strictest(ruled, lineage), "urn", "left")
    else:
        ruled = ruled.withColumn("given", F.lit(None).cast(ruled.schema["own"].dataType)).withColumn("source", F.lit(None).cast("string"))
    rule = F.when(F.col("governs"), F.col("own")).otherwise(F.coalesce("given", "own"))
    return ruled.withColumn("r", rule).select(
        "urn", "dataset_urn", "dataset", "column", "data_type", "domain", "tags", "terms",
        F.coalesce("r.action", F.lit("allow")).alias("action"), F.col("r.id").alias("rule_id"), F.col("r.strategy").alias("strategy"), "source",
    )


def visible(datasets: DataFrame, scopes: list[Scope]) -> DataFrame:
    """principal, urn of every data set within each principal's scope."""
    who = F.array_compact(F.array(*[F.when(s.permits(F.col("domain"), F.col("platform")), F.lit(s.principal)) for s in scopes]))
    return datasets.select(F.explode(who).alias("principal"), "urn", "name")


def substitutes(datasets: DataFrame, lineage: DataFrame) -> DataFrame:
    """urn, substitute, ord: direct downstream data sets that are certified and not deprecated, for deprecated ones."""
    old = datasets.where("lifecycle = 'DEPRECATED'").select("urn")
    good = datasets.where("certification = 'CERTIFIED' AND lifecycle <> 'DEPRECATED'").select(F.col("urn").alias("substitute"))
    edges = lineage.where("src_urn IS NOT NULL AND dst_urn IS NOT NULL").groupBy(F.col("src_urn").alias("urn"), F.col("dst_urn").alias("substitute")).agg(F.min("ord").alias("ord"))
    return edges.join(old, "urn").join(good, "substitute").select("urn", "substitute", "ord")


def out_of_scope(requests: DataFrame, datasets: DataFrame, scopes: list[Scope]) -> DataFrame:
    """principal, urn, code 301, n_requests: data sets asked for outside the principal's reach.

    ``requests`` is (principal, dataset_urn), a row per request and data set.
    Data sets the catalog does not know have no domain or platform; principals
    without a scope are not judged.
    """
    who = F.create_map(*[x for s in scopes for x in (F.lit(s.principal), s.permits(F.col("domain"), F.col("platform")))])
    asked = requests.where(F.col("principal").isin(*[s.principal for s in scopes])).groupBy("principal", F.col("dataset_urn").alias("urn")).agg(F.count("*").alias("n_requests"))
    return asked.join(datasets.select("urn", "domain", "platform"), "urn", "left").where(~F.element_at(who, F.col("principal"))).select("principal", "urn", F.lit(OUT_OF_SCOPE).alias("code"), "n_requests")


SUBSTITUTED, SUBSTITUTE_LACKS, OUT_OF_SCOPE = 201, 202, 301  # Fixed values: reason numbers.


def redirected(reads: DataFrame, picks: DataFrame) -> DataFrame:
    """Reads with the data set really read: its substitute where one has all columns asked for.

    ``reads`` is (request, dataset_urn, column), ``picks`` the substitutes with
    their ``columns``, in order ``ord``. Adds effective_urn and code: 201 where
    substituted, 202 where no substitute has all columns, null elsewhere. A
    request's columns of one data set are judged together.
    """
    asked = reads.groupBy("request", "dataset_urn").agg(F.collect_set(F.lower("column")).alias("asked"))
    shapes = asked.select("dataset_urn", F.array_sort("asked").alias("asked")).distinct()
    offers = shapes.join(picks.select(F.col("urn").alias("dataset_urn"), "substitute", "ord", "columns"), "dataset_urn")
    missing = F.size(F.array_except("asked", "columns"))
    best = offers.groupBy("dataset_urn", "asked").agg(F.min(F.when(missing == 0, F.struct("ord", "substitute"))).alias("best"))
    told = asked.withColumn("asked", F.array_sort("asked")).join(best.withColumn("_old", F.lit(True)), ["dataset_urn", "asked"], "left")
    code = F.when(F.col("best").isNotNull(), SUBSTITUTED).when(F.col("_old"), SUBSTITUTE_LACKS)
    return told.select("request", "dataset_urn", F.size("asked").cast("bigint").alias("n_columns"), F.coalesce("best.substitute", "dataset_urn").alias("effective_urn"), code.alias("code"))


def covering(reads: DataFrame, columns: DataFrame, subs: DataFrame) -> DataFrame:
    """urn, substitute, n_missing: per deprecated data set the substitute lacking fewest of the columns
    read from it (then the first in lineage order). ``reads`` is (dataset_urn, column), any case."""
    wanted = reads.select(F.col("dataset_urn").alias("urn"), F.lower("column").alias("column")).distinct()
    have = columns.select(F.col("dataset_urn").alias("substitute"), F.lower("column").alias("column"), F.lit(1).alias("_has")).distinct()
    pairs = wanted.join(subs, "urn").join(have, ["substitute", "column"], "left")
    scored = pairs.groupBy("urn", "substitute", "ord").agg(F.count_if(F.col("_has").isNull()).alias("n_missing"))
    best = scored.groupBy("urn").agg(F.min(F.struct("n_missing", "ord", "substitute")).alias("b"))
    return best.select("urn", "b.substitute", "b.n_missing")


def name_index(datasets: DataFrame) -> DataFrame:
    """key, n_datasets, urn: every dotted suffix of a data set's name; urn null where it is ambiguous."""
    parts = F.split(F.lower("name"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = datasets.where("name IS NOT NULL").select("urn", F.explode(suffixes).alias("key")).distinct()
    return keys.groupBy("key").agg(F.count("*").alias("n_datasets"), F.min("urn").alias("_u")).select("key", "n_datasets", F.when(F.col("n_datasets") == 1, F.col("_u")).alias("urn"))


def tie_conflicts(rules: list[Rule]) -> list[tuple[str, str]]:
    """Pairs of rules between which only the id decides although they do different things (lint of the configuration)."""
    level = lambda r: (RANK[r.action], len(r.conditions))
    out = []
    for _, equal in groupby(sorted(rules, key=level), key=level):
        out += [(a.id, b.id) for a, b in combinations(equal, 2) if (a.action, a.strategy) != (b.action, b.strategy)]
    return out


def rule_diff(old: list[Rule], new: list[Rule]) -> list[str]:
    """'+id', '-id' and '~id' lines between two rule lists."""
    a, b = {r.id: r for r in old}, {r.id: r for r in new}
    return [f"+{k}" for k in b if k not in a] + [f"-{k}" for k in a if k not in b] + [f"~{k}" for k in b if k in a and a[k] != b[k]]


def certified_by_label(datasets: DataFrame) -> DataFrame:
    """urn of data sets with a tag or term whose name contains "certified"."""
    hit = lambda c: F.exists(c, lambda x: x.contains("certified"))
    return datasets.where(hit("tags") | hit("terms")).select("urn", "name")


def described(outcomes: DataFrame, datasets: DataFrame, scopes: list[Scope]) -> DataFrame:
    """principal, dataset_urn, column, data_type, policy: columns of visible data sets only."""
    policy = F.when(F.col("action") == "mask", F.concat(F.lit("mask:"), F.coalesce("strategy", F.lit("auto")))).otherwise(F.col("action"))
    seen = visible(datasets, scopes).select("principal", F.col("urn").alias("dataset_urn"))
    return outcomes.join(seen, "dataset_urn").select("principal", "dataset_urn", "column", "data_type", policy.alias("policy"))
