"""Association databases of different shapes brought to one evidence schema and mapped to entities and cohorts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scalars import canonical
from assaylake.operators.ids import by_rules, coalesced, contexts

FIELDS = ("record", "entity_raw", "context_raw", "method_raw", "description", "pmid_raw", "direction_raw")
DIRECTIONS = [(r"\b(up|over|increas|gain|high)|activat", "up"), (r"\b(down|under|decreas|loss|low)|repress", "down")]


@dataclass(frozen=True)
class Database:
    """How one database names its columns (any spelling of an alias; letters and digits count) and classes its methods.

    classes: (pattern, class, kind) in order, kind one of experimental, predicted, other; the first that the method matches
    counts. Without a match `default` does. suffix: a pattern cut from names that map to nothing, for a second try.
    """

    name: str
    aliases: dict[str, list[str]]
    default: tuple[str, str]
    classes: list[tuple[str, str, str]] = field(default_factory=list)
    suffix: str | None = None


def standardised(rows: DataFrame, base: Database) -> DataFrame:
    """database, FIELDS as strings, method_class, kind, direction, pmid, suffix. A field that a database lacks is null; so are its results."""
    text = {f: coalesced(rows, base.aliases.get(f, [])).cast("string") for f in FIELDS}
    out = rows.select(F.lit(base.name).alias("database"), *[F.when(F.trim(c) != "", F.trim(c)).alias(f) for f, c in text.items()])
    class_ = by_rules(F.col("method_raw"), [(p, c) for p, c, _ in base.classes], base.default[0])
    kind = by_rules(F.col("method_raw"), [(p, k) for p, _, k in base.classes], base.default[1])
    number = F.regexp_extract(F.col("pmid_raw"), r"^(?i:pmid)?[:\s]*0*([1-9][0-9]*)(?:\.0+)?$", 1)
    return out.withColumns({
        "method_class": class_, "kind": kind, "direction": by_rules(F.col("direction_raw"), DIRECTIONS, "unknown"),
        "pmid": F.when(number != "", number.cast("long")), "suffix": F.lit(base.suffix).cast("string"),
    })


def stacked(databases: list[tuple[DataFrame, Database]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [standardised(rows, base) for rows, base in databases])


def _met(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join on key. Rows without one meet nothing; they are spread by their record, so that no task gets all of them."""
    spread = F.when(F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64("record", "entity_raw"), F.lit(4096))).cast("int")
    nought = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    return rows.withColumn("spread_", spread).join(side.withColumn("spread_", nought), [key, "spread_"], "left").drop("spread_")


def mapped(rows: DataFrame, names: DataFrame, cohorts: DataFrame, trained: DataFrame) -> DataFrame:
    """Adds entity, entity_status, cohort, context_status, trained_pmid, role and two eligibility flags.

    names(alias, entity), cohorts(alias, cohort), trained(pmid): publications that training used. Contexts and cohorts' aliases are
    compared by their letters and digits.
    A name of several entities is ambiguous and gets none. Eligible for validation: experimental, mapped to an entity and one
    cohort, and published outside training; predictions can only be compared for consistency. Rows without a publication are not in training.
    """
    index = names.select(canonical(F.col("alias")).alias("alias_"), "entity").where("alias_ is not null and entity is not null")
    index = index.groupBy("alias_").agg(F.count_distinct("entity").alias("n_"), F.min("entity").alias("one_"))
    first, second = index.withColumnsRenamed({"alias_": "key_", "n_": "n1_", "one_": "e1_"}), index.withColumnsRenamed({"alias_": "short_", "n_": "n2_", "one_": "e2_"})
    cut = F.when(F.col("suffix").isNotNull(), canonical(F.expr("regexp_replace(entity_raw, suffix, '')")))
    tried = _met(_met(rows.withColumns({"key_": canonical(F.col("entity_raw")), "short_": cut}), first, "key_"), second, "short_")
    n, one = F.coalesce("n1_", "n2_"), F.when(F.col("n1_").isNotNull(), F.col("e1_")).otherwise(F.col("e2_"))
    status = F.when(F.col("key_").isNull(), "unnamed").when(n.isNull(), "unmapped").when(n > 1, "ambiguous").when(F.col("n1_").isNull(), "mapped_short").otherwise("mapped")
    named = tried.withColumn("entity_status", status).withColumn("entity", F.when(n == 1, one)).drop("key_", "short_", "n1_", "n2_", "e1_", "e2_")
    plain = F.trim(F.regexp_replace(F.lower("alias"), "[^a-z0-9]+", " "))
    spelled = cohorts.select(plain.alias("alias"), "cohort").where("alias <> ''").distinct()
    placed = contexts(named, spelled, "context_raw").withColumnRenamed("cohort_", "cohort")
    used = trained.select("pmid").where("pmid is not null").distinct().withColumn("trained_pmid", F.lit(True))
    out = _met(placed, used, "pmid").fillna(False, ["trained_pmid"])
    return out.drop("suffix").withColumns(_roles(F.col("entity").isNotNull() & F.col("cohort").isNotNull()))


def _roles(whole: Column) -> dict[str, Column]:
    predicted, experimental = F.col("kind") == "predicted", F.col("kind") == "experimental"
    return {
        "role": F.when(predicted, "consistency").when(experimental, "validation").otherwise("context"),
        "validation_eligible": whole & experimental & ~F.col("trained_pmid"),
        "consistency_eligible": whole & predicted,
    }
