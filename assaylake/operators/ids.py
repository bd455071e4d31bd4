"""Identity and standardisation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.scalars import canonical


def crosswalk(aliases: DataFrame, key: str, alias: str, kind: str) -> DataFrame:
    """alias, kind, key, status: lists split at ; , | and upper-cased; unique if an alias has one key within its kind."""
    rows = aliases.select(key, kind, F.explode(F.split(alias, r"[;,|]")).alias("alias")).withColumn("alias", canonical(F.col("alias")))
    rows = rows.where("alias is not null").select("alias", kind, key).distinct()
    n = rows.groupBy("alias", kind).agg(F.count(key).alias("candidates"))
    return rows.join(n, ["alias", kind]).withColumn("status", F.when(F.col("candidates") == 1, "unique").otherwise("ambiguous"))


def by_priority(sources: list[DataFrame], pair: list[str]) -> DataFrame:
    """The rows of the first source that has each pair; sources have the same columns."""
    stacked = reduce(DataFrame.unionByName, [s.withColumn("priority", F.lit(i + 1)) for i, s in enumerate(sources)])
    w = Window.partitionBy(*pair).orderBy("priority", *[c for c in sources[0].columns if c not in pair])
    return stacked.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def coalesced(df: DataFrame, aliases: list[str]) -> Column:
    """First non-null of the columns whose headers match one of the aliases, letters and digits only, in any case."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    found = [F.col(f"`{c}`") for a in aliases for c in df.columns if plain(c) == plain(a)]
    return F.coalesce(*found) if found else F.lit(None)


def resolve(rows: DataFrame, drugs: DataFrame, genes: DataFrame) -> DataFrame:
    """rows: drug, gene. Adds drug_id, gene_id and status mapped, drug_only, gene_only or unmapped."""
    out = rows.join(drugs, "drug", "left").join(genes, "gene", "left")
    d, g = F.col("drug_id").isNotNull(), F.col("gene_id").isNotNull()
    return out.withColumn("status", F.when(d & g, "mapped").when(d, "drug_only").when(g, "gene_only").otherwise("unmapped"))


def classify_members(members: DataFrame, index: DataFrame) -> DataFrame:
    """members: position, member. index: alias, kind, id. Adds state: a kind, ambiguous, unmapped or duplicate."""
    forced = F.regexp_extract(F.upper("member"), r"^(LNC|GENE):", 1)
    rows = members.withColumns({"forced": forced, "alias": canonical(F.regexp_replace(F.upper("member"), r"^(LNC|GENE):", ""))})
    hits = rows.join(index, "alias", "left").where((F.col("forced") == "") | F.col("kind").isNull() | (F.upper("kind") == F.col("forced")))
    found = hits.groupBy("position", "member", "alias").agg(F.collect_set("id").alias("ids"), F.min("kind").alias("kind"))
    missing = rows.join(found, ["position", "member"], "left_anti").select("position", "member", "alias", F.array().cast("array<string>").alias("ids"), F.lit(None).cast("string").alias("kind"))
    w = Window.partitionBy(F.coalesce("alias", F.concat(F.lit("#"), "position"))).orderBy("position")
    state = F.when(F.col("nth") > 1, "duplicate").when(F.size("ids") == 0, "unmapped").when(F.size("ids") > 1, "ambiguous").otherwise(F.col("kind"))
    return found.unionByName(missing).withColumn("nth", F.row_number().over(w)).withColumn("state", state).select("position", "member", "state")


def expand_global(rows: DataFrame, cohorts: DataFrame, cohort: str, marks=("PAN", "ALL")) -> DataFrame:
    """Rows of no or every cohort are repeated for each cohort."""
    everywhere = F.col(cohort).isNull() | F.upper(cohort).isin(*marks)
    spread = rows.where(everywhere).drop(cohort).join(F.broadcast(cohorts.select(cohort)))
    return rows.where(~everywhere).unionByName(spread)


def contexts(rows: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """cohort_, context_status: exact if the text holds the aliases of one cohort, ambiguous of several, unmapped of none, global without text."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    keyed = rows.withColumn("plain_", plain)
    texts = keyed.select("plain_").where("plain_ is not null").distinct()
    hits = texts.join(F.broadcast(aliases), F.col("plain_").contains(F.concat(F.lit(" "), "alias", F.lit(" "))))
    found = hits.groupBy("plain_").agg(F.count_distinct("cohort").alias("n_"), F.min("cohort").alias("one_"))
    out = keyed.join(found, "plain_", "left")
    status = F.when(F.trim("plain_").isNull() | (F.trim("plain_") == ""), "global").when(F.col("n_").isNull(), "unmapped").when(F.col("n_") == 1, "exact").otherwise("ambiguous")
    return out.withColumn("context_status", status).withColumn("cohort_", F.when(F.col("context_status") == "exact", F.col("one_"))).drop("plain_", "n_", "one_")


def by_rules(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found in the lower-cased text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(default)


def endpoints(rows: DataFrame, key: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """key, endpoint, time, event, available: one row a key and endpoint, the available one of repeats, then the longest time."""
    stacked = reduce(DataFrame.unionByName, [rows.select(*key, F.lit(name).alias("endpoint"), F.col(t).cast("double").alias("time"), F.col(e).cast("int").alias("event")) for name, (t, e) in pairs.items()])
    stacked = stacked.withColumn("available", F.coalesce((F.col("time") > 0) & F.col("event").isin(0, 1), F.lit(False)))
    w = Window.partitionBy(*key, "endpoint").orderBy(F.desc("available"), F.desc_nulls_last("time"), F.desc_nulls_last("event"))
    return stacked.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def most_complete(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the most non-null fields; ties by `order`."""
    others = [c for c in rows.columns if c not in key]
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in others])
    w = Window.partitionBy(*key).orderBy(F.desc("filled"), *order)
    return rows.withColumn("filled", filled).withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def representative(rows: DataFrame, key: list[str], flags: list[Column]) -> DataFrame:
    """One row of each key: the first by the flags in turn."""
    return rows.withColumn("r_", F.row_number().over(Window.partitionBy(*key).orderBy(*flags))).where("r_ = 1").drop("r_")


def recover(rows: DataFrame, ident: str, name: str, steps: list[DataFrame]) -> DataFrame:
    """Fail-closed recovery: steps are tables (lookup, id), the first looked up by `ident`, others by `name`. The first step
    with a candidate decides; with several it is ambiguous. Adds id_, status, candidates."""
    out = rows
    for i, s in enumerate(steps):
        sets = s.groupBy("lookup").agg(F.count_distinct("id").alias(f"n{i}"), F.min("id").alias(f"id{i}"))
        out = out.join(sets, F.col(ident if i == 0 else name) == F.col("lookup"), "left").drop("lookup")
    n = [F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in range(len(steps))]
    status, picked, count = F.lit("unresolved"), F.lit(None).cast("string"), F.lit(0).cast("long")
    for i in reversed(range(len(steps))):
        status = F.when(n[i] > 1, "ambiguous").when(n[i] == 1, f"step_{i + 1}").otherwise(status)
        picked = F.when(n[i] == 1, F.col(f"id{i}").cast("string")).when(n[i] > 1, F.lit(None)).otherwise(picked)
        count = F.when(n[i] > 0, n[i]).otherwise(count)
    return out.withColumns({"status": status, "id_": picked, "candidates": count}).drop(*[c for i in range(len(steps)) for c in (f"n{i}", f"id{i}")])


def match_samples(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows: key, sample, patient, tumour. known: sample_, patient_, passed. Adds one status a row."""
    repeated = F.count("*").over(Window.partitionBy("sample"))
    patients = known.select(F.col("patient_").alias("p_")).distinct()
    out = rows.withColumn("times", repeated).join(patients, F.col("patient") == F.col("p_"), "left").join(known, F.col("sample") == F.col("sample_"), "left")
    status = (
        F.when(F.col("p_").isNull(), "no_patient").when(~F.col("tumour"), "not_tumour").when(F.col("sample_").isNull(), "sample_mismatch")
        .when(~F.col("passed"), "quality_excluded").when(F.col("times") > 1, "several_unresolved").otherwise("matched")
    )
    return out.withColumn("status", status).select(key, "status")
