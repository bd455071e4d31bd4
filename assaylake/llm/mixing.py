"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic). Each sweep scales the cells to the source
targets, then the language targets, then the topic targets, until a sweep scales
no value by more than TOLERANCE (as a share); after SWEEPS sweeps without that, as when targets contradict each other, a
warning states what is left. A cell's multiplier is its fitted over its own weight. A document is expected
multiplier * RATE times in the mix: as many whole copies, and one more with the probability that is left, decided
by a hash of its id. So no weight is lost to probabilities over one, and the mix meets the targets.

Targets are shares of all tokens: given tables, or each value's share to the power SOURCE_POWER,
LANG_POWER or TOPIC_POWER, normalised. The topic is a surface form of the whole text (tabular, markup,
numeric, lines, prose) unless another expression is given. Tokens are the pieces between spaces.

Null values of a dimension are their own value `none`; null and empty texts have no tokens and the
multiplier of their cell, 1 if the cell has no tokens at all. Repeated ids share their decision. An empty
table gives an empty mix. What is worked out stands in one column of a name that docs hasn't got, so no
column of docs is touched. The fit runs on the cell table only, in Spark, whatever the number of cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import discard, saved, table

SWEEPS, TOLERANCE, RATE, SOURCE_POWER, LANG_POWER, TOPIC_POWER = 20, 1e-12, 1.0, 0.7, 0.7, 0.8
CELLS_A_FILE = 50_000
DIMENSIONS = ("source_", "lang_", "topic_")


def _share(char: str) -> Column:
    return (F.length("text") - F.length(F.replace("text", F.lit(char)))) / F.length("text")


def topic() -> Column:
    return (
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "none")
        .when(_share("|") > 0.01, "tabular")
        .when(_share("<") + _share("{") > 0.005, "markup")
        .when((F.length("text") - F.length(F.translate("text", "0123456789", ""))) / F.length("text") > 0.05, "numeric")
        .when(_share("\n") > 0.01, "lines")
        .otherwise("prose")
    )


def tokens() -> Column:
    return F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1).cast("long")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """dimension, target: shares to a power, normalised."""
    share = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
    total = share.agg(F.sum("p").alias("all_p"))
    return share.join(F.broadcast(total)).select(dimension, F.when(F.col("all_p") > 0, F.col("p") / F.col("all_p")).otherwise(0.0).alias("target"))


def fit(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells: the dimensions and tokens. Adds multiplier. A value without a target, or without tokens, keeps its weight."""
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    now = cells.join(F.broadcast(total)).withColumn("w", F.col("tokens").cast("double"))
    for d, t in targets.items():
        now = now.join(t.select(d, (F.col("target")).alias(f"t{d}")), d, "left")
    files = cells.count() // CELLS_A_FILE + 1
    now, left = now.withColumn("off", F.lit(None).cast("double")), None
    for _ in range(sweeps):
        before, offs = now, []
        now = now.coalesce(files)
        for i, d in enumerate(targets):
            # Cells of one value are few next to documents: one for each pair of values of the other dimensions at most.
            target = F.when(F.sum("w").over(Window.partitionBy(d)) > 0, F.col(f"t{d}") * F.col("total") / F.sum("w").over(Window.partitionBy(d)))
            now = now.withColumn(f"by{i}", F.coalesce(target, F.lit(1.0))).withColumn("w", F.col("w") * F.col(f"by{i}"))
            offs.append(F.abs(F.col(f"by{i}") - 1))
        now = now.withColumn("off", F.greatest(*offs)).drop(*(f"by{i}" for i in range(len(targets))))
        now = saved(now, "mixing-sweep")  # each sweep is a written table: plans stay small
        if hasattr(before, "_saved_at"):
            discard(before)
        left = now.agg(F.max("off").alias("off")).first().off
        if left is None or left <= tolerance:
            break
    else:
        if left is not None and left > max(tolerance, 1e-6):
            warnings.warn(f"after {sweeps} sweeps a marginal is off its target by {left:.2g} of it", stacklevel=2)
    return now.withColumn("multiplier", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0)).select(*targets, "tokens", "w", "multiplier")


def chance(key: str) -> Column:
    """Uniform in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def own_name(docs: DataFrame, name: str = "mix") -> str:
    """A column name that docs hasn't got."""
    there = {c.lower() for c in docs.columns}
    while name in there or f"{name}_cell" in there:
        name += "_"
    return name


def weighted(docs: DataFrame, key: str = "doc_id", topic_of: Column | None = None, targets: dict[str, DataFrame] | None = None, rate: float = RATE, sweeps: int = SWEEPS, name: str | None = None) -> DataFrame:
    """docs with one struct column more (`mix`, or its first free spelling): source, lang, topic, tokens, multiplier, expected, copies."""
    name = name or own_name(docs)
    topic_of = topic() if topic_of is None else topic_of
    parts = [F.coalesce(c, F.lit("none")).alias(n) for n, c in (("source", F.col("source")), ("lang", F.col("lang")), ("topic", topic_of))]
    rows = docs.withColumn(name, F.struct(*parts, tokens().alias("tokens")))
    of = [F.col(f"{name}.{d[:-1]}").alias(d) for d in DIMENSIONS]
    cells = saved(rows.groupBy(*of).agg(F.sum(f"{name}.tokens").alias("tokens")), "mixing-cells")
    powers = dict(zip(DIMENSIONS, (SOURCE_POWER, LANG_POWER, TOPIC_POWER)))
    targets = targets or {d: tempered(cells, d, powers[d]) for d in DIMENSIONS}
    cell = f"{name}_cell"
    fitted = saved(fit(cells, targets, sweeps).select(F.struct(*DIMENSIONS, "multiplier").alias(cell)), "mixing-fitted")
    same = [F.col(f"{name}.{d[:-1]}") == F.col(f"{cell}.{d}") for d in DIMENSIONS]
    expected = F.col(f"{cell}.multiplier") * F.lit(float(rate))
    copies = F.floor(expected) + (chance(key) < expected - F.floor(expected)).cast("long")
    kept = [F.col(f"{name}.{x}").alias(x) for x in ("source", "lang", "topic", "tokens")]
    done = F.struct(*kept, F.col(f"{cell}.multiplier").alias("multiplier"), expected.alias("expected"), copies.alias("copies"))
    return rows.join(fitted, same).select(*docs.columns, done.alias(name))


def sample(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The mix: rows of docs, with its columns, each as often as it is drawn."""
    name = own_name(docs)
    rows = weighted(docs, key, name=name, **how).where(F.col(f"{name}.copies") > 0)
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).drop(name)


def op6_mixing(spark, sf_dir):
    rows = weighted(table(spark, sf_dir, "documents"), name="mix")
    return rows.select("doc_id", "mix.source", "mix.lang", "mix.topic", F.col("mix.tokens").alias("n_tokens"), F.round("mix.expected", 6).alias("expected"), "mix.copies")


def op6_sql(sweeps: int = SWEEPS) -> str:
    less = lambda c: f"(length(text) - length(replace(text, '{c}', '')))"
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
CASE WHEN coalesce(length(text), 0) = 0 THEN 'none' WHEN {less('|')} / length(text) > 0.01 THEN 'tabular'
WHEN {less('<')} / length(text) + {less('{')} / length(text) > 0.005 THEN 'markup'
WHEN (length(text) - length(translate(text, '0123456789', ''))) / length(text) > 0.05 THEN 'numeric'
WHEN (length(text) - length(replace(text, chr(10), ''))) / length(text) > 0.01 THEN 'lines' ELSE 'prose' END AS topic,
CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS n_tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim, power in (("source", SOURCE_POWER), ("lang", LANG_POWER), ("topic", TOPIC_POWER)):
        parts.append(f"p_{dim} AS (SELECT {dim}, pow(sum(tokens), {power}) AS p FROM cells GROUP BY {dim})")
        parts.append(f"t_{dim} AS (SELECT {dim}, p / (SELECT sum(p) FROM p_{dim}) AS t FROM p_{dim})")
    parts.append("w0 AS (SELECT cells.*, tokens AS w, t_source.t AS ts, t_lang.t AS tl, t_topic.t AS tt, (SELECT sum(tokens) FROM cells) AS total FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))")
    n = 0
    for _ in range(sweeps):
        for dim, t in (("source", "ts"), ("lang", "tl"), ("topic", "tt")):
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {dim}) > 0 THEN w * ({t} * total / sum(w) OVER (PARTITION BY {dim})) ELSE w END AS w) FROM w{n})")
            n += 1
    parts.append(f"m AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 1.0 END AS m FROM w{n})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(m * {RATE}, 6) AS expected,
CAST(floor(m * {RATE}) AS BIGINT) + CAST(CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < m * {RATE} - floor(m * {RATE}) AS BIGINT) AS copies
FROM d JOIN m USING (source, lang, topic)"""
