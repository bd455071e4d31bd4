"""Combined p-values against Monte-Carlo nulls of a Gaussian copula, one null a pattern of available readouts.

A relation's statistic is the weighted sum of -2 ln p over its available readouts; readouts of one group share a weight of one.
How it is calibrated depends on the pattern of readouts alone:

exact       one readout: its p
bonferroni  a pair's dependence is unknown: k times the least p, 1 at most
duplicate   all pairs are fully dependent: the weighted geometric mean of p
empirical   otherwise: (1 + draws that reach the statistic) / (1 + draws)

The draws of a pattern are correlated normals: independent ones, times a factor of the pattern's correlations (the nearest that
are positive semidefinite, with unit variances). An independent normal comes from a hash of seed, draw and readout, so the null is the
same for any partitioning and any other pattern's presence. A pattern's sorted null is made by one task, holds `draws` numbers,
and travels ahead of the relations it judges, once for each of SALTS: many relations of one pattern are dealt to many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32
TINY = np.finfo(float).tiny
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normals(seed: int, readout: str, draws: int) -> np.ndarray:
    """Standard normals 0 to draws - 1 of a readout."""
    with np.errstate(over="ignore"):
        key = _mixed(np.array([xxhash.xxh64_intdigest(readout, seed)], np.uint64))
        at = np.arange(draws, dtype=np.uint64) * np.uint64(2)
        u, v = ((_mixed(_mixed(at + np.uint64(k)) ^ key) >> np.uint64(11)).astype(float) + 0.5 for k in (0, 1))
    return np.sqrt(-2 * np.log(u / 2**53)) * np.cos(2 * math.pi * v / 2**53)


def factor(r: np.ndarray) -> np.ndarray:
    """A matrix whose product with its transpose is the nearest correlation matrix to r, negative eigenvalues set to zero."""
    values, vectors = np.linalg.eigh(r)
    fixed = (vectors * np.clip(values, 0, None)) @ vectors.T
    size = np.sqrt(np.diag(fixed))
    values, vectors = np.linalg.eigh(fixed / size[:, None] / size)
    return vectors * np.sqrt(np.clip(values, 0, None))


def weights(groups: list[str]) -> np.ndarray:
    return np.array([1 / groups.count(g) for g in groups])


def null(readouts: list[str], groups: list[str], r: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """The sorted null statistics of a pattern."""
    g = np.column_stack([normals(seed, name, draws) for name in readouts]) @ factor(r).T
    p = np.maximum(_erfc(np.abs(g) / math.sqrt(2)).astype(float), TINY)
    return np.sort(-2 * np.log(p) @ weights(groups))


def empirical_fisher(pvalues: DataFrame, dependence: DataFrame, relation: str, readout: str, group: str, p: str, draws: int = 100_000, seed: int = 1) -> DataFrame:
    """relation, k, p, method. pvalues: a row a relation and readout (null p: not available), group: readouts that are duplicates;
    dependence: a, b, rho (a pair once, in any order). A relation without a readout has a null p and the method unavailable;
    of repeated rows the least p counts. p outside 0 and 1 is an error."""
    own = pvalues.groupBy(relation, readout).agg(F.min(p).alias("p_"), F.min(F.col(group).cast("string")).alias("g_"))
    fine = F.when(F.col("p_").isNull() | F.isnan("p_"), F.lit(None)).when((F.col("p_") >= 0) & (F.col("p_") <= 1), F.col("p_")).otherwise(F.raise_error(F.lit("p out of range")).cast("double"))
    own = own.withColumn("p_", fine)
    listed = F.array_sort(F.filter(F.collect_list(F.struct(F.col(readout).cast("string").alias("r"), "g_", "p_")), lambda x: x["p_"].isNotNull()))
    rows = own.groupBy(relation).agg(listed.alias("x_"))
    rows = rows.select(relation, F.transform("x_", lambda x: x["r"]).alias("names_"), F.transform("x_", lambda x: x["g_"]).alias("groups_"), F.transform("x_", lambda x: x["p_"]).alias("ps_"))
    patterns = rows.select("names_", "groups_").distinct().where(F.size("names_") > 1)
    pairs = patterns.select("names_", "groups_", F.explode("names_").alias("a"), "names_").toDF("names_", "groups_", "a", "more_").select("names_", "groups_", "a", F.explode("more_").alias("b")).where("a < b")
    known = dependence.select(F.least(F.col("a").cast("string"), F.col("b").cast("string")).alias("a"), F.greatest(F.col("a").cast("string"), F.col("b").cast("string")).alias("b"), F.col("rho").cast("double").alias("rho")).dropDuplicates(["a", "b"])
    matrix = pairs.join(known, ["a", "b"], "left").groupBy("names_", "groups_").agg(F.array_sort(F.collect_list(F.struct("a", "b", "rho"))).alias("m_"))

    def nulls(batches):
        for b in batches:
            methods, made = [], []
            for names, groups, m in zip(*(c.to_pylist() for c in b.columns)):
                r = np.eye(len(names))
                for x in m:
                    i, j = names.index(x["a"]), names.index(x["b"])
                    r[i, j] = r[j, i] = np.nan if x["rho"] is None else x["rho"]
                method = "bonferroni" if np.isnan(r).any() else "duplicate" if (np.abs(r) >= 1 - 1e-12).all() else "empirical"
                methods.append(method)
                made.append(null(names, groups, r, draws, seed) if method == "empirical" else np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(methods, pa.string()), pa.array(made, pa.list_(pa.float64()))], ["names_", "groups_", "method_", "null_"])

    spread = matrix.repartition("names_", "groups_").mapInArrow(nulls, "names_ array<string>, groups_ array<string>, method_ string, null_ array<double>")
    ahead = spread.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt_", F.pmod(F.xxhash64(relation), F.lit(SALTS)).cast("int")).unionByName(ahead, allowMissingColumns=True)
    dealt = dealt.withColumn("judged_", F.col("method_").isNull()).repartition("names_", "groups_", "salt_").sortWithinPartitions("names_", "groups_", "judged_")
    kind = pvalues.schema[relation].dataType.simpleString()

    def judged(batches):
        pattern, method, sorted_null, w = None, None, np.zeros(0), np.zeros(0)
        for b in batches:
            out = []
            for i, (names, groups, ps, is_row) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 6)))):
                if not is_row:
                    if pattern != (names, groups):
                        pattern, method, sorted_null, w = (names, groups), b.column(4)[i].as_py(), b.column(5)[i].values.to_numpy(), weights(groups)
                    continue
                k = len(ps)
                if k < 2:
                    out.append((i, k, ps[0] if k else None, "exact" if k else "unavailable"))
                    continue
                logs = np.log(np.maximum(ps, TINY))
                if method == "bonferroni":
                    value = min(1.0, k * min(ps))
                elif method == "duplicate":
                    value = float(np.exp(logs @ w / w.sum()))
                else:
                    value = (1 + len(sorted_null) - int(np.searchsorted(sorted_null, -2 * logs @ w))) / (1 + len(sorted_null))
                out.append((i, k, value, method))
            at, ks, values, methods = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ks, pa.int32()), pa.array(values, pa.float64()), pa.array(methods, pa.string())], [relation, "k", "p", "method"])

    return dealt.select(relation, "names_", "groups_", "ps_", "method_", "null_", "judged_").mapInArrow(judged, f"`{relation}` {kind}, k int, p double, method string")
