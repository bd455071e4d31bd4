"""Subgroup interaction with covariates (STA-13): y on x, a group of 0 and 1, their product and covariates, with HC3 errors.

Three passes over the rows, each pre-aggregated by key: moments, the Gram matrix of the scaled design, and the squared residuals
over (1 - leverage), weighted by what a contrast takes from a row. Between them a key is one row: its inverse Gram matrix and
coefficients, which go back to the rows by a join. Leverages and residuals are column expressions, so no key's rows meet in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.scalars import normal_two_sided
from assaylake.operators.blocks import adjusted_p

#: Normal quantile of the interval's upper end, by confidence.
QUANTILE = {0.9: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}
_CONTRASTS = {"slope_0": (1,), "slope_1": (1, 3), "difference": (3,)}


def interaction(df: DataFrame, by: list[str], y: str, x: str, group: str, covariates: list[str] = (), *, least: int = 10, confidence: float = 0.95, family: list[str] = ()) -> DataFrame:
    """by, n, n_0, n_1, unknown, reason; slope_0, slope_1 and difference, each with _se, _low, _high; p of the difference and q over
    the family's keys, unavailable ones included. Rows with a null or a group other than 0 and 1 are unknown: counted, not used.

    reason (null: available): group_too_small, constant_x (in a group), singular_design, no_degrees_of_freedom, unit_leverage."""
    known = F.col(group).isin(0, 1) & F.col(y).isNotNull() & F.col(x).isNotNull()
    for c in covariates:
        known = known & F.col(c).isNotNull()
    number = lambda c: F.when(F.col("ok_"), F.col(c).cast("double"))
    rows = df.withColumn("ok_", F.coalesce(known, F.lit(False))).select(*by, "ok_", number(y).alias("y_"), number(x).alias("x_"), F.when(F.col("ok_"), F.col(group).cast("double")).alias("g_"), *[number(c).alias(f"c{i}_") for i, c in enumerate(covariates)])
    scaled = ["x_", *(f"c{i}_" for i in range(len(covariates)))]
    spread = lambda k: F.stddev_pop(F.when(F.col("g_") == k, F.col("x_")))
    moments = rows.groupBy(*by).agg(
        F.count_if("ok_").alias("n"), F.count_if(F.col("g_") == 0).alias("n_0"), F.count_if(F.col("g_") == 1).alias("n_1"), F.count_if(~F.col("ok_")).alias("unknown"),
        F.avg("y_").alias("my_"), spread(0).alias("s0_"), spread(1).alias("s1_"), *[f(c).alias(f"{tag}{c}") for c in scaled for tag, f in (("m", F.avg), ("s", F.stddev_pop))],
    )
    z = lambda c: (F.col(c) - F.col(f"m{c}")) / F.when(F.col(f"s{c}") > 0, F.col(f"s{c}")).otherwise(1.0)
    design = [F.lit(1.0), z("x_"), F.col("g_"), z("x_") * F.col("g_"), *(z(c) for c in scaled[1:])]
    k = len(design)
    ready = rows.where("ok_").join(moments, by).select(*by, (F.col("y_") - F.col("my_")).alias("y_"), F.array(*design).alias("d_"))
    at = lambda i: F.element_at("d_", i + 1)
    gram = ready.groupBy(*by).agg(F.array(*[F.sum(at(i) * at(j)) for i in range(k) for j in range(i, k)]).alias("gram_"), F.array(*[F.sum(at(i) * F.col("y_")) for i in range(k)]).alias("product_"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)

    def solve(batches):
        upper = np.triu_indices(k)
        for b in batches:
            inverses, betas, singular = [], [], []
            for g, p in zip(b.column(len(by)).to_pylist(), b.column(len(by) + 1).to_pylist()):
                m = np.zeros((k, k))
                m[upper] = g
                m = m + np.triu(m, 1).T
                size = np.sqrt(np.maximum(np.diag(m), 1e-300))
                values = np.linalg.eigvalsh(m / np.outer(size, size))
                bad = bool(values[0] < 1e-10)
                inverse = np.zeros((k, k)) if bad else np.linalg.inv(m / np.outer(size, size)) / np.outer(size, size)
                inverses.append(inverse.ravel()), betas.append(inverse @ np.array(p)), singular.append(bad)
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(by))), pa.array(inverses, floats), pa.array(betas, floats), pa.array(singular, pa.bool_())], [*by, "inverse_", "beta_", "singular_"])

    solved = gram.mapInArrow(solve, f"{fields}, inverse_ array<double>, beta_ array<double>, singular_ boolean")
    of = lambda i, j: F.element_at("inverse_", i * k + j + 1)
    beta = lambda i: F.element_at("beta_", i + 1)
    fit = ready.join(solved, by)
    residual = F.col("y_") - sum((beta(i) * at(i) for i in range(1, k)), beta(0) * at(0))
    leverage = sum((at(i) * at(j) * of(i, j) * (1 if i == j else 2) for i in range(k) for j in range(i, k)), F.lit(0.0))
    fit = fit.withColumns({"e_": residual, "l_": leverage})
    pull = F.col("e_") / F.greatest(1 - F.col("l_"), F.lit(1e-12))
    taken = lambda cs: sum((sum((of(c, j) for c in cs), F.lit(0.0)) * at(j) for j in range(k)), F.lit(0.0))
    errors = fit.groupBy(*by).agg(F.max("l_").alias("most_"), *[F.sqrt(F.sum(F.pow(taken(cs) * pull, 2))).alias(f"{name}_se") for name, cs in _CONTRASTS.items()])
    out = moments.join(solved.drop("inverse_"), by, "left").join(errors, by, "left")
    reason = (
        F.when((F.col("n_0") < least) | (F.col("n_1") < least), "group_too_small").when((F.col("s0_") < 1e-8) | (F.col("s1_") < 1e-8), "constant_x")
        .when(F.col("n") <= k + 2, "no_degrees_of_freedom").when(F.coalesce("singular_", F.lit(True)), "singular_design").when(F.col("most_") >= 1 - 1e-8, "unit_leverage")
    )
    out = out.withColumn("reason", reason)
    free = lambda c: F.when(F.col("reason").isNull(), c)
    columns = {}
    for name, cs in _CONTRASTS.items():
        effect, se = sum((beta(c) for c in cs), F.lit(0.0)) / F.col("sx_"), F.col(f"{name}_se") / F.col("sx_")
        columns |= {name: free(effect), f"{name}_se_": free(se), f"{name}_low": free(effect - QUANTILE[confidence] * se), f"{name}_high": free(effect + QUANTILE[confidence] * se)}
    out = out.withColumns(columns)
    p = F.when(F.col("difference_se_") > 0, normal_two_sided(F.col("difference") / F.col("difference_se_"))).otherwise(F.when(F.col("difference") == 0, 1.0).otherwise(0.0))
    out = out.withColumn("p", free(p)).select(*by, "n", "n_0", "n_1", "unknown", "reason", *[F.col(c + end).alias(c + end.rstrip("_") if end == "_se_" else c + end) for c in _CONTRASTS for end in ("", "_se_", "_low", "_high")], "p")
    sizes = out.groupBy(*family).agg(F.count("*").alias("tests_")) if family else out.agg(F.count("*").alias("tests_"))
    out = out.join(sizes, list(family)) if family else out.join(F.broadcast(sizes))
    return adjusted_p(out, "p", list(family), "tests_").drop("tests_")
