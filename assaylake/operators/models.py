"""Models on pyspark.ml, grids over validation rows, and moment-based cross-fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.stats import binary_metrics


def hashed_logistic(df: DataFrame, features: list[str], label: str, train, validation, width: int, grid: tuple[float, ...], l1: bool, weight: str | None = None):
    """FeatureHasher and elastic-net logistic regression; the penalty with the best validation precision. Gives scored rows and the penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import FeatureHasher
    from pyspark.ml.functions import vector_to_array

    hashed = FeatureHasher(inputCols=features, outputCol="features_", numFeatures=width).transform(df)
    best = None
    judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderPR")
    for penalty in grid:
        fit = LogisticRegression(featuresCol="features_", labelCol=label, regParam=penalty, elasticNetParam=1.0 if l1 else 0.0, maxIter=30, **({"weightCol": weight} if weight else {})).fit(hashed.where(train))
        value = judge.evaluate(fit.transform(hashed.where(validation)))
        if best is None or value > best[0]:
            best = (value, penalty, fit)
    scored = best[2].transform(hashed).withColumn("probability_", vector_to_array("probability")[1])
    return scored.drop("features_", "rawPrediction", "probability", "prediction"), best[1]


def ridge_out_of_fold(df: DataFrame, features: list[str], target: str, fold: str, k: int, penalty: float) -> DataFrame:
    """Predictions of each fold by a ridge fitted on the others."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    ready = VectorAssembler(inputCols=features, outputCol="features_").transform(df)
    out = None
    for f in range(k):
        fit = LinearRegression(featuresCol="features_", labelCol=target, regParam=penalty, elasticNetParam=0.0).fit(ready.where(F.col(fold) != f))
        part = fit.transform(ready.where(F.col(fold) == f)).drop("features_")
        out = part if out is None else out.unionByName(part)
    return out


def fold_slopes(df: DataFrame, by: list[str], fold: str, x: str, y: str) -> DataFrame:
    """Univariate regression per key and held-out fold from the moments of the other folds: totals minus the fold's own."""
    own = df.groupBy(*by, fold).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by)
    less = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "x", "y", "xx", "xy")}
    m = own.select(*by, fold, *[v.alias(c) for c, v in less.items()])
    var = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    slope = F.when((F.col("n") > 2) & (var > 1e-9), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / var)
    return m.select(*by, fold, "n", slope.alias("slope"), F.when(F.col("n") > 0, (F.col("y") - slope * F.col("x")) / F.col("n")).alias("intercept"))


def temperature(df: DataFrame, logit: str, label: str, low: float = 0.25, high: float = 4.0, steps: int = 16, rounds: int = 3) -> DataFrame:
    """temperature, nll: grid search of the mean negative log likelihood, refined around the best; one row."""
    best = None
    for _ in range(rounds):
        grid = F.explode(F.array(*[F.lit(low + (high - low) * i / steps) for i in range(steps + 1)]))
        z = F.col(logit) / F.col("temperature")
        nll = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col(label)
        scored = df.select(logit, label, grid.alias("temperature")).groupBy("temperature").agg(F.avg(nll).alias("nll"))
        best = scored.orderBy(F.round("nll", 12), "temperature").limit(1)
        at, width = best.first().temperature, (high - low) / steps
        low, high = max(1e-3, at - width), at + width
    return best


def blend_weight(df: DataFrame, base: str, residual: str, label: str, grid: tuple[float, ...], slack: float) -> DataFrame:
    """The weight of a residual score with the best validation AUROC whose Brier score is no worse than the base's by more than `slack`."""
    rows = df.withColumn("weight", F.explode(F.array(*[F.lit(float(g)) for g in (0.0, *grid)]))).withColumn("score_", F.least(F.greatest(F.col(base) + F.col("weight") * F.col(residual), F.lit(0.0)), F.lit(1.0)))
    m = binary_metrics(rows, ["weight"], label, "score_")
    guard = m.where("weight = 0").select(F.col("brier").alias("base_brier"))
    return m.join(F.broadcast(guard)).where(F.col("brier") <= F.col("base_brier") + slack).orderBy(F.desc(F.round("auroc", 9)), "weight").limit(1).select("weight", "auroc", "brier")


def modules(df: DataFrame, vector: str, key: str, components: int, k: int, seed: int = 7) -> DataFrame:
    """key, module: principal components, then k-means; modules are numbered by size and least key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window

    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    p = PCA(k=components, inputCol="v", outputCol="p").fit(v).transform(v)
    out = KMeans(k=k, seed=seed, featuresCol="p", predictionCol="c").fit(p).transform(p).select(key, "c")
    order = out.groupBy("c").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    order = order.withColumn("module", F.row_number().over(Window.orderBy(F.desc("n"), "first")))
    return out.join(F.broadcast(order), "c").select(key, "module", F.col("n").alias("size"))
