"""Local, disjoint groups of cells within contexts (SC-05), as a sequential greedy pass would make them, in parallel rounds.

A context is a donor, a type and what else may not be mixed. A cell's neighbours are the nearest of its context, itself first:
contexts are packed into blocks of BLOCK cells, blocks of a context meet pairwise as one matrix product, and the nearest of a
block are merged by cell; no pair of cells becomes a row but the nearest. The radius is a quantile, over the cells of training donors, of the
distance to the last cell of a full group. Candidates of a cell are its neighbours within the radius.

Seeds are ordered by how many candidates they have, then by cell: thin neighbourhoods first. In that order a seed takes its
nearest free candidates, `size` at most, if there are `smallest` of them. A round decides every seed that is least among the
undecided ones that want any of its free candidates: nothing decided later can matter to it, so the result is the sequential
one, and a context's seeds are not one task's work. The number of rounds is the longest chain of seeds that wait for each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.graph import _written

BLOCK = 2048


def local_space(cells: DataFrame, vector: str, train: Column, components: int) -> DataFrame:
    """cells with z: principal components of the standardised vectors, both fitted on the training rows only."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = cells.withColumn("v_", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(inputCol="v_", outputCol="s_", withMean=True, withStd=True).fit(rows.where(train))
    scaled = scaler.transform(rows)
    pca = PCA(k=components, inputCol="s_", outputCol="p_").fit(scaled.where(train))
    return pca.transform(scaled).withColumn("z", vector_to_array("p_")).drop("v_", "s_", "p_")


def nearest(cells: DataFrame, context: list[str], cell: str, z: str, k: int) -> DataFrame:
    """context, cell, other, distance, place (from 1): the k nearest cells of a cell's context, ties by cell, itself at distance 0."""
    nb, kind = len(context), cells.schema[cell].dataType.simpleString()
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*context).schema)

    def pack(batches):
        key, names, rows, types = None, [], [], None

        def block():
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types)), pa.array([names], pa.list_(types[-1])), pa.array([np.stack(rows).tobytes()], pa.binary())], [*context, "names", "rows"])

        for b in batches:
            types = [b.column(i).type for i in range(nb + 1)]
            for own, name, v in zip(zip(*(b.column(i).to_pylist() for i in range(nb))), b.column(nb).to_pylist(), b.column(nb + 1)):
                if names and (own != key or len(names) == BLOCK):
                    yield block()
                    names, rows = [], []
                key = own
                names.append(name), rows.append(v.values.to_numpy(zero_copy_only=False).astype(float))
        if names:
            yield block()

    ready = cells.select(*context, cell, F.col(z).cast("array<double>").alias("z_")).repartition(*context, F.pmod(F.xxhash64(cell), F.lit(64))).sortWithinPartitions(*context)
    blocks = ready.mapInArrow(pack, f"{keys}, names array<{kind}>, rows binary")
    met = blocks.join(blocks.withColumnsRenamed({"names": "others", "rows": "other_rows"}).hint("merge"), context).select(*context, "names", "others", "rows", "other_rows")

    def near(batches):
        for b in batches:
            for i in range(b.num_rows):
                who, whom = b.column(nb)[i].values, b.column(nb + 1)[i].values
                x, y = (np.frombuffer(b.column(nb + j)[i].as_py()).reshape(n, -1) for j, n in ((2, len(who)), (3, len(whom))))
                d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)
                # The product loses digits: those that may be among the k nearest are measured again, exactly.
                m = min(k, len(whom))
                bar = np.partition(d, m - 1, axis=1)[:, m - 1]
                row, column = np.nonzero(d <= (bar + 1e-9 * (1 + bar))[:, None])
                exact = np.sqrt(((x[row] - y[column]) ** 2).sum(1))
                group = [pa.array([b.column(j)[i].as_py()] * len(row), b.column(j).type) for j in range(nb)]
                yield pa.RecordBatch.from_arrays([*group, who.take(pa.array(row)), whom.take(pa.array(column)), pa.array(exact)], [*context, cell, "other", "distance"])

    found = met.mapInArrow(near, f"{keys}, `{cell}` {kind}, other {kind}, distance double")
    place = F.row_number().over(Window.partitionBy(*context, cell).orderBy(F.col("other") != F.col(cell), "distance", "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def disjoint_groups(cells: DataFrame, context: list[str], cell: str, z: str, train: Column, *, size: int = 5, smallest: int = 3, quantile: float = 0.9, multiplier: int = 4) -> tuple[DataFrame, float]:
    """context, cell, seed (null: in no group) and the radius. cell: unique, not null; train: the rows of training donors."""
    near = _written(nearest(cells, context, cell, z, size * multiplier), "group-near")
    fitted = near.where(F.col("place") == size).join(cells.where(train).select(cell).hint("merge"), cell, "left_semi")
    radius = fitted.agg(F.percentile("distance", quantile)).first()[0]
    if radius is None:
        raise ValueError("no training context has a full group's cells")
    wanted = near.where((F.col("distance") <= max(radius, 1e-12)) | (F.col("place") == 1))
    counts = wanted.groupBy(cell).agg(F.count("*").alias("c_"))
    turn = F.struct("c_", F.col(cell).alias("seed")).alias("turn")
    live = _written(wanted.join(counts.hint("merge"), cell).select(turn, F.col("other").alias("cell_"), "place"), "group-live")
    taken = None
    while not live.isEmpty():
        first = live.groupBy("cell_").agg(F.min("turn").alias("first_")).hint("merge")  # a round sends no table to the driver
        ready = live.join(first, "cell_").groupBy("turn").agg(F.min((F.col("turn") == F.col("first_")).cast("int")).alias("ready"), F.count("*").alias("free")).where("ready = 1")
        chosen = live.join(ready.hint("merge"), "turn").withColumn("at_", F.row_number().over(Window.partitionBy("turn").orderBy("place"))).where((F.col("at_") <= size) & (F.col("free") >= smallest))
        chosen = _written(chosen.select("cell_", F.col("turn.seed").alias("seed")), "group-chosen")
        taken = chosen if taken is None else taken.unionAll(chosen)
        rest = live.join(ready.select("turn").hint("merge"), "turn", "left_anti")
        used = chosen.select(F.col("cell_").alias("used_")).hint("merge")
        rest = rest.join(used, rest["cell_"] == used["used_"], "left_anti")
        # A seed that is used itself is out.
        gone = chosen.select(F.col("cell_").alias("gone_")).hint("merge")
        live = _written(rest.join(gone, rest["turn.seed"] == gone["gone_"], "left_anti"), "group-live")
    own = cells.select(*context, cell)
    if taken is None:
        return own.withColumn("seed", F.lit(None).cast(cells.schema[cell].dataType)), radius
    return own.join(taken.hint("merge"), own[cell] == taken["cell_"], "left").drop("cell_"), radius
