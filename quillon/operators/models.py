"""Models: ridge from aggregated moments, k-means assignment, principal components, entropic transport."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import col, distance, mean_of


def moments(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, i, j, n, sx, sy, sxx, sxy: the sums that a multi-output ridge needs, one row for each pair of features.

    Each task adds up matrix products of its batches, for each key, and passes on P * P sums, P being the feature count.
    """
    chosen = rows.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    fields = ["n", "sx", "sy", "sxx", "sxy"]

    def run(batches):
        total: dict[tuple, list] = {}
        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True)) or [()] * batch.num_rows
            a, b = (np.array(batch.column(len(keys) + i).to_pylist(), np.float64).reshape(batch.num_rows, -1) for i in (0, 1))
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(names):
                groups.setdefault(k, []).append(i)
            for k, at in groups.items():
                u, v = a[at], b[at]
                part = [len(at), u.sum(0), v.sum(0), u.T @ u, u.T @ v]
                total[k] = [p + q for p, q in zip(total[k], part, strict=True)] if k in total else part
        for k, (n, su, sv, uu, uv) in total.items():
            p = len(su)
            i, j = np.divmod(np.arange(p * p), p)
            columns = [pa.array([name] * (p * p), t.type) for name, t in zip(k, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(i), pa.array(j), pa.array(np.full(p * p, n)), pa.array(su[i]), pa.array(sv[j]), pa.array(uu.ravel()), pa.array(uv.ravel())], [*keys, "i", "j", *fields])

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [to_arrow_schema(chosen.schema).field(k) for k in keys]
    named = "".join(f"`{k}` {chosen.schema[k].dataType.simpleString()}, " for k in keys)
    parts = chosen.mapInArrow(run, named + "i long, j long, n long, sx double, sy double, sxx double, sxy double")
    return parts.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in fields])


def fit_ridge(rows: DataFrame, x: str, y: str, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (P, P), mean of x and mean of y: centred multi-output ridge, penalty scaled by the mean diagonal.

    Only the P * P moments reach the driver.
    """
    got = moments(rows, x, y).toPandas()
    p = int(got["i"].max()) + 1
    n = float(got["n"].iloc[0])
    grid = lambda c: got.pivot(index="i", columns="j", values=c).to_numpy()
    mx, my = grid("sx")[:, 0] / n, grid("sy")[0] / n
    xx, xy = grid("sxx") - n * np.outer(mx, mx), grid("sxy") - n * np.outer(mx, my)
    penalty = ridge * (np.trace(xx) / p + 1e-9)
    return np.linalg.solve(xx + penalty * np.eye(p), xy), mx, my


def row_centred(vec: Column | str) -> Column:
    """A row's values less their own mean, which takes out the constant that fills absent places."""
    v, m = col(vec), mean_of(vec)
    return F.transform(v, lambda x: x - m)


def fit_plain_ridge(rows: DataFrame, x: str, y: str, ridge: float) -> np.ndarray:
    """Weights (P, P) without intercept and with the penalty as it is. Only the P * P moments reach the driver."""
    got = moments(rows, x, y).toPandas()
    grid = lambda c: got.pivot(index="i", columns="j", values=c).to_numpy()
    xx = grid("sxx")
    return np.linalg.solve(xx + ridge * np.eye(len(xx)), grid("sxy"))


def predict_linear(rows: DataFrame, x: str, weights: np.ndarray, mean_x: np.ndarray, mean_y: np.ndarray, out: str = "predicted") -> DataFrame:
    """rows with mean_y + (x - mean_x) W, a matrix product for each batch."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType([*rows.schema.fields]).add(out, ArrayType(DoubleType()))
    at = rows.columns.index(x)

    def run(batches):
        for batch in batches:
            values = np.array(batch.column(at).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            found = mean_y + (values - mean_x) @ weights
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.float64()))], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def nearest_centre(rows: DataFrame, centres: DataFrame, group: list[str], vec: str, ident: str) -> DataFrame:
    """group, ident, centre, d: each row's nearest centre of its group, ties to the lower number. centres: group, centre, c.

    Centres are broadcast if there are at most 10,000, else joined by group.
    """
    few = centres.limit(10_001).count() <= 10_000
    d = rows.join(F.broadcast(centres) if few else centres, group).select(*group, ident, "centre", distance(vec, "c").alias("d"))
    return d.groupBy(*group, ident).agg(F.min_by("centre", F.struct(F.round("d", 9), F.col("centre"))).alias("centre"), F.min("d").alias("d"))


def kmeans(rows: DataFrame, vec: str, k: int, seed: int = 1, iterations: int = 25) -> DataFrame:
    """rows with cluster, by the library's distributed k-means."""
    from pyspark.ml.clustering import KMeans

    prepared = rows.withColumn("_v", array_to_vector(vec))
    return KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_v", predictionCol="cluster").fit(prepared).transform(prepared).drop("_v")


def principal_components(rows: DataFrame, vec: str, k: int) -> DataFrame:
    """rows with coords: the first k principal coordinates, each component's largest weight made positive."""
    from pyspark.ml.feature import PCA

    prepared = rows.withColumn("_v", array_to_vector(vec))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(prepared)
    pc = model.pc.toArray()
    sign = np.sign(pc[np.abs(pc).argmax(0), np.arange(k)])
    signs = F.array(*[F.lit(float(s) or 1.0) for s in sign])
    return model.transform(prepared).withColumn("coords", F.zip_with(vector_to_array("_p"), signs, lambda a, b: a * b)).drop("_v", "_p")


def sinkhorn(cost: np.ndarray, epsilon: float, iterations: int = 250) -> np.ndarray:
    """Entropic transport plan between uniform margins, in the log domain so that no kernel entry underflows."""
    n, m = cost.shape
    f, g = np.zeros(n), np.zeros(m)
    k = -cost / epsilon
    lse = lambda a, axis: (top := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis))
    for _ in range(iterations):
        f = -np.log(n) - lse(k + g, 1)
        g = -np.log(m) - lse(k + f[:, None], 0)
    return np.exp(f[:, None] + k + g)


def transport_targets(rows: DataFrame, group: list[str], side: str, vec: str, ident: str, epsilon: float = 0.5, iterations: int = 250) -> DataFrame:
    """group, ident, target: for each row of side 0 its barycentre among side 1's rows under the group's transport plan.

    A group is one task's work: callers cap it first (sampling.first_per_key), as the plan needs all its pairs at once.
    """
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*group, ident))

    def solve(table: pa.Table) -> pa.Table:
        s = np.array(table[side].to_pylist())
        x = np.array(table[vec].to_pylist(), np.float64).reshape(len(s), -1)
        a, b = x[s == 0], x[s == 1]
        own = table.filter(pa.array(s == 0)).select([*group, ident])
        if not len(a) or not len(b):
            return own.slice(0, 0).append_column("target", pa.array([], pa.list_(pa.float64())))
        cost = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
        plan = sinkhorn(np.maximum(cost, 0), epsilon, iterations)
        return own.append_column("target", pa.array(list((plan / plan.sum(1, keepdims=True)) @ b), pa.list_(pa.float64())))

    return rows.groupBy(*group).applyInArrow(solve, f"{kinds}, target array<double>")


def logistic_probe(rows: DataFrame, vec: str, label: str, fold: Column, folds: int) -> DataFrame:
    """fold, n, accuracy of a logistic regression fitted on the other folds."""
    from pyspark.ml.classification import LogisticRegression

    prepared = rows.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label"), fold.alias("fold"))
    out = None
    for i in range(folds):
        model = LogisticRegression(maxIter=50, regParam=0.1).fit(prepared.where(F.col("fold") != i))
        part = model.transform(prepared.where(F.col("fold") == i)).groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out
