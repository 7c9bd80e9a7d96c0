"""Centroid clustering (k-means in whole numbers) with an incremental distance matrix.

Components are turned to integers, so all sums and products are exact and the
result does not depend on how rows are laid out.  Every vector keeps its dot product
with every centroid beside its components, in a table of the shared folder.  A
round adds up the vectors of each cluster (sums per slice of rows first, then one
row per cluster), moves the centroids to the floor of the means, and adds to
each dot product only what the changed components of that centroid contribute.
The nearest centroid is then the least |c|^2 - 2 v.c, without another look at the
other components.  The driver holds the centroids alone: as many
as asked for, whatever the table.

Cases: vectors that are null, of another length, or hold a null or non-finite
component are left out; repeated rows are vectors of their own; a vector without an
id takes part but is no first centroid; with fewer vectors than centroids asked
for every vector with an id is a first centroid, and a table without any gives no
row; equal distances go to the smaller number; an empty cluster keeps its centroid.
Components of more than 2^27 after scaling count as 2^27, so that every product fits
64 bits.  Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractus.session import remove_path, scratch_dir

LENGTH, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256.0
LARGEST, MOST = 1 << 27, (1 << 63) - 1
#: Rows handled at once in a task.
ROWS = 8192


def whole_vectors(vectors: DataFrame, length: int = LENGTH, scale: float = SCALE, id_col: str = "vec_id",
                  vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<int>): floor(scale * component) of the usable vectors."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    usable = (F.size(vector_col) == length) & F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c))
    limit = F.lit(float(LARGEST))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, limit), -limit)).cast("int"))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def first_centroids(kept: DataFrame, clusters: int, order: Column) -> np.ndarray:
    """The vectors with the smallest ``order``; equal ones by id, then by components."""
    rows = kept.where("vec_id is not null").orderBy(order, "vec_id", "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in 64-bit integers, by way of doubles where none of their sums can round."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64)


@dataclass(frozen=True)
class Change:
    """From one set of centroids to the next."""
    old: np.ndarray | None
    new: np.ndarray

    def apply(self, v: np.ndarray, dots: np.ndarray | None) -> np.ndarray:
        if self.old is None:
            return exact_products(v, self.new.T)
        delta = self.new - self.old
        dots = dots.copy()
        for k in np.flatnonzero(delta.any(axis=1)):
            at = np.flatnonzero(delta[k])
            dots[:, k] += exact_products(v[:, at], delta[k, at][:, None])[:, 0]
        return dots

    def nearest(self, v: np.ndarray, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of every vector."""
        rest = (self.new * self.new).sum(axis=1)[None] - 2 * dots
        cluster = rest.argmin(axis=1)
        return cluster, rest[np.arange(len(v)), cluster] + (v * v).sum(axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(at, pa.array(m.ravel()).cast(kind))


def _moved(table: DataFrame, change: Change) -> DataFrame:
    """The table (vec_id, v, dots, cluster, distance) under the new centroids."""
    k, length = change.new.shape
    started = "dots" in table.columns

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v = _matrix(b.column("v"), length)
                dots = change.apply(v, _matrix(b.column("dots"), k) if started else None)
                cluster, distance = change.nearest(v, dots)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), _lists(dots, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "v", "dots", "cluster", "distance"])

    columns = ["vec_id", "v", *(["dots"] if started else [])]
    return table.select(*columns).mapInArrow(run, "vec_id long, v array<int>, dots array<long>, cluster int, distance long")


def _cluster_sums(table: DataFrame, k: int, length: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, component sums)}: slices are added up in the tasks first."""
    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, length), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                cluster = b.column("cluster").to_numpy()
                order = np.argsort(cluster, kind="stable")
                v, present = _matrix(b.column("v"), length)[order], np.unique(cluster)
                sums[present] += np.add.reduceat(v, np.searchsorted(cluster[order], present), axis=0)
                count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(sums[some, j]) for j in range(length))],
                names=["cluster", "n", *(f"s{j}" for j in range(length))])

    names = ["n", *(f"s{j}" for j in range(length))]
    parts = table.select("cluster", "v").mapInArrow(run, "cluster int, " + ", ".join(f"{c} long" for c in names))
    # decimals: a component's sum over all vectors may pass 64 bits
    total = parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in names])
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{j}"]) for j in range(length)]) for r in total.collect()}


def cluster_vectors(kept: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), final centroids) after ``rounds`` rounds and a last assignment.

    Each round reads the table of the round before and writes its own; the older one is removed."""
    spark, path = kept.sparkSession, None
    change, table = Change(None, first), kept
    for r in range(rounds + 1):
        moved, before, path = _moved(table, change), path, scratch_dir(spark, "dot-products")
        moved.write.mode("overwrite").parquet(path)
        table = spark.read.schema(moved.schema).parquet(path)
        if before is not None:
            remove_path(spark, before)
        if r < rounds:
            new = change.new.copy()
            for k, (n, sums) in _cluster_sums(table, *first.shape).items():
                new[k] = [s // n for s in sums]
            change = Change(change.new, new)
    return table.select("vec_id", "cluster", "distance"), change.new


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(vectors: DataFrame, n: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, seed: int = 2) -> DataFrame:
    """The columns of the registered query: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, length)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = first_centroids(kept, n, order)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table, final = cluster_vectors(kept, first, rounds)
    # one row per cluster
    per = {r["cluster"]: int(r["d"]) for r in
           table.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    total = sum(per.values())
    side = spark.createDataFrame([(k, min(d, MOST), min(total, MOST), centroid_hash(final[k])) for k, d in per.items()],
                                 "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(side), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
