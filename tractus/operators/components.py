"""Connected components of an edge table, by alternating stars.

Each round joins every node's neighbours to the smallest of them: first those
larger than the node (large star), then those not larger (small star).  The
edge set turns into one star per component, centred on the smallest id, in
a number of rounds that grows with the logarithm of the longest path and
not with the path itself.  Minima are aggregates with partial sums in the tasks
and rows come back by a join that adaptive execution can split, so a node
with a third of all edges is not one task's work.  Each round is written to
the shared folder; the round before it is removed.

A round of stars shuffles all edges several times, and long paths take many rounds, so a graph of
more than ``SMALL`` edges is contracted first: every node goes to the neighbour (or itself)
with the smallest hash, by another hash in each round, and edges between the
representatives remain.  In expectation at least a quarter of the nodes goes in each round whatever the graph, so all
rounds together cost a few times the first one.  The labels come back by a join per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tractus.session import materialize, remove_path, scratch_dir

#: Edges from which on a graph is contracted before the stars.
SMALL = 100_000


def _star(pairs: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Join each neighbour v of u with ``keep`` to the smallest of u and its neighbours there."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
    out = pairs.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("_m").alias("b"))
    return out, least


def _large(edges: DataFrame) -> DataFrame:
    out, _ = _star(_both(edges), "v > u")
    return out.where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges come with a > b."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    out, least = _star(down, "v <= u")
    own = least.select(F.col("u").alias("a"), F.col("_m").alias("b"))
    return out.unionAll(own).where("a <> b").distinct()


def _write(e: DataFrame, purpose: str) -> tuple[DataFrame, str, tuple]:
    """The edges (a, b) written and read back, their path, and their number and a sum that tells edge sets apart."""
    spark = e.sparkSession
    path, obs = scratch_dir(spark, purpose), Observation()
    (e.observe(obs, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"))
     .write.mode("overwrite").parquet(path))
    return spark.read.schema(e.schema).parquet(path), path, (obs.get["n"], obs.get["h"])


def _both(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
            .unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))))


def _represent(edges: DataFrame, number: int) -> DataFrame:
    """(u, r) of every node: r is the one of u and its neighbours with the smallest hash of the round."""
    h = lambda c: F.xxhash64(F.lit(number), c)
    near = _both(edges).groupBy("u").agg(F.min(h("v")).alias("_h"), F.min_by("v", h("v")).alias("_m"))
    return near.select("u", F.when(F.col("_h") < h("u"), F.col("_m")).otherwise(F.col("u")).alias("r"))


def _contract(edges: DataFrame, reps: DataFrame) -> DataFrame:
    """The edges between different representatives."""
    moved = (edges.join(reps.select(F.col("u").alias("a"), F.col("r").alias("_a")), "a")
             .join(reps.select(F.col("u").alias("b"), F.col("r").alias("_b")), "b").where("_a <> _b"))
    return moved.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct()


def _stars(e: DataFrame, path: str, state: tuple) -> DataFrame:
    """(id, component) of written edges, by alternating stars."""
    spark = e.sparkSession
    while state[0]:
        before = state
        e, new, state = _write(_small(_large(e)), "components")
        remove_path(spark, path)
        path = new
        if state == before:
            break
    # a star per component: children point to the centre
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()))


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(id, component) of every node of an edge; component = the smallest id
    that is reachable.  Nulls and loops are ignored; edges may repeat and may
    point either way.  No limit on the rounds: the edge set changes in every
    round but the last."""
    spark = edges.sparkSession
    e, path, state = _write(edges.where(f"{a} is not null and {b} is not null and {a} <> {b}")
                            .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "components")
    if state[0] <= small:
        return _stars(e, path, state)
    names = None
    if e.schema["a"].dataType.simpleString() != "bigint":
        # numbers stand for other ids
        names = materialize(_both(e).select(F.col("u").alias("id")).distinct().withColumn("n", F.monotonically_increasing_id()), "nodes")
        numbered = (e.join(names.select(F.col("id").alias("a"), F.col("n").alias("_a")), "a")
                    .join(names.select(F.col("id").alias("b"), F.col("n").alias("_b")), "b")
                    .select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")))
        e, new, state = _write(numbered, "components")
        remove_path(spark, path)
        path = new
    rounds = []
    while state[0] > small:
        rounds.append(materialize(_represent(e, len(rounds)), "representatives"))
        e, new, state = _write(_contract(e, rounds[-1]), "components")
        remove_path(spark, path)
        path = new
    found = _stars(e, path, state)
    for reps in reversed(rounds):
        found = (reps.join(found, reps["r"] == found["id"], "left")
                 .select(reps["u"].alias("id"), F.coalesce("component", "r").alias("component")))
    if names is not None:
        found = names.join(found.withColumnRenamed("id", "n"), "n").select("id", "component")
    found = materialize(found, "components")
    least = found.groupBy("component").agg(F.min("id").alias("_least"))
    return found.join(least, "component").select("id", F.col("_least").alias("component"))
