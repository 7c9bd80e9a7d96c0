"""Embedding near-duplicates: an exact metric range join.

Angles between vectors are a metric.  Pivots partition the vectors.  They form a tree of two
levels, made of a bounded sample: a vector goes to its nearest top pivot, then to the
nearest leaf below it, whose cell is its own.  If u lies within the range r of v, the triangle
inequality gives angle(u, p) <= angle(u, q) + 2 r for v's pivot p and any other pivot q that v
was compared with, and angle(u, p) <= radius(p) + r.  Both hold for tops and for the leaves
below a top, so a vector is replicated to just the leaves that pass on either level, without being
compared with the others.  So every link of a vector is found in its own cell,
and cells are joined independently of each other, each cut into blocks of own
rows that meet all the cell's rows as a stream.  Equal vectors are joined once.
The sample has a pivot per 4,096 vectors within ``PIVOT_BYTES`` (65,536 pivots of 64 numbers, that is
268 million vectors); beyond that the cells grow and have more blocks.

A block counts the links of its rows and emits links for a spanning forest only,
so that a group of near copies does not give all its pairs.  Candidates are
found in single precision with a margin; those within the margin of the limit
are decided by the cosine in double precision.

Vectors without neighbours whose angles to all pivots are alike are replicated
to all cells: there the join is a block-wise comparison of all vectors.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers
link with nothing and are their own component; vectors of different
lengths never link; repeated rows link with each other; rows with a null
id are returned without links and without a component; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import materialize, shuffle_width
from tractus.operators.components import components

COSINE = 0.9
#: Rows of a block, and vectors per pivot.
BLOCK = 4096
#: Pivots of all vector lengths together take at most this many bytes (and one pivot per length).
PIVOT_BYTES = 32 << 20
STREAM = 1024
MARGIN = 1e-4
#: Added to angles that are compared: arc cosines near 0 are exact to about 2e-8.
SLACK = 1e-7


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Equal-length lists as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


class _Tree:
    """Pivots of one vector length in two levels: tops, and leaves below their nearest top.
    The leaves are the cells; ``start[t]`` to ``start[t + 1]`` are those of top t."""

    def __init__(self, sample: np.ndarray):
        leaves = _unit(sample)
        tops = leaves[:math.ceil(math.sqrt(len(leaves)))]
        of = _angles(leaves, tops).argmin(1)
        # a top that points where an earlier one does has no leaves and goes
        kept, of = np.unique(of, return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.tops, self.leaves = tops[kept], leaves[order]
        self.start = np.searchsorted(of[order], np.arange(len(kept) + 1))
        self.top_of = of[order]

    def home(self, x: np.ndarray):
        """(leaf, angle to it, angle to its top) by descent."""
        units = _unit(x)
        t = _angles(units, self.tops)
        top = t.argmin(1)
        leaf, near = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for k in np.unique(top):
            at = np.flatnonzero(top == k)
            below = _angles(units[at], self.leaves[self.start[k]:self.start[k + 1]])
            leaf[at] = self.start[k] + below.argmin(1)
            near[at] = below.min(1)
        return leaf, near, t[np.arange(len(x)), top]

    def meets(self, x: np.ndarray, radius: np.ndarray, top_radius: np.ndarray, limit: float):
        """(row, leaf): the cells that may hold a row's neighbours, by the two conditions on
        either level."""
        units = _unit(x)
        t = _angles(units, self.tops)
        open_ = (t <= t.min(1, keepdims=True) + 2 * limit + SLACK) & (t <= top_radius + limit + SLACK)
        rows, cells = [], []
        for k in np.flatnonzero(open_.any(0)):
            at, low, high = np.flatnonzero(open_[:, k]), self.start[k], self.start[k + 1]
            below = _angles(units[at], self.leaves[low:high])
            i, j = np.nonzero((below <= below.min(1, keepdims=True) + 2 * limit + SLACK)
                              & (below <= radius[low:high] + limit + SLACK))
            rows.append(at[i])
            cells.append(low + j)
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64),) * 2


def valid(column: str = "embedding"):
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))
                      & (F.abs(v.cast("double")) != float("inf")))
    return (F.col(column).isNotNull() & (F.size(column) > 0) & finite
            & F.exists(column, lambda v: v != 0))


def _near_pivot(classes: DataFrame, trees: dict[int, _Tree]) -> DataFrame:
    """(rep, w, x, dim, cell, near, near_top): the own cell, the angles to its pivot and to the pivot above."""
    shared = classes.sparkSession.sparkContext.broadcast(trees)
    x_type = dict(classes.dtypes)["x"]

    def run(batches):
        for b in batches:
            dims = b.column(3).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                cell, near, top = shared.value[int(d)].home(_matrix(part.column(2)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(near), pa.array(top)],
                    names=["rep", "w", "x", "dim", "cell", "near", "near_top"])

    return classes.mapInArrow(run, f"rep long, w long, x {x_type}, dim int, cell int, near double, near_top double")


def _targets(home: DataFrame, trees: dict[int, _Tree], radius: dict, top_radius: dict, blocks: dict,
             limit: float) -> DataFrame:
    """(rep, w, x, dim, cell, block, own): own rows of each block, then all
    rows that the cell's blocks meet."""
    shared = home.sparkSession.sparkContext.broadcast((trees, radius, top_radius, blocks))
    x_type = dict(home.dtypes)["x"]

    def run(batches):
        tree, rad, top_rad, blk = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, STREAM):
                b = whole.slice(start, STREAM)
                dims = b.column(3).to_numpy()
                for d in np.unique(dims):
                    part = b.filter(pa.array(dims == d))
                    d = int(d)
                    row, cell = tree[d].meets(_matrix(part.column(2)), rad[d], top_rad[d], limit)
                    n = blk[d][cell]
                    row, cell = row.repeat(n), cell.repeat(n)
                    block = np.concatenate([np.arange(k) for k in n]) if len(n) else np.zeros(0, np.int64)
                    own_cell = part.column(4).to_numpy()
                    rep = part.column(0).to_numpy()
                    own_block = (rep * 0x9E3779B1 >> 7) % blk[d][own_cell]
                    row = np.concatenate([np.arange(len(rep)), row])
                    out = part.select([0, 1, 2, 3]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(np.concatenate([own_cell, cell]).astype(np.int32)),
                         pa.array(np.concatenate([own_block, block]).astype(np.int32)),
                         pa.array(np.concatenate([np.ones(len(rep)), np.zeros(len(cell))]).astype(bool))],
                        names=["rep", "w", "x", "dim", "cell", "block", "own"])

    return home.mapInArrow(run, f"rep long, w long, x {x_type}, dim int, cell int, block int, own boolean")


class _Block:
    """Own rows of a block: links counted, forest links emitted."""

    def __init__(self, cosine: float):
        self.cosine, self.rep, self.w, self.x = cosine, [], [], []
        self.ready = False

    def add(self, rep, w, x):
        self.rep.append(rep)
        self.w.append(w)
        self.x.append(x)

    def _fix(self):
        self.rep, self.w = np.concatenate(self.rep), np.concatenate(self.w)
        self.x = np.concatenate(self.x)
        self.u = _unit(self.x)
        self.u32 = self.u.astype(np.float32)
        self.links = self.w - 1    # its own copies
        self.label = np.arange(len(self.rep))
        self.ready = True

    def meet(self, rep, w, x):
        """Links (a, b) between rows of the stream and the block."""
        if not self.ready:
            self._fix()
        u = _unit(x)
        s = u.astype(np.float32) @ self.u32.T
        hit = s >= self.cosine + MARGIN
        i, j = np.nonzero(~hit & (s >= self.cosine - MARGIN))
        if len(i):
            a, b = x[i], self.x[j]
            exact = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
            hit[i, j] = exact >= self.cosine
        at = np.flatnonzero(np.isin(rep, self.rep))   # a row does not link with itself
        if len(at):
            order = np.argsort(self.rep)
            hit[at, order[np.searchsorted(self.rep, rep[at], sorter=order)]] = False
        self.links += w @ hit
        a, b = [], []
        for r in np.flatnonzero(hit.any(1)):
            cols = np.flatnonzero(hit[r])
            a.append(rep[r])
            b.append(self.rep[cols[0]])
            labels = np.unique(self.label[cols])
            if len(labels) > 1:
                for other in labels[1:]:
                    a.append(rep[r])
                    b.append(self.rep[cols[np.flatnonzero(self.label[cols] == other)[0]]])
                self.label[np.isin(self.label, labels)] = labels[0]
        return a, b


def _join_cells(cosine: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        key, block = None, None

        def close():
            if block is not None and len(block.rep):   # the hash may leave a block without own rows
                if not block.ready:
                    block._fix()
                yield pa.RecordBatch.from_pydict({"a": block.rep, "b": [None] * len(block.rep), "n": block.links},
                                                 schema=schema)

        for whole in batches:
            for start in range(0, whole.num_rows, STREAM):
                b = whole.slice(start, STREAM)
                keys = list(zip(*(b.column(c).to_pylist() for c in (3, 4, 5, 6))))
                at = 0
                while at < len(keys):
                    stop = at
                    while stop < len(keys) and keys[stop] == keys[at]:
                        stop += 1
                    part = b.slice(at, stop - at)
                    rows = (part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2)))
                    if keys[at][:3] != key:
                        yield from close()
                        key, block = keys[at][:3], _Block(cosine)
                    if keys[at][3]:
                        block.add(*rows)
                    elif len(block.rep):
                        a, z = block.meet(*rows)
                        if a:
                            yield pa.RecordBatch.from_pydict({"a": a, "b": z, "n": [None] * len(a)}, schema=schema)
                    at = stop
        yield from close()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x"))
    good = materialize(rows.where(valid("x") & F.col("vec_id").isNotNull()), "vectors")
    classes = materialize(good.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
                          .select("rep", "w", "x", F.size("x").alias("dim")), "vector-classes")
    of_vec = good.join(classes.select("x", "rep"), "x").select("vec_id", "rep")

    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees, total = {}, sum(sizes.values())
    for d, n in sizes.items():
        most = max(1, int(PIVOT_BYTES * n / total) // (8 * d))
        got = (classes.where(F.col("dim") == d).orderBy(F.xxhash64(F.lit(3), "rep"), "rep")
               .limit(min(-(-n // BLOCK), most)).select("x").collect())
        trees[d] = _Tree(np.array([r["x"] for r in got], dtype=np.float64))
    limit = float(np.arccos(cosine))
    home = materialize(_near_pivot(classes, trees), "vector-cells")
    radius = {d: np.full(len(t.leaves), -np.inf) for d, t in trees.items()}
    top_radius = {d: np.full(len(t.tops), -np.inf) for d, t in trees.items()}
    blocks = {d: np.zeros(len(t.leaves), dtype=np.int64) for d, t in trees.items()}
    for r in (home.groupBy("dim", "cell").agg(F.max("near").alias("r"), F.max("near_top").alias("top"), F.count(F.lit(1)).alias("n"))
              .collect()):
        d, cell = r["dim"], r["cell"]
        radius[d][cell] = r["r"]
        blocks[d][cell] = -(-r["n"] // BLOCK)
        top = trees[d].top_of[cell]
        top_radius[d][top] = max(top_radius[d][top], r["top"])
    laid = (_targets(home, trees, radius, top_radius, blocks, limit)
            .repartition(shuffle_width(spark), "dim", "cell", "block")
            .sortWithinPartitions("dim", "cell", "block", F.desc("own")))
    found = materialize(laid.mapInArrow(_join_cells(cosine), "a long, b long, n long"), "vector-links")
    comp = components(found.where("b is not null").select("a", "b"))
    per_class = (found.where("b is null").select(F.col("a").alias("rep"), F.col("n").alias("n_links"))
                 .join(comp, F.col("rep") == F.col("id"), "left")
                 .select("rep", "n_links", F.coalesce("component", "rep").alias("component_id")))
    linked = of_vec.join(per_class, "rep").select("vec_id", "n_links", "component_id")
    alone = (rows.where(~F.coalesce(valid("x"), F.lit(False)) | F.col("vec_id").isNull())
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
