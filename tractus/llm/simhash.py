"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes of word shingles.  Two of them within four
differing bits agree wholly on at least two of six bit blocks, so each distinct
fingerprint goes to fifteen groups, one per pair of blocks: a group is a shared
masked bit pattern, the uppermost node of its index.  Inside a group
fingerprints are sorted by Gray rank; runs of neighbours form nodes that
keep the bits all members share, nodes form larger nodes, and a pair of nodes
whose shared bits already differ in more than the limit is pruned as a whole.
Groups are laid out by a range partitioning on (group, Gray rank), which
splits a group of any size over tasks: a group inside one task is joined
there, a larger one is cut into blocks that are joined pairwise, block pairs
pruned by their shared bits first.  Only links that join different clusters of
near neighbours are emitted, so that a large cluster does not give all its
pairs.

Cases: null and empty texts have the fingerprint zero and are linked like
any other; a text shorter than a shingle is one shingle; repeated rows have
the same component; a null id is never a component's id.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import id_text, map_slices, materialize, shuffle_width
from tractus.operators.components import components

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Rows of a group that are joined at once; larger groups are cut.
BLOCK = 8192
LEAF, FAN = 16, 4
_CHUNK = 1 << 14


# --------------------------------------------------------- fingerprints
def simhash(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64."""
    import xxhash
    w = text.encode("utf-8", "surrogatepass").lower().split()   # ASCII letters, ASCII white space
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = [e - 1 for e in accumulate(len(x) + 1 for x in w)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, n = xxhash.xxh64_digest, len(w) - words + 1
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        stop = min(n, at + (1 << 15))
        raw = b"".join([digest(joined[a:b], SEED)
                        for a, b in zip(starts[at:stop], ends[at + words - 1:stop + words - 1])])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""
    def run(b):
        fp = [simhash(t.as_py(), words) for t in b.column(1)]
        return {"doc_id": b.column(0), "fp": np.array(fp, dtype=np.uint64).view(np.int64)}
    return map_slices(id_text(docs), run, "doc_id long, fp long")


def gray_rank(col: Column) -> Column:
    """Position of a codeword in Gray order, as an unsigned number whose
    signed order is the same (sign bit flipped)."""
    for s in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, s))
    return col.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


# ---------------------------------------------------------------- index
def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _levels(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, leaves first: the bits that all members of a node share (mask) and their values."""
    out = []
    both = any_ = f
    step = LEAF
    while True:
        at = np.arange(0, len(both), step)
        both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)
        out.append((~(both ^ any_), both))
        if len(at) <= 1:
            return out
        step = FAN


def near_pairs(f: np.ndarray, g: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) within ``max_bits``: of f with itself (g None, i < j) or
    of f with g, both in Gray order.  Pairs inside one cluster of
    adjacent neighbours are left out, and of the pairs between clusters a
    spanning forest is given."""
    own = g is None
    g = f if own else g
    cut = lambda v: np.concatenate([[0], np.cumsum(_popcount(v[1:] ^ v[:-1]) > max_bits)])
    cf, cg = cut(f), cut(g)
    out: list[np.ndarray] = []
    if own:
        at = np.flatnonzero(cf[1:] == cf[:-1])
        out.append(np.stack([at, at + 1]))
    lf, lg = _levels(f), _levels(g)
    depth = max(len(lf), len(lg))
    lf += [lf[-1]] * (depth - len(lf))
    lg += [lg[-1]] * (depth - len(lg))
    span = lambda level: LEAF * FAN ** level
    stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    seen: set[int] = set()
    while stack:
        level, a, b = stack.pop()
        if len(a) > _CHUNK:
            stack += [(level, a[_CHUNK:], b[_CHUNK:])]
            a, b = a[:_CHUNK], b[:_CHUNK]
        (ma, va), (mb, vb) = lf[level], lg[level]
        keep = _popcount((va[a] ^ vb[b]) & ma[a] & mb[b]) <= max_bits
        if own:   # nodes inside one cluster are joined already
            s = span(level)
            keep &= ~(cf[a * s] == cf[np.minimum((b + 1) * s, len(f)) - 1])
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if level:
            ia, ib = (np.arange(FAN).repeat(FAN), np.tile(np.arange(FAN), FAN))
            a, b = (a[:, None] * FAN + ia).ravel(), (b[:, None] * FAN + ib).ravel()
            ok = (a < len(lf[level - 1][0])) & (b < len(lg[level - 1][0]))
            if own:
                ok &= a <= b
            stack.append((level - 1, a[ok], b[ok]))
            continue
        ia, ib = (np.arange(LEAF).repeat(LEAF), np.tile(np.arange(LEAF), LEAF))
        for at in range(0, len(a), 1024):
            i = (a[at:at + 1024, None] * LEAF + ia).ravel()
            j = (b[at:at + 1024, None] * LEAF + ib).ravel()
            ok = (i < len(f)) & (j < len(g))
            if own:
                ok &= i < j
            i, j = i[ok], j[ok]
            hit = _popcount(f[i] ^ g[j]) <= max_bits
            if own:
                hit &= cf[i] != cf[j]
            i, j = i[hit], j[hit]
            if len(i):   # one pair for two clusters
                pair, first = np.unique(cf[i] * (int(cg[-1]) + 1) + cg[j], return_index=True)
                fresh = np.array([p not in seen for p in pair.tolist()], dtype=bool)
                seen.update(pair.tolist())
                out.append(np.stack([i[first[fresh]], j[first[fresh]]]))
    i, j = np.concatenate(out, axis=1) if out else (np.zeros(0, np.int64),) * 2
    keep = forest(len(f) + (0 if own else len(g)), i, j if own else j + len(f))
    return i[keep], j[keep]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) between n nodes a spanning forest needs."""
    root, keep = list(range(n)), np.zeros(len(i), bool)
    for at, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            keep[at] = True
    return keep


def _block_masks(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of ``blocks`` bit blocks of nearly equal width."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    return [(edge[i], edge[i + 1] - edge[i]) for i in range(blocks)]


def grouped(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, rank, fp, rep): each distinct fingerprint in the groups of all
    pairs of max_bits + 2 blocks."""
    parts = _block_masks(max_bits + 2)
    take = lambda sh, w: F.shiftrightunsigned("fp", sh).bitwiseAND(F.lit((1 << w) - 1))
    keys = [F.shiftleft(F.lit(k).cast("long"), 50).bitwiseOR(
                F.shiftleft(take(*parts[i]), 25).bitwiseOR(take(*parts[j])))
            for k, (i, j) in enumerate(combinations(range(len(parts)), 2))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), gray_rank(F.col("fp")).alias("rank"), "fp", "rep")


_STAGE = "a long, b long, key long, block long, fps binary, reps binary, mask long, value long"


def _join_groups(max_bits: int, rows: int = BLOCK):
    """Over rows sorted by (key, rank): links inside the groups that lie
    within the task, and the blocks of those that may not."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "key", "block")]
                       + [("fps", pa.binary()), ("reps", pa.binary()), ("mask", pa.int64()), ("value", pa.int64())])

    def links(f, r, i, j):
        ok = r[i] != r[j]
        i, j = i[ok], j[ok]
        none = [None] * len(i)
        return pa.RecordBatch.from_pydict({"a": r[i], "b": r[j], "key": none, "block": none, "fps": none,
                                           "reps": none, "mask": none, "value": none}, schema=schema)

    def block(key, number, f, r):
        both, any_ = np.bitwise_and.reduce(f), np.bitwise_or.reduce(f)
        one = lambda v: np.array([v], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_pydict({"a": [None], "b": [None], "key": [key], "block": [number],
                                           "fps": [f.tobytes()], "reps": [r.tobytes()],
                                           "mask": one(~(both ^ any_)), "value": one(both)}, schema=schema)

    def runs(batches):
        """(keys, fps, reps) of whole groups, or of BLOCK rows of one group."""
        hold = None
        for b in batches:
            k = b.column(0).to_numpy()
            f, r = b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            if hold is not None:
                k, f, r = (np.concatenate([x, y]) for x, y in zip(hold, (k, f, r)))
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1]))   # the last group may go on
            if last:
                yield k[:last], f[:last], r[:last]
            k, f, r = k[last:], f[last:], r[last:]
            while len(k) >= 2 * rows:
                yield k[:rows], f[:rows], r[:rows]
                k, f, r = k[rows:], f[rows:], r[rows:]
            hold = (k, f, r)
        if hold is not None and len(hold[0]):
            yield hold

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        first, open_key = True, None
        pending = None
        # a group at either end of the task, or one cut by size, goes out as blocks
        def emit(k, f, r, edge_first, edge_last):
            nonlocal number, open_key
            start = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
            size = np.diff(np.append(start, len(k)))
            out = np.zeros(len(start), bool)
            out |= size > rows
            if edge_first:
                out[0] = True
            if edge_last:
                out[-1] = True
            if open_key is not None:
                out |= k[start] == open_key
            blocked = np.repeat(out, size)
            for s in np.flatnonzero(out):
                open_key = int(k[start[s]])
                for at in range(start[s], start[s] + size[s], rows):
                    stop = min(at + rows, start[s] + size[s])
                    i, j = near_pairs(f[at:stop], None, max_bits)
                    yield links(f, r, i + at, j + at)
                    number += 1
                    yield block(open_key, number, f[at:stop], r[at:stop])
            rest = ~blocked
            k, f, r = k[rest], f[rest], r[rest]
            # small groups: each row with the next ones of its group
            small = np.repeat(size[~out] <= 2 * LEAF, size[~out])
            ks, fs, rs = k[small], f[small], r[small]
            for d in range(1, 2 * LEAF):
                i = np.flatnonzero(ks[d:] == ks[:-d])
                if not len(i):
                    break
                i = i[_popcount(fs[i] ^ fs[i + d]) <= max_bits]
                if len(i):
                    yield links(fs, rs, i, i + d)
            k, f, r = k[~small], f[~small], r[~small]
            start = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1]) if len(k) else []
            for s, e in zip(start, np.append(start, len(k))[1:]):
                i, j = near_pairs(f[s:e], None, max_bits)
                yield links(f, r, i + s, j + s)

        for part in runs(batches):
            if pending is not None:
                # the pending rows end at a group boundary unless the next part continues the same group
                if pending[0][-1] == part[0][0]:
                    open_key = int(part[0][0])
                yield from emit(*pending, first, False)
                first = False
            pending = part
        if pending is not None:
            yield from emit(*pending, first, True)

    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, rows: int = BLOCK) -> DataFrame:
    """Links (a, b) between representatives that connect all fingerprints
    (fp, rep) within ``max_bits``.  ``fps`` is a materialized table of distinct
    fingerprints."""
    spark = fps.sparkSession
    laid = (grouped(fps, max_bits).repartitionByRange(shuffle_width(spark), "key", "rank")
            .sortWithinPartitions("key", "rank").select("key", "fp", "rep"))
    stage = materialize(laid.mapInArrow(_join_groups(max_bits, rows), _STAGE), "simhash-groups")
    inside = stage.where("key is null").select("a", "b")
    blocks = stage.where("key is not null").select("key", "block", "fps", "reps", "mask", "value")
    left = blocks.select("key", *[F.col(c).alias(f"l_{c}") for c in ("block", "fps", "reps", "mask", "value")])
    right = blocks.select("key", *[F.col(c).alias(f"r_{c}") for c in ("block", "fps", "reps", "mask", "value")])
    lower = F.bit_count(F.col("l_value").bitwiseXOR(F.col("r_value"))
                        .bitwiseAND(F.col("l_mask")).bitwiseAND(F.col("r_mask")))
    pairs = (left.join(right, "key").where((F.col("l_block") < F.col("r_block")) & (lower <= max_bits))
             .select("l_fps", "l_reps", "r_fps", "r_reps"))

    def across(b):
        a, z = [], []
        for lf, lr, rf, rr in zip(*(b.column(c) for c in range(4))):
            lr, rr = np.frombuffer(lr.as_py(), np.int64), np.frombuffer(rr.as_py(), np.int64)
            i, j = near_pairs(np.frombuffer(lf.as_py(), np.uint64), np.frombuffer(rf.as_py(), np.uint64), max_bits)
            a.append(lr[i])
            z.append(rr[j])
        return {"a": np.concatenate(a), "b": np.concatenate(z)} if a else None

    return inside.unionAll(map_slices(pairs, across, "a long, b long", rows=16))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach."""
    own = materialize(fingerprints(docs, words), "simhash")
    fps = materialize(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    comp = components(near_links(fps, max_bits))
    of_fp = (fps.join(comp, fps["rep"] == comp["id"], "left")
             .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return own.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")
