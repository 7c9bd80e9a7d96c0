"""Conversation prefix trie by a splitter skeleton.

A conversation is the sequence of its turns, each a 128-bit hash of (role, text);
its path is these hashes joined, so paths sort like sequences, a prefix before what
it is a prefix of.  Splitters cut the order of (path, conv_id) into shards, by
quantiles of a hash-ordered sample of bounded size.  A node whose members lie in
two shards or more is a prefix of a splitter between them, so the trie of the
splitters' paths, the skeleton, holds every node that a shard alone cannot finish:

1. Rows go to their shard and are sorted there.  One pass with a stack as deep
   as the longest path finishes all other nodes, whose members are neighbours in
   the shard.
2. For each skeleton node on its way a shard gives a partial aggregate: members,
   smallest id, and what its finished children add up to.
3. Partials are reduced per skeleton node.  Skeleton nodes are numbered in
   preorder, so a subtree is a range of numbers and its sum a difference of two
   running sums.
4. Ids of the conversations that end in a node come in ascending order, as the
   order of rows is (path, conv_id).  Shards pass a skeleton node's ids on as chunks
   of text, and SHA-256 runs through the chunks in order without holding them.

The skeleton has a bound: shards times ``SPLITTER_TURNS`` nodes.  A splitter's path is cut to that
many turns, which stays a valid splitter; conversations that share more turns than
that go to one shard.  Copies of one conversation are told apart by conv_id, so
they are spread over shards.

Cases: null roles and texts are empty; a null turn number stands first; equal turn
numbers follow by the turn's hash and repeated rows are turns of their own; rows
without conv_id take no part; an empty table gives no row; a conversation without a
rebuilt turn ends in the root.  Only the four named columns are read, so others
may have any name.  A conversation is one row of 20 bytes a turn.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractus.llm.common import materialize, shuffle_width

WORD = r"[^\x20\x09-\x0D]+"
HASH = 16
#: Shards per shuffle partition, sampled conversations per shard, turns of a splitter.
SHARDS, SAMPLE, SPLITTER_TURNS = 2, 8, 1024
#: Ids in one chunk of text.
CHUNK = 4096
BASE, SHARED = 20, 4
FINISHED, PARTIAL, ENDS = 0, 1, 2


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, t array<struct<hash, words>>), in the order of the turns."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the length keeps role and text apart
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), name.alias("hash"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return sorted_turns.select("conv_id", F.transform("t", lambda x: F.struct(x["hash"].alias("hash"), x["words"].alias("words"))).alias("t"))


def rebuilt(paths: DataFrame, base: int = BASE, shared: int = SHARED) -> DataFrame:
    """Each conversation's first h turns replaced by those of the first of its ``base``
    neighbours; h = crc32(conv_id) mod ``shared``."""
    own = F.col("conv_id")
    h = F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(shared)).cast("int")
    heads = paths.where(F.pmod(own, F.lit(base)) == 0).select(own.alias("_base"), F.slice("t", 1, shared - 1).alias("_head"))
    joined = paths.join(heads, own - F.pmod(own, F.lit(base)) == F.col("_base"), "left")
    rest = F.slice("t", h + 1, F.size("t"))
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), h))
    return joined.select("conv_id", F.when(head.isNotNull(), F.concat(head, rest)).otherwise(rest).alias("t"))


def as_rows(paths: DataFrame) -> DataFrame:
    """(conv_id, path binary, words array<int>)."""
    return paths.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["hash"]), "")).alias("path"),
                        F.transform("t", lambda x: x["words"]).alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two paths share from the start."""
    lo, hi = 0, min(len(a), len(b)) // HASH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid * HASH] == b[:mid * HASH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Skeleton:
    """The trie of the splitters' paths.

    ``nodes``: (number, parent, last number of the subtree, children), in
    preorder from the root, 0; ``ids[i][d]``: the node of splitter i at depth d."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = sorted(set(splitters))
        parent, last, children, self.ids = [-1], [0], [0], []
        before, open_ = b"", [0]
        for path, _ in self.splitters:
            same = common_turns(before, path)
            for n in open_[same + 1:]:
                last[n] = len(parent) - 1
            open_ = open_[:same + 1]
            for _ in range(same, len(path) // HASH):
                children[open_[-1]] += 1
                parent.append(open_[-1])
                last.append(0)
                children.append(0)
                open_.append(len(parent) - 1)
            self.ids.append(list(open_))
            before = path
        for n in open_:
            last[n] = len(parent) - 1
        self.nodes = [(n, parent[n], last[n], children[n]) for n in range(len(parent))]

    def shard(self, path: bytes, conv_id: int) -> int:
        """Number of splitters at or before a row."""
        return bisect.bisect_right(self.splitters, (path, conv_id))

    def beside(self, shard: int) -> list[tuple[bytes, list[int]]]:
        """The splitters on both sides of a shard: (path, nodes)."""
        return [(self.splitters[i][0], self.ids[i]) for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]


def skeleton(rows: DataFrame, shards: int) -> Skeleton:
    """Splitters at the quantiles of the conversations whose ids have the smallest hashes: at most
    ``SAMPLE`` per shard are looked at by the driver, each cut to ``SPLITTER_TURNS`` turns."""
    got = (rows.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * shards)
           .select(F.substring("path", 1, SPLITTER_TURNS * HASH).alias("path"),
                   F.when(F.length("path") > SPLITTER_TURNS * HASH, F.lit(-(1 << 63))).otherwise(F.col("conv_id")).alias("conv_id"))
           .collect())
    sample = sorted({(bytes(r["path"]), r["conv_id"]) for r in got})
    return Skeleton([sample[i * len(sample) // shards] for i in range(1, shards)] if sample else [])


class _Open:
    """A node on the way to the row at hand."""
    __slots__ = ("number", "words", "least", "n", "children", "leaves", "saved", "ends", "held", "seq", "waiting")

    def __init__(self, number: int | None, words: int):
        self.number, self.words = number, words      # number: of a skeleton node
        self.least, self.n, self.children, self.leaves, self.saved = 1 << 63, 0, 0, 0, 0
        self.ends, self.held, self.seq, self.waiting = None, [], 0, []


class Shard:
    """One shard's pass; ``out`` gathers rows of ``COLUMNS``."""
    COLUMNS = ("kind", "node", "shard", "seq", "conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "words", "ends")

    def __init__(self, number: int, frame: Skeleton, out: list):
        self.number, self.beside, self.out = number, frame.beside(number), out
        self.path, self.stack = b"", [_Open(0, 0)]

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        same = common_turns(self.path, path)
        self.close(same)
        on, ids = max(((common_turns(p, path), ids) for p, ids in self.beside), default=(0, []), key=lambda x: x[0])
        for d in range(same + 1, len(path) // HASH + 1):
            self.stack.append(_Open(ids[d] if d <= on else None, words[d - 1]))
        self.path, top = path, self.stack[-1]
        top.n += 1
        top.least = min(top.least, conv_id)
        if top.number is None:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv_id).encode())
            else:
                top.ends.update(f",{conv_id}".encode())
        else:
            top.held.append(str(conv_id))
            if len(top.held) >= CHUNK:
                self._pass_on(top)

    def _row(self, kind, node, seq, depth, o: _Open, parent=None, ends=None):
        return (kind, node, self.number, seq, o.least, depth, parent, o.n, o.children, o.leaves, o.saved, o.words, ends)

    def _pass_on(self, o: _Open) -> None:
        self.out.append(self._row(ENDS, o.number, o.seq, 0, _NONE, None, ",".join(o.held)))
        o.held, o.seq = [], o.seq + 1

    def close(self, depth: int) -> None:
        """Finish the open nodes below ``depth`` (-1: all)."""
        while len(self.stack) - 1 > depth:
            o = self.stack.pop()
            at, up = len(self.stack), self.stack[-1] if self.stack else None
            if o.number is None:
                o.leaves += not o.children
                o.saved += (o.n - 1) * o.words
                for row in o.waiting:    # finished children get their parent's smallest member
                    self.out.append((*row[:6], o.least, *row[7:]))
                row = self._row(FINISHED, up.number, 0, at, o, None, (o.ends or hashlib.sha256()).hexdigest())
                (up.waiting if up.number is None else self.out).append(row)
                up.children += 1
                up.leaves += o.leaves
                up.saved += o.saved
            else:
                if o.held:
                    self._pass_on(o)
                self.out.append(self._row(PARTIAL, o.number, 0, at, o))
            if up is not None:
                up.n += o.n
                up.least = min(up.least, o.least)


_NONE = _Open(None, 0)
_NONE.least = 0
_TYPES = dict.fromkeys(Shard.COLUMNS, pa.int64()) | {"ends": pa.string()}
_SCHEMA = ", ".join(f"{c} {'string' if c == 'ends' else 'long'}" for c in Shard.COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=_TYPES[n]) for n, c in zip(Shard.COLUMNS, zip(*rows))], names=list(Shard.COLUMNS))


def _shards(rows: DataFrame, frame, width: int) -> DataFrame:
    def assign(batches):
        for b in batches:
            at = [frame.value.shard(p, c) for p, c in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int32()), *b.columns], names=["shard", *b.schema.names])

    def walk(batches):
        shard, out = None, []
        for b in batches:
            for number, conv_id, path, words in zip(*(c.to_pylist() for c in b.columns)):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.close(-1)
                    shard = Shard(number, frame.value, out)
                shard.add(conv_id, path, words)
                if len(out) >= 10_000:
                    yield _batch(out)
                    out.clear()
        if shard is not None:
            shard.close(-1)
        if out:
            yield _batch(out)

    dealt = rows.mapInArrow(assign, "shard int, conv_id long, path binary, words array<int>")
    return (dealt.repartition(width, "shard").sortWithinPartitions("shard", "path", "conv_id")
            .mapInArrow(walk, _SCHEMA))


def _end_hashes(chunks: DataFrame, width: int) -> DataFrame:
    """(node, ends_sha256) of the chunks of ids of each skeleton node, in order."""
    def run(batches):
        node, h = None, None
        for b in batches:
            for n, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                if n != node:
                    if node is not None:
                        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [h.hexdigest()]})
                    node, h = n, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [h.hexdigest()]})

    return (chunks.select("node", "shard", "seq", "ends").repartition(width, "node")
            .sortWithinPartitions("node", "shard", "seq").mapInArrow(run, "node long, ends_sha256 string"))


def prefix_trie(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``rows`` (conv_id, path, words): (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    spark = rows.sparkSession
    width = shuffle_width(spark)
    frame = skeleton(rows, shards or SHARDS * width)
    parts = materialize(_shards(rows, spark.sparkContext.broadcast(frame), width), "trie-parts")

    # bounded by the skeleton from here on: a row per node and shard, then a row per node
    nodes = spark.createDataFrame(frame.nodes, "node long, parent long, last long, inner long")
    total = (parts.where(F.col("kind") == PARTIAL).groupBy("node")
             .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n").alias("n"),
                  F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                  F.max("words").alias("words")).join(nodes, "node"))
    running = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    own = {"leaves": F.col("leaves") + F.when(F.col("children") + F.col("inner") == 0, 1).otherwise(0),
           "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")}
    summed = total.select("*", *[F.sum(v).over(running).alias(f"to_{c}") for c, v in own.items()],
                          *[(F.sum(v).over(running) - v).alias(f"before_{c}") for c, v in own.items()])
    summed = materialize(summed, "trie-skeleton")
    after = summed.select(F.col("node").alias("last"), F.col("to_leaves").alias("_l"), F.col("to_saved").alias("_s"))
    up = summed.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = _end_hashes(parts.where(F.col("kind") == ENDS), width)
    none = hashlib.sha256().hexdigest()
    inner = (summed.join(after, "last").join(up, "parent", "left").join(ends, "node", "left")
             .select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                     (F.col("children") + F.col("inner")).alias("n_children"), (F.col("_l") - F.col("before_leaves")).alias("n_leaves"),
                     (F.col("_s") - F.col("before_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
    # the skeleton is bounded, so it can go to all tasks
    above = F.broadcast(up.select(F.col("parent").alias("node"), F.col("parent_conv_id").alias("_above")))
    finished = (parts.where(F.col("kind") == FINISHED).join(above, "node", "left")
                .select("conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.col("ends").alias("ends_sha256")))
    return inner.unionByName(finished)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    own = materialize(turn_paths(turns), "turn-paths")
    return prefix_trie(materialize(as_rows(rebuilt(own)), "rebuilt-paths"))
