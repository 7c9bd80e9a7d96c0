"""Best-fit packing: a configuration linear program over the histogram of
piece lengths.

Documents become ids with an end id and are cut into pieces.  A size class is a
length (``GRAIN`` = 1, so no room is rounded away); the number of pieces per
class - at most capacity / GRAIN numbers, whatever the corpus - is all the
driver sees.  The program "fewest patterns that cover every class" is solved by
multiplicative weights: the weight of a class falls as it gets covered, and
a knapsack dynamic program prices the best pattern under the weights.  The
fractional solution is rounded to whole patterns (by fill, as often as the
remaining counts allow) and what is left is packed best-fit, largest
first.  Pieces then find their sequence by their rank within their class:
ranks are made per (class, salt), so that a class with a third of all pieces
is spread, and looked up in the plan's slot table, whose size depends on the
plan only.  Offsets are prefix sums within a sequence.

Cases: null and empty texts hold the end id alone; texts of any length are cut
only where they exceed the capacity; repeated rows are packed as often
as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tractus.llm.common import Memory, id_text, map_slices, materialize, shuffle_width

CAPACITY = 4096
END_ID = 1
#: Tokens of a size class.
GRAIN = 1
#: Pricing steps of the multiplicative weights, and their learning rate.
STEPS, RATE = 900, 0.6
MEMORY = 250_000
#: UTF-8 bytes of the texts that are encoded together.
SLICE_BYTES = 2 << 20

_L, _N = "a-zªµºß-öø-ɏ", "0-9²³¹¼-¾"
#: Characters outside the range where lower-casing, composition and the
#: pattern's classes are the plain ones, or a special token's start.  Arrow lower-cases İ to one
#: character, the library to two.
_SLOW = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-ɏ]|İ|<\|"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+"
_SPACES = re.compile(r"[\t\n\r ]+")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Ids of a tokenizer that drops white space: texts are cut into words
    and these into the pattern's pieces, each distinct one of a slice once;
    pieces are encoded on their own and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from tractus.llm.bytebpe import byte_table
        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._table = str.maketrans({chr(b): c for b, c in enumerate(byte_table())})
        self._piece = Memory(self._encode_piece, MEMORY)
        self._rare = Memory(self._encode_whole, MEMORY // 20)

    def _encode_piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself
        s = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self._table)
        return array("I", [t.id for t in self._model.tokenize(s)]).tobytes()

    def _encode_whole(self, word: str) -> bytes:
        return array("I", self._whole.encode(word, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of each text.

        White space always ends a pre-token, so words are independent; in
        the plain range lower-casing first changes nothing either."""
        texts = texts.cast(pa.large_string())
        low = pc.utf8_lower(texts)
        slow = pc.or_(pc.match_substring_regex(texts, _SLOW), pc.match_substring_regex(low, _SLOW))
        words = pc.ascii_split_whitespace(pc.if_else(slow, "", low))
        word = words.flatten().dictionary_encode()
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(word.dictionary, _PIECES, r"\0 "))
        part = parts.flatten().dictionary_encode()
        known = map(self._piece.__getitem__, part.dictionary.to_numpy(zero_copy_only=False).tolist())
        of_word = _joined(parts, part.indices, pa.array(known, pa.large_binary()))
        out = _joined(words, word.indices, of_word).to_pylist()
        for i in np.flatnonzero(slow.to_numpy(zero_copy_only=False)).tolist():
            out[i] = b"".join(map(self._rare.__getitem__, _SPACES.split(texts[i].as_py())))
        return out


def _joined(lists: pa.ListArray, index: pa.Array, values: pa.Array) -> pa.Array:
    """Per list the values of its elements, one after the other; ``index`` names
    the value of every element."""
    got = values.take(index)
    _, ends, data = got.buffers()
    ends = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), data])


def _by_bytes(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive slices of ``most`` bytes beside their first text."""
    at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    for a, z in zip(edges, edges[1:]):
        yield texts.slice(a, z - a)


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    end = array("I", [END_ID]).tobytes()

    def run(b):
        tokens = word_tokens(path)
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        ids = chain.from_iterable(map(tokens.many, _by_bytes(b.column(1), SLICE_BYTES)))
        for doc_id, raw in zip(b.column(0).to_pylist(), ids):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at:at + 4 * capacity]
                for name, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[name].append(v)
        pa.default_memory_pool().release_unused()   # workers live on for other operators
        return out

    return map_slices(id_text(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long",
                      rows=8192)


# ------------------------------------------------------------ the program
def price(value: np.ndarray, size: int) -> list[int]:
    """Knapsack: the multiset of classes (1..size) with the largest total
    value whose sizes add up to ``size`` at most.  ``value[c]`` is the value of
    class c, -inf for an absent one."""
    best, pick, used = np.zeros(size + 1), np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
    live = np.flatnonzero(value > -np.inf)
    worth, fits = value[live], np.searchsorted(live, np.arange(size + 1), side="right").tolist()
    for c in range(1, size + 1):
        n = fits[c]   # classes that fit
        total = best[c - live[:n]] + worth[:n]
        k = int(total.argmax()) if n else 0
        if n and total[k] > best[c - 1]:
            best[c], pick[c], used[c] = total[k], live[k], c
        else:
            best[c], pick[c], used[c] = best[c - 1], 0, used[c - 1]
    out, c = [], int(used[size])
    while c > 0:
        out.append(int(pick[c]))
        c = int(used[c - pick[c]])
    return out


def fractional(counts: np.ndarray, size: int, steps: int = STEPS, rate: float = RATE) -> dict[tuple[int, ...], float]:
    """Covering program by multiplicative weights: pattern -> multiplicity."""
    live = counts > 0
    cover = np.zeros(len(counts))
    prior = np.arange(len(counts)) / size
    x: Counter = Counter()
    for _ in range(steps):
        low = cover[live].min()
        value = np.where(live, prior * np.exp(-rate * (cover - low)), -np.inf)
        pattern = price(value, size)
        need = Counter(pattern)
        # as often as the scarcest of its classes is there once
        step = min(counts[c] / a for c, a in need.items())
        x[tuple(sorted(pattern, reverse=True))] += step
        for c, a in need.items():
            cover[c] += a * step / counts[c]
    mean = max(1.0, float((cover[live] * counts[live]).sum() / counts[live].sum()))
    return {p: v / mean for p, v in x.items()}


def best_fit(left: np.ndarray, size: int) -> Counter:
    """Best-fit, largest first, over the remaining counts.  Equal bins are
    kept together, so that work depends on the classes and not on the counts."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: Counter = Counter()

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if n and room:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((content, n))
        elif n:
            done[content] += n

    for c in range(size, 0, -1):
        n = int(left[c])
        while n:
            at = bisect_left(rooms, c)
            if at == len(rooms):
                per = size // c
                full, rest = divmod(n, per)
                put(size - per * c, (c,) * per, full)
                if rest:
                    put(size - rest * c, (c,) * rest, 1)
                n = 0
                break
            room = rooms[at]
            content, m = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
            take = min(n, m)
            put(room, content, m - take)
            put(room - c, content + (c,), take)
            n -= take
    for content_list in bins.values():
        for content, m in content_list:
            done[content] += m
    return done


def solve(counts: np.ndarray, size: int, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with whole multiplicities that hold every counted piece
    exactly once.  ``counts[c]``: pieces of class c (index 0 unused)."""
    left = counts.astype(np.int64).copy()
    plan: Counter = Counter()
    if left.sum():
        x = fractional(left.astype(np.float64), size, steps)
        by_fill = sorted(x, key=lambda p: (-sum(p), -x[p], p))
        for target in (lambda p: int(np.floor(x[p])), lambda p: 1 << 62):   # the program's share, then all that fits
            for p in by_fill:
                need = Counter(p)
                if sum(p) < size and target(p) >= 1 << 62:
                    continue   # only full patterns beyond the share
                m = min(min(int(left[c]) // a for c, a in need.items()), target(p))
                if m > 0:
                    plan[p] += m
                    for c, a in need.items():
                        left[c] -= a * m
        plan.update(best_fit(left, size))
    return sorted(plan.items(), key=lambda e: (-sum(e[0]), e[0]))


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per class: ranks from which a pattern's slots begin, slots of the
    class in the pattern, first sequence, first slot number."""
    taken: Counter = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for pattern, m in plan:
        slot = 0
        for c, a in Counter(pattern).items():
            rows.setdefault(c, []).append((taken[c], a, first, slot))
            taken[c] += a * m
            slot += a
        first += m
    return {c: tuple(np.array(v, dtype=np.int64).T) for c, v in rows.items()}


def assign(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``cut`` (a materialized table of pieces) with sequence_id and offset."""
    size = capacity // grain
    cls = F.ceil(F.col("length") / grain).cast("int")
    got = cut.groupBy(cls.alias("c")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(size + 1, dtype=np.int64)
    counts[got["c"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    table = cut.sparkSession.sparkContext.broadcast(slot_table(solve(counts, size)))

    # as many salts as shuffle partitions: even one class of all rows is spread
    salted = cut.withColumn("_c", cls).withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shuffle_width(cut.sparkSession))).cast("int"))
    before = (salted.groupBy("_c", "_salt").agg(F.count(F.lit(1)).alias("_n"))
              .select("_c", "_salt", (F.sum("_n").over(Window.partitionBy("_c").orderBy("_salt")) - F.col("_n"))
                      .alias("_before")))
    order = Window.partitionBy("_c", "_salt").orderBy("doc_id", "piece", "start", "length", "ids_crc32")
    ranked = (salted.withColumn("_i", F.row_number().over(order) - 1)
              .join(before, ["_c", "_salt"])
              .withColumn("_rank", F.col("_before") + F.col("_i")))
    columns = cut.columns

    def place(b):
        c, rank = (b.column(len(columns) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
        seq, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for k in np.unique(c):
            at = c == k
            start, per, first, base = table.value[int(k)]
            j = np.searchsorted(start, rank[at], side="right") - 1
            i = rank[at] - start[j]
            seq[at], slot[at] = first[j] + i // per[j], base[j] + i % per[j]
        return {n: b.column(i) for i, n in enumerate(columns)} | {"sequence_id": seq, "_slot": slot}

    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    placed = map_slices(ranked.select(*columns, "_c", F.col("_rank").cast("long")), place,
                        f"{schema}, sequence_id long, _slot long", rows=8192)
    inside = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")).drop("_slot")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return assign(materialize(pieces(docs, path, capacity), "pieces"), capacity)
