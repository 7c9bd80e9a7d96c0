"""Substring near-duplicates with compact windows.

A text is the sequence of its five-word shingles.  Under one hash function
the Cartesian tree of the shingles' hashes tells for each position c the
longest window around it whose minimum sits at c; all its subsequences that
hold c have the same min-hash.  Only windows of at least ``WORDS`` words
matter.  Their centres are exactly the minima of the sliding windows of that
length, found with array operations; the tree is then built over these few
positions alone.

1. Windows: (key, text, interval) with key = hash function and min-hash.  Texts
   are named by their hash, so exact copies count once.
2. Groups: rows are laid out by ranges of (key, text), which splits a key of any
   frequency over tasks.  In one streaming pass each window is linked to the first
   text of its group and to the one before it: links grow linearly with
   the group.  Groups that cross tasks are linked through a table of one row per
   task end.
   Whole runs: a group holds all texts with that minimum, so the first text
   may share no passage with the others.  Every run of ``WORDS`` words whose groups
   have two or more texts under each hash function is therefore grouped by
   the hash of the whole run, too: there all texts share it, and a link to the
   first loses none.
3. Interval join: a pair's links are swept along both texts; intervals that
   overlap under ``AGREE`` or more hash functions, or by a whole run, become a
   candidate.
4. Verification: the exact shingles of both intervals are compared; spans of at
   least ``WORDS`` words and a Jaccard similarity of ``SIMILARITY`` or more stay.

Of two texts with the same passage the one with the smaller hash keeps it; of
exact copies the smallest doc_id stands for all.

Cases: null and empty texts and texts under ``WORDS`` words have no windows; a
passage that repeats only inside one text is not reported; repeated rows
are exact copies; rows with a null id take no part.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import id_text, map_slices, marked, materialize, materialize_freed, shuffle_width, shuffles_freed
from tractus.session import remove_path, scratch_dir

SHINGLE, WORDS, SIMILARITY = 5, 50, 0.8
HASHES, AGREE = 5, 2
#: Number of the links by a whole run or a context, beside those of the hash functions.
WHOLE = 30
#: Shingles to one side of a minimum that name its window, its own included.
CONTEXT = 12
#: Largest number of positions handled at once; longer texts go in overlapping pieces.
PIECE = 1 << 22
#: Characters handled together.
STRETCH = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                   0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xD6E8FEB86659FD93], dtype=np.uint64)


def _random_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_CHARACTERS = _random_numbers(1 << 12, 11)
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(m))]), dtype=np.uint64)
                 for m in (_MULTIPLIER, inverse))


def _codes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place of every word (a run of characters that are no white space)."""
    space = _SPACE[codes] if codes.dtype == np.uint8 else _SPACE[np.minimum(codes, len(_SPACE) - 1)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    return edge[::2], edge[1::2]


def word_starts(text: str) -> np.ndarray:
    """Code points where the words start, and the text's end."""
    codes = _codes(text)
    return np.append(_bounds(codes)[0], len(codes)).astype("<u4")


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first places): a 64-bit hash per word, the sum of its characters' random numbers times
    powers by their place, as a difference of running sums over a stretch of text, moved to place 0."""
    codes = _codes(text)
    first, end = _bounds(codes)
    out = np.zeros(len(first), np.uint64)
    at = 0
    while at < len(first):
        # whole words, about STRETCH characters
        to = max(at + 1, int(np.searchsorted(end, first[at] + STRETCH, side="right")))
        base = int(first[at])
        part = codes[base:int(end[to - 1])]
        power, inverse = _powers(max(STRETCH, 1 << (len(part) - 1).bit_length()))
        value = _CHARACTERS[part] if part.dtype == np.uint8 else (
            _CHARACTERS[part & np.uint32(0xFFF)] + (part >> np.uint32(12)) * _SALTS[1])
        value *= power[:len(part)]
        total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
        f = first[at:to] - base
        h = (total[end[at:to] - base] - total[f]) * inverse[f]
        h ^= h >> np.uint64(32)
        h *= _SALTS[2]
        out[at:to] = h ^ (h >> np.uint64(29))
        at = to
    return out, first


def shingle_batch(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): a 64-bit hash per run of k words (lower-cased) of all texts in one
    array; text i has those from offsets[i] to offsets[i + 1]."""
    low = [t.lower() for t in texts]
    w, first = _word_hashes("\n".join(low))
    ends = np.cumsum([len(t) + 1 for t in low])
    words = np.diff(np.searchsorted(first, ends), prepend=0)
    counts = np.maximum(words - k + 1, 0)
    n = len(w) - k + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if n < 1:
        return np.zeros(0, np.uint64), offsets
    s = w[:n].copy()
    for i in range(1, k):
        s *= _MULTIPLIER
        s += w[i:n + i]
        s ^= s >> np.uint64(29)
    s *= _MULTIPLIER
    s ^= s >> np.uint64(32)
    if len(texts) > 1:       # runs over the end of a text go
        owner = np.repeat(np.arange(len(texts)), words)
        s = s[owner[:n] == owner[k - 1:]]
    return s, offsets


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    return shingle_batch([text], k)[0]


def _text_batches(column, rows: int = 256, characters: int = STRETCH):
    """(first row, texts): runs of a column's texts, few enough characters for a processor's cache, or a single text."""
    at, held, size = 0, [], 0
    for i, t in enumerate(column):
        t = t.as_py()
        if held and (len(held) >= rows or size + len(t) > characters):
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def _centres(s: np.ndarray, offsets: np.ndarray, salts: np.ndarray, length: int) -> list[np.ndarray]:
    """Per hash function the minima of all sliding windows inside the texts, in order: 40 bits of
    hash over 24 bits of position.  All hash functions go through each array
    operation together."""
    n, salt = len(s), salts[:, None]
    if n < length:
        return [np.zeros(0, np.uint64) for _ in salts]
    h = (s[None] ^ salt) * _MULTIPLIER
    h ^= h >> np.uint64(31)
    h *= salt | np.uint64(1)
    m = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= length:
        m = np.minimum(m[:, :-span], m[:, span:])
        span *= 2
    if span < length:
        m = np.minimum(m[:, :n - length + 1], m[:, length - span:length - span + n - length + 1])
    new = np.ones(m.shape, dtype=bool)
    np.not_equal(m[:, 1:], m[:, :-1], out=new[:, 1:])
    if len(offsets) > 2:
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        whole = owner[:n - length + 1] == owner[length - 1:]      # windows inside one text
        new[:, 1:] |= ~whole[:-1]
        new &= whole
    return [row[keep] for row, keep in zip(m, new)]


def _nearest_smaller(keys: np.ndarray, edge: np.ndarray, step: int) -> np.ndarray:
    """Index of the nearest smaller key on one side, or len(keys) beyond an ``edge``.  Each
    round every element that points to a larger one goes on to where that one points."""
    n = len(keys)
    k = np.append(keys, np.uint64(0))
    to = np.arange(n + 1) + step
    to[np.append(edge, True)] = n
    active = np.arange(n)
    while True:
        active = active[k[to[active]] > keys[active]]
        if not len(active):
            return to[:n]
        to[active] = to[to[active]]


def _tree(centres: list[np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, left, right): Cartesian trees over the centres of each text under each hash function; a centre's window lies
    between the nearest smaller ones on both sides.  Places count from the text's start."""
    centre = np.concatenate(centres)
    place = (centre & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, place, side="right") - 1
    first = np.ones(len(centre), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    at = np.cumsum([len(c) for c in centres[:-1]], dtype=np.int64)
    first[at[at < len(first)]] = True
    last = np.append(first[1:], True) if len(centre) else first
    lower, upper = _nearest_smaller(centre, first, -1), _nearest_smaller(centre, last, 1)
    padded = np.append(place, 0)
    left = np.where(lower < len(centre), padded[lower] + 1, offsets[text])
    right = np.where(upper < len(centre), padded[upper] - 1, offsets[text + 1] - 1)
    base = offsets[text]
    return text, place - base, left - base, right - base


def compact_windows(s: np.ndarray, salt: np.uint64, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(min-hash, left, right) of every compact window of at least
    ``length`` positions, under one hash function.  Equal hashes: the leftmost is the smaller."""
    whole = np.array([0, len(s)])
    centre = _centres(s, whole, np.array([salt], dtype=np.uint64), length)[0]
    return (centre >> np.uint64(24), *_tree([centre], whole)[2:])


def _pieces(s: np.ndarray, offsets: np.ndarray, length: int):
    """(s, offsets, first text, start): texts of a batch together, one that is longer than PIECE in overlapping pieces."""
    if len(s) <= PIECE + length:
        yield s, offsets, 0, 0
        return
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for start in range(0, max(1, hi - lo - length + 1), PIECE):
            part = s[lo + start:min(hi, lo + start + PIECE + length - 1)]
            yield part, np.array([0, len(part)]), i, start


def _key(centre: np.ndarray, f: int) -> np.ndarray:
    return ((centre >> np.uint64(24)) | np.uint64(f << 40)).astype(np.int64)


def _windows(docs: DataFrame, hashes: int, words: int) -> DataFrame:
    """(key, h, at): at holds the left end (32 bits) and the length (31 bits)."""
    length = words - SHINGLE + 1
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy()
            for row, texts in _text_batches(b.column(1)):
                for s, offsets, i, start in _pieces(*shingle_batch(texts), length):
                    centres = _centres(s, offsets, _SALTS[:hashes], length)
                    text, _, left, right = _tree(centres, offsets)
                    key = np.concatenate([_key(centre, f) for f, centre in enumerate(centres)])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                        key, h[row + i + text], ((left + start) << 31) | (right - left + 1))], schema=schema)

    return docs.select("h", "text").mapInArrow(run, "key long, h long, at long")


def _link_groups(batches, chain: bool = True):
    """Rows sorted by (key, h, at): links of each window in a group to the
    group's first one and, with ``chain``, of each text's first window to the text
    before; further windows of the first text come as links with a = b.  A window that stands again (of an
    exact copy) has no link of its own.  With ``chain`` every window that has a link is
    the b of exactly one row with ``more`` below 2: the first one's is a link to itself, and links to the text before have 2.
    The heads of the first and the last group, which may go on in another task, come marked by b null,
    and ``more`` 1 where they have a link to themselves."""
    schema = pa.schema([(c, pa.int64()) for c in ("key", "a", "a_at", "b", "b_at", "more")])
    head = prev = None    # (key, h, at)
    first = None
    told = first_told = False    # has the group at hand, the first group, a link
    for batch in batches:
        k, h, at = (batch.column(i).to_numpy() for i in range(3))
        if not len(k):
            continue
        # the row before and the head of the group go in front
        before_k, before_h, before_at = (np.concatenate([[prev[i] if prev else 0], x[:-1]]) for i, x in enumerate((k, h, at)))
        starts = k != before_k
        if prev is None:
            starts[0] = True
        group = np.maximum.accumulate(np.where(starts, np.arange(len(k)), -1))
        opened = group < 0   # go on with the group of the batch before
        head_h = np.where(opened, head[1] if head else 0, h[group])
        head_at = np.where(opened, head[2] if head else 0, at[group])
        # groups of one text alone have no links; more: of more than two windows.  Groups that may go
        # on beyond the batch count as both
        number = np.cumsum(starts)
        size, others = np.bincount(number), np.bincount(number, weights=h != head_h)
        size[[number[0], number[-1]]] = 3
        others[[number[0], number[-1]]] = 1
        more = (size[number] > 2).astype(np.int64)
        inner = ~starts & (others[number] > 0)
        linked = np.bincount(number, weights=inner) > 0
        again = ~starts & (h == before_h) & (at == before_at)
        links = [tuple(x[inner & ~again] for x in (k, head_h, head_at, h, at, more))]
        if chain:
            new = inner & (h != before_h) & (before_h != head_h)
            links.append((*(x[new] for x in (k, before_h, before_at, h, at)), np.full(new.sum(), 2)))
            heads = starts & linked[number]
            links.append(tuple(x[heads] for x in (k, h, at, h, at, more)))
            if opened[0] and linked[0] and not told:
                links.append(tuple(np.array([x]) for x in (*head, *head[1:], 1)))
        if first is None:
            first = (int(k[0]), int(h[0]), int(at[0]))
        if k[0] == first[0]:
            first_told |= bool(linked[number[0]])
        told = bool(linked[number[-1]]) or (told and not starts.any())
        head = (int(k[-1]), int(head_h[-1]), int(head_at[-1]))
        prev = (int(k[-1]), int(h[-1]), int(at[-1]))
        cols = [np.concatenate(c) for c in zip(*links)]
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)
    for (key, h, at), has in {first: first_told, head: told}.items() if first else ():
        yield pa.RecordBatch.from_pydict({"key": [key], "a": [h], "a_at": [at], "b": [None], "b_at": [None], "more": [int(has)]}, schema=schema)


def _linked(rows: DataFrame, name: str, chain: bool = True) -> DataFrame:
    """Links within the groups of ``rows`` (key, h, at), and the links of the
    groups' parts in other tasks to the first one."""
    # written once, as the range partitioning reads its input for a sample, too; removed when the links are there
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, f"{name}-input")
    with shuffles_freed(spark):
        rows.write.mode("overwrite").parquet(path)
    laid = (spark.read.schema(rows.schema).parquet(path).repartitionByRange(shuffle_width(spark), "key", "h")
            .sortWithinPartitions("key", "h", "at"))
    links, _ = materialize_freed(laid.mapInArrow(lambda batches: _link_groups(batches, chain),
                                                 "key long, a long, a_at long, b long, b_at long, more long"), name)
    remove_path(spark, path)
    ends = links.where("b is null").groupBy("key", "a", "a_at").agg(F.max("more").alias("told"))
    heads = ends.groupBy("key").agg(F.min(F.struct("a", "a_at")).alias("m"), F.count(F.lit(1)).alias("ends")).where("ends > 1")
    across = (ends.join(heads, "key")   # links to the first one, and to itself where it has none
              .select("key", "told", F.explode(F.array(
                  F.struct(F.col("m.a").alias("a"), F.col("m.a_at").alias("a_at"), F.col("a").alias("b"), F.col("a_at").alias("b_at"),
                           F.lit(2).cast("long").alias("more")),
                  F.struct("a", "a_at", F.col("a").alias("b"), F.col("a_at").alias("b_at"), F.lit(1).cast("long").alias("more")))).alias("l"))
              .where("l.more = 2 and struct(l.a, l.a_at) <> struct(l.b, l.b_at) or l.more = 1 and told = 0").select("key", "l.*"))
    return links.where("b is not null").unionByName(across)


def _shared(links: DataFrame) -> DataFrame:
    """(h, key, at, more): the windows that have links, each once."""
    return links.where("more < 2").select(F.col("b").alias("h"), "key", F.col("b_at").alias("at"), "more")


def _run_hashes(s: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` shingles from each position on."""
    def join(x, y):
        z = (x ^ (x >> np.uint64(31))) * _MULTIPLIER + y
        z = (z ^ (z >> np.uint64(29))) * _SALTS[0]
        return z ^ (z >> np.uint64(32))

    n, span = len(s) - length + 1, 1
    while 2 * span <= length:
        s = join(s[:-span], s[span:])
        span *= 2
    return join(s[:n], s[length - span:length - span + n])


def _covered(f: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: np.ndarray, n: int, hashes: int, agree: int) -> np.ndarray:
    """Places, of n, from which a run lies in shared windows (runs start from lo to hi) under every hash
    function, and in groups of more than two under so many that fewer than ``agree`` link it at once."""
    def inside(own):
        return np.cumsum(np.bincount(lo[own], minlength=n + 1) - np.bincount(hi[own] + 1, minlength=n + 1))[:n] > 0

    held, large = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
    for i in range(hashes):
        held &= inside(f == i)
        large += inside((f == i) & (more > 0))
    return np.flatnonzero(held & (large > hashes - agree))


def _strong_keys(s: np.ndarray, offsets: np.ndarray, text: np.ndarray, key: np.ndarray, at: np.ndarray, more: np.ndarray,
                 hashes: int, agree: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, at) of the whole runs and contexts of a batch's shared windows (text, key, at, more)."""
    base, left, size = offsets[text], at >> 31, at & 0x7FFFFFFF
    out = []
    if len(s) >= length:
        first = _covered(key >> 40, base + left, base + left + size - length, more, len(s), hashes, agree)
        owner = np.searchsorted(offsets, first, side="right") - 1
        out.append((_run_hashes(s, length).view(np.int64)[first], owner, ((first - offsets[owner]) << 31) | length))
    # the windows' own centres: the first one of their hash inside them
    text, key, at, base, left, size = (x[more > 0] for x in (text, key, at, base, left, size))
    names, places = [], []
    for part, bounds, i, start in _pieces(s, offsets, length):
        for f, c in enumerate(_centres(part, bounds, _SALTS[:hashes], length)):
            place = (c & np.uint64(0xFFFFFF)).astype(np.int64)
            own = np.searchsorted(bounds, place, side="right") - 1
            names.append((_key(c, f) << 8) | (own + i))
            places.append(place - bounds[own] + start)
    names, places = np.concatenate(names), np.concatenate(places)
    order = np.argsort(names, kind="stable")    # the places of a name are in order
    names, places = names[order], places[order]
    own = np.searchsorted(names, (key << 8) | text, side="left")
    while (late := places[own] < left).any():
        own[late] += 1
    run = _run_hashes(s, CONTEXT)
    for side, first in ((_SALTS[3], places[own] - CONTEXT + 1), (_SALTS[4], places[own])):
        inside = (left <= first) & (first + CONTEXT <= left + size)
        h = (key[inside].view(np.uint64) * _MULTIPLIER) ^ run[(base + first)[inside]]
        h = (h ^ (h >> np.uint64(31))) * side
        out.append(((h ^ (h >> np.uint64(29))).view(np.int64), text[inside], at[inside]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _strong_windows(texts: DataFrame, links: DataFrame, reps: DataFrame, hashes: int, agree: int, words: int) -> DataFrame:
    """(key, h, at): stronger names of the shared windows.  A group of windows may be led by a text
    that shares no passage with the others, so two finer kinds of group follow:

    * whole runs: every run of ``words`` words in shared windows under each hash function, by its hash.  Two
      texts with a run in common have a group in common under every hash function, so none is lost.  Where ``agree`` of
      these groups hold two windows only, those are linked as they are;
    * contexts: a window of a group of three or more, by its minimum and the CONTEXT shingles to either
      side.  Near variants share one or the other side of most minima, strangers
      that share a line or phrase do not, unless all of it is theirs, too."""
    length = words - SHINGLE + 1
    sides = _shared(links)
    # without a large group there is nothing to name anew
    per = (sides.groupBy("h").agg(F.collect_list(F.struct("key", "at", "more")).alias("l"), F.max("more").alias("more")).where("more > 0")
           .join(reps.groupBy("h").agg(F.min("rep").alias("doc_id")), "h"))
    asked = texts.join(per, ["doc_id", "h"]).select("h", "text", "l")

    def run(batches):
        for b in batches:
            h, lists = b.column(0).to_numpy(), b.column(2)
            for row, held in _text_batches(b.column(1)):
                own = lists.slice(row, len(held))
                windows, text = own.flatten(), np.repeat(np.arange(len(held)), own.value_lengths().to_numpy())
                key, at, more = (windows.field(c).to_numpy() for c in ("key", "at", "more"))
                keys, owner, ats = _strong_keys(*shingle_batch(held), text, key, at, more, hashes, agree, length)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(h[row + owner]), pa.array(ats)], names=["key", "h", "at"])

    return asked.mapInArrow(run, "key long, h long, at long")


def _clusters(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, cluster): rows by group and lo, and a number per run of intervals of a group that overlap or touch."""
    order = np.lexsort((lo, group))
    g, x, y = group[order], lo[order], hi[order]
    # groups stand far apart, so that a running maximum does not reach into the next one
    far = g * (int(y.max()) + 3)
    reach = np.maximum.accumulate(y + far)
    new = np.ones(len(g), dtype=bool)
    new[1:] = x[1:] + far[1:] > reach[:-1] + 1
    return order, np.cumsum(new) - 1


def sweep(pair: np.ndarray, f: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, agree: int) -> tuple[np.ndarray, ...]:
    """(pair, a_lo, a_hi, b_lo, b_hi): intervals where links of one pair overlap in b, and in a,
    under ``agree`` or more hash functions or by a whole run or context.  Pairs are numbered from 0."""
    a_lo, b_lo = a_at >> 31, b_at >> 31
    a_hi, b_hi = a_lo + (a_at & 0x7FFFFFFF) - 1, b_lo + (b_at & 0x7FFFFFFF) - 1
    order, in_b = _clusters(pair, b_lo, b_hi)
    pair, f, a_lo, a_hi, b_lo, b_hi = (x[order] for x in (pair, f, a_lo, a_hi, b_lo, b_hi))
    order, part = _clusters(in_b, a_lo, a_hi)
    pair, f, a_lo, a_hi, b_lo, b_hi = (x[order] for x in (pair, f, a_lo, a_hi, b_lo, b_hi))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    kinds = np.bitwise_or.reduceat(np.int64(1) << f, first)
    keep = (np.bitwise_count(kinds) >= agree) | (kinds >> WHOLE > 0)
    low, high = np.minimum.reduceat, np.maximum.reduceat
    return tuple(x[keep] for x in (pair[first], low(a_lo, first), high(a_hi, first), low(b_lo, first), high(b_hi, first)))


def _candidates(links: DataFrame, agree: int, width: int) -> DataFrame:
    """(a, b, a_lo, a_hi, b_lo, b_hi) of links (a, b, f, a_at, b_at).  A pair's links come to one task, sorted; a
    hot first text's pairs go to many."""
    def run(batches):
        held = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            # the last pair may go on in the next batch
            end = int(new[-1]) if len(new) else 0
            held = [c[end:] for c in cols]
            if end:
                yield found([c[:end] for c in cols], new[:-1])
        if held is not None:
            yield found(held, np.zeros(0, np.int64))

    def found(cols, starts):
        a, b, f, a_at, b_at = cols
        starts = np.concatenate([[0], starts])
        pair = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a))))
        at, *rest = sweep(pair, f, a_at, b_at, agree)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[starts[at]], b[starts[at]], *rest)],
                                          names=["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"])

    return (links.select("a", "b", "f", "a_at", "b_at").repartition(width, "a", "b").sortWithinPartitions("a", "b")
            .mapInArrow(run, "a long, b long, a_lo long, a_hi long, b_lo long, b_hi long"))


def _jaccard(a: np.ndarray, b: np.ndarray, distinct: bool = False) -> float:
    if not distinct:
        a, b = np.sort(a), np.sort(b)
        a, b = a[np.append(True, a[1:] != a[:-1])], b[np.append(True, b[1:] != b[:-1])]
    both = np.sort(np.concatenate([a, b]))
    both = int((both[1:] == both[:-1]).sum())
    return both / (len(a) + len(b) - both)


@dataclass
class Matches:
    """What the shingles of some pairs of intervals have in common.  The a's stand behind each other, and the b's; pair i
    has those from ``a_at[i]`` to ``a_at[i + 1]``.  Running sums begin with 0 before the first shingle."""
    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    partner: np.ndarray     # of each place in b the first place in a with the same shingle, -1: none
    repeated: np.ndarray    # for places in b: does a hold the shingle more than once
    common: np.ndarray      # running sum over b: shingles that a holds
    common_a: np.ndarray    # running sum over a: shingles that b holds
    kinds_a: np.ndarray     # running sums: shingles that stand for the first time in their interval
    kinds_b: np.ndarray


def _sum(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)])


def _matches(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> Matches:
    """All pairs' shingles (32 bits) in one sorting, by pair, shingle and place, a before b."""
    value = np.concatenate([a, b]).astype(np.uint64)
    pairs = np.arange(len(a_at) - 1, dtype=np.uint64)
    value |= np.concatenate([np.repeat(pairs, np.diff(a_at)), np.repeat(pairs, np.diff(b_at))]) << np.uint64(32)
    n = len(value)
    if n < 1 << 24 and len(pairs) <= 1 << 8:
        key = (value << np.uint64(24)) | np.arange(n, dtype=np.uint64)
        key.sort()
        order, name = (key & np.uint64(0xFFFFFF)).astype(np.int64), key >> np.uint64(24)
    else:
        order = np.argsort(value, kind="stable")
        name = value[order]
    new = np.concatenate([[True], name[1:] != name[:-1]])
    of_b = order >= len(a)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    in_a, in_b = ~of_b[start], of_b[start + size - 1]
    twice = in_a & (size > 1) & ~of_b[np.minimum(start + 1, n - 1)]
    first = new.copy()
    first[1:] |= of_b[1:] & ~of_b[:-1]

    def placed(x, dtype):
        out = np.empty(n, dtype)
        out[order] = x
        return out

    partner = placed(np.repeat(np.where(in_a, order[start], -1), size), np.int64)[len(a):]
    repeated = placed(np.repeat(twice, size), bool)[len(a):]
    held_a = placed(np.repeat(in_b, size), bool)[:len(a)]
    kinds = placed(first, bool)
    return Matches(a, b, a_at, b_at, partner, repeated, _sum(partner >= 0), _sum(held_a), _sum(kinds[:len(a)]), _sum(kinds[len(a):]))


def _dense(common: np.ndarray, kinds: np.ndarray, at: np.ndarray, need: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(any, low, high): has a pair an interval of ``need`` places or more whose common shingles are
    ``similarity`` of its distinct ones, as a span's must be; for places, the least value of
    common - similarity * distinct up to there, and the largest from there on.  Places of pair i begin at at[i] + i."""
    n = np.diff(at) + 1
    pair = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(pair)) - pair
    # the pairs stand far apart, so that no value reaches into another one
    x = common[place] - similarity * kinds[place] - pair * float(len(common) + 1)
    low, high = np.minimum.accumulate(x), np.maximum.accumulate(x[::-1])[::-1]
    inside = place - at[pair] >= need
    late = np.flatnonzero(inside)
    found = np.zeros(len(n), dtype=bool)
    found[pair[late[x[late] - low[late - need] >= -1e-3]]] = True
    return found, low, high


def _runs(places: np.ndarray, a_at: np.ndarray, repeated: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows a_first, b_first, length of the unbroken common runs; ``places`` are the common places of b, a_at their
    first places in a.  A shingle that a repeats goes on with the run before it and, besides, with the
    run after it; on its own it stands for its first place."""
    ways = [a_at]
    if repeated.any():
        turn, bp, al, bl = np.flatnonzero(repeated).tolist(), places.tolist(), a.tolist(), b[places].tolist()
        for step in (1, -1):
            own = a_at.tolist()
            for i in turn[::step]:
                if 0 <= i - step < len(bp) and bp[i] - step == bp[i - step]:
                    want = own[i - step] + step
                    if 0 <= want < len(al) and al[want] == bl[i]:
                        own[i] = want
            ways.append(np.array(own, dtype=np.int64))
    out, apart = [], places[1:] - places[:-1] != 1
    for way in ways:
        first = np.flatnonzero(np.concatenate([[True], apart | (way[1:] - way[:-1] != 1)]))
        out.append((way[first], places[first], np.append(first[1:], len(places)) - first))
    if len(out) == 1:
        return np.stack(out[0])
    runs = np.concatenate([np.stack(x) for x in out], axis=1)
    runs = runs[:, np.lexsort((runs[2], runs[0], runs[1]))]
    return runs[:, np.concatenate([[True], (runs[:, 1:] != runs[:, :-1]).any(axis=0)])]


def verify(a: np.ndarray, b: np.ndarray, words: int = WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """The spans of one pair, of shingles of any size; see ``verify_pairs``."""
    named = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.uint32)
    return verify_pairs(named[:len(a)], named[len(a):], np.array([0, len(a)]), np.array([0, len(b)]), words, similarity)[0]


def verify_pairs(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray,
                 words: int = WORDS, similarity: float = SIMILARITY) -> list[list[tuple[int, int, int, int, float]]]:
    """Per pair the spans (a_first, a_last, b_first, b_last, similarity), in shingles, where
    b repeats a passage of a.  The shingles of pair i stand from a_at[i] to a_at[i + 1], and from b_at[i].

    Of all pairs together it is found which shingles are common, and which pairs have no interval dense enough."""
    need, n = words - SHINGLE + 1, len(a_at) - 1
    out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in range(n)]
    if not len(a) or not len(b):
        return out
    m = _matches(a, b, a_at, b_at)
    total = m.common[b_at[1:]] - m.common[b_at[:-1]]
    once_b = m.kinds_b[b_at[1:]] - m.kinds_b[b_at[:-1]] == np.diff(b_at)
    dense_b, low_b, high_b = _dense(m.common, m.kinds_b, b_at, need, similarity)
    # distinct shingles of b need as many in a, but for the share that may differ
    dense_a, low_a, high_a = _dense(m.common_a, m.kinds_a, a_at, int(np.ceil(similarity * need - 1e-6)), similarity)
    for i in np.flatnonzero((total > 0) & dense_b & (dense_a | ~once_b)).tolist():
        out[i] = _spans(m, i, (low_a, high_a, low_b, high_b), need, similarity)
    return out


def _stretches(sizes: list[int], most: int = 1 << 20):
    """(from, to) of rows that go together: ``most`` bytes, or a single row."""
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if sizes:
        yield lo, len(sizes)


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4-byte numbers of all rows behind each other, and where each row's begin."""
    return np.frombuffer(b"".join(raw), dtype="<u4"), _sum([len(x) // 4 for x in raw]).astype(np.int64)


def _spans(m: Matches, i: int, bounds: tuple[np.ndarray, ...], need: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The spans of pair i.

    With c common shingles and g others in both intervals the similarity is
    c / (c + g), so a gap may be as long as the runs around it pay for.  The longest
    run that no span holds yet is extended run by run to both sides, wherever in a it
    lies, until no run is left."""
    pay, out = similarity / max(1e-9, 1 - similarity), []
    a_0, a_n, b_0, b_n = int(m.a_at[i]), int(m.a_at[i + 1]), int(m.b_at[i]), int(m.b_at[i + 1])
    a, b, partner = m.a[a_0:a_n], m.b[b_0:b_n], m.partner[b_0:b_n]
    common, kinds_a, kinds_b = (x[lo:hi + 1] - x[lo] for x, lo, hi in ((m.common, b_0, b_n), (m.kinds_a, a_0, a_n), (m.kinds_b, b_0, b_n)))
    total = int(common[-1])
    plain = bool(kinds_a[-1] == len(a) and kinds_b[-1] == len(b))
    if plain and total < similarity * need - 1e-6:
        return []
    places = np.flatnonzero(partner >= 0)
    runs = _runs(places, partner[places] - a_0, m.repeated[b_0:b_n][places], a, b)
    # k breaks cost 8 k shingles or more, so one run of a span has this length; with repeated shingles 4 k
    least = min(need, max(1, int((4 if plain else 2) * pay)))
    # from the first run to the last: no span is longer, and of near copies this is the whole passage
    ra, rb, rl = runs
    a_end, b_end = ra + rl - 1, rb + rl - 1
    if (ra[1:] > a_end[:-1]).all() and (rb[1:] > b_end[:-1]).all():
        a0, a1, b0, b1 = (int(x) for x in (ra[0], a_end[-1], rb[0], b_end[-1]))
        if b1 - b0 + 1 >= need and total * (1 + similarity) >= similarity * (
                kinds_a[a1 + 1] - kinds_a[a0] + kinds_b[b1 + 1] - kinds_b[b0]) - 1e-6:
            j = _jaccard(a[a0:a1 + 1], b[b0:b1 + 1], plain)
            if j >= similarity:
                return [(a0, a1, b0, b1, j)]
    # runs that no dense interval holds are in no span
    low_a, high_a, low_b, high_b = bounds
    low_a, high_a, low_b, high_b = low_a[a_0 + i + ra], high_a[a_0 + i + ra + rl], low_b[b_0 + i + rb], high_b[b_0 + i + rb + rl]
    left = (rl >= least) & (high_b - low_b >= -1e-3) & (high_a - low_a >= -1e-3)
    if not left.any():
        return []
    low_a, high_a, low_b, high_b = (x.tolist() for x in (low_a, high_a, low_b, high_b))

    def follower(ra, rb, both, k):
        """(run, gain) of the run that goes on best behind run k."""
        a1, b1 = ra[k] + rl[k], rb[k] + rl[k]
        # the part of a run that lies beyond both ends
        skip = np.maximum(a1 - ra, b1 - rb)
        np.maximum(skip, 0, out=skip)
        more = rl - skip
        worth = more - pay * (both + 2 * skip - (a1 + b1))
        worth[more <= 0] = -np.inf
        best = int(worth.argmax())
        return best, float(worth[best])

    def extend(ra, rb, both, known, k, others, after, dense):
        """Runs reached from run k to the right, as long as
        all matches, ``others`` and ``after`` (by the run), could pay for the gap and a ``dense``
        interval can hold both runs."""
        ends, gain = [k], 0.0
        while True:
            if k not in known:
                known[k] = follower(ra, rb, both, k)
            k, more = known[k]
            gain += more
            if not (gain + others + after[k] >= -1e-6 and dense(k)):
                return ends
            ends.append(k)

    onward, backward = {}, {}
    # to the left: the same on mirrored positions
    left_a, left_b = 1 - ra - rl, 1 - rb - rl
    both, left_both = ra + rb, left_a + left_b
    before, after = common[rb].tolist(), (total - common[b_end + 1]).tolist()
    seeds = np.flatnonzero(left)
    for at in seeds[np.argsort(-rl[seeds], kind="stable")].tolist():
        if not left[at]:
            continue
        last = extend(ra, rb, both, onward, at, total - after[at], after,
                      lambda k: high_b[k] - low_b[at] >= -1e-3 and high_a[k] - low_a[at] >= -1e-3)  # noqa: B023
        first = extend(left_a, left_b, left_both, backward, at, total - before[at], before,
                       lambda k: high_b[at] - low_b[k] >= -1e-3 and high_a[at] - low_a[k] >= -1e-3)  # noqa: B023
        if len(first) == len(last) == 1:   # the run alone
            if rl[at] >= need:
                span = int(ra[at]), int(a_end[at]), int(rb[at]), int(b_end[at])
                out.append((*span, 1.0))
                left &= (rb < span[2]) | (b_end > span[3])
            continue
        a0, a1, b0, b1 = ra[first], a_end[last], rb[first], b_end[last]
        size = b1 - b0[:, None] + 1
        # no more than b's matches are common, no less than the first places are distinct
        may = (size >= need) & ((common[b1 + 1] - common[b0][:, None]) * (1 + similarity) >= similarity * (
            (kinds_a[a1 + 1] + kinds_b[b1 + 1]) - (kinds_a[a0] + kinds_b[b0])[:, None]) - 1e-6)
        for c in np.flatnonzero(may)[np.argsort(-size[may], kind="stable")].tolist():
            c0, c1 = divmod(c, len(last))
            span = int(a0[c0]), int(a1[c1]), int(b0[c0]), int(b1[c1])
            j = _jaccard(a[span[0]:span[1] + 1], b[span[2]:span[3] + 1], plain)
            if j >= similarity:
                out.append((*span, j))
                left &= (rb < span[2]) | (b_end > span[3])
                break
    return sorted(out, key=lambda r: r[2])


def near_duplicate_spans(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY,
                         hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """(doc_id, match_id, start, end, match_start, match_end, similarity,
    exact_copy): spans of doc_id, in code points, that repeat match_id's.

    A span ends where the next word starts.  Exact copies of whole texts
    of ``words`` words or more come with the copy's whole text as span."""
    texts = (id_text(docs).where("doc_id is not null")
             .select("doc_id", F.xxhash64("text").alias("h"), "text"))
    # so many stretches of white space; the pattern reads no further
    long_enough = F.col("text").rlike(rf"\A(?:\S*+\s++){{{max(0, words - 1)}}}")
    own = materialize(texts.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2"),
                                   F.length("text").alias("n"), long_enough.alias("long")), "texts")
    reps = own.groupBy("h", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))

    near = _linked(_windows(texts, hashes, words), "window-links")
    exact = _linked(_strong_windows(texts, near, reps, hashes, agree, words), "strong-links", chain=False)
    both = near.withColumn("f", F.shiftright("key", 40)).unionByName(exact.withColumn("f", F.lit(WHOLE).cast("long"))).where("a <> b")
    cand, count = materialize_freed(_candidates(both, agree, shuffle_width(docs.sparkSession)), "candidates")
    spans = _verified(texts, cand, count, reps, words, similarity)
    copies = (own.join(reps.where("copies > 1"), ["h", "h2"]).where("long and doc_id <> rep")
              .select("doc_id", F.col("rep").alias("match_id"), F.lit(0).cast("long").alias("start"),
                      F.col("n").cast("long").alias("end"), F.lit(0).cast("long").alias("match_start"),
                      F.col("n").cast("long").alias("match_end"), F.lit(1.0).alias("similarity"),
                      F.lit(True).alias("exact_copy")))
    return spans.unionByName(copies)


def _verified(texts: DataFrame, cand: DataFrame, count: int, reps: DataFrame, words: int, similarity: float) -> DataFrame:
    # the part of each text that any candidate names, as one interval
    sides = (cand.select(F.col("a").alias("h"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi"))
             .unionAll(cand.select(F.col("b").alias("h"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))))
    hulls = (sides.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
             .join(reps.groupBy("h").agg(F.min("rep").alias("doc_id")), "h"))
    # texts that no candidate names are not shuffled
    named = marked(texts, F.col("h"), sides.select("h"), 2 * count).where("_may")
    asked = named.join(hulls, ["doc_id", "h"]).select("h", "doc_id", "text", "lo", "hi")

    def extract(b):
        out = {"h": b.column(0), "doc_id": b.column(1), "lo": b.column(3), "s": [], "places": []}
        lo, hi = b.column(3).to_pylist(), b.column(4).to_pylist()
        for row, held in _text_batches(b.column(2)):
            every, offsets = shingle_batch(held)
            for i, text in enumerate(held):
                s, x, y = every[offsets[i]:offsets[i + 1]], lo[row + i], hi[row + i]
                out["s"].append((s[x:y + 1] >> np.uint64(32)).astype("<u4").tobytes())
                out["places"].append(word_starts(text)[x:y + SHINGLE + 1].tobytes())
        return out

    held, _ = materialize_freed(map_slices(asked, extract, "h long, doc_id long, lo long, s binary, places binary"), "candidate-texts")

    def cut(lo, hi, extra):   # little-endian 4-byte numbers lo..hi + extra of a text's interval
        return lambda c: F.substring(F.col(c), ((F.col(lo) - F.col("lo")) * 4 + 1).cast("int"),
                                     ((F.col(hi) - F.col(lo) + 1 + extra) * 4).cast("int"))

    side_a = (cand.join(held, cand["a"] == held["h"])
              .select("a", "b", "b_lo", "b_hi", F.col("doc_id").alias("match_id"),
                      cut("a_lo", "a_hi", 0)("s").alias("a_s"), cut("a_lo", "a_hi", SHINGLE)("places").alias("a_at")))
    both = (side_a.join(held, side_a["b"] == held["h"])
            .select("match_id", "doc_id", "a_s", "a_at", cut("b_lo", "b_hi", 0)("s").alias("b_s"),
                    cut("b_lo", "b_hi", SHINGLE)("places").alias("b_at")))

    def check(b):
        out = {c: [] for c in ("doc_id", "match_id", "start", "end", "match_start", "match_end", "similarity")}
        match_ids, doc_ids, a_s, a_at, b_s, b_at = (c.to_pylist() for c in b.columns)
        for lo, hi in _stretches([len(x) + len(y) for x, y in zip(a_s, b_s)]):
            (x, x_at), (y, y_at) = _joined(a_s[lo:hi]), _joined(b_s[lo:hi])
            for i, spans in enumerate(verify_pairs(x, y, x_at, y_at, words, similarity), lo):
                if spans:
                    at, match_at = (np.frombuffer(raw[i], dtype="<u4") for raw in (b_at, a_at))
                for a0, a1, b0, b1, j in spans:
                    row = (doc_ids[i], match_ids[i], int(at[b0]), int(at[b1 + SHINGLE]), int(match_at[a0]), int(match_at[a1 + SHINGLE]), j)
                    for c, v in zip(out, row):
                        out[c].append(v)
        return out

    return (map_slices(both, check, "doc_id long, match_id long, start long, end long, match_start long, match_end long, similarity double")
            .distinct().withColumn("exact_copy", F.lit(False)))


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans removed from their texts (and n_chars set anew,
    where there is one); every row and column stays."""
    one, count = materialize_freed(spans.groupBy(F.col("doc_id").alias("_id")).agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans")), "cuts")
    # the row as one struct: its columns' names cannot clash with the spans'
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"))
    # texts without spans stay where they are; only the others go through the join's shuffle
    rows = marked(rows, F.col("d.doc_id").cast("long"), one.select("_id"), count)
    joined = rows.where("_may").join(one, F.col("d.doc_id").cast("long") == F.col("_id"), "left")
    text, some = F.col("d.text"), F.col("_spans").isNotNull()
    # the text left of each span, from where the spans before it ended
    start = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("p"))

    def step(acc, s):
        more = F.substring(text, (acc["p"] + 1).cast("int"), F.greatest(s["start"] - acc["p"], F.lit(0)).cast("int"))
        return F.struct(F.concat(acc["t"], more).alias("t"), F.greatest(acc["p"], s["end"]).alias("p"))

    done = F.aggregate("_spans", start, step)
    rest = F.concat(done["t"], F.substring(text, (done["p"] + 1).cast("int"), F.length(text)))
    new = {"text": F.when(some, rest).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length(rest)).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    cut = joined.select(*[new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
    return rows.where("not _may").select(*[F.col(f"d.`{c}`") for c in docs.columns]).union(cut)
