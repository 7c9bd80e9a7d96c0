"""Language-model scoring with Brown-style class n-grams.

Every word belongs to a class; a text's probability is the product of class
transitions and of words given their class, both smoothed, with one end token
per text.  Counts cover all training texts: word counts and unit bigrams are
made in the tasks and summed by Spark.  Units are the ``HEAD`` most frequent
words, each alone, and ``SUFFIXES`` groups of all other words by the hash of
their last letters, so the table that the exchange clustering works on has a
fixed size, and a word never seen has a class too.  The exchange algorithm
moves one unit at a time to the class that raises the class bigram likelihood
most.

Scoring joins words to their counts: those of the ``TABLE`` most frequent words
are broadcast (16 bytes each), all others come by a join on the word's hash, with
a text's repeated words summed first.

Cases: null and empty texts hold the end token alone; no training text at all
leaves the smoothing's uniform values; texts of any length are scored whole;
repeated rows are scored, and learned from, as often as they occur.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import SLICE_ROWS, Memory, id_text, materialize

HEAD, SUFFIXES, CLASSES = 1023, 512, 48
#: Words whose counts are broadcast, at most: 4 MB.
TABLE = 1 << 18
MEMORY = 150_000
END = b"\n"   # never a word
UNITS = 1 + HEAD + SUFFIXES   # unit 0: the end token


def tokens(text: str) -> list[bytes]:
    """Words: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash that stands for the word in tables."""
    import xxhash
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h



def suffix_unit(word: bytes) -> int:
    import xxhash
    return 1 + HEAD + xxhash.xxh32_intdigest(word[-3:]) % SUFFIXES


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, suffix, c): occurrences of every word and of the end token."""
    schema = pa.schema([("h", pa.int64()), ("suffix", pa.int32()), ("n", pa.int64())])

    def out(count):
        words = list(count)
        return pa.RecordBatch.from_pydict({
            "h": [word_hash(w) for w in words],
            "suffix": [0 if w == END else suffix_unit(w) for w in words],
            "n": list(count.values())}, schema=schema)

    def run(batches):
        count: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                count.update(tokens(t.as_py()))
                count[END] += 1
                if len(count) > 300_000:
                    yield out(count)
                    count.clear()
        if count:
            yield out(count)

    return (texts.select("text").mapInArrow(run, "h long, suffix int, n long")
            .groupBy("h").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("c")))


def unit_bigrams(texts: DataFrame, head: dict[int, int]) -> np.ndarray:
    """Counts of adjacent units, with the end token before and after each
    text; at most UNITS * UNITS numbers come to the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        top = shared.value
        unit = Memory(lambda w: top.get(word_hash(w)) or suffix_unit(w), MEMORY)
        total = np.zeros(UNITS * UNITS, dtype=np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                seq = [0]   # texts follow each other, an end token between them
                for t in whole.column(0).slice(start, SLICE_ROWS):
                    seq.extend(map(unit.__getitem__, tokens(t.as_py())))
                    seq.append(0)
                u = np.array(seq, dtype=np.int64)
                total += np.bincount(u[:-1] * UNITS + u[1:], minlength=UNITS * UNITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    got = (texts.select("text").mapInArrow(run, "pair int, n long")
           .groupBy("pair").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(UNITS * UNITS)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(UNITS, UNITS)


def frequent(vocabulary: DataFrame, limit: int = TABLE) -> pa.Table:
    """The words above the lowest count that at most ``limit`` words reach,
    most frequent first.  The count is found in a histogram of counts, so that
    no task sorts words and only the result comes to the driver."""
    per = sorted(((r.c, r.v) for r in vocabulary.groupBy("c").agg(F.count(F.lit(1)).alias("v")).collect()), reverse=True)
    least, held = None, 0
    for c, v in per:
        held += v
        if held > limit:
            break
        least = c
    got = vocabulary.where(F.col("c") >= least if least is not None else F.lit(False)).toArrow()
    return got.sort_by([("c", "descending"), ("h", "ascending")])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """Class of each unit.  The end token keeps class 0 for itself; the others
    start dealt out by frequency and move one at a time to the class with the
    largest class bigram likelihood, until a sweep moves none (every move raises the likelihood,
    so that comes; ties stay where they are).  ``sweeps`` stops earlier, for a look at the way there."""
    n = len(bigrams)
    freq = bigrams.sum(0) + bigrams.sum(1)
    order = [int(u) for u in np.argsort(-freq, kind="stable") if u]
    cls = np.zeros(n, dtype=np.int64)
    for i, u in enumerate(order):
        cls[u] = 1 + i % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    g = member.T @ bigrams @ member
    moved, done = 1, 0
    while moved and done != sweeps:
        moved, done = 0, done + 1
        for u in order:
            if not freq[u]:
                continue
            own, loop = cls[u], bigrams[u, u]
            row = np.bincount(cls, bigrams[u], classes)
            col = np.bincount(cls, bigrams[:, u], classes)
            row[own] -= loop
            col[own] -= loop
            g[own] -= row
            g[:, own] -= col
            g[own, own] -= loop
            # likelihood change of joining each class h
            a = _xlogx(g + row) - _xlogx(g)              # row h gains u's successors
            b = _xlogx(g + col[:, None]) - _xlogx(g)     # column h gains u's predecessors
            d = np.diag(g)
            gain = (a.sum(1) - np.diag(a) + b.sum(0) - np.diag(b)
                    + _xlogx(d + row + col + loop) - _xlogx(d))
            out, into = g.sum(1), g.sum(0)
            gain -= _xlogx(out + row.sum() + loop) - _xlogx(out) + _xlogx(into + col.sum() + loop) - _xlogx(into)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            g[best] += row
            g[:, best] += col
            g[best, best] += loop
            cls[u] = best
            moved += best != own
    return cls


@dataclass
class ClassModel:
    head: dict[int, int]          # word hash -> unit
    unit_class: np.ndarray
    transition: np.ndarray        # log10, classes x classes
    log_room: np.ndarray          # log10 of each class's emission denominator
    table_hash: np.ndarray        # sorted hashes of the most frequent words
    table_count: np.ndarray
    train_tokens: int
    distinct: int

    @property
    def base_room(self) -> float:
        return float(np.log10(self.train_tokens + 0.5 * (self.distinct + 1)))


def transitions(class_bigrams: np.ndarray) -> np.ndarray:
    """Witten-Bell: a class's successors, interpolated with all classes' frequencies."""
    total = class_bigrams.sum()
    unigram = (class_bigrams.sum(0) + 0.5) / (total + 0.5 * len(class_bigrams))
    n, kinds = class_bigrams.sum(1, keepdims=True), (class_bigrams > 0).sum(1, keepdims=True)
    lam = n / np.maximum(n + kinds, 1)
    return np.log10(lam * class_bigrams / np.maximum(n, 1) + (1 - lam) * unigram)


def fit(docs: DataFrame, train: Column) -> tuple[ClassModel, DataFrame]:
    """The model and the table of word counts (h, c), learned where ``train`` holds."""
    texts = id_text(docs.where(train))
    vocabulary = materialize(word_counts(texts), "vocabulary")
    sums = vocabulary.groupBy("suffix").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    n, v = sum(s.c for s in sums), sum(s.v for s in sums)
    top = frequent(vocabulary)
    h, count = (top[c].to_numpy() for c in ("h", "c"))
    # not taken from the broadcast table, which holds none of the words whose count too many share
    first = vocabulary.where("suffix <> 0").orderBy(F.desc("c"), "h").limit(HEAD).collect()
    head = {r.h: i + 1 for i, r in enumerate(first)}
    big = unit_bigrams(texts, head)
    cls = exchange(big)
    # tokens and distinct words of each unit, the head's taken out of their suffix groups
    unit_n, unit_v = np.zeros(UNITS), np.zeros(UNITS)
    for s in sums:
        unit_n[s.suffix], unit_v[s.suffix] = s.c, s.v
    for i, r in enumerate(first):
        unit_n[r.suffix] -= r.c
        unit_v[r.suffix] -= 1
        unit_n[i + 1], unit_v[i + 1] = r.c, 1
    member = np.zeros((UNITS, CLASSES))
    member[np.arange(UNITS), cls] = 1
    room = member.T @ unit_n + 0.5 * (member.T @ unit_v + 1)
    order = np.argsort(h)
    return ClassModel(head, cls, transitions(member.T @ big @ member), np.log10(room),
                      h[order], count[order],
                      int(n), int(v)), vocabulary.select("h", "c")


class _Words:
    """A worker's words: class, log10 of the smoothed count (NaN where the count
    is not among the broadcast ones) and hash, by a number given on first sight."""

    def __init__(self, model: ClassModel, limit: int = 2 * MEMORY):
        self.model, self.limit = model, limit
        self.log = np.log10(model.table_count + 0.5)
        self._start()

    def _start(self):
        self.number: dict[bytes, int] = Numbered(self._make)
        self.cls, self.logs, self.hashes = array("i"), array("d"), array("q")

    def _make(self, word: bytes) -> int:
        m, h = self.model, word_hash(word)
        unit = 0 if word == END else m.head.get(h) or suffix_unit(word)
        at = int(m.table_hash.searchsorted(h))
        known = at < len(m.table_hash) and m.table_hash[at] == h
        self.cls.append(int(m.unit_class[unit]))
        self.logs.append(self.log[at] if known else np.nan)
        self.hashes.append(h)
        return len(self.cls) - 1

    def ids(self, text: str) -> np.ndarray:
        """Numbers of the text's words and of the end token."""
        w = tokens(text)
        w.append(END)
        return np.fromiter(map(self.number.__getitem__, w), dtype=np.int64, count=len(w))

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.cls, dtype=np.int64), np.array(self.logs), np.array(self.hashes, dtype=np.int64)

    def forget(self) -> None:
        """Start anew when many words are held (between slices only)."""
        if len(self.cls) > self.limit:
            self._start()


class Numbered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


def score(docs: DataFrame, model: ClassModel, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row; scores are log10."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("k", pa.int64()),
                        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()),
                        ("rest", pa.float64())])

    def batch(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type)
                                           for f in schema], schema=schema)

    def run(batches):
        """A row with what the task knows of a text, and a row for each of its
        words whose count has to be joined."""
        from pyspark import TaskContext
        m = shared.value
        words = _Words(m)
        number = TaskContext.get().partitionId() << 36
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                part = whole.slice(start, SLICE_ROWS)
                ids = [words.ids(t.as_py()) for t in part.column(1)]
                cls, log, h = words.columns()
                doc_ids, rows, known, logs, rest, tails = part.column(0).to_pylist(), [], [], [], [], []
                for i, doc_id in zip(ids, doc_ids):
                    number += 1
                    c = np.concatenate([[0], cls[i]])
                    rest.append(float(m.transition[c[:-1], c[1:]].sum() - m.log_room[c[1:]].sum()))
                    found = log[i]
                    away = np.isnan(found)
                    logs.append(float(found[~away].sum()))
                    known.append(len(i) - int(away.sum()))
                    rows.append(number)
                    if away.any():
                        at, k = np.unique(i[away], return_counts=True)
                        tails.append((np.full(len(at), number), h[at], k))
                # the own row's hash is its number's, so that these rows spread over the join's tasks
                yield batch(len(ids), row=rows, doc_id=doc_ids, h=[r * 0x9E3779B97F4A7C15 % (1 << 62) for r in rows],
                            k=[0] * len(ids), n_tokens=[len(i) for i in ids], n_known=known, logs=logs, rest=rest)
                if tails:
                    row, hs, k = (np.concatenate(x) for x in zip(*tails))
                    yield batch(len(row), row=row, h=hs, k=k)
                words.forget()

    rows = id_text(docs).mapInArrow(run, "row long, doc_id long, h long, k long, n_tokens long, n_known long, "
                                         "logs double, rest double")
    c = F.coalesce(F.col("c"), F.lit(0))
    tail = F.col("n_tokens").isNull()
    per_doc = (rows.join(vocabulary, "h", "left")
               .select("row", "doc_id", "n_tokens", "rest",
                       F.when(tail, F.when(c > 0, F.col("k")).otherwise(0)).otherwise(F.col("n_known")).alias("known"),
                       F.when(tail, F.col("k") * F.log10(c + 0.5)).otherwise(F.col("logs")).alias("logs"))
               .groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
                                   F.sum("known").alias("n_known"), F.sum("logs").alias("logs"),
                                   F.max("rest").alias("rest")))
    return per_doc.select("doc_id", "n_tokens", "n_known",
                          (F.col("logs") - F.col("n_tokens") * F.lit(model.base_room)).alias("base_score"),
                          (F.col("logs") + F.col("rest")).alias("score"))


def perplexity(log10_probability: Column, n_tokens: Column) -> Column:
    """Per token."""
    return F.pow(F.lit(10.0), -log10_probability / n_tokens)
