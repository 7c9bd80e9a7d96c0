"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics in one pass (the
table of vectors is written to the shared folder; texts are read once).
Class means and covariances are sums over all labelled rows, made by one
aggregate of moments.  Each covariance is shrunk towards a scaled identity by
the oracle-approximating rule, its Cholesky factor is cached in the model,
and the score is the calibrated difference of the two Mahalanobis
log-densities.

Cases: null text counts as empty and is scored like any other; labels with a
null id or value are ignored, repeated labels count as often as they occur; a
class without labelled rows cannot be told apart, then every text scores 1.0
(no label 0 seen) or 0.0 (only label 0 seen).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import SLICE_ROWS, id_text, map_slices, materialize

FEATURES = ("log_words", "word_length", "word_length_spread", "repeat_share", "top_word_share",
            "adjacent_repeat", "repeat_line_share", "symbol_share", "upper_share", "digit_share",
            "stop_rate", "short_word_share", "symbol_word_share", "non_ascii_share", "log_line")
D = len(FEATURES)
_SYMBOL_END = re.compile(r"[^\w\s.,;:'\"?)\-]")
CALIBRATION_BINS = 400
CALIBRATION_RANGE = 60.0

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL[48:58] = _SYMBOL[65:91] = _SYMBOL[97:123] = False
for _c in b".,;:'\"-()":
    _SYMBOL[_c] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


#: Strength (in words; five times that in characters) and values of the
#: typical shares that a short text's shares are drawn towards.
PRIOR = 20.0


def _logit(hits: float, n: float, typical: float, strength: float = PRIOR) -> float:
    """Log-odds of hits out of n, drawn towards a typical share; without
    that, a text of two words would be an outlier in every share."""
    return float(np.log((hits + strength * typical) / (n - hits + strength * (1.0 - typical))))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text."""
    words = text.split()
    nw = len(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    chars = int(raw.sum()) - int(raw[32] + raw[9:14].sum())
    letters = int(raw[_LETTER].sum())
    count = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=nw)
    adjacent = sum(map(str.__eq__, words, words[1:])) if nw > 1 else 0
    lines = [x for x in text.split("\n") if x]
    mean = (lengths.sum() + PRIOR * 5.5) / (nw + PRIOR)
    spread = (((lengths - mean) ** 2).sum() + PRIOR * 8.0) / (nw + PRIOR)
    symbol_words = sum(k for w, k in count.items() if _SYMBOL_END.search(w))
    return [
        float(np.log(nw + PRIOR)),
        float(np.log(mean)),
        float(np.log(spread)),
        _logit(nw - len(count), nw, 0.2),
        _logit(max(count.values(), default=0), nw, 0.08),
        _logit(adjacent, nw, 0.003),
        _logit(len(lines) - len(set(lines)), len(lines), 0.03, PRIOR / 4),
        _logit(int(raw[_SYMBOL].sum()), chars, 0.003, 5 * PRIOR),
        _logit(int(raw[_UPPER].sum()), letters, 0.03, 5 * PRIOR),
        _logit(int(raw[_DIGIT].sum()), chars, 0.002, 5 * PRIOR),
        _logit(min(nw, int(raw[46])), nw, 0.08),
        _logit(int((lengths <= 3).sum()), nw, 0.35),
        _logit(symbol_words, nw, 0.01),
        _logit(int(raw[128:].sum()), chars, 0.03, 5 * PRIOR),
        float(np.log((nw + PRIOR) / (len(lines) + 1))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) for every row; one pass over the texts."""
    def run(b):
        return {"doc_id": b.column(0), "x": [statistics(t.as_py()) for t in b.column(1)]}
    return map_slices(id_text(docs), run, "doc_id long, x array<double>")


def shrunk_covariance(cov: np.ndarray, n: float) -> np.ndarray:
    """Oracle-approximating shrinkage towards a scaled identity."""
    d = len(cov)
    mu = np.trace(cov) / d
    alpha = float((cov ** 2).mean())
    num, den = alpha + mu ** 2, (n + 1.0) * (alpha - mu ** 2 / d)
    lam = 1.0 if den <= 0 else min(1.0, num / den)
    return (1.0 - lam) * cov + lam * mu * np.eye(d) + 1e-6 * max(mu, 1e-6) * np.eye(d)


@dataclass
class QualityModel:
    """Standardisation, class means, inverse Cholesky factors, calibration."""
    centre: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    inverse_factor: list[np.ndarray]
    log_det: list[float]
    slope: float = 1.0
    intercept: float = 0.0
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log N(x | class 1) - log N(x | class 0), a row per text."""
        z = np.clip((x - self.centre) / self.scale, -8.0, 8.0)
        side = []
        for m, f, ld in zip(self.mean, self.inverse_factor, self.log_det):
            w = (z - m) @ f.T
            side.append(-0.5 * (w ** 2).sum(1) - ld)
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        t = self.slope * self.difference(x) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(t, -500, 500)))


def _matrix(b, column: int) -> np.ndarray:
    return np.array(b.column(column).to_pylist(), dtype=np.float64).reshape(-1, D)


def _moments(labelled: DataFrame, centre: np.ndarray | None, scale: np.ndarray | None):
    """Per class: rows, sums, sums of products - partial in each task, then
    one aggregate over (class, position): 2 * (1 + D + D*D) rows."""
    def partials(batches):
        acc = {}
        for b in batches:
            y, x = np.array(b.column(0).to_pylist(), dtype=np.int64), _matrix(b, 1)
            if centre is not None:
                x = np.clip((x - centre) / scale, -8.0, 8.0)
            one = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                acc[k] = acc.get(k, 0.0) + one[y == k].T @ one[y == k]
        for k, m in acc.items():
            v = m.ravel()
            yield pa.RecordBatch.from_pydict({"y": pa.array([k] * len(v), pa.int32()),
                                              "i": pa.array(range(len(v)), pa.int32()),
                                              "v": pa.array(v, pa.float64())})
    got = (labelled.select(F.col("y").cast("int"), "x")
           .mapInArrow(partials, "y int, i int, v double")
           .groupBy("y", "i").agg(F.sum("v").alias("v")).toPandas())
    out = np.zeros((2, (D + 1) ** 2))
    out[got["y"], got["i"]] = got["v"]
    return out.reshape(2, D + 1, D + 1)


def fit(feats: DataFrame, labels: DataFrame, train: Column) -> QualityModel:
    """Learn from the feature rows with a label where ``train`` holds."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    rows = materialize(feats.where(train).join(y.where("y in (0, 1)"), "doc_id").select("y", "x"),
                       "quality-train")
    m = _moments(rows, None, None)
    n = m[:, 0, 0]
    if min(n) < 2:
        # one class (or none) seen
        return QualityModel(np.zeros(D), np.ones(D), [], [], [], constant=float(n[1] > 0 or n.sum() == 0))
    both = m.sum(0)
    centre = both[0, 1:] / both[0, 0]
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - centre ** 2, 1e-8))
    m = _moments(rows, centre, scale)
    model = QualityModel(centre, scale, [], [], [])
    for k in (0, 1):
        mean = m[k, 0, 1:] / n[k]
        cov = shrunk_covariance(m[k, 1:, 1:] / n[k] - np.outer(mean, mean), n[k])
        factor = np.linalg.cholesky(cov)
        model.mean.append(mean)
        model.inverse_factor.append(np.linalg.inv(factor))
        model.log_det.append(float(np.log(np.diag(factor)).sum()))
    model.slope, model.intercept = _calibrate(rows, model)
    return model


def _calibrate(rows: DataFrame, model: QualityModel) -> tuple[float, float]:
    """Logistic calibration of the density difference on a histogram (2 x
    CALIBRATION_BINS sums over all labelled rows)."""
    def partials(batches):
        h = np.zeros((2, CALIBRATION_BINS), dtype=np.int64)
        for b in batches:
            y, d = np.array(b.column(0).to_pylist(), dtype=np.int64), model.difference(_matrix(b, 1))
            at = np.clip((d / CALIBRATION_RANGE + 1) / 2 * CALIBRATION_BINS, 0, CALIBRATION_BINS - 1)
            np.add.at(h, (y, at.astype(np.int64)), 1)
        y, at = np.nonzero(h)
        yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "at": pa.array(at, pa.int32()),
                                          "n": pa.array(h[y, at], pa.int64())})
    got = (rows.select(F.col("y").cast("int"), "x").mapInArrow(partials, "y int, at int, n long")
           .groupBy("y", "at").agg(F.sum("n").alias("n")).toPandas())
    d = ((got["at"].to_numpy() + 0.5) / CALIBRATION_BINS * 2 - 1) * CALIBRATION_RANGE
    y, w = got["y"].to_numpy(dtype=np.float64), got["n"].to_numpy(dtype=np.float64)
    n1, n0 = w[y == 1].sum(), w[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 0.1, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(60):   # Newton steps on a convex loss with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * d + c, -500, 500)))
        g = np.array([(w * (p - target) * d).sum() + 1e-3 * a, (w * (p - target)).sum()])
        q = w * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * d * d).sum() + 1e-3, (q * d).sum()], [(q * d).sum(), q.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        size = min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, c = a - size * step[0], c - size * step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-6), c


def score(feats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every feature row."""
    def run(b):
        return {"doc_id": b.column(0), "score": model.score(_matrix(b, 1))}
    return map_slices(feats.select("doc_id", "x"), run, "doc_id long, score double", rows=4096)


def accepted(docs: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """The rows, with all columns, whose text scores ``threshold`` or more.
    Rows are judged where they are read: no join, so repeated and null ids
    need no care."""
    at = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(start, SLICE_ROWS)
                x = np.array([statistics(t.as_py() or "") for t in b.column(at)], dtype=np.float64).reshape(-1, D)
                yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
