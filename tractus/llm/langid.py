"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts the hashed 1- to 3-grams of every labelled text per
language inside the tasks (one dense vector of ``buckets`` per language and
task) and sums them with one aggregate; the smoothed log-probability
matrix (languages x buckets) is the only thing that is broadcast, and its
size depends on the number of languages alone.  Scoring is a sparse
product of a text's bucket counts with that matrix.

Cases: null text or a text without a letter is ``und`` with score 0; no
labelled row at all makes every text ``und`` with score 0; equal scores go to
the language that sorts first; rows with a null language are not learned
from; repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractus.llm.common import id_text, map_slices

BUCKETS = 1 << 14
UNDETERMINED = "und"
_NOT_LETTER = re.compile(r"[\W\d_]+")
_ASCII_LETTER = re.compile("[a-z]")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def letters_only(text: str | None) -> str | None:
    """Lower-cased words of letters with single spaces; None without a letter."""
    if not text:
        return None
    s = _NOT_LETTER.sub(" ", text.lower())
    if not _ASCII_LETTER.search(s) and not any(c.isalpha() for c in s):
        return None
    return s


def bucket_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each hash bucket over the 1-, 2- and 3-grams."""
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = (c + np.uint32(1)) * _MIX[0]
    out = np.bincount(h >> shift, minlength=buckets)
    for n in (1, 2):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[n] + c[n:]
        h *= _MIX[0]
        out += np.bincount(h >> shift, minlength=buckets)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray   # (languages,)
    log_prob: np.ndarray    # (languages, buckets)

    def predict(self, text: str | None) -> tuple[str, float]:
        s = letters_only(text)
        if s is None or not self.languages:
            return UNDETERMINED, 0.0
        counts = bucket_counts(s, self.log_prob.shape[1])
        at = np.flatnonzero(counts)
        ll = self.log_prob[:, at] @ counts[at].astype(np.float64)
        # n-grams overlap and repeat, so that their evidence is damped by
        # the root of their number before the posterior is taken
        z = self.log_prior + ll / np.sqrt(max(1, len(s)))
        best = int(np.argmax(z))
        return self.languages[best], float(1.0 / np.exp(z - z[best]).sum())


def fit(docs: DataFrame, train: Column, buckets: int = BUCKETS,
        alpha: float = 0.5) -> LanguageModel:
    """Counts over all rows where ``train`` holds and lang is not null."""
    rows = (docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))

    def partials(batches):
        import pyarrow as pa
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = letters_only(text.as_py())
                if s is not None:
                    if lang not in total:
                        total[lang] = np.zeros(buckets, dtype=np.int64)
                    total[lang] += bucket_counts(s, buckets)
                    docs_of[lang] = docs_of.get(lang, 0) + 1
        for lang, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * (len(at) + 1), pa.string()),
                "bucket": pa.array(np.append(at, -1), pa.int32()),   # -1: number of texts
                "n": pa.array(np.append(v[at], docs_of[lang]), pa.int64())})

    sums = (rows.mapInArrow(partials, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(sums["lang"].unique().tolist())
    index = {v: i for i, v in enumerate(languages)}
    counts = np.zeros((len(languages), buckets))
    prior = np.zeros(len(languages))
    lang_at = sums["lang"].map(index).to_numpy(dtype=np.int64)
    at, n = sums["bucket"].to_numpy(dtype=np.int64), sums["n"].to_numpy(dtype=np.float64)
    counts[lang_at[at >= 0], at[at >= 0]] = n[at >= 0]
    prior[lang_at[at < 0]] = n[at < 0]
    log_prob = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * buckets))
    return LanguageModel(languages, np.log(prior / max(1.0, prior.sum())) if languages else prior, log_prob)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(b):
        got = [shared.value.predict(t.as_py()) for t in b.column(1)]
        return {"doc_id": b.column(0), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    return map_slices(id_text(docs), score, "doc_id long, lang_pred string, score double")
