"""Small frames shared by the tests."""

import numpy as np
import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=400):
    r = np.random.default_rng(seed)
    abc = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ten", "zu") for b in ("ra", "so", "vi", "na") for c in
           ("", "ly", "ion", "ed", "st", "er", "an", "um", "ik", "os", "al", "ep", "ur", "ox", "id", "et", "ag", "in", "ob", "us")]
    return [abc[i] for i in r.integers(0, min(vocabulary, len(abc)), n)]


def prose(seed, n=120):
    w = words(seed, n)
    return ". ".join(" ".join(w[i:i + 9]).capitalize() for i in range(0, n, 9)) + "."


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_rows():
    """Null and empty texts, a long one, ties, repeated rows, a null id."""
    long = prose(77, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(4)), (5, prose(4)), (5, prose(4)), (6, long),
            (None, prose(9)), (8, "x"), (9, "é ñ 中文 🙂 ß ŉ"), (10, prose(10) + "\n" + prose(11))]


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    extra = ["x", "y", "h", "fp", "rep", "part", "at", "key", "a", "b", "n", "score", "id", "component", "length",
             "start", "end", "spans", "row", "c", "_c", "cell", "_spans", "label", "rank"]
    return df.select("*", *[F.lit("clash").alias(c) for c in extra if c not in df.columns])


def pandas(df, *by) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(by) or [out.columns[0]]).reset_index(drop=True) if len(out) else out


def roots(n, pairs):
    """Smallest member reachable, of 0..n-1."""
    p = list(range(n))

    def find(a):
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]
