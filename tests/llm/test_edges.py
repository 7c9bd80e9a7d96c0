"""Every operator and stage on null, empty, very long and repeated texts, on
empty tables and with extra columns whose names clash."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tractus.llm import (bytebpe, classlm, fingerprint, langid, packing, quality, secrets, simhash, substring,
                         vectorjoin)

from .frames import clashing, documents, edge_rows

def train():
    return F.lit(True)

LABELS = "doc_id long, quality int, toxic int"


def _quality(d):
    lab = d.sparkSession.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (10, 1, 0), (2, 0, 0), (None, 1, 0), (6, None, 0)], LABELS)
    f = quality.features(d)
    return quality.score(f, quality.fit(f, lab, train()))


def _lm(d):
    return classlm.score(d, *classlm.fit(d, train()))


OPERATORS = {
    "secrets": lambda d: secrets.digest(secrets.scan(d, secrets.fit(d))),
    "bytebpe": lambda d: bytebpe.digest(d, bytebpe.default_ranks()),
    "fingerprint": fingerprint.compare_edits,
    "quality": _quality,
    "classlm": _lm,
    "simhash": simhash.near_duplicates,
    "langid": lambda d: langid.predict(d, langid.fit(d, train())),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, name):
    rows = edge_rows()
    d = clashing(documents(spark, rows))
    got = OPERATORS[name](d).toPandas()
    ids = sorted(str(r[0]) for r in rows)
    assert sorted("None" if v != v or v is None else str(int(v)) for v in got["doc_id"]) == ids


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](documents(spark, []).limit(0)).count() == 0


def test_packing_edges(spark):
    d = clashing(documents(spark, edge_rows()))
    got = packing.pack(d, packing.default_vocabulary()).toPandas()
    assert len(got[got.doc_id == 5]) == 2 and (got[got.doc_id.isin([1, 2, 3])].length == 1).all()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert got[got.doc_id == 6].piece.max() >= 1
    assert packing.pack(documents(spark, []), packing.default_vocabulary()).count() == 0


def test_substring_edges(spark):
    d = clashing(documents(spark, edge_rows()))
    got = substring.near_duplicate_spans(d).toPandas()
    assert set(zip(got.doc_id, got.match_id, got.exact_copy)) == {(5, 4, True)}
    assert substring.near_duplicate_spans(documents(spark, [])).count() == 0


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, []), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [1e-200, 0.0]), (11, [1e200, 1e199])]
    d = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in vectorjoin.near_duplicates(d).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert got[1] == [(4, 1)] and got[2] == [(4, 1)] * 2 and got[10] == [(4, 1)] and got[11] == [(4, 1)]
    for alone in (3, 4, 5, 6, 7, 8, 9):
        assert got[alone] == [(0, alone)]
    assert got[None] == [(0, None)]
    assert vectorjoin.near_duplicates(d.limit(0)).count() == 0


def test_defined_results_of_empty_texts(spark):
    d = documents(spark, [(1, None), (2, ""), (3, "abc def")])
    bpe = {r.doc_id: r for r in bytebpe.digest(d, bytebpe.default_ranks()).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert bpe[1].n_tokens == 0 and bpe[1].ids_sha256 == bpe[2].decoded_sha256 == nothing
    fp = {r.doc_id: r for r in fingerprint.compare_edits(d).collect()}
    assert fp[1].fingerprint == fp[2].fingerprint and fp[1].near_next == 1.0 and fp[2].near_next == 0.0
    sh = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert sh[1] == sh[2] == (0, 1) and sh[3][1] == 3
    lang = langid.predict(d, langid.fit(d, train())).collect()
    assert {r.doc_id: r.lang_pred for r in lang} == {1: "und", 2: "und", 3: "en"}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_pipeline_stages(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (10, 1, 0), (2, 0, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    plain = documents(spark, edge_rows())
    d = clashing(plain)
    got = stage(spark, d, str(tmp_path))
    if name != "pack":
        assert got.columns == d.columns
        assert stage(spark, plain, str(tmp_path)).columns == plain.columns
    if name in ("substring", "secrets"):
        assert got.count() == d.count()
    if name == "near_dedup":
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        assert sorted(str(i) for i in ids) == sorted(["1", "4", "6", "None", "8", "9", "10"])
    assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0
