"""One GeoJSON document read by many tasks, and written as one."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tractus.session import scratch_dir
from tractus.sinks.features import write_collection
from tractus.sources.collection import document_features, read_collection
from tractus.sources.geojson import read_features

TEXTS = ["plain", 'a "quoted" one', "brace } and { brace", "back\\slash\\", 'end\\"}', "", "ünï {cødé}  ", "\n\t}", None]


def _features(n):
    return [{"type": "Feature", "id": i,
             "properties": {"id": i, "name": TEXTS[i % len(TEXTS)], "deep": {"a": {"b": [{"c": "}"}]}}},
             "geometry": None if i % 11 == 0 else {"type": "Point", "coordinates": [i / 8, -i / 4]}} for i in range(n)]


def _write(spark, name, text):
    path = scratch_dir(spark, name).removeprefix("file:")
    with open(path + "/layer.geojson", "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


DOCUMENTS = {
    "one line": lambda f: json.dumps({"type": "FeatureCollection", "features": f}),
    "spread, members around": lambda f: json.dumps(
        {"name": "x } {\" y", "crs": {"type": "name", "properties": {"name": "urn:{}"}}, "features": f,
         "bbox": [0, 1, 2, 3], "more": {"type": "x"}, "type": "FeatureCollection"}, indent=3, ensure_ascii=False) + "\n\n",
}


@pytest.mark.parametrize("layout", list(DOCUMENTS))
def test_document_over_many_splits(spark, small_splits, layout):
    want = _features(120)
    path = _write(spark, "doc", DOCUMENTS[layout](want))
    splits = spark.read.option("lineSep", "}").text(path).select("_metadata.file_block_start").distinct().count()
    assert splits > 10
    objects = [json.loads(r.feature) for r in document_features(spark, path).orderBy("n").collect()]
    assert [o for o in objects if o.get("type") == "Feature"] == want
    assert [o for o in objects if o.get("type") != "Feature"] == (
        [] if layout == "one line" else [{"type": "name", "properties": {"name": "urn:{}"}}, {"type": "x"}])
    rows = {r.id: r for r in read_features(spark, path, "id int, name string", collection=True).collect()}
    assert len(rows) == 120
    for f in want:
        r = rows[f["id"]]
        assert r.name == f["properties"]["name"] and r.geometry is None
        assert (r.point and [r.point.x, r.point.y]) == (f["geometry"] and f["geometry"]["coordinates"])


def test_several_documents_and_empty_ones(spark, small_splits):
    path = _write(spark, "docs", DOCUMENTS["one line"](_features(30)))
    for name, f in (("b", _features(25)), ("c", [])):
        with open(f"{path}/{name}.geojson", "w") as out:
            out.write(json.dumps({"features": f, "type": "FeatureCollection"}, indent=1))
    got = document_features(spark, path).groupBy("doc").count().collect()
    assert sorted(r["count"] for r in got) == [25, 30]


def test_cut_off_document_is_an_error(spark):
    text = DOCUMENTS["one line"](_features(30))
    path = _write(spark, "cut", text[:len(text) // 2])
    with pytest.raises(Exception, match="unbalanced GeoJSON document"):
        read_collection(spark, path, "id int").count()


@pytest.mark.parametrize("n", [0, 1, 57])
def test_written_document(spark, small_splits, n):
    want = _features(n)
    texts = [(json.dumps(f),) for f in want] + [(None,)]
    path = write_collection(spark.createDataFrame(texts, "feature string").repartition(5), scratch_dir(spark, "out"), name='a "b" }')
    parts = sorted(glob.glob(path.removeprefix("file:") + "/part-*"))
    doc = json.loads("".join(open(p, encoding="utf-8").read() for p in parts))
    assert doc["type"] == "FeatureCollection" and doc["name"] == 'a "b" }'
    key = lambda f: f["id"]
    assert sorted(doc["features"], key=key) == want
    got = [json.loads(r.feature) for r in document_features(spark, path, one_document=True).collect()]
    assert sorted(got, key=key) == want


def test_text_is_shuffled_without_python(spark):
    path = _write(spark, "plan", DOCUMENTS["one line"](_features(3)))
    plan = read_collection(spark, path, "id int")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and os.path.exists(path)
    assert read_collection(spark, path, "id int").select(F.sum("id")).first()[0] == 3
