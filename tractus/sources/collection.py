"""One GeoJSON document (a FeatureCollection) read by many tasks.

A document has no line structure, so its features are found by their braces.
The text is scanned in pieces that end at ``}`` (Spark's text source splits a
file at any record delimiter).  Whether a brace counts depends on all text
before it: is it inside a string, how deep is it.  Both are prefix sums: each
split sums its pieces for either state at its start, one row per split is
chained along the document, and the pieces then get their exact state.

Layouts: any white space, key order and members beside ``features``; text of
properties may hold braces, quotes and escapes.  Files are uncompressed UTF-8 without a byte order
mark.  With ``one_document`` all files of a folder, by part number, are one document
(the layout that ``tractus.sinks.features.write_collection`` writes; a part ends between features).

Cases: a document without features and an empty folder give no rows; a cut-off document
is an error; a feature without geometry has a null one; repeated features are repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tractus.session import materialize
from tractus.sources.geojson import feature_schema, geometry_columns

SPLIT = ["doc", "part_no", "file", "block"]


def _braces(text: Column) -> Column:
    """How many ``{`` stand outside strings in a text that starts outside one."""
    bare = F.regexp_replace(text, r'"[^"]*+"?', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("{")))


def _pieces(spark: SparkSession, path: str, one_document: bool) -> DataFrame:
    """A row per piece: its place, text, whether it holds an odd number of
    quotes, and its opening braces if it starts outside or inside a string."""
    file = F.col("_metadata.file_path")
    plain = F.regexp_replace("value", r"\\.", "")   # a piece never ends within an escape
    return (spark.read.option("lineSep", "}").text(path)
            .select(F.lit("").alias("doc") if one_document else file.alias("doc"),
                    F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).try_cast("long").alias("part_no"), file.alias("file"),
                    F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"),
                    F.monotonically_increasing_id().alias("seq"), "value", plain.alias("plain"))
            .withColumn("part_no", F.coalesce("part_no", F.lit(-1)))
            .withColumn("flip", F.pmod(F.length("plain") - F.length(F.replace("plain", F.lit('"'))), F.lit(2)))
            .withColumn("open_out", _braces(F.col("plain")))
            .withColumn("open_in", _braces(F.regexp_replace("plain", r'^[^"]*+"?', "")))
            .drop("plain"))


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(what, w) -> Column:
    return F.coalesce(F.sum(what).over(_before(w)), F.lit(0))


def _split_starts(pieces: DataFrame) -> DataFrame:
    """A row per split: in a string or not, depth and features ended at its start."""
    inner = Window.partitionBy(*SPLIT).orderBy("seq")
    inside = F.pmod(_sum_before("flip", inner), F.lit(2))
    step = (pieces.select(*SPLIT, "seq", "file_size", "flip", "open_out", "open_in", (F.octet_length("value") + 1).alias("bytes"))
            .withColumn("inside", inside)
            .withColumn("ends_in", F.pmod(F.col("inside") + F.col("flip"), F.lit(2)))
            .withColumn("net0", F.when(F.col("inside") == 0, F.col("open_out")).otherwise(F.col("open_in")) - (1 - F.col("ends_in")))
            .withColumn("net1", F.when(F.col("inside") == 0, F.col("open_in")).otherwise(F.col("open_out")) - F.col("ends_in"))
            .withColumn("rel0", F.sum("net0").over(inner)).withColumn("rel1", F.sum("net1").over(inner)))
    thin = materialize(step.select(*SPLIT, "file_size", "flip", "bytes", "ends_in", "net0", "net1", "rel0", "rel1"), "pieces")

    whole = Window.partitionBy("doc")
    order = whole.orderBy("part_no", "file", "block")
    of_file = Window.partitionBy("doc", "part_no", "file")
    splits = (thin.groupBy(*SPLIT).agg(F.max("file_size").alias("file_size"), F.sum("bytes").alias("bytes"), F.pmod(F.sum("flip"), F.lit(2)).alias("flip"),
                                       F.sum("net0").alias("net0"), F.sum("net1").alias("net1"))
              .withColumn("inside", F.pmod(_sum_before("flip", order), F.lit(2)))
              # what follows a file's last brace is a piece, too, but no brace ends it
              .withColumn("loose", (F.sum("bytes").over(of_file) > F.col("file_size")) & (F.col("block") == F.max("block").over(of_file)))
              .withColumn("net", F.when(F.col("inside") == 0, F.col("net0")).otherwise(F.col("net1"))
                          + F.when(F.col("loose") & (F.pmod(F.col("inside") + F.col("flip"), F.lit(2)) == 0), 1).otherwise(0))
              .withColumn("depth", _sum_before("net", order))
              .withColumn("whole", (F.sum("net").over(whole) == 0) & (F.pmod(F.sum("flip").over(whole), F.lit(2)) == 0))
              .withColumn("depth", F.when(F.col("whole"), F.col("depth")).otherwise(
                  F.raise_error(F.concat(F.lit("unbalanced GeoJSON document: "), F.col("file"))).cast("long")))
              .select(*SPLIT, "inside", "loose", "depth"))
    ended = F.when(F.col("inside") == 0, (F.col("ends_in") == 0) & (F.col("depth") + F.col("rel0") == 1)).otherwise(
        (F.col("ends_in") == 1) & (F.col("depth") + F.col("rel1") == 1))
    # a loose piece is never counted: its false brace would end the document, not a feature
    counts = (thin.select(*SPLIT, "ends_in", "rel0", "rel1").join(splits, SPLIT)
              .groupBy(*SPLIT, "inside", "loose", "depth").agg(F.sum(ended.cast("long")).alias("features")))
    return counts.withColumn("features", _sum_before("features", order))


def document_features(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """(doc, n, feature): the JSON text of every object on the second level of
    each document, numbered along it."""
    pieces = _pieces(spark, path, one_document)
    starts = _split_starts(pieces).withColumnsRenamed({"inside": "inside0", "depth": "depth0", "features": "n0"})
    w = Window.partitionBy(*SPLIT).orderBy("seq")
    placed = (pieces.drop("file_size").join(starts, SPLIT)
              .withColumn("inside", F.pmod(F.col("inside0") + _sum_before("flip", w), F.lit(2)))
              .withColumn("closes", (F.pmod(F.col("inside") + F.col("flip"), F.lit(2)) == 0).cast("long"))
              .withColumn("last", F.lead("seq").over(w).isNull() & F.col("loose"))
              .withColumn("net", F.when(F.col("inside") == 0, F.col("open_out")).otherwise(F.col("open_in")) - F.col("closes"))
              .withColumn("depth", F.col("depth0") + F.sum("net").over(w))
              .withColumn("end", ((F.col("closes") == 1) & (F.col("depth") == 1)).cast("long"))
              .withColumn("n", F.col("n0") + _sum_before("end", w))
              .withColumn("text", F.concat("value", F.when(F.col("last"), "").otherwise("}"))))
    # before its first brace a group holds separators and other members; the first also holds the document's own brace
    head = r'^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+\{'
    cut = F.regexp_replace("text", head, "{")
    first = F.regexp_replace(F.regexp_replace("text", head, ""), head, "{")
    return (placed.groupBy("doc", "n")
            .agg(F.array_sort(F.collect_list(F.struct("part_no", "file", "block", "seq", "text"))).alias("texts"), F.max("end").alias("ended"))
            .where("ended = 1")
            .select("doc", "n", F.concat_ws("", F.transform("texts", lambda t: t["text"])).alias("text"))
            .select("doc", "n", F.when(F.col("n") == 0, first).otherwise(cut).alias("feature")))


def read_collection(spark: SparkSession, path: str, properties: StructType | str, one_document: bool = False) -> DataFrame:
    """The features of one or more documents: properties as columns, plus ``geometry``
    and ``point`` as in ``tractus.sources.geojson.read_features``."""
    schema = feature_schema(StructType.fromDDL(properties) if isinstance(properties, str) else properties)
    parsed = document_features(spark, path, one_document).select(F.from_json("feature", schema, {"mode": "FAILFAST"}).alias("f"))
    return geometry_columns(parsed.select("f.*").where(F.col("type") == "Feature"))
