"""Region keys that two tables spell differently.

One affix repair (``X`` to ``X County``) leaves parishes, boroughs and accented
names without a partner.  Here every distinct key of the places gets a unit key
in three steps, each working on what the one before left:

* exact: the same text;
* normalised: the same after lower-casing, removing accents and punctuation,
  writing abbreviations out and dropping the area word at the end;
* similar: the largest share of common words (Jaccard), ``threshold`` at least.

``block`` names columns (a state, say) that both tables have and that must agree.
The similarity join is blocked by words: names with a Jaccard of t share one of the
``size - ceil(t * size) + 1`` rarest words of either, so just those are
joined, and no frequent word ("san") brings all its names together.

Only distinct keys are joined; the places behind a key are counted before.

Cases: a key that fits several unit keys equally well is ``ambiguous`` and gets
none; null or blank keys, and keys with a null block, are ``unmatched``; a unit key
may serve several place keys; repeated rows only raise the count; without units all
keys are unmatched, without places there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tractus.operators.places import attach_principal_place

# fixed values: words for kinds of areas, and abbreviations in names
AREA_WORDS = ("city and borough", "census area", "county", "parish", "borough", "municipality", "municipio")
ABBREVIATIONS = {"st": "saint", "ste": "sainte", "ft": "fort", "mt": "mount"}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēėęěğīįłńňōőřśšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeegiilnnoorsstuuuzzz"
THRESHOLD = 0.6
EXACT, NORMALISED, SIMILAR, AMBIGUOUS, UNMATCHED = "exact", "normalised", "similar", "ambiguous", "unmatched"


def normalised(key: str | Column, area_words: tuple[str, ...] = AREA_WORDS,
               abbreviations: dict[str, str] | None = None) -> Column:
    """The key without accents, punctuation, abbreviations and trailing area words."""
    c = F.translate(F.lower(F.col(key) if isinstance(key, str) else key), ACCENTED, PLAIN)
    c = F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    for short, long in (ABBREVIATIONS if abbreviations is None else abbreviations).items():
        c = F.regexp_replace(c, rf"\b{short}\b", long)
    return F.regexp_replace(c, f"( ({'|'.join(area_words)}))+$", "") if area_words else c


def _words(names: DataFrame, counts: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(on, name, words, word): a row for each word by which the name is looked up."""
    single = names.select(*on, "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    ranked = (single.join(counts, "word").groupBy(*on, "name")
              .agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ws")))
    size = F.size("ws")
    head = size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    return ranked.select(*on, "name", F.col("ws.word").alias("words"), F.explode(F.slice("ws", F.lit(1), head)["word"]).alias("word"))


def _similar(a: DataFrame, b: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(on, name, other, similarity, n_best) for names of ``b``: the best name of ``a``,
    and how many are as good."""
    both = a.select("name").unionAll(b.select("name")).select(F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    counts = both.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    left = _words(b, counts, on, threshold)
    right = _words(a, counts, on, threshold).withColumnRenamed("name", "other").withColumnRenamed("words", "other_words")
    pairs = left.join(right, [*on, "word"]).drop("word").distinct()
    common = F.size(F.array_intersect("words", "other_words"))
    scored = (pairs.withColumn("similarity", common / (F.size("words") + F.size("other_words") - common))
              .where(F.col("similarity") >= threshold))
    # partial aggregates: the best similarity, then the names that reach it
    top = scored.groupBy(*on, "name").agg(F.max("similarity").alias("similarity"))
    return (scored.join(top, [*on, "name", "similarity"]).groupBy(*on, "name", "similarity")
            .agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("n_best")))


def match_keys(units: DataFrame, places: DataFrame, unit_key: str = "county_name", place_key: str = "county_name",
               block: tuple[str, ...] = (), threshold: float = THRESHOLD, area_words: tuple[str, ...] = AREA_WORDS,
               observation: Observation | None = None) -> DataFrame:
    """(block, place_key, matched_key, how, similarity, n_places), a row per distinct place key.

    ``observation`` receives ``keys``, ``unmatched_keys`` and ``unmatched_places`` (ambiguous ones
    included) when the result is computed, without a job of its own."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    on = list(block)
    own = (units.select(*on, F.col(unit_key).cast("string").alias("unit")).where("unit is not null").distinct()
           .withColumn("name", normalised("unit", area_words)).where("name <> ''"))
    keys = places.groupBy(*on, F.col(place_key).cast("string").alias("place")).agg(F.count(F.lit(1)).alias("n_places"))
    keys = keys.withColumn("name", normalised("place", area_words))

    same = own.select(*on, F.col("unit").alias("place"), F.col("unit").alias("exact_unit"))
    names = own.groupBy(*on, "name").agg(F.min("unit").alias("name_unit"), F.count(F.lit(1)).alias("n_units"))
    step = keys.join(same, [*on, "place"], "left").join(names, [*on, "name"], "left")
    rest = step.where("exact_unit is null and name_unit is null and name <> ''").select(*on, "name").distinct()
    near = (_similar(names.select(*on, "name"), rest, on, threshold)
            .join(names.select(*on, F.col("name").alias("other"), F.col("name_unit").alias("near_unit"),
                               F.col("n_units").alias("near_units")), [*on, "other"]))
    step = step.join(near.drop("other"), [*on, "name"], "left")
    how = (F.when(F.col("exact_unit").isNotNull(), EXACT)
           .when(F.col("n_units") == 1, NORMALISED).when(F.col("n_units") > 1, AMBIGUOUS)
           .when((F.col("n_best") == 1) & (F.col("near_units") == 1), SIMILAR).when(F.col("n_best") >= 1, AMBIGUOUS)
           .otherwise(UNMATCHED))
    step = step.withColumn("how", how)
    unit = F.when(F.col("how") == EXACT, F.col("exact_unit")).when(F.col("how") == NORMALISED, F.col("name_unit")).when(
        F.col("how") == SIMILAR, F.col("near_unit"))
    share = F.when(F.col("how").isin(EXACT, NORMALISED), F.lit(1.0)).when(F.col("how") == SIMILAR, F.col("similarity"))
    out = step.select(*on, F.col("place").alias(place_key), unit.alias("matched_key"), "how", share.alias("similarity"), "n_places")
    if observation is not None:
        lost = F.col("matched_key").isNull()
        out = out.observe(observation, F.count(F.lit(1)).alias("keys"), F.count_if(lost).alias("unmatched_keys"),
                          F.coalesce(F.sum(F.when(lost, F.col("n_places"))), F.lit(0)).alias("unmatched_places"))
    return out


def repaired_places(places: DataFrame, matches: DataFrame, place_key: str = "county_name") -> DataFrame:
    """The places that ``match_keys`` (without blocks) found a unit key for, with that key as ``place_key``."""
    found = (matches.where("matched_key is not null")
             .select(F.col(place_key).alias("_place"), F.col("matched_key").alias("_unit")))
    return (places.withColumn("_place", F.col(place_key).cast("string")).join(found, "_place")
            .withColumn(place_key, F.col("_unit")).drop("_place", "_unit"))


def attach_repaired_place(units: DataFrame, places: DataFrame, unit_key: str = "county_name", place_key: str = "county_name",
                          matches: DataFrame | None = None, block: tuple[str, ...] = (), **principal) -> DataFrame:
    """C1 with repaired keys: the places take the unit key that ``match_keys`` found, then the principal
    place is attached.  ``matches``: a stored result of ``match_keys`` (computed here if not given).
    Places without a unit key are left out; with ``block`` the same key in two blocks stays apart."""
    found = matches if matches is not None else match_keys(units, places, unit_key, place_key, block)
    on = list(block)
    if not on:
        return attach_principal_place(units, repaired_places(places, found, place_key), unit_key, place_key, **principal)
    found = (found.where("matched_key is not null")
             .select(*on, F.col(place_key).alias("_place"), F.col("matched_key").alias("_unit")))
    own = places.withColumn("_place", F.col(place_key).cast("string")).join(found, [*on, "_place"])
    # block and key as one value, so that equal keys of two blocks are not merged
    own = own.withColumn("_key", F.struct(*on, F.col("_unit"))).drop(*on, place_key, "_place", "_unit")
    keyed = units.withColumn("_key", F.struct(*on, F.col(unit_key).cast("string").alias("_unit")))
    return attach_principal_place(keyed, own, "_key", "_key", **principal).drop("_key")
