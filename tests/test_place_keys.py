"""Region keys spelled in two ways."""

import random

import pytest
from pyspark.sql import Observation

from tractus.operators.place_keys import attach_repaired_place, match_keys, normalised

UNITS = ["Acadia Parish", "Doña Ana County", "St. Louis County", "Juneau City and Borough", "Prince of Wales Census Area",
         "San Juan County", "San Juan Municipio", "Lake of the Woods County", "Orange County"]


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _units(spark):
    return _frame(spark, [(u,) for u in UNITS] + [(None,), ("Orange County",)], "county_name string")


def _matched(spark, names, **kw):
    places = _frame(spark, [(n,) for n in names], "county_name string")
    return {r.county_name: (r.matched_key, r.how) for r in match_keys(_units(spark), places, **kw).collect()}


def test_four_affixes_accents_and_abbreviations(spark):
    got = _matched(spark, ["Acadia", "Dona Ana", "Saint Louis", "Juneau", "Prince of Wales", "Orange County", "ORANGE"])
    assert got == {"Acadia": ("Acadia Parish", "normalised"), "Dona Ana": ("Doña Ana County", "normalised"),
                   "Saint Louis": ("St. Louis County", "normalised"), "Juneau": ("Juneau City and Borough", "normalised"),
                   "Prince of Wales": ("Prince of Wales Census Area", "normalised"),
                   "Orange County": ("Orange County", "exact"), "ORANGE": ("Orange County", "normalised")}


def test_similar_ambiguous_and_unmatched(spark):
    got = _matched(spark, ["Lake of Woods", "San Juan", "San Mateo", "", None, "County"])
    assert got == {"Lake of Woods": ("Lake of the Woods County", "similar"), "San Juan": (None, "ambiguous"),
                   "San Mateo": (None, "unmatched"), "": (None, "unmatched"), None: (None, "unmatched"), "County": (None, "unmatched")}


def test_unmatched_are_observed(spark):
    seen = Observation()
    places = _frame(spark, [("Acadia",)] * 3 + [("Nowhere",)] * 5 + [("San Juan",)] * 2, "county_name string")
    match_keys(_units(spark), places, observation=seen).collect()
    assert seen.get == {"keys": 3, "unmatched_keys": 2, "unmatched_places": 7}


def test_empty_sides(spark):
    none = _frame(spark, [], "county_name string")
    assert match_keys(_units(spark), none).count() == 0
    assert [r.how for r in match_keys(none, _units(spark).where("county_name = 'Orange County'")).collect()] == ["unmatched"]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 1.0])
def test_best_similarity_against_all_pairs(spark, threshold):
    r = random.Random(11)
    words = ["san", "santa", "de", "la", "rio", "alto", "bajo", "norte", "verde", "lago"]

    def name():
        return " ".join(r.sample(words, r.randrange(1, 6)))

    units, places = sorted({name() for _ in range(60)}), sorted({name() for _ in range(80)})
    got = {x.p: x for x in match_keys(_frame(spark, [(u,) for u in units], "u string"), _frame(spark, [(p,) for p in places], "p string"),
                                      "u", "p", threshold=threshold).collect()}
    assert set(got) == set(places)
    for p in places:
        share = {u: len(set(u.split()) & set(p.split())) / len(set(u.split()) | set(p.split())) for u in units}
        best = max(share.values())
        tops = [u for u in units if share[u] == best]
        if p in units:
            assert (got[p].matched_key, got[p].how) == (p, "exact")
        elif best < threshold:
            assert got[p].how == "unmatched"
        elif len(tops) > 1:
            assert got[p].how == "ambiguous"
        else:
            assert (got[p].matched_key, got[p].how) == (tops[0], "similar") and got[p].similarity == best


def test_blocks_and_principal_place(spark):
    units = _frame(spark, [("A", "Orange County"), ("B", "Orange Parish"), ("B", "Doña Ana"), (None, "Orange")], "state string, county_name string")
    places = _frame(spark, [("A", "Orange", "x", 5, 1), ("B", "Orange", "y", 9, 2), ("B", "dona ana", "z", 3, 3), (None, "Orange", "w", 99, 4)],
                    "state string, county_name string, city string, population int, id int")
    got = attach_repaired_place(units, places, block=("state",), keep={"city": "city"}).collect()
    assert {(r.state, r.county_name): r.city for r in got} == {
        ("A", "Orange County"): "x", ("B", "Orange Parish"): "y", ("B", "Doña Ana"): "z", (None, "Orange"): None}
    one = attach_repaired_place(units.where("state = 'B'"), places, keep={"city": "city"}).collect()
    assert {r.county_name: r.city for r in one} == {"Orange Parish": "w", "Doña Ana": "z"}


def test_accents_pair_up(spark):
    from tractus.operators.place_keys import ACCENTED, PLAIN
    import unicodedata
    assert len(ACCENTED) == len(PLAIN)
    for a, p in zip(ACCENTED, PLAIN):
        assert p == ("l" if a == "ł" else unicodedata.normalize("NFD", a)[0])
    assert spark.range(1).select(normalised(__import__("pyspark").sql.functions.lit("  Ste.-Marie  PARISH ")).alias("n")).first().n == "sainte marie"
