"""Readers: screening-tool tract table, cities, centres, CSV null text."""

from tractus.session import scratch_dir
from tractus.sources.screening import (INDICATORS, canonical_tracts, normalise, read_centres,
                                       read_cities, read_tracts)


def test_normalise_names():
    assert normalise("PM2.5 in the air (percentile)") == "PM2.5_in_the_air__percentile_"
    assert normalise("State/Territory") == "State_Territory"


def test_read_tracts_csv_with_source_names(spark):
    path = scratch_dir(spark, "tracts")
    header = ["Census tract ID", "County Name", "State/Territory", "Total population",
              "PM2.5 in the air (percentile)", "Traffic proximity and volume (percentile)",
              "Unused column"]
    rows = [["1073013300", "Jefferson County", "Alabama", "3000", "0.5", "0.25", "x"]]
    with open(path.removeprefix("file:") + "/t.csv", "w") as f:
        f.write(",".join(f'"{h}"' for h in header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")
    df = read_tracts(spark, path)
    assert df.columns == ["census_tract_id", "county_name", "state", "total_population", "PM25",
                          "Traffic_Proximity"]
    r = df.first()
    assert r.census_tract_id == "01073013300" and r.total_population == 3000 and r.PM25 == 0.5
    assert INDICATORS[0] == "PM25" and len(INDICATORS) == 7


def test_canonical_catalog_names(spark):
    df = spark.createDataFrame([("Alabama", "Kent County", "27073180300", 0.9)],
                               "State string, County_Name string, Census_tract_ID string, "
                               "`Diesel_particulate_matter_exposure__percentile_` double")
    assert canonical_tracts(df).columns == ["state", "county_name", "census_tract_id",
                                            "Diesel_Particulate"]


def test_read_cities_and_centres(spark):
    path = scratch_dir(spark, "cities")
    with open(path.removeprefix("file:") + "/c.csv", "w") as f:
        f.write("city,county_name,population,lat,lng,id\nA,Kent,10,1.5,2.5,7\n")
    c = read_cities(spark, path).first()
    assert (c.city, c.population, c.id) == ("A", 10, 7)
    path = scratch_dir(spark, "centres")
    with open(path.removeprefix("file:") + "/s.csv", "w") as f:
        f.write(",SF,lat,lon,geo_size\n0,Alabama,32.5,-86.7,1.0\n1,Guam,null,null,2.0\n")
    rows = read_centres(spark, path, ["SF"]).orderBy("SF").collect()
    assert [(r.SF, r.lat) for r in rows] == [("Alabama", 32.5), ("Guam", None)]


def _csv(spark, *texts):
    path = scratch_dir(spark, "csv").removeprefix("file:")
    for i, t in enumerate(texts):
        with open(f"{path}/{i}.csv", "w") as f:
            f.write(t)
    return path


def test_inferred_schema_keeps_ids(spark):
    from tractus.sources.files import infer_csv_schema, read_csv_inferred
    head = "id,n,share,flag,day,none,long,mixed,word\n"
    path = _csv(spark, head + "01073013300,5,0.5,true,2020-02-29,null,1234567890123456789,1,a\n48001950100,-7,,False,,,3,null,\n",
                head + "48001950100,0,1e-3,true,2021-01-01,,4,x,null\n")
    got = {f.name: f.dataType.simpleString() for f in infer_csv_schema(spark, path).fields}
    assert got == {"id": "string", "n": "bigint", "share": "double", "flag": "boolean", "day": "date", "none": "string",
                   "long": "string", "mixed": "string", "word": "string"}
    rows = read_csv_inferred(spark, path, strings=("n",)).collect()
    assert sorted(r.id for r in rows) == ["01073013300", "48001950100", "48001950100"]
    assert sorted(r.n for r in rows) == ["-7", "0", "5"] and {r.share for r in rows} == {0.5, None, 0.001}


def test_inferred_schema_of_odd_files(spark):
    import pytest

    from tractus.sources.files import check_columns, infer_csv_schema
    assert infer_csv_schema(spark, _csv(spark, "a,b.c\n")).simpleString() == "struct<a:string,b.c:string>"
    got = infer_csv_schema(spark, _csv(spark, "d,e\n2021-02-30,1.\n2021-02-28,.5\n"))
    assert got.simpleString() == "struct<d:string,e:double>"
    with pytest.raises(Exception):
        infer_csv_schema(spark, _csv(spark, "a,b\n1,2\n", "b,a\n1,2\n"))
    with pytest.raises(ValueError, match="lacks"):
        check_columns(spark.range(1), ["id", "rank"])
