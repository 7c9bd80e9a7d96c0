"""DuckDB oracle SQL for the registered queries.

The same bindings and chain as ``tractus.sources.bindings`` and
``tractus.plans.domain``, written as CTEs over the driver's views
(region nation customer supplier orders lineitem ...).  Spark/DuckDB
differences are spelled out: explicit NULLS FIRST/LAST, ``trunc`` before
an integer cast, ``nullif`` for a zero divisor, ``||`` for NULL-
propagating concatenation, ranks cast to INTEGER.
"""

from __future__ import annotations

from tractus.sources import bindings as B

IND = B.INDICATORS
DEC = "DECIMAL(18,2)"
SCORE_T = "DECIMAL(30,12)"


def _d(x: float) -> str:
    """A DOUBLE literal (DuckDB reads ``0.05`` as DECIMAL)."""
    return f"CAST({x!r} AS DOUBLE)"


def _dsum(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS {DEC})) AS {DEC})"


CTE_UNITS = f"""
ind AS (
  SELECT o_custkey,
         {_dsum('l_quantity')} AS quantity,
         {_dsum('l_extendedprice')} AS revenue,
         COUNT(*) AS lines,
         {_dsum('l_tax')} AS tax,
         {_dsum('l_discount')} AS discount,
         COUNT_IF(l_returnflag = '{B.RETURN_FLAG}') AS "returns",
         MAX(l_quantity) AS max_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey),
u0 AS (
  SELECT c_custkey AS unit_id, n_name AS county_name, r_name AS state,
         CAST(round(abs(c_acctbal)) AS BIGINT) AS population,
         CAST(c_custkey % {B.AREA_MODULUS} AS DOUBLE) AS geo_area,
         quantity, revenue, lines, tax,
         CASE WHEN c_nationkey NOT IN {B.NULL_DISCOUNT_NATIONS} THEN discount END AS discount,
         "returns", max_quantity
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN ind ON c_custkey = o_custkey
            AND c_custkey % {B.NULL_UNIT_MODULUS} <> {B.NULL_UNIT_REMAINDER}),
units AS (
  SELECT unit_id, county_name, state, population, geo_area,
         SUM(geo_area) OVER (PARTITION BY county_name) AS cf_area,
         SUM(geo_area) OVER (PARTITION BY state) AS sf_area,
         {', '.join(f'"{m}"' for m in IND)}
  FROM u0)"""

CTE_PLACES = f"""
places AS (
  SELECT s_name AS city,
         CASE WHEN s_nationkey % {B.PLACE_NATION_MODULUS} <> 0 THEN replace(n_name, '{B.NATION_PREFIX}', '')
              ELSE '{B.UNMATCHED_PREFIX}' || CAST(s_nationkey AS VARCHAR) END AS county_name,
         s_acctbal AS population,
         CAST(25 + s_suppkey % 20 AS DOUBLE) AS lat,
         CAST(-120 + s_suppkey % 50 AS DOUBLE) AS lng,
         s_suppkey AS id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

# principal place, ties='one' (largest population, then smallest id)
CTE_BEST = """
best AS (
  SELECT region_key, city, city_lat, city_lon, city_id FROM (
    SELECT '""" + B.NATION_PREFIX + """' || county_name AS region_key, city,
           lat AS city_lat, lng AS city_lon, id AS city_id,
           row_number() OVER (PARTITION BY '""" + B.NATION_PREFIX + """' || county_name
                              ORDER BY population DESC NULLS LAST, id ASC) AS rn
    FROM places WHERE county_name IS NOT NULL) t
  WHERE rn = 1)"""

CTE_ENRICHED = """
e1 AS (
  SELECT u.*, b.city, b.city_lat, b.city_lon, b.city_id
  FROM units u LEFT JOIN best b ON u.county_name = b.region_key),
cden AS (SELECT county_name, CAST(SUM(population) AS DOUBLE) / nullif(MAX(cf_area), 0) AS county_density
         FROM e1 WHERE county_name IS NOT NULL GROUP BY county_name),
sden AS (SELECT state, CAST(SUM(population) AS DOUBLE) / nullif(MAX(sf_area), 0) AS state_density
         FROM e1 WHERE state IS NOT NULL GROUP BY state),
yden AS (SELECT city, CAST(SUM(population) AS DOUBLE) / nullif(SUM(geo_area), 0) AS city_density
         FROM e1 WHERE city IS NOT NULL GROUP BY city),
enriched AS (
  SELECT e1.*, CAST(population AS DOUBLE) / nullif(geo_area, 0) AS unit_density,
         cden.county_density, sden.state_density, yden.city_density
  FROM e1 LEFT JOIN cden USING (county_name) LEFT JOIN sden USING (state)
          LEFT JOIN yden USING (city))"""

CTE_SCORED = f"""
pctd AS (
  SELECT *, percent_rank() OVER (ORDER BY unit_density DESC NULLS LAST) AS density_percentile
  FROM enriched),
scored AS (
  SELECT *, CAST({' + '.join(f'CAST("{m}" AS {SCORE_T})' for m in IND)}
                 + CAST(density_percentile AS {SCORE_T}) AS {SCORE_T}) AS score
  FROM pctd)"""

CTE_COUNTY_CENTRES = f"""
county_centres AS (
  SELECT n_name AS CF, r_name AS SF, CAST(25 + n_nationkey AS DOUBLE) AS lat,
         CAST(-120 + 2 * n_nationkey AS DOUBLE) AS lon
  FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey NOT IN {B.COUNTY_CENTRES_MISSING})"""

CTE_STATE_CENTRES = f"""
state_centres AS (
  SELECT r_name AS SF, CAST(30 + 2 * r_regionkey AS DOUBLE) AS lat,
         CAST(-100 - 5 * r_regionkey AS DOUBLE) AS lon
  FROM region WHERE r_regionkey NOT IN ({B.STATE_CENTRES_MISSING[0]}))"""

CTE_TRACT_CENTRES = f"""
tract_centres AS (
  SELECT c_custkey AS GEOID10,
         CASE WHEN c_custkey % {B.TRACT_CENTRE_MODULUS} <> 0 THEN
           {_d(B.GRID_ORIGIN_Y)} + {_d(B.GRID_STEP)} * CAST(c_custkey // {B.GRID_COLUMNS} AS DOUBLE) + {_d(B.GRID_STEP / 2)} END AS lat,
         CASE WHEN c_custkey % {B.TRACT_CENTRE_MODULUS} <> 0 THEN
           {_d(B.GRID_ORIGIN_X)} + {_d(B.GRID_STEP)} * CAST(c_custkey % {B.GRID_COLUMNS} AS DOUBLE) + {_d(B.GRID_STEP / 2)} END AS lon
  FROM customer)"""

CTE_CITY_CENTRES = """
city_centres AS (
  SELECT city_id, city, city_lat AS lat, city_lon AS lon FROM best)"""

CTE_CENTRES = ",".join(c.strip("\n") for c in (CTE_COUNTY_CENTRES, CTE_STATE_CENTRES,
                                                CTE_TRACT_CENTRES, CTE_CITY_CENTRES))


def chain(*extra: str) -> str:
    """WITH clause of the full chain plus extra CTEs."""
    parts = [CTE_UNITS, CTE_PLACES, CTE_BEST, CTE_ENRICHED, CTE_SCORED, CTE_CENTRES, *extra]
    return "WITH " + ",".join(p.strip("\n") for p in parts)


def explain_ctes(level_key: str, tag: str, k: int = 3) -> str:
    """CTEs ``sums_<tag>``, ``long_<tag>``, ``pct_<tag>``, ``top_<tag>``,
    ``desc_<tag>`` for one level."""
    sums = ", ".join(f'CAST(SUM("{m}") AS DOUBLE) AS "{m}"' for m in IND)
    unions = "\n    UNION ALL ".join(
        f"SELECT k, '{m}' AS variable, {i} AS pos, \"{m}\" AS value FROM sums_{tag}"
        for i, m in enumerate(IND))
    return f"""
sums_{tag} AS (SELECT {level_key} AS k, {sums} FROM scored GROUP BY {level_key}),
long_{tag} AS ({unions}),
pct_{tag} AS (
  SELECT k, variable, pos,
         percent_rank() OVER (PARTITION BY variable ORDER BY value ASC NULLS FIRST) AS value
  FROM long_{tag}),
top_{tag} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY value DESC NULLS LAST, pos ASC) AS rn
    FROM pct_{tag} WHERE k IS NOT NULL) t
  WHERE rn <= {k}),
desc_{tag} AS (
  SELECT k, 'Ranks highly in: ' || string_agg(
           variable || ': ' || CAST(CAST(trunc(value * 100) AS INTEGER) AS VARCHAR) || '%',
           ', ' ORDER BY rn) AS description
  FROM top_{tag} GROUP BY k)"""


LEVEL_SQL = {
    # level: (rank key, describe key or None, centres CTE, centres key,
    #         name column, drop incomplete before rank)
    "state": ("state", "state", "state_centres", "SF", "state", False),
    "county": ("county_name", "county_name", "county_centres", "CF", "county_name", False),
    "city": ("city_id", "city", "city_centres", "city_id", "city", True),
    "tract": ("unit_id", None, "tract_centres", "GEOID10", "unit_id", False),
}


def ranked_ctes(level: str, n: int = 501, tag: str | None = None) -> str:
    """CTEs up to ``ranked_<tag>`` (name, rank, lat, lon[, description]).

    The description always joins on the output name column (state,
    county name, city name)."""
    key, dkey, ctab, ckey, name, drop_first = LEVEL_SQL[level]
    tag = tag or level
    out = [explain_ctes(dkey, tag)] if dkey else []
    name_src = "c.city" if level == "city" else f"t.{key}"
    desc_join = f"LEFT JOIN desc_{tag} d ON j0.name_ = d.k" if dkey else ""
    desc_col = ", d.description" if dkey else ""
    desc_sel = ", description" if dkey else ""
    where = ""
    if drop_first:
        cols = ["name_", "s", "lat", "lon"] + (["description"] if dkey else [])
        where = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols)
    out.append(f"""
ls_{tag} AS (SELECT {key} AS k, SUM(score) AS s FROM scored GROUP BY {key}),
top_k_{tag} AS (SELECT k, s FROM ls_{tag}
                ORDER BY s DESC NULLS LAST, k ASC NULLS FIRST LIMIT {n}),
j0_{tag} AS (
  SELECT {name_src.replace('t.' + key, 't.k')} AS name_, t.s, c.lat, c.lon
  FROM top_k_{tag} t LEFT JOIN {ctab} c ON t.k = c.{ckey}),
j_{tag} AS (SELECT j0.*{desc_col} FROM j0_{tag} j0 {desc_join}),
ranked_{tag} AS (
  SELECT name_ AS {name}, CAST(rank() OVER (ORDER BY s DESC NULLS LAST) AS INTEGER) AS rank,
         lat, lon{desc_sel}
  FROM j_{tag} {where})""")
    return ",".join(o.strip("\n") for o in out)


def ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip("\n") for p in parts)


# ------------------------------------------------------------ geometry
def _grid(col: str, origin: float, offset: str) -> str:
    return f"{_d(origin)} + {_d(B.GRID_STEP)} * CAST({col} + {offset} AS DOUBLE)"


CTE_CORNERS = f"""
corners AS (
  SELECT c_custkey AS GEOID10,
         'C' || CAST((c_custkey % {B.GRID_COLUMNS}) // {B.GRID_BLOCK} AS VARCHAR) || '_'
             || CAST((c_custkey // {B.GRID_COLUMNS}) // {B.GRID_BLOCK} AS VARCHAR) AS CF,
         'S' || CAST((c_custkey % {B.GRID_COLUMNS}) // {B.GRID_BLOCK} AS VARCHAR) AS SF,
         v.idx,
         {_grid(f'c_custkey % {B.GRID_COLUMNS}', B.GRID_ORIGIN_X, 'v.dx')} AS x,
         {_grid(f'c_custkey // {B.GRID_COLUMNS}', B.GRID_ORIGIN_Y, 'v.dy')} AS y
  FROM customer, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) v(idx, dx, dy))"""


def _qz(c: str) -> str:
    return f"CAST(round({c} / {_d(1e-7)}) AS BIGINT)"


CTE_CELL_EDGES = f"""
cedges AS (
  SELECT a.GEOID10, a.CF, a.SF, a.idx, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1,
         {_qz('a.x')} AS qx0, {_qz('a.y')} AS qy0, {_qz('b.x')} AS qx1, {_qz('b.y')} AS qy1
  FROM corners a JOIN corners b ON a.GEOID10 = b.GEOID10 AND b.idx = a.idx + 1)"""


def outline_ctes(key: str) -> str:
    """``outline`` CTE: edges of the cells that do not cancel per key."""
    lo = "(qx0 < qx1 OR (qx0 = qx1 AND qy0 < qy1))"
    return f"""
ukeys AS (
  SELECT {key} AS k, x0, y0, x1, y1, qx0, qy0, qx1, qy1,
         CASE WHEN {lo} THEN qx0 ELSE qx1 END AS lx, CASE WHEN {lo} THEN qy0 ELSE qy1 END AS ly,
         CASE WHEN {lo} THEN qx1 ELSE qx0 END AS hx, CASE WHEN {lo} THEN qy1 ELSE qy0 END AS hy
  FROM cedges),
outline AS (
  SELECT k, max(x0) AS x0, max(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
         max(qx0) AS qx0, max(qy0) AS qy0, max(qx1) AS qx1, max(qy1) AS qy1
  FROM ukeys GROUP BY k, lx, ly, hx, hy HAVING count(*) = 1)"""


CTE_ZONES = f"""
zedges AS (
  SELECT e.*, 'Z' || CAST(CASE WHEN ({' OR '.join(f"(ix % {B.GRID_BLOCK} = {x} AND iy % {B.GRID_BLOCK} = {y})" for x, y in B.ENCLAVES)})
                          THEN (ix // {B.GRID_BLOCK} + 1) % {B.ZONES} ELSE ix // {B.GRID_BLOCK} END AS VARCHAR) AS ZONE
  FROM (SELECT *, GEOID10 % {B.GRID_COLUMNS} AS ix, GEOID10 // {B.GRID_COLUMNS} AS iy FROM cedges) e)"""

# sides of cells with odd ids are halved, and so are those that an odd neighbour has halved (left and right ones
# alone: 50 columns, so ids above and below have the same parity)
CTE_SPLIT_EDGES = f"""
sedges AS (
  SELECT GEOID10, CF, qx0, qy0, (qx0 + qx1) // 2 AS qx1, (qy0 + qy1) // 2 AS qy1 FROM halved WHERE half
  UNION ALL SELECT GEOID10, CF, (qx0 + qx1) // 2, (qy0 + qy1) // 2, qx1, qy1 FROM halved WHERE half
  UNION ALL SELECT GEOID10, CF, qx0, qy0, qx1, qy1 FROM halved WHERE NOT half)"""
CTE_HALVED = f"""
halved AS (
  SELECT e.*, GEOID10 % 2 = 1
    OR (idx = 1 AND GEOID10 % {B.GRID_COLUMNS} < {B.GRID_COLUMNS - 1} AND GEOID10 + 1 IN (SELECT c_custkey FROM customer))
    OR (idx = 3 AND GEOID10 % {B.GRID_COLUMNS} > 0 AND GEOID10 - 1 IN (SELECT c_custkey FROM customer)) AS half
  FROM cedges e)"""


def polygon_ctes(edges: str, key: str) -> str:
    """``polygons`` CTE (k, part, ring, pos, qx, qy): rings of the merged cells, walked edge by edge.  Sides are
    parallel to the axes: directions are 0 to 3 from east."""
    return f"""
und AS (
  SELECT {key} AS k, GEOID10 AS u, qx0, qy0, qx1, qy1, least(qx0, qx1) AS lx, least(qy0, qy1) AS ly, greatest(qx0, qx1) AS hx, greatest(qy0, qy1) AS hy,
    CASE WHEN qx1 > qx0 THEN 0 WHEN qy1 > qy0 THEN 1 WHEN qx1 < qx0 THEN 2 ELSE 3 END AS dir FROM {edges}),
near AS (SELECT DISTINCT a.u AS a, b.u AS b FROM und a JOIN und b ON (a.k, a.lx, a.ly, a.hx, a.hy) = (b.k, b.lx, b.ly, b.hx, b.hy) AND a.u <> b.u),
reach AS (SELECT DISTINCT u, u AS r FROM und UNION SELECT reach.u, near.b FROM reach JOIN near ON reach.r = near.a),
block AS (SELECT u, min(r) AS part FROM reach GROUP BY u),
ol AS (
  SELECT row_number() OVER () AS id, und.k, part, qx0, qy0, qx1, qy1, dir FROM und JOIN block USING (u)
  JOIN (SELECT k, lx, ly, hx, hy FROM und GROUP BY ALL HAVING count(*) = 1) once ON (und.k, und.lx, und.ly, und.hx, und.hy) = (once.k, once.lx, once.ly, once.hx, once.hy)),
follow AS (
  SELECT a.id, arg_min(b.id, (b.dir - a.dir + 6) % 4) AS next FROM ol a
  JOIN ol b ON (a.k, a.part, a.qx1, a.qy1) = (b.k, b.part, b.qx0, b.qy0) GROUP BY a.id),
walk AS (SELECT id AS s, id AS cur, 0 AS pos FROM ol UNION ALL SELECT s, next, pos + 1 FROM walk JOIN follow ON id = cur WHERE next <> s),
placed AS (SELECT s, pos, k, part, qx0, qy0, qx1, qy1 FROM walk JOIN ol ON id = cur),
loops AS (
  SELECT s, any_value(k) AS k, any_value(part) AS part, min((qx0, qy0)) AS least, arg_min((qx0, qy0), pos) AS first, count(*) AS n,
    sum(CAST(qx0 AS HUGEINT) * qy1 - CAST(qx1 AS HUGEINT) * qy0) < 0 AS hole FROM placed GROUP BY s HAVING least = first),
named AS (
  SELECT *, row_number() OVER (PARTITION BY k, part ORDER BY hole, first) - 1 AS ring, min(CASE WHEN NOT hole THEN first END) OVER (PARTITION BY k, part) AS shell FROM loops),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY shell) - 1 AS part_no FROM named),
polygons AS (
  SELECT n.k, part_no, ring, pos, qx0 AS qx, qy0 AS qy FROM numbered n JOIN placed p ON p.s = n.s
  UNION ALL SELECT n.k, part_no, ring, n.n, qx0, qy0 FROM numbered n JOIN placed p ON p.s = n.s AND pos = 0)"""


def scanline_ctes(edges: str, k: str = "k") -> str:
    """``ipoint`` CTE (k, x, y): scan-line interior point of edge set."""
    return f"""
env AS (SELECT {k} AS k, min(least(y0, y1)) AS miny, max(greatest(y0, y1)) AS maxy
        FROM {edges} GROUP BY {k}),
scan AS (
  SELECT e.{k} AS k,
         (greatest(coalesce(max(CASE WHEN y0 <= (miny + maxy) / {_d(2.0)} THEN y0 END), min(miny)), min(miny))
          + least(coalesce(min(CASE WHEN y0 > (miny + maxy) / {_d(2.0)} THEN y0 END), max(maxy)), max(maxy)))
         / {_d(2.0)} AS sy
  FROM {edges} e JOIN env ON e.{k} = env.k GROUP BY e.{k}),
cx AS (
  SELECT e.{k} AS k, s.sy,
         CASE WHEN x0 = x1 THEN x0 ELSE x0 + (s.sy - y0) / ((y1 - y0) / (x1 - x0)) END AS x
  FROM {edges} e JOIN scan s ON e.{k} = s.k
  WHERE NOT ((y0 > s.sy AND y1 > s.sy) OR (y0 < s.sy AND y1 < s.sy))
    AND y0 <> y1 AND NOT (y0 = s.sy AND y1 < s.sy) AND NOT (y1 = s.sy AND y0 < s.sy)),
pairs AS (
  SELECT k, pair, min(x) AS xa, max(x) AS xb, any_value(sy) AS sy FROM (
    SELECT k, sy, x, (row_number() OVER (PARTITION BY k ORDER BY x) - 1) // 2 AS pair FROM cx) t
  GROUP BY k, pair),
ipoint AS (
  SELECT k, x, y FROM (
    SELECT k, (xa + xb) / {_d(2.0)} AS x, sy AS y,
           row_number() OVER (PARTITION BY k ORDER BY xb - xa DESC, pair ASC) AS rn
    FROM pairs) t
  WHERE rn = 1)"""


def projection_sql(lon: str, lat: str, srid: int) -> tuple[str, str]:
    """SQL twin of ``tractus.functions.projection`` (same operation order)."""
    from tractus.functions.projection import CEA, DEG, LAEA, LAEA_EUROPE_FE, LAEA_EUROPE_FN

    def q(s: str, e: float) -> str:
        e2 = e * e
        return (f"({_d(1 - e2)} * (({s} / ({_d(1.0)} - (({_d(e2)} * {s}) * {s}))) - "
                f"({_d(1 / (2 * e))} * ln((({_d(1.0)} - ({_d(e)} * {s})) / ({_d(1.0)} + ({_d(e)} * {s})))))))")

    rlon, rlat = f"({lon} * {_d(DEG)})", f"({lat} * {_d(DEG)})"
    if srid == 6933:
        return (f"({_d(CEA.a * CEA.k0)} * {rlon})",
                f"({_d(CEA.a / (2 * CEA.k0))} * {q(f'sin({rlat})', CEA.e)})")
    beta = f"asin(({q(f'sin({rlat})', LAEA.e)} / {_d(LAEA.qp)}))"
    dlam = f"({rlon} - {_d(LAEA.lam0)})"
    b = (f"({_d(LAEA.rq)} * sqrt(({_d(2.0)} / (({_d(1.0)} + ({_d(LAEA.sin_b1)} * sin({beta}))) + "
         f"(({_d(LAEA.cos_b1)} * cos({beta})) * cos({dlam}))))))")
    x = f"({_d(LAEA_EUROPE_FE)} + ((({b} * {_d(LAEA.d)}) * cos({beta})) * sin({dlam})))"
    y = (f"({_d(LAEA_EUROPE_FN)} + (({b} / {_d(LAEA.d)}) * (({_d(LAEA.cos_b1)} * sin({beta})) - "
         f"(({_d(LAEA.sin_b1)} * cos({beta})) * cos({dlam})))))")
    return x, y


def projected_corners_cte(srid: int, name: str = "pcorners") -> str:
    x, y = projection_sql("x", "y", srid)
    return f"""
{name} AS (SELECT GEOID10, CF, SF, idx, {x} AS x, {y} AS y FROM corners)"""


def unit_area_cte(src: str = "pcorners", name: str = "uarea") -> str:
    """Shoelace of the closed 4-corner ring, relative to corner 0."""
    def t(i: int) -> str:
        return (f"((p{i}.x - p0.x) * (p{i+1}.y - p0.y) - (p{i+1}.x - p0.x) * (p{i}.y - p0.y))")
    joins = " ".join(f"JOIN {src} p{i} ON p{i}.GEOID10 = p0.GEOID10 AND p{i}.idx = {i}"
                     for i in (1, 2, 3))
    return f"""
{name} AS (
  SELECT p0.GEOID10, p0.CF, p0.SF, abs(({t(1)} + {t(2)}) / {_d(2.0)}) AS area
  FROM {src} p0 {joins} WHERE p0.idx = 0)"""
