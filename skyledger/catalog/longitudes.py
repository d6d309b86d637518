"""Longitudes of the bodies at the events' instants (F38), and the SQL that works them out from the same published terms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyledger.functions import ephemeris as eph
from skyledger.registry import query
from skyledger.sources.tables import dealt_out, read


def _turn(x: str) -> str:
    return f"((({x}) % 360 + 360) % 360)"


def _poly(coefficients: tuple, t: str = "t") -> str:
    out = f"({coefficients[-1]!r}::DOUBLE)"
    for x in reversed(coefficients[:-1]):
        out = f"({out} * {t} + {x!r}::DOUBLE)"
    return out


def _listed(rows: list[tuple], names: str) -> str:
    """A DuckDB list of structs with these one-letter names."""
    return "[" + ", ".join("{" + ", ".join(f"{n}: {float(v)!r}::DOUBLE" for n, v in zip(names, r, strict=True)) + "}" for r in rows) + "]"


def _pulls(kind: str) -> str:
    """Case per body: the sum of its perturbations (degrees)."""
    cases = []
    for body in dict.fromkeys(p[0] for p in eph.PERTURBATIONS if p[1] == kind):
        rows = [(a, j, s, u, math.radians(g)) for b, k, a, j, s, u, g in eph.PERTURBATIONS if (b, k) == (body, kind)]
        cases.append(f"WHEN '{body}' THEN list_sum(list_transform({_listed(rows, 'ajsug')}, lambda z: z.a * sin(z.j * mj + z.s * msat + z.u * mu + z.g)))")
    return f"CASE body {' '.join(cases)} ELSE 0 END"


def _pluto(kind: str) -> str:
    (start, drift), pairs = eph.PLUTO[kind]
    terms = [f"({start!r}::DOUBLE + d * {drift!r}::DOUBLE)"] + [f"({s!r}::DOUBLE) * sin({i} * pa) + ({q!r}::DOUBLE) * cos({i} * pa)" for i, (s, q) in enumerate(pairs, 1)]
    if kind in eph.PLUTO_MIXED:
        terms.append(f"({eph.PLUTO_MIXED[kind][0]!r}::DOUBLE) * sin(sa - pa) + ({eph.PLUTO_MIXED[kind][1]!r}::DOUBLE) * cos(sa - pa)")
    return " + ".join(terms)


def longitudes_sql(source: str, out: str = "lon") -> str:
    """CTEs that end in `out` (moment, body, lon) for the instants (column moment, TIMESTAMP) of a source without repeats."""
    elements = ", ".join(f"('{b}', {', '.join(f'{x!r}::DOUBLE' for pair in e for x in pair)})" for b, e in eph.ELEMENTS.items())
    anomaly = {n: _turn(f"{eph.ELEMENTS[b][5][0]!r}::DOUBLE + d * {eph.ELEMENTS[b][5][1]!r}::DOUBLE") for n, b in (("mj", "Jupiter"), ("msat", "Saturn"), ("mu", "Uranus"))}
    nutation = _listed(eph.NUTATION, "ansm")
    moon = _listed([(a, e, s, m, f) for e, s, m, f, a in eph.MOON_TERMS], "aesmf")
    weight = "CASE abs(z.s) WHEN 0 THEN z.a WHEN 1 THEN z.a * em ELSE z.a * em * em END"
    kepler = ", ".join(f"k{i + 1} AS (SELECT * REPLACE (x - (x - ec * sin(x) - ma) / (1 - ec * cos(x)) AS x) FROM k{i})" for i in range(eph.KEPLER_STEPS))
    return f"""
    {out}0 AS (SELECT moment, (epoch_us(moment) // 1000) / 86400000.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE AS clock FROM {source}),
    {out}1 AS (SELECT moment, clock + CASE WHEN 2000 + clock / 365.25::DOUBLE >= 2005 AND 2000 + clock / 365.25::DOUBLE < 2050
        THEN 62.92::DOUBLE + 0.32217::DOUBLE * (clock / 365.25::DOUBLE) + 0.005589::DOUBLE * (clock / 365.25::DOUBLE) * (clock / 365.25::DOUBLE)
        ELSE 32 * ((180 + clock / 365.25::DOUBLE) / 100) * ((180 + clock / 365.25::DOUBLE) / 100) - 20 END / 86400 AS days FROM {out}0),
    {out}2 AS (SELECT moment, days / 36525 AS t, days + 1.5::DOUBLE AS d FROM {out}1),
    {out}3 AS (SELECT moment, t, d, {", ".join(f"radians({_turn(_poly(p))}) AS {n}" for n, p in eph.MOON_ARGUMENTS.items())},
      {_turn(_poly((280.46646, 36000.76983, 0.0003032)))} AS l0, radians({_turn(_poly((357.52911, 35999.05029, -0.0001537)))}) AS sm, radians({_turn(_poly((125.04452, -1934.136261)))}) AS om,
      {_poly((0.016708634, -0.000042037, -0.0000001267))} AS es, {_poly((1.0, -0.002516, -0.0000074))} AS em, {", ".join(f"radians({a}) AS {n}" for n, a in anomaly.items())} FROM {out}2),
    {out}4 AS (SELECT *, {_poly((1.914602, -0.004817, -0.000014))} * sin(sm) + {_poly((0.019993, -0.000101))} * sin(2 * sm) + 0.000289::DOUBLE * sin(3 * sm) AS centre,
      list_sum(list_transform({nutation}, lambda z: z.a * sin(z.n * om + z.s * radians(l0) + z.m * lm))) AS nut FROM {out}3),
    {out}5 AS (SELECT *, l0 + centre AS sun, 1.000001018::DOUBLE * (1 - es * es) / (1 + es * cos(sm + radians(centre))) AS rs FROM {out}4),
    el(body, n0, n1, i0, i1, w0, w1, a0, a1, e0, e1, m0, m1) AS (VALUES {elements}),
    k0 AS (SELECT moment, d, nut, sun, rs, mj, msat, mu, body, n0, n1, i0, i1, w0, w1, a0 + d * a1 AS ax, e0 + d * e1 AS ec, radians({_turn("m0 + d * m1")}) AS ma,
      radians({_turn("m0 + d * m1")}) + (e0 + d * e1) * sin(radians({_turn("m0 + d * m1")})) * (1 + (e0 + d * e1) * cos(radians({_turn("m0 + d * m1")}))) AS x FROM {out}5, el),
    {kepler},
    f1 AS (SELECT *, ax * (cos(x) - ec) AS p, ax * sqrt(1 - ec * ec) * sin(x) AS q, radians(n0 + d * n1) AS n, radians(i0 + d * i1) AS i FROM k{eph.KEPLER_STEPS}),
    f2 AS (SELECT *, sqrt(p * p + q * q) AS r, atan2(q, p) + radians(w0 + d * w1) AS u FROM f1),
    f3 AS (SELECT moment, nut, sun, rs, body, r, n + atan2(sin(u) * cos(i), cos(u)) + radians({_pulls("l")}) AS l, asin(sin(u) * sin(i)) + radians({_pulls("b")}) AS b FROM f2),
    pl AS (SELECT *, radians({_turn(f"{eph.PLUTO_ANGLE[0]!r}::DOUBLE + d * {eph.PLUTO_ANGLE[1]!r}::DOUBLE")}) AS pa, radians({_turn(f"{eph.PLUTO_SATURN[0]!r}::DOUBLE + d * {eph.PLUTO_SATURN[1]!r}::DOUBLE")}) AS sa FROM {out}5),
    f4 AS (SELECT * FROM f3 UNION ALL SELECT moment, nut, sun, rs, 'Pluto', {_pluto("r")}, radians({_pluto("l")}), radians({_pluto("b")}) FROM pl),
    {out} AS (SELECT moment, body, {_turn("degrees(atan2(r * cos(b) * sin(l) + rs * sin(radians(sun)), r * cos(b) * cos(l) + rs * cos(radians(sun)))) + nut")} AS lon FROM f4
      UNION ALL SELECT moment, 'Sun', {_turn(f"sun + nut - {eph.ABERRATION!r}::DOUBLE / rs")} FROM {out}5
      UNION ALL SELECT moment, 'Moon', {_turn(f"degrees(lm) + (list_sum(list_transform({moon}, lambda z: {weight} * sin(z.e * dm + z.s * ms + z.m * mm + z.f * fm))) + 3958 * sin(radians(119.75::DOUBLE + 131.849::DOUBLE * t)) + 1962 * sin(lm - fm) + 318 * sin(radians(53.09::DOUBLE + 479264.29::DOUBLE * t))) / 1000000 + nut")} FROM {out}5)"""


#: The instants of all events and a day later, their longitudes, and per event and body (event_id, body, lon, step): where it stands and how far it moves to the next day.
EVENT_LON_SQL = f"""inst AS (SELECT CAST(ts AS TIMESTAMP) AS moment FROM events UNION SELECT CAST(ts AS TIMESTAMP) + INTERVAL 1 DAY FROM events), {longitudes_sql('inst')},
bodies AS (SELECT event_id, a.body, a.lon, b.lon - a.lon - CASE WHEN b.lon - a.lon > 180 THEN 360 WHEN b.lon - a.lon < -180 THEN -360 ELSE 0 END AS step
  FROM events JOIN lon a ON a.moment = CAST(ts AS TIMESTAMP) JOIN lon b ON b.moment = CAST(ts AS TIMESTAMP) + INTERVAL 1 DAY AND b.body = a.body)"""


#: sky (event_id, sun, moon): longitudes of the Sun and the Moon at an event.
SUN_MOON_SQL = f"{EVENT_LON_SQL}, sky AS (SELECT event_id, max(lon) FILTER (body = 'Sun') AS sun, max(lon) FILTER (body = 'Moon') AS moon FROM bodies GROUP BY event_id)"


@query("f38_body_longitude", f"WITH {EVENT_LON_SQL} SELECT event_id, body, round(lon, 4) AS lon, round(step, 4) AS step FROM bodies")
def f38(spark, sf_dir):
    """Every event's ten longitudes and the way each body goes until the same time of the next day."""
    rows = eph.with_longitudes(dealt_out(read(spark, sf_dir, "events").select("event_id", "ts")), F.col("ts"))
    way = lambda b: F.col(f"next_{b}") - F.col(f"lon_{b}")
    step = lambda b: way(b) - F.when(way(b) > 180, 360).when(way(b) < -180, -360).otherwise(0)
    told = F.array(*(F.struct(F.lit(b).alias("body"), F.round(f"lon_{b}", 4).alias("lon"), F.round(step(b), 4).alias("step")) for b in eph.BODIES))
    return rows.select("event_id", F.explode(told).alias("b")).select("event_id", "b.*")
