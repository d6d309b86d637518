"""Solar, lunar and chart arithmetic over events and nations."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyledger.catalog.dates import LAT, LON, ZONE, places
from skyledger.catalog.longitudes import EVENT_LON_SQL, SUN_MOON_SQL, longitudes_sql
from skyledger.catalog.ranges import SIGNS_SQL as RANGES_SQL
from skyledger.catalog.ranges import signs
from skyledger.functions import calendar as cal
from skyledger.functions import sky
from skyledger.functions.ephemeris import BODIES, with_longitudes
from skyledger.operators import ranges
from skyledger.registry import query
from skyledger.sources.tables import dealt_out, read

PI = repr(math.pi)


def norm_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) % 360 < 0 THEN (({x}) % 360 + 360) % 360 ELSE ({x}) % 360 END)"


def event_places(spark, sf_dir):
    """Every event with the place of the nation that its user's number leads to."""
    events = read(spark, sf_dir, "events").withColumn("k", (F.col("user_id") % 25).cast("int"))
    return events.join(F.broadcast(places(spark, sf_dir)), F.col("k") == F.col("n_nationkey"))  # 25 nations


EVENT_PLACES = f"e AS (SELECT event_id, user_id, value, CAST(ts AS TIMESTAMP) AS ts, {LAT} AS lat, {LON} AS lon FROM events JOIN nation ON user_id % 25 = n_nationkey)"


def event_longitudes(spark, sf_dir, *bodies):
    """Every event's number, instant and value with the bodies' longitudes (lon_Sun, ...)."""
    return with_longitudes(dealt_out(read(spark, sf_dir, "events").select("event_id", "user_id", "value", "ts")), F.col("ts"), list(bodies), ahead=False)


def solar_sql(g: str) -> tuple[str, str]:
    eq = f"229.18 * (0.000075 + 0.001868 * cos({g}) - 0.032077 * sin({g}) - 0.014615 * cos(2 * {g}) - 0.040849 * sin(2 * {g}))"
    decl = f"(0.006918 - 0.399912 * cos({g}) + 0.070257 * sin({g}) - 0.006758 * cos(2 * {g}) + 0.000907 * sin(2 * {g}) - 0.002697 * cos(3 * {g}) + 0.00148 * sin(3 * {g}))"
    return eq, decl


def event_sql(zenith: float, sign: str) -> str:
    cosine = f"(cos(radians({zenith}::DOUBLE)) / (cos(radians(lat)) * cos(decl)) - tan(radians(lat)) * tan(decl))"
    return f"CASE WHEN {cosine} BETWEEN -1 AND 1 THEN 720 - 4 * (lon {sign} degrees(acos({cosine}))) - eq END"


_g = f"(2 * {PI} / 365 * (dayofyear(ts) - 1 + 0.5::DOUBLE))"
SUN_DAY = f"{EVENT_PLACES}, s AS (SELECT *, {solar_sql(_g)[0]} AS eq, {solar_sql(_g)[1]} AS decl FROM e)"


def altitude_sql(source: str, out: str, ts: str) -> str:
    """CTEs that add the altitude at `ts` as column `alt` to the rows of `source`."""
    minutes = f"(hour({ts}) * 60 + minute({ts}) + second({ts}) / 60.0::DOUBLE)"
    g = f"(2 * {PI} / 365 * (dayofyear({ts}) - 1 + ({minutes} / 60 - 12) / 24))"
    eq, decl = solar_sql("g")
    sine = "sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(radians((minutes + eq + 4 * lon) / 4 - 180))"
    return f"""{out}1 AS (SELECT *, {minutes} AS minutes, {g} AS g FROM {source}), {out}2 AS (SELECT *, {eq} AS eq, {decl} AS decl FROM {out}1),
    {out} AS (SELECT * EXCLUDE (minutes, g, eq, decl), degrees(asin(greatest(-1.0, least(1.0, {sine})))) AS {out}_alt FROM {out}2)"""


@query("f26_norm360", "SELECT event_id, round(((value * 10 - 700) % 360 + 360) % 360, 6) AS angle FROM events")
def f26(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(sky.turn(F.col("value") * 10 - 700), 6).alias("angle"))


SIGNS_SQL = "[" + ", ".join(f"'{s}'" for s in sky.SIGNS) + "]"


@query(
    "f27_sign_parts",
    f"""WITH {SUN_MOON_SQL}, x AS (SELECT event_id, moon AS lon FROM sky), y AS (SELECT event_id, CAST(floor(lon / 30) AS INTEGER) AS sign, lon - floor(lon / 30) * 30 AS w FROM x)
    SELECT event_id, sign, {SIGNS_SQL}[sign + 1] AS sign_name, CAST(floor(w) AS INTEGER) AS degree, CAST(floor((w - floor(w)) * 60) AS INTEGER) AS minute, round(w, 4) AS within FROM y""",
)
def f27(spark, sf_dir):
    """The Moon's sign and place in it."""
    part = sky.sign_parts(F.col("lon_Moon"))
    return event_longitudes(spark, sf_dir, "Moon").select("event_id", *(part[c].alias(c) for c in ("sign", "sign_name", "degree", "minute")), F.round(part["within"], 4).alias("within"))


@query("f28_solar_event", f"WITH {SUN_DAY} SELECT event_id, round({event_sql(90.833, '+')}, 5) AS sunrise_minutes FROM s")
def f28(spark, sf_dir):
    rise = sky.solar_event(F.col("ts"), F.col("lat"), F.col("lon"), sky.SUNRISE_ZENITH, True)
    return event_places(spark, sf_dir).select("event_id", F.round(rise, 5).alias("sunrise_minutes"))


@query(
    "f29_four_solar_times",
    f"""WITH {SUN_DAY} SELECT event_id, round({event_sql(96.0, '+')}, 5) AS dawn, round({event_sql(90.833, '+')}, 5) AS sunrise, round({event_sql(90.833, '+ -')}, 5) AS sunset, round({event_sql(96.0, '+ -')}, 5) AS dusk FROM s""",
)
def f29(spark, sf_dir):
    times = sky.solar_times(F.col("ts"), F.col("lat"), F.col("lon"))
    return event_places(spark, sf_dir).select("event_id", *(F.round(c, 5).alias(n) for n, c in times.items()))


@query("f30_solar_altitude", f"WITH {EVENT_PLACES}, {altitude_sql('e', 'a', 'ts')} SELECT event_id, round(a_alt, 5) AS altitude FROM a")
def f30(spark, sf_dir):
    return event_places(spark, sf_dir).select("event_id", F.round(sky.solar_altitude(F.col("ts"), F.col("lat"), F.col("lon")), 5).alias("altitude"))


PHASE_SQL = f"WITH {EVENT_PLACES}, {altitude_sql('e', 'a', 'ts')}, l AS (SELECT *, ts + INTERVAL 10 MINUTE AS later FROM a), {altitude_sql('l', 'b', 'later')}, p AS (SELECT *, CASE WHEN a_alt < -6 THEN 'night' WHEN a_alt >= 10 THEN 'day' WHEN b_alt > a_alt THEN 'dawn' ELSE 'dusk' END AS phase FROM b)"


@query("f31_sun_phase", PHASE_SQL + " SELECT event_id, phase FROM p")
def f31(spark, sf_dir):
    return event_places(spark, sf_dir).select("event_id", sky.sun_phase(F.col("ts"), F.col("lat"), F.col("lon")).alias("phase"))


@query("f32_is_evening", f"WITH {EVENT_PLACES}, {altitude_sql('e', 'a', 'ts')} SELECT event_id, a_alt < 0 AND (hour(ts) >= 12 OR hour(ts) < 4) AS evening FROM a")
def f32(spark, sf_dir):
    alt = sky.solar_altitude(F.col("ts"), F.col("lat"), F.col("lon"))
    return event_places(spark, sf_dir).select("event_id", ((alt < 0) & ((F.hour("ts") >= 12) | (F.hour("ts") < 4))).alias("evening"))


@query("w8_rising", f"WITH {EVENT_PLACES}, {altitude_sql('e', 'a', 'ts')}, l AS (SELECT *, ts + INTERVAL 10 MINUTE AS later FROM a), {altitude_sql('l', 'b', 'later')} SELECT event_id, b_alt > a_alt AS rising FROM b")
def w8(spark, sf_dir):
    alt = lambda ts: sky.solar_altitude(ts, F.col("lat"), F.col("lon"))
    return event_places(spark, sf_dir).select("event_id", (alt(F.col("ts") + F.expr("INTERVAL 10 MINUTES")) > alt(F.col("ts"))).alias("rising"))


T_SQL = "(((epoch_us(ts) // 1000) / 86400000.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525)"
EPS_SQL = "(23.439291111 - 0.0130041667 * t - 1.6666667e-7 * t * t + 5.027778e-7 * t * t * t)"
NODE_SQL = norm_sql("125.0445479 - 1934.1362891 * t + 0.0020754 * t * t + t * t * t / 467441 - t * t * t * t / 60616000")


@query("f34_obliquity_and_node", f"WITH x AS (SELECT event_id, {T_SQL} AS t FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts FROM events)) SELECT event_id, round({EPS_SQL}, 6) AS obliquity, round({NODE_SQL}, 6) AS node FROM x")
def f34(spark, sf_dir):
    t = sky.centuries(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", F.round(sky.obliquity(t), 6).alias("obliquity"), F.round(sky.mean_node(t), 6).alias("node"))


ANGLES_SQL = f"""{EVENT_PLACES}, t1 AS (SELECT *, {T_SQL} AS t, (epoch_us(ts) // 1000) / 86400000.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE AS days FROM e),
t2 AS (SELECT *, radians({EPS_SQL}) AS eps, {norm_sql("280.46061837 + 360.98564736629 * days + 0.000387933 * t * t - t * t * t / 38710000 + lon")} AS ramc FROM t1),
t3 AS (SELECT *, {norm_sql("degrees(atan2(sin(radians(ramc)), cos(radians(ramc)) * cos(eps)))")} AS mc,
  {norm_sql("degrees(atan2(cos(radians(ramc)), -(sin(radians(ramc)) * cos(eps) + tan(radians(lat)) * sin(eps))))")} AS asc0 FROM t2),
angles AS (SELECT * EXCLUDE (asc0), CASE WHEN {norm_sql("asc0 - mc")} > 180 THEN {norm_sql("asc0 + 180")} ELSE asc0 END AS asc_ FROM t3)"""


def with_angles(df):
    """Adds eps (degrees), ramc, mc and asc_ to rows with ts, lat and lon."""
    df = df.withColumn("eps", sky.obliquity(sky.centuries(F.col("ts")))).withColumn("ramc", sky.sidereal_degrees(F.col("ts"), F.col("lon")))
    return df.withColumn("mc", sky.midheaven(F.col("ramc"), F.col("eps"))).withColumn("asc_", sky.ascendant(F.col("ramc"), F.col("eps"), F.col("lat")))


@query("f35_chart_angles", f"WITH {ANGLES_SQL} SELECT event_id, round(ramc, 4) AS ramc, round(mc, 4) AS midheaven, round(asc_, 4) AS ascendant FROM angles")
def f35(spark, sf_dir):
    at = with_angles(event_places(spark, sf_dir))
    return at.select("event_id", F.round("ramc", 4).alias("ramc"), F.round("mc", 4).alias("midheaven"), F.round("asc_", 4).alias("ascendant"))


@query(
    "f36_whole_and_equal_houses",
    f"""WITH {ANGLES_SQL} SELECT event_id, CAST(i + 1 AS INTEGER) AS house, {norm_sql('floor(asc_ / 30) * 30 + 30 * i')} AS whole_cusp, round({norm_sql('asc_ + 30 * i')}, 4) AS equal_cusp FROM angles, range(0, 12) r(i)""",
)
def f36(spark, sf_dir):
    both = F.arrays_zip(sky.whole_sign_cusps(F.col("asc_")).alias("w"), sky.equal_cusps(F.col("asc_")).alias("q"))
    rows = with_angles(event_places(spark, sf_dir)).select("event_id", F.posexplode(both).alias("i", "c"))
    return rows.select("event_id", (F.col("i") + 1).alias("house"), F.col("c.w").alias("whole_cusp"), F.round("c.q", 4).alias("equal_cusp"))


#: Charts are drawn for every event: at places up to 75 degrees from the equator; one in 97 is asked for an instant three hundred years on.
CHART_LAT = f"(CASE WHEN event_id % 5 = 0 THEN {LAT} * 1.25 ELSE {LAT} END)"
PLACED_SQL = ANGLES_SQL.replace(f"{LAT} AS lat", f"{CHART_LAT} AS lat")
CHART_SQL = PLACED_SQL.replace("ON user_id % 25 = n_nationkey", "ON user_id % 25 = n_nationkey WHERE event_id % 97 > 0")


def chart_places(spark, sf_dir):
    """Every event at the place that its chart is drawn for."""
    return dealt_out(event_places(spark, sf_dir)).withColumn("lat", F.when(F.col("event_id") % 5 == 0, F.col("lat") * 1.25).otherwise(F.col("lat")))


def charted(spark, sf_dir):
    """Every event's place and instant (column ts), with its angles, within the years 1700 to 2200; and the events outside them."""
    at = chart_places(spark, sf_dir).withColumn("at", F.when(F.col("event_id") % 97 == 0, F.col("ts") + F.expr("INTERVAL 300 YEARS")).otherwise(F.col("ts")))
    inside = F.year("at").between(1700, 2200)
    return with_angles(at.where(inside).drop("at")), at.where(~inside).select("event_id")


def _placidus_ctes() -> str:
    """The four intermediate cusps by the same twelve rounds, and from them all twelve (pc), null unless ok."""
    spec = ", ".join(f"({h}, {o}::DOUBLE, {f!r}::DOUBLE, {s})" for h, o, f, s in sky.PLACIDUS)
    lam = "atan2(sin(radians(ra)), cos(radians(ra)) * cos(eps))"
    x = f"tan(radians(lat)) * tan(asin(sin(eps) * sin({lam})))"
    c = {h: f"max(cusp) FILTER (house = {h})" for h in (11, 12, 2, 3)}
    half = ["asc_", "c2", "c3", norm_sql("mc + 180"), norm_sql("c11 + 180"), norm_sql("c12 + 180"), norm_sql("asc_ + 180"), norm_sql("c2 + 180"), norm_sql("c3 + 180"), "mc", "c11", "c12"]
    return f"""spec(house, off, share, sgn) AS (VALUES {spec}),
    it AS (SELECT event_id, lat, eps, ramc, house, off, share, sgn, 0 AS n, ramc + off AS ra FROM angles, spec
      UNION ALL SELECT event_id, lat, eps, ramc, house, off, share, sgn, n + 1, CASE WHEN abs({x}) <= 1 THEN ramc + off + degrees(asin({x})) * (sgn * share) END FROM it WHERE n < 12),
    four AS (SELECT event_id, count(cusp) = 4 AS ok, {c[11]} AS c11, {c[12]} AS c12, {c[2]} AS c2, {c[3]} AS c3 FROM (SELECT event_id, house, {norm_sql('degrees(' + lam + ')')} AS cusp FROM it WHERE n = 12) GROUP BY event_id),
    placed AS (SELECT angles.*, ok, CASE WHEN ok THEN [{', '.join(half)}] END AS pc FROM angles JOIN four USING (event_id))"""


@query("f37_placidus", f"WITH RECURSIVE {PLACED_SQL}, {_placidus_ctes()} SELECT event_id, CAST(i AS INTEGER) AS house, round(pc[i], 4) AS cusp FROM placed, range(1, 13) r(i)")
def f37(spark, sf_dir):
    """All twelve cusps, or none where one of them is undefined, for every instant: the range of years is the chart's rule, not the houses'."""
    at = sky.with_placidus(with_angles(chart_places(spark, sf_dir)))
    cusps = F.array(*sky.placidus_cusps(F.col("asc_"), F.col("mc")))
    return at.select("event_id", F.posexplode(cusps).alias("i", "c")).select("event_id", (F.col("i") + 1).alias("house"), F.round("c", 4).alias("cusp"))


AGE_SQL = f"(((epoch_us(CAST(ts AS TIMESTAMP)) // 1000 - {sky.NEW_MOON_MS}) / 86400000.0::DOUBLE) % {sky.SYNODIC}::DOUBLE)"
MOON_NAME_SQL = "CASE " + " ".join(f"WHEN age >= {s} THEN '{n}'" for s, n in reversed(sky.MOON_PHASES)) + " END"


@query("f39_moon_phase", f"WITH x AS (SELECT event_id, {AGE_SQL} AS age FROM events) SELECT event_id, round(age, 5) AS age, {MOON_NAME_SQL} AS name, CAST(floor((1 - cos(2 * {PI} * age / {sky.SYNODIC}::DOUBLE)) / 2 * 100 + 0.5) AS INTEGER) AS lit FROM x")
def f39(spark, sf_dir):
    aged = read(spark, sf_dir, "events").withColumn("age", sky.moon_age(F.col("ts")))
    return aged.select("event_id", F.round("age", 5).alias("age"), sky.moon_phase_name(F.col("age")).alias("name"), F.floor(sky.illumination(F.col("age")) * 100 + 0.5).cast("int").alias("lit"))


@query(
    "f40_part_of_fortune",
    f"""WITH {ANGLES_SQL}, {SUN_MOON_SQL}, b AS (SELECT *, {norm_sql('floor(asc_ / 30) * 30')} AS first FROM angles JOIN sky USING (event_id)),
    h AS (SELECT *, CAST(floor({norm_sql('sun - first')} / 30) AS INTEGER) + 1 AS house FROM b)
    SELECT event_id, house AS sun_house, round(CASE WHEN house >= 7 THEN {norm_sql('asc_ + moon - sun')} ELSE {norm_sql('asc_ + sun - moon')} END, 4) AS fortune FROM h""",
)
def f40(spark, sf_dir):
    at = with_longitudes(with_angles(dealt_out(event_places(spark, sf_dir))), F.col("ts"), ["Sun", "Moon"], ahead=False).withColumnsRenamed({"lon_Sun": "sun", "lon_Moon": "moon"})
    at = at.withColumn("house", sky.house_from(F.col("sun"), sky.whole_sign_start(F.col("asc_"))))
    fortune = sky.part_of_fortune(F.col("asc_"), F.col("sun"), F.col("moon"), F.col("house").between(7, 12))
    return at.select("event_id", F.col("house").alias("sun_house"), F.round(fortune, 4).alias("fortune"))


def bodies():
    """The ten bodies beside the columns of `with_longitudes`: name, longitude, and whether it moves backward until the next day (Sun and Moon never do)."""
    found = []
    for name in BODIES:
        retro = F.lit(False) if name in ("Sun", "Moon") else sky.half_turn(F.col(f"next_{name}") - F.col(f"lon_{name}")) < 0
        found.append(F.struct(F.lit(name).alias("point"), F.col(f"lon_{name}").alias("plon"), retro.alias("retro")))
    return found


RETRO_SQL = "body NOT IN ('Sun', 'Moon') AND step < 0"


_inside = f"list_filter(range(1, 13), lambda i: {norm_sql('round(cusps[i % 12 + 1] - cusps[i], 9)')} = 0 OR {norm_sql('round(LON - cusps[i], 9)')} < {norm_sql('round(cusps[i % 12 + 1] - cusps[i], 9)')})"


def house_sql(lon: str) -> str:
    return f"CAST(coalesce({_inside.replace('LON', lon)}[1], 1) AS INTEGER)"


@query(
    "f41_full_chart",
    f"""WITH RECURSIVE {CHART_SQL}, {_placidus_ctes()}, {SUN_MOON_SQL},
    sys AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'whole' WHEN event_id % 3 = 1 THEN 'equal' WHEN ok THEN 'placidus' ELSE 'whole' END AS used, event_id % 3 = 2 AND NOT ok AS fell FROM placed),
    cu AS (SELECT *, CASE used WHEN 'placidus' THEN pc WHEN 'equal' THEN list_transform(range(0, 12), lambda i: {norm_sql('asc_ + 30 * i')}) ELSE list_transform(range(0, 12), lambda i: {norm_sql('floor(asc_ / 30) * 30 + 30 * i')}) END AS cusps, sun, moon FROM sys JOIN sky USING (event_id)),
    sect AS (SELECT *, {house_sql('sun')} >= 7 AS day FROM cu),
    q AS (SELECT event_id, body AS point, bodies.lon AS plon, {RETRO_SQL} AS retro, cusps, used, fell, day FROM sect JOIN bodies USING (event_id)
      UNION ALL SELECT event_id, 'Node', {NODE_SQL}, true, cusps, used, fell, day FROM sect
      UNION ALL SELECT event_id, 'Fortune', CASE WHEN day THEN {norm_sql('asc_ + moon - sun')} ELSE {norm_sql('asc_ + sun - moon')} END, false, cusps, used, fell, day FROM sect)
    SELECT event_id, point, round(plon, 4) AS lon_, {SIGNS_SQL}[CAST(floor(plon / 30) AS INTEGER) + 1] AS sign_name, retro, {house_sql('plon')} AS house, used AS house_system, CASE WHEN fell THEN 'no Placidus houses at this latitude' ELSE '' END AS note,
      CASE WHEN day THEN 'day' ELSE 'night' END AS sect, NULL AS error FROM q
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'out-of-range' FROM events WHERE event_id % 97 = 0""",
)
def f41(spark, sf_dir):
    """Twelve points of a chart with sign, motion and house, by the house system asked for; Placidus falls back to whole signs where it is undefined."""
    inside, outside = charted(spark, sf_dir)
    at = sky.with_placidus(with_longitudes(inside, F.col("ts")))
    placidus = sky.placidus_cusps(F.col("asc_"), F.col("mc"))
    asked = F.get(F.array(F.lit("whole"), F.lit("equal"), F.lit("placidus")), (F.col("event_id") % 3).cast("int"))
    at = at.withColumn("asked", asked).withColumn("used", F.when((F.col("asked") == "placidus") & placidus[10].isNull(), "whole").otherwise(F.col("asked")))
    whole = sky.whole_sign_start(F.col("asc_"))
    cusps = [F.when(F.col("used") == "placidus", placidus[i]).when(F.col("used") == "equal", sky.turn(F.col("asc_") + 30 * i)).otherwise(sky.turn(whole + 30 * i)) for i in range(12)]
    houses = ["cusps", "cusps_past", "cusps_in_order"]
    at = sky.with_houses(at, cusps).withColumns({"sun": F.col("lon_Sun"), "moon": F.col("lon_Moon"), "node": sky.mean_node(sky.centuries(F.col("ts")))})
    at = at.withColumn("by_day", sky.house_among(F.col("sun")) >= 7)
    fortune = sky.part_of_fortune(F.col("asc_"), F.col("sun"), F.col("moon"), F.col("by_day"))
    more = [F.struct(F.lit(n).alias("point"), lon.alias("plon"), F.lit(retro).alias("retro")) for n, lon, retro in (("Node", F.col("node"), True), ("Fortune", fortune, False))]
    rows = at.select("event_id", "asked", "used", "by_day", *houses, F.explode(F.array(*bodies(), *more)).alias("p")).select("*", "p.*")
    note = F.when(F.col("asked") != F.col("used"), "no Placidus houses at this latitude").otherwise("")
    chart = rows.select(
        "event_id", "point", F.round("plon", 4).alias("lon_"), sky.sign_parts(F.col("plon"))["sign_name"].alias("sign_name"), "retro", sky.house_among(F.col("plon")).alias("house"),
        F.col("used").alias("house_system"), note.alias("note"), F.when(F.col("by_day"), "day").otherwise("night").alias("sect"), F.lit(None).cast("string").alias("error"),
    )
    return chart.unionByName(outside.withColumn("error", F.lit("out-of-range")), allowMissingColumns=True)


@query(
    "f41_chart_aspects",
    f"""WITH {CHART_SQL}, {EVENT_LON_SQL}, o(name, i) AS (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate([*BODIES, 'Ascendant', 'Midheaven']))}),
    q AS (SELECT event_id, body AS name, bodies.lon FROM angles JOIN bodies USING (event_id) UNION ALL SELECT event_id, 'Ascendant', asc_ FROM angles UNION ALL SELECT event_id, 'Midheaven', mc FROM angles),
    z AS (SELECT q.*, i FROM q JOIN o USING (name)),
    s AS (SELECT a.event_id, a.i AS i, b.i AS j, a.name AS a, b.name AS b, CASE WHEN abs(a.lon - b.lon) > 180 THEN 360 - abs(a.lon - b.lon) ELSE abs(a.lon - b.lon) END AS sep FROM z a JOIN z b ON a.event_id = b.event_id AND a.i < b.i),
    k(aspect, angle, o, kind) AS (VALUES ('Conjunction', 0, 8, 'major'), ('Opposition', 180, 8, 'major'), ('Trine', 120, 7, 'soft'), ('Square', 90, 7, 'hard'), ('Sextile', 60, 5, 'soft'))
    SELECT event_id, a, b, aspect, kind, round(abs(sep - angle), 4) AS orb, CAST(row_number() OVER (PARTITION BY event_id ORDER BY round(abs(sep - angle), 9), i, j) AS INTEGER) AS place FROM s JOIN k ON abs(sep - angle) <= o""",
)
def f41_aspects(spark, sf_dir):
    """Aspects of a chart's ten bodies and two angles, the closest first: all pairs within a row, without a join."""
    names = [*BODIES, "Ascendant", "Midheaven"]
    points = F.array(*(b["plon"] for b in bodies()), F.col("asc_"), F.col("mc"))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(12) for j in range(i + 1, 12)))
    at = with_longitudes(charted(spark, sf_dir)[0], F.col("ts")).select("event_id", points.alias("points"), F.array(*map(F.lit, names)).alias("names"))

    def told(p):
        return sky.bound(sky.separation(F.get("points", p["i"]), F.get("points", p["j"])), lambda apart: F.struct(F.round(sky.aspect_of(apart)["orb"], 9).alias("by"), p["i"].alias("i"), p["j"].alias("j"), sky.aspect_of(apart).alias("hit")))

    hits = F.array_sort(F.filter(F.transform(pairs, told), lambda h: h["hit"].isNotNull()))
    rows = at.select("event_id", "names", F.posexplode(hits).alias("place", "h"))
    return rows.select("event_id", F.get("names", F.col("h.i")).alias("a"), F.get("names", F.col("h.j")).alias("b"), "h.hit.aspect", "h.hit.kind", F.round("h.hit.orb", 4).alias("orb"), (F.col("place") + 1).alias("place"))


PHASES_SQL = "[" + ", ".join(f"'{n}'" for _, n in sky.MOON_PHASES[:8]) + "]"


@query(
    "f43_sky_now",
    f"""WITH {SUN_MOON_SQL}, y AS (SELECT *, {norm_sql('moon - sun')} AS elong, lon AS plon FROM bodies JOIN sky USING (event_id))
    SELECT event_id, body, round(plon, 4) AS lon_, {SIGNS_SQL}[CAST(floor(plon / 30) AS INTEGER) + 1] AS sign_name, {RETRO_SQL} AS retro, {PHASES_SQL}[CAST(floor((elong + 22.5) / 45) AS INTEGER) % 8 + 1] AS phase,
      CAST(floor((1 - cos(radians(elong))) / 2 * 100 + 0.5) AS INTEGER) AS lit FROM y""",
)
def f43(spark, sf_dir):
    """The ten bodies with sign and motion, the moon's phase and lit share."""
    at = with_longitudes(dealt_out(read(spark, sf_dir, "events").select("event_id", "ts")), F.col("ts")).withColumn("elong", sky.turn(F.col("lon_Moon") - F.col("lon_Sun")))
    lit = F.floor((1 - F.cos(F.radians("elong"))) / 2 * 100 + 0.5).cast("int")
    rows = at.select("event_id", sky.phase_name_of_angle(F.col("elong")).alias("phase"), lit.alias("lit"), F.explode(F.array(*bodies())).alias("p")).select("*", "p.*")
    return rows.select("event_id", F.col("point").alias("body"), F.round("plon", 4).alias("lon_"), sky.sign_parts(F.col("plon"))["sign_name"].alias("sign_name"), "retro", "phase", "lit")


@query(
    "f44_cusp_warning",
    f"""WITH {RANGES_SQL}, {SUN_MOON_SQL}, x AS (SELECT event_id, sun AS lon, CAST(month(ts) * 100 + day(ts) AS INTEGER) AS md FROM events JOIN sky USING (event_id)), y AS (SELECT event_id, md, lon, lon - floor(lon / 30) * 30 AS w FROM x)
    SELECT event_id, 'computed' AS source, {SIGNS_SQL}[CAST(floor(lon / 30) AS INTEGER) + 1] AS sign_name, CAST(floor(w) AS INTEGER) AS degree, CAST(floor((w - floor(w)) * 60) AS INTEGER) AS minute, least(w, 30 - w) < 1 AS on_cusp FROM y WHERE event_id % 4 > 0
    UNION ALL SELECT event_id, 'table', {SIGNS_SQL}[i + 1], NULL, NULL, NULL FROM y JOIN g ON CASE WHEN lo <= hi THEN md BETWEEN lo AND hi ELSE md >= lo OR md <= hi END WHERE event_id % 4 = 0""",
)
def f44(spark, sf_dir):
    """The sun's sign with a warning near a boundary; without an ephemeris (every fourth event) the sign of the date ranges, and no warning."""
    events = read(spark, sf_dir, "events")
    part = sky.sign_parts(F.col("lon_Sun"))
    on_cusp = F.least(part["within"], 30 - part["within"]) < 1
    computed = event_longitudes(spark, sf_dir, "Sun").where("event_id % 4 > 0").select("event_id", F.lit("computed").alias("source"), *(part[c].alias(c) for c in ("sign_name", "degree", "minute")), on_cusp.alias("on_cusp"))
    dated = events.where("event_id % 4 = 0").select("event_id", (F.month("ts") * 100 + F.dayofmonth("ts")).cast("int").alias("md"))
    found = ranges.in_interval(dated, "md", ranges.unwrapped(signs(spark), "lo", "hi", 101, 1231), "lo", "hi")
    table = found.select("event_id", F.lit("table").alias("source"), F.get(F.array(*map(F.lit, sky.SIGNS)), F.col("i")).alias("sign_name"))
    return computed.unionByName(table, allowMissingColumns=True)


@query("f45_step_timer", "SELECT event_id, greatest(0, 60 - value) AS seconds_left, CAST(floor(least(value / 60, 1) * 100 + 0.5) AS INTEGER) AS percent FROM events")
def f45(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0.0), 60 - F.col("value")).alias("seconds_left"), F.floor(F.least(F.col("value") / 60, F.lit(1.0)) * 100 + 0.5).cast("int").alias("percent"))


#: Every fourth nation has no place of its own: forty degrees north, and the longitude that its zone's hours lead to.
HERE = f"{EVENT_PLACES.replace('AS ts,', 'AS ts, n_nationkey % 4 > 0 AS exact,').replace(f'{LAT} AS lat', f'CASE WHEN n_nationkey % 4 = 0 THEN 40.0::DOUBLE ELSE {LAT} END AS lat').replace(f'{LON} AS lon', f'CASE WHEN n_nationkey % 4 = 0 THEN CAST(15 * (n_nationkey % 24 - 12) AS DOUBLE) ELSE {LON} END AS lon')}"


def clock_sql(minutes: str) -> str:
    at = f"make_timestamp(epoch_us(date_trunc('day', ts)) + CAST(floor({minutes} * 60000 + 0.5) AS BIGINT) * 1000)"
    return f"coalesce(strftime({at} AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%-I:%M %p'), '—')"


#: The month's season north of the equator, turned by half a year south of it.
SEASON_SQL = "['winter', 'spring', 'summer', 'autumn'][(month(ts) % 12 // 3 + CASE WHEN lat < 0 THEN 2 ELSE 0 END) % 4 + 1]"


@query(
    "f50_sky_summary",
    PHASE_SQL.replace(EVENT_PLACES, HERE) + f""", g AS (SELECT event_id, exact, phase, lat, lon, ts, {solar_sql(_g)[0]} AS eq, {solar_sql(_g)[1]} AS decl FROM p), m AS (SELECT *, {event_sql(96.0, '+')} AS first, {event_sql(90.833, '+')} AS rise, {event_sql(90.833, '+ -')} AS fall, {event_sql(96.0, '+ -')} AS last FROM g)
    SELECT event_id, exact, round(lat, 4) AS lat, round(lon, 4) AS lon, phase, {SEASON_SQL} AS season, {clock_sql('first')} AS dawn, {clock_sql('rise')} AS sunrise, {clock_sql('fall')} AS sunset, {clock_sql('last')} AS dusk, rise IS NULL OR fall IS NULL AS polar FROM m""",
)
def f50(spark, sf_dir):
    """What a place's sky is taken to be: where, which phase and season, and the four solar times on the local clock."""
    ts, key = F.col("ts"), F.col("n_nationkey")
    at = event_places(spark, sf_dir).withColumn("exact", key % 4 > 0)
    at = at.withColumn("lat", F.when(F.col("exact"), F.col("lat")).otherwise(40.0)).withColumn("lon", F.when(F.col("exact"), F.col("lon")).otherwise((15 * (key % 24 - 12)).cast("double")))
    lat, lon = F.col("lat"), F.col("lon")
    times = sky.solar_times(ts, lat, lon)
    clock = {n: F.coalesce(F.date_format(cal.in_zone(cal.minutes_after(ts, m), ZONE), "h:mm a"), F.lit("—")).alias(n) for n, m in times.items()}
    return at.select(
        "event_id", "exact", F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"), sky.sun_phase(ts, lat, lon).alias("phase"), cal.season(F.month(ts), lat).alias("season"),
        *clock.values(), (times["sunrise"].isNull() | times["sunset"].isNull()).alias("polar"),
    )


@query(
    "w7_retrograde",
    f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, max(CAST(ts AS TIMESTAMP)) AS moment FROM events GROUP BY ALL), inst AS (SELECT DISTINCT moment FROM d), {longitudes_sql('inst')},
    s AS (SELECT user_id, d, body, lon FROM d JOIN lon USING (moment)), n AS (SELECT *, {norm_sql('lead(lon) OVER (PARTITION BY user_id, body ORDER BY d) - lon')} AS step FROM s)
    SELECT user_id, d, body, body NOT IN ('Sun', 'Moon') AND step > 180 AS retrograde FROM n WHERE step IS NOT NULL""",
)
def w7(spark, sf_dir):
    """Backward motion of the bodies from the last event of a user's day to that of the next; Sun and Moon never turn back."""
    last = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max("ts").alias("ts"))
    daily = with_longitudes(last, F.col("ts"), ahead=False)
    following = Window.partitionBy("user_id").orderBy("d")
    step = lambda b: sky.half_turn(F.lead(f"lon_{b}").over(following) - F.col(f"lon_{b}"))
    moved = daily.withColumns({f"step_{b}": step(b) for b in BODIES}).where("step_Sun IS NOT NULL")
    retro = lambda b: F.lit(False) if b in ("Sun", "Moon") else F.col(f"step_{b}") < 0
    told = F.array(*(F.struct(F.lit(b).alias("body"), retro(b).alias("retrograde")) for b in BODIES))
    return moved.select("user_id", "d", F.explode(told).alias("b")).select("user_id", "d", "b.*")


CUSPS_SQL = "SELECT c_nationkey, CAST(c_custkey * 31 % 360 AS DOUBLE) AS cusp FROM customer"


@query("w10_wrapping_lead", f"WITH c AS ({CUSPS_SQL}) SELECT c_nationkey, cusp, coalesce(lead(cusp) OVER w, first(cusp) OVER w) AS next_cusp FROM (SELECT DISTINCT * FROM c) WINDOW w AS (PARTITION BY c_nationkey ORDER BY cusp)")
def w10(spark, sf_dir):
    cusps = read(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") * 31 % 360).cast("double").alias("cusp")).distinct()
    w = Window.partitionBy("c_nationkey").orderBy("cusp")
    return cusps.select("c_nationkey", "cusp", F.coalesce(F.lead("cusp").over(w), F.first("cusp").over(w)).alias("next_cusp"))


@query("j13_nearest_bucket", "SELECT event_id, CAST(CAST(floor((value * 7 % 360 + 22.5) / 45) AS INTEGER) % 8 AS INTEGER) AS bucket FROM events")
def j13(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", sky.phase_of_angle(F.col("value") * 7).alias("bucket"))


@query("j12_backward_bucket", f"WITH x AS (SELECT event_id, {AGE_SQL} AS age FROM events) SELECT event_id, {MOON_NAME_SQL} AS name FROM x")
def j12(spark, sf_dir):
    """The last phase that starts at or before the age."""
    return read(spark, sf_dir, "events").select("event_id", sky.moon_phase_name(sky.moon_age(F.col("ts"))).alias("name"))


@query("j15_circular_house", f"WITH {ANGLES_SQL}, {SUN_MOON_SQL} SELECT event_id, CAST(floor({norm_sql('moon - asc_')} / 30) AS INTEGER) + 1 AS house FROM angles JOIN sky USING (event_id)")
def j15(spark, sf_dir):
    """The Moon's house of thirty degrees from the ascendant on."""
    at = with_longitudes(with_angles(dealt_out(event_places(spark, sf_dir))), F.col("ts"), ["Moon"], ahead=False)
    return at.select("event_id", sky.house_from(F.col("lon_Moon"), F.col("asc_")).alias("house"))


@query("f42_polar_and_easing", f"WITH {SUN_MOON_SQL} SELECT event_id, round(100 + 80 * cos(radians(moon)), 5) AS x, round(100 - 80 * sin(radians(moon)), 5) AS y, round((1 - cos({PI} * (value % 1))) / 2, 6) AS eased FROM events JOIN sky USING (event_id)")
def f42(spark, sf_dir):
    """The Moon's point on a circle (radius 80 around 100, 100) and a cosine ease of a share."""
    lon = F.radians("lon_Moon")
    return event_longitudes(spark, sf_dir, "Moon").select("event_id", F.round(100 + 80 * F.cos(lon), 5).alias("x"), F.round(100 - 80 * F.sin(lon), 5).alias("y"), F.round((1 - F.cos(math.pi * (F.col("value") % 1))) / 2, 6).alias("eased"))
