"""Solar, lunar and chart arithmetic as columns. Angles are degrees."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.calendar import millis

#: Zenith angles of sunrise and of civil dawn, cuts of the altitude phases.
SUNRISE_ZENITH, DAWN_ZENITH = 90.833, 96.0
NIGHT_BELOW, DAY_FROM = -6.0, 10.0
#: Length of the lunar month, a new moon (epoch ms), and where each phase of it starts.
SYNODIC, NEW_MOON_MS = 29.530588853, 947182440000
MOON_PHASES = [
    (0.0, "New Moon"), (1.85, "Waxing Crescent"), (5.54, "First Quarter"), (9.23, "Waxing Gibbous"), (12.92, "Full Moon"),
    (16.61, "Waning Gibbous"), (20.30, "Last Quarter"), (23.99, "Waning Crescent"), (27.68, "New Moon"),
]
#: Aspects as (name, angle, orb, kind).
ASPECTS = [("Conjunction", 0.0, 8.0, "major"), ("Opposition", 180.0, 8.0, "major"), ("Trine", 120.0, 7.0, "soft"), ("Square", 90.0, 7.0, "hard"), ("Sextile", 60.0, 5.0, "soft")]
#: The twelve signs in order of longitude.
SIGNS = ["Aries", "Taurus", "Gemini", "Cancer", "Leo", "Virgo", "Libra", "Scorpio", "Sagittarius", "Capricorn", "Aquarius", "Pisces"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once: an expression that a lambda refers to would be worked out at each step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def turn(x: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def half_turn(x: Column) -> Column:
    """An angle in (-180, 180]."""
    folded = turn(x)
    return F.when(folded > 180, folded - 360).otherwise(folded)


def separation(a: Column, b: Column) -> Column:
    """Circular distance of two angles, 0 to 180."""
    apart = F.abs(turn(a) - turn(b))
    return F.when(apart > 180, 360 - apart).otherwise(apart)


def aspect_of(apart: Column, aspects: list[tuple] | None = None) -> Column:
    """The first aspect whose orb holds a circular distance, as a struct (aspect, kind, orb, exactness); null if none does."""
    hits = []
    for aspect, at, orb, kind in aspects or ASPECTS:
        delta = F.abs(apart - at)
        hits.append(F.when(delta <= orb, F.struct(F.lit(aspect).alias("aspect"), F.lit(kind).alias("kind"), delta.alias("orb"), (1 - delta / orb).alias("exactness"))))
    return F.coalesce(*hits)


def sign_number(longitude: Column) -> Column:
    """Sign 0 to 11."""
    return F.floor(turn(longitude) / 30).cast("int")


def sign_parts(longitude: Column) -> dict[str, Column]:
    """Number and name of the sign, whole degrees and minutes within it, and the rest in degrees."""
    within = turn(longitude) - sign_number(longitude) * 30
    return {
        "sign": sign_number(longitude),
        "sign_name": F.get(F.array(*map(F.lit, SIGNS)), sign_number(longitude)),
        "degree": F.floor(within).cast("int"),
        "minute": F.floor((within - F.floor(within)) * 60).cast("int"),
        "within": within,
    }


def longitude_label(longitude: Column) -> Column:
    part = sign_parts(longitude)
    return F.concat(part["degree"].cast("string"), F.lit("° "), part["sign_name"], F.lit(" "), F.lpad(part["minute"].cast("string"), 2, "0"), F.lit("′"))


def _solar(day_of_year: Column, hour: float | Column = 12.0) -> tuple[Column, Column]:
    """Equation of time (minutes) and declination (radians). The coefficients of the published Fourier series."""
    g = 2 * math.pi / 365 * (day_of_year - 1 + (hour - 12) / 24)
    minutes = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    return minutes, decl


def solar_event(date: Column, latitude: Column, longitude: Column, zenith: float, rising: bool) -> Column:
    """UTC minutes of the day at which the sun passes a zenith angle; null where it does not."""
    equation, decl = _solar(F.dayofyear(date), 24.0)
    lat = F.radians(latitude)
    cosine = F.cos(F.lit(math.radians(zenith))) / (F.cos(lat) * F.cos(decl)) - F.tan(lat) * F.tan(decl)
    angle = F.degrees(F.acos(F.when((cosine >= -1) & (cosine <= 1), cosine)))
    return 720 - 4 * (longitude + (angle if rising else -angle)) - equation


def solar_times(date: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    return {
        "dawn": solar_event(date, latitude, longitude, DAWN_ZENITH, True),
        "sunrise": solar_event(date, latitude, longitude, SUNRISE_ZENITH, True),
        "sunset": solar_event(date, latitude, longitude, SUNRISE_ZENITH, False),
        "dusk": solar_event(date, latitude, longitude, DAWN_ZENITH, False),
    }


def solar_altitude(ts: Column, latitude: Column, longitude: Column) -> Column:
    """Altitude of the sun at a UTC instant."""
    minutes = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60
    equation, decl = _solar(F.dayofyear(ts), minutes / 60)
    hour_angle = F.radians((minutes + equation + 4 * longitude) / 4 - 180)
    lat = F.radians(latitude)
    sine = F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(hour_angle)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))


def sun_phase(ts: Column, latitude: Column, longitude: Column) -> Column:
    """night, day, dawn (rising over the next ten minutes) or dusk."""
    now = solar_altitude(ts, latitude, longitude)
    later = solar_altitude(ts + F.expr("INTERVAL 10 MINUTES"), latitude, longitude)
    return F.when(now < NIGHT_BELOW, "night").when(now >= DAY_FROM, "day").when(later > now, "dawn").otherwise("dusk")


def moon_age(ts: Column) -> Column:
    """Days since the mean new moon."""
    return F.pmod((millis(ts) - NEW_MOON_MS) / 86_400_000, F.lit(SYNODIC))


def moon_phase_name(age: Column) -> Column:
    """The last phase that starts at or before the age."""
    out = F.lit(MOON_PHASES[0][1])
    for start, name in MOON_PHASES[1:]:
        out = F.when(age >= start, name).otherwise(out)
    return out


def illumination(age: Column) -> Column:
    return (1 - F.cos(2 * math.pi * age / SYNODIC)) / 2


def phase_name_of_angle(angle: Column) -> Column:
    """Name of the moon's phase that an elongation is nearest to."""
    return F.get(F.array(*(F.lit(name) for _, name in MOON_PHASES[:8])), phase_of_angle(angle))


def phase_of_angle(angle: Column) -> Column:
    """Eighth of a turn that an elongation is nearest to, 0 to 7."""
    return F.pmod(F.floor((turn(angle) + 22.5) / 45), F.lit(8)).cast("int")


def centuries(ts: Column) -> Column:
    """Julian centuries since 2000-01-01 12:00."""
    return (millis(ts) / 86_400_000 + 2440587.5 - 2451545.0) / 36525


def obliquity(t: Column) -> Column:
    """Mean obliquity of the ecliptic. The published polynomial."""
    return 23.439291111 - 0.0130041667 * t - 1.6666667e-7 * t * t + 5.027778e-7 * t * t * t


def mean_node(t: Column) -> Column:
    """Longitude of the moon's mean ascending node. The published polynomial."""
    return turn(125.0445479 - 1934.1362891 * t + 0.0020754 * t * t + t * t * t / 467441 - t * t * t * t / 60616000)


def sidereal_degrees(ts: Column, longitude: Column) -> Column:
    """Local mean sidereal time as an angle. The published polynomial."""
    days = millis(ts) / 86_400_000 + 2440587.5 - 2451545.0
    t = days / 36525
    return turn(280.46061837 + 360.98564736629 * days + 0.000387933 * t * t - t * t * t / 38710000 + longitude)


def midheaven(ramc: Column, eps: Column) -> Column:
    r, e = F.radians(ramc), F.radians(eps)
    return turn(F.degrees(F.atan2(F.sin(r), F.cos(r) * F.cos(e))))


def ascendant(ramc: Column, eps: Column, latitude: Column) -> Column:
    """Rising degree; the half-circle east of the midheaven."""
    r, e, lat = F.radians(ramc), F.radians(eps), F.radians(latitude)
    rising = turn(F.degrees(F.atan2(F.cos(r), -(F.sin(r) * F.cos(e) + F.tan(lat) * F.sin(e)))))
    return F.when(turn(rising - midheaven(ramc, eps)) > 180, turn(rising + 180)).otherwise(rising)


def _cusps_from(start: Column) -> Column:
    return bound(start, lambda a: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.pmod((a + 30 * i).cast("double"), F.lit(360.0))))


def whole_sign_cusps(asc: Column) -> Column:
    return _cusps_from(whole_sign_start(asc))


def equal_cusps(asc: Column) -> Column:
    return _cusps_from(asc)


#: Placidus houses as (house, offset of the right ascension, share of the semi-arc, sign of the ascensional difference).
PLACIDUS = [(11, 30.0, 1 / 3, 1), (12, 60.0, 2 / 3, 1), (2, 120.0, 2 / 3, -1), (3, 150.0, 1 / 3, -1)]


def with_placidus(df: DataFrame, rounds: int = 12) -> DataFrame:
    """Adds cusp_11, cusp_12, cusp_2 and cusp_3 to rows with ramc, eps and lat (degrees): fixed-point iteration on the right ascension of each.

    Null where the ecliptic degree never rises, in any round. Twelve rounds change a value by less than a micro-degree where it settles at all.
    A round is a projection of its own over plain columns, so that each value is worked out once.
    """
    own = {"_se": F.sin(F.radians("eps")), "_ce": F.cos(F.radians("eps")), "_tl": F.tan(F.radians("lat")), "_r": F.radians("ramc")}
    df = df.withColumns(own).withColumns({f"_h{h}": F.col("_r") + math.radians(offset) for h, offset, _, _ in PLACIDUS})
    for _ in range(rounds):
        # tan(asin(y)) is y / sqrt(1 - y * y); y is the sine of the declination
        df = df.withColumns({f"_y{h}": F.col("_se") * F.sin(f"_h{h}") / F.sqrt(F.pow(F.sin(f"_h{h}"), F.lit(2)) + F.pow(F.cos(f"_h{h}") * F.col("_ce"), F.lit(2))) for h, *_ in PLACIDUS})
        df = df.withColumns({f"_x{h}": F.col("_tl") * F.col(f"_y{h}") / F.sqrt(1 - F.col(f"_y{h}") * F.col(f"_y{h}")) for h, *_ in PLACIDUS})
        df = df.withColumns({f"_h{h}": F.when(F.abs(f"_x{h}") <= 1, F.col("_r") + math.radians(offset) + F.asin(f"_x{h}") * (sign * share)) for h, offset, share, sign in PLACIDUS})
    df = df.withColumns({f"cusp_{h}": turn(F.degrees(F.atan2(F.sin(f"_h{h}"), F.cos(f"_h{h}") * F.col("_ce")))) for h, *_ in PLACIDUS})
    return df.drop(*own, *(f"_{c}{h}" for c in "hyx" for h, *_ in PLACIDUS))


def placidus_cusps(asc: Column, mc: Column) -> list[Column]:
    """The twelve cusps beside the columns of `with_placidus`; all null where one of those is (above the polar circles)."""
    eleven, twelve, two, three = (F.col(f"cusp_{h}") for h in (11, 12, 2, 3))
    defined = eleven.isNotNull() & twelve.isNotNull() & two.isNotNull() & three.isNotNull()
    half = [asc, two, three, turn(mc + 180), turn(eleven + 180), turn(twelve + 180)]
    return [F.when(defined, c) for c in [*half, turn(asc + 180), turn(two + 180), turn(three + 180), mc, eleven, twelve]]


def with_houses(df: DataFrame, cusps: list[Column]) -> DataFrame:
    """Adds what `house_among` reads: the cusps (array), how far each lies past the first, and whether they lie in order."""
    df = df.withColumn("cusps", F.array(*cusps))
    spans = F.transform("cusps", lambda c, i: turn(F.round(F.get("cusps", F.pmod(i + 1, F.lit(12))) - c, 9)))
    in_order = F.abs(F.aggregate(spans, F.lit(0.0), lambda acc, x: acc + x) - 360) < 1e-6
    past = F.transform("cusps", lambda c: turn(F.round(c - F.get("cusps", F.lit(0)), 9)))
    return df.withColumn("cusps_past", past).withColumn("cusps_in_order", in_order)


def house_among(longitude: Column) -> Column:
    """House 1 to 12 beside the columns of `with_houses`: the first whose span from its cusp to the next holds the longitude; 1 if none does.

    A longitude within a billionth of a degree of a cusp is on it. Of cusps in order it is the last one that is not past the longitude.
    """
    at = turn(F.round(longitude - F.get("cusps", F.lit(0)), 9))
    ranked = sum(((F.get("cusps_past", F.lit(i)) <= at).cast("int") for i in range(1, 12)), F.lit(1))

    def inside(i: Column) -> Column:
        here = F.get("cusps", i)
        span = turn(F.round(F.get("cusps", F.pmod(i + 1, F.lit(12))) - here, 9))
        return (span == 0) | (turn(F.round(longitude - here, 9)) < span)

    tried = F.get(F.filter(F.sequence(F.lit(0), F.lit(11)), inside), F.lit(0)) + 1
    return F.when(F.col("cusps_in_order"), ranked).otherwise(F.coalesce(tried, F.lit(1))).cast("int")


def part_of_fortune(asc: Column, sun: Column, moon: Column, by_day: Column) -> Column:
    return F.when(by_day, turn(asc + moon - sun)).otherwise(turn(asc + sun - moon))


def house_from(longitude: Column, first: Column) -> Column:
    """House 1 to 12 of houses of thirty degrees, from the first cusp on."""
    house = F.floor(turn(longitude - first) / 30) + 1
    return F.when(house > 12, 1).otherwise(house).cast("int")  # a turn may round up to 360


def whole_sign_start(asc: Column) -> Column:
    """Cusp of the first whole-sign house."""
    return (F.floor(turn(asc) / 30) * 30).cast("double")
