"""Geocentric longitudes of ten bodies from published low-precision theories.

Sun: the equation of centre. Moon: the periodic terms of longitude. Mercury to Neptune: Kepler orbits whose elements drift linearly, with the largest
perturbations of Jupiter, Saturn and Uranus. Pluto: a fitted series. Longitudes are those of the true equinox of date: nutation's four largest terms are added.
The Sun's aberration is taken off; light time and aberration of the planets are left out (at most a minute of arc for Mercury, twenty seconds for the
outer ones). Within 1900 to 2100 the Sun is good to 0.01 degrees, the Moon to 0.02, planets to about 0.05, Pluto to 0.1; farther from the
present the error of the planets grows to some tenths of a degree.

The terms are data: a table of amplitudes and multiples is one matrix product and one sine over a batch of instants. (As column expressions the same terms
are some thousands of nodes, more than a generated method may hold: 13.8 s for 100,000 instants and a day later, where batches take a tenth of it.)
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.calendar import millis

BODIES = ["Sun", "Moon", "Mercury", "Venus", "Mars", "Jupiter", "Saturn", "Uranus", "Neptune", "Pluto"]

#: Fixed values (published lunar theory): polynomials in Julian centuries, in degrees: mean longitude, elongation, the Sun's anomaly, the
#: Moon's anomaly, argument of latitude.
MOON_ARGUMENTS = {
    "lm": (218.3164477, 481267.88123421, -0.0015786, 1 / 538841, -1 / 65194000),
    "dm": (297.8501921, 445267.1114034, -0.0018819, 1 / 545868, -1 / 113065000),
    "ms": (357.5291092, 35999.0502909, -0.0001536, 1 / 24490000),
    "mm": (134.9633964, 477198.8675055, 0.0087414, 1 / 69699, -1 / 14712000),
    "fm": (93.2720950, 483202.0175233, -0.0036539, -1 / 3526000, 1 / 863310000),
}
#: Fixed values (published lunar theory): multiples of elongation, Sun's anomaly, Moon's anomaly and argument of latitude; millionths of a degree.
MOON_TERMS = [
    (0, 0, 1, 0, 6288774), (2, 0, -1, 0, 1274027), (2, 0, 0, 0, 658314), (0, 0, 2, 0, 213618), (0, 1, 0, 0, -185116), (0, 0, 0, 2, -114332),
    (2, 0, -2, 0, 58793), (2, -1, -1, 0, 57066), (2, 0, 1, 0, 53322), (2, -1, 0, 0, 45758), (0, 1, -1, 0, -40923), (1, 0, 0, 0, -34720),
    (0, 1, 1, 0, -30383), (2, 0, 0, -2, 15327), (0, 0, 1, 2, -12528), (0, 0, 1, -2, 10980), (4, 0, -1, 0, 10675), (0, 0, 3, 0, 10034),
    (4, 0, -2, 0, 8548), (2, 1, -1, 0, -7888), (2, 1, 0, 0, -6766), (1, 0, -1, 0, -5163), (1, 1, 0, 0, 4987), (2, -1, 1, 0, 4036),
    (2, 0, 2, 0, 3994), (4, 0, 0, 0, 3861), (2, 0, -3, 0, 3665), (0, 1, -2, 0, -2689), (2, 0, -1, 2, -2602), (2, -1, -2, 0, 2390),
    (1, 0, 1, 0, -2348), (2, -2, 0, 0, 2236), (0, 1, 2, 0, -2120), (0, 2, 0, 0, -2069), (2, -2, -1, 0, 2048), (2, 0, 1, -2, -1773),
    (2, 0, 0, 2, -1595), (4, -1, -1, 0, 1215), (0, 0, 2, 2, -1110), (3, 0, -1, 0, -892), (2, 1, 1, 0, -810), (4, -1, -2, 0, 759),
    (0, 2, -1, 0, -713), (2, 2, -1, 0, -700), (2, 1, -2, 0, 691), (2, -1, 0, -2, 596), (4, 0, 1, 0, 549), (0, 0, 4, 0, 537),
    (4, -1, 0, 0, 520), (1, 0, -2, 0, -487), (2, 1, 0, -2, -399), (0, 0, 2, -2, -381), (1, 1, 1, 0, 351), (3, 0, -2, 0, -340),
    (4, 0, -3, 0, 330), (2, -1, 2, 0, 327), (0, 2, 1, 0, -323), (1, 1, -1, 0, 299), (2, 0, 3, 0, 294),
]
#: Fixed values (published elements): ascending node, inclination, perihelion, axis, eccentricity and anomaly at day 0 (1999-12-31) and their change per day.
ELEMENTS = {
    "Mercury": ((48.3313, 3.24587e-5), (7.0047, 5.00e-8), (29.1241, 1.01444e-5), (0.387098, 0.0), (0.205635, 5.59e-10), (168.6562, 4.0923344368)),
    "Venus": ((76.6799, 2.46590e-5), (3.3946, 2.75e-8), (54.8910, 1.38374e-5), (0.723330, 0.0), (0.006773, -1.302e-9), (48.0052, 1.6021302244)),
    "Mars": ((49.5574, 2.11081e-5), (1.8497, -1.78e-8), (286.5016, 2.92961e-5), (1.523688, 0.0), (0.093405, 2.516e-9), (18.6021, 0.5240207766)),
    "Jupiter": ((100.4542, 2.76854e-5), (1.3030, -1.557e-7), (273.8777, 1.64505e-5), (5.20256, 0.0), (0.048498, 4.469e-9), (19.8950, 0.0830853001)),
    "Saturn": ((113.6634, 2.38980e-5), (2.4886, -1.081e-7), (339.3939, 2.97661e-5), (9.55475, 0.0), (0.055546, -9.499e-9), (316.9670, 0.0334442282)),
    "Uranus": ((74.0005, 1.3978e-5), (0.7733, 1.9e-8), (96.6612, 3.0565e-5), (19.18171, -1.55e-8), (0.047318, 7.45e-9), (142.5905, 0.011725806)),
    "Neptune": ((131.7806, 3.0173e-5), (1.7700, -2.55e-7), (272.8461, -6.027e-6), (30.05826, 3.313e-8), (0.008606, 2.15e-9), (260.2471, 0.005995147)),
}
#: Fixed values (published with the elements): body, l (longitude) or b (latitude), degrees, multiples of the anomalies of Jupiter, Saturn and Uranus, and a
#: constant angle. A cosine is a sine of 90 degrees more.
PERTURBATIONS = [
    ("Jupiter", "l", -0.332, 2, -5, 0, -67.6), ("Jupiter", "l", -0.056, 2, -2, 0, 21.0), ("Jupiter", "l", 0.042, 3, -5, 0, 21.0), ("Jupiter", "l", -0.036, 1, -2, 0, 0.0),
    ("Jupiter", "l", 0.022, 1, -1, 0, 90.0), ("Jupiter", "l", 0.023, 2, -3, 0, 52.0), ("Jupiter", "l", -0.016, 1, -5, 0, -69.0),
    ("Saturn", "l", 0.812, 2, -5, 0, -67.6), ("Saturn", "l", -0.229, 2, -4, 0, 88.0), ("Saturn", "l", 0.119, 1, -2, 0, -3.0), ("Saturn", "l", 0.046, 2, -6, 0, -69.0),
    ("Saturn", "l", 0.014, 1, -3, 0, 32.0), ("Saturn", "b", -0.020, 2, -4, 0, 88.0), ("Saturn", "b", 0.018, 2, -6, 0, -49.0),
    ("Uranus", "l", 0.040, 0, 1, -2, 6.0), ("Uranus", "l", 0.035, 0, 1, -3, 33.0), ("Uranus", "l", -0.015, 1, 0, -1, 20.0),
]
#: Fixed values (published series for Pluto): the constant and drift, then the sine and cosine of 1, 2, ... times its angle.
PLUTO = {
    "l": ((238.9508, 0.00400703), [(-19.799, 19.848), (0.897, -4.956), (0.610, 1.211), (-0.341, -0.190), (0.128, -0.034), (-0.038, 0.031)]),
    "b": ((-3.9082, 0.0), [(-5.453, -14.975), (3.527, 1.673), (-1.051, 0.328), (0.179, -0.292), (0.019, 0.100), (-0.031, -0.026)]),
    "r": ((40.72, 0.0), [(6.68, 6.90), (-1.18, -0.03), (0.15, -0.14)]),
}
PLUTO_ANGLE, PLUTO_SATURN = (238.95, 0.003968789), (50.03, 0.033459652)
#: Sine and cosine of Saturn's angle less Pluto's.
PLUTO_MIXED = {"l": (0.020, -0.010), "b": (0.0, 0.011)}
#: Nutation in longitude, degrees: multiples of the Moon's node, the Sun's and the Moon's mean longitude.
NUTATION = [(-17.20 / 3600, 1, 0, 0), (-1.32 / 3600, 0, 2, 0), (-0.23 / 3600, 0, 0, 2), (0.21 / 3600, 2, 0, 0)]
#: Fixed value: the Sun's aberration at the mean distance, degrees.
ABERRATION = 20.4898 / 3600
KEPLER_STEPS = 4




def _poly(t: np.ndarray, coefficients: tuple) -> np.ndarray:
    """A polynomial by Horner's rule."""
    out = np.full_like(t, coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def terrestrial_days(clock: np.ndarray) -> np.ndarray:
    """Days since 2000-01-01 12:00 of terrestrial time, which runs ahead of the clock by a published estimate: that of 2005 to 2050, else the long-term parabola."""
    year = 2000 + clock / 365.25
    near = 62.92 + 0.32217 * (year - 2000) + 0.005589 * (year - 2000) ** 2
    far = 32 * ((year - 1820) / 100) ** 2 - 20
    return clock + np.where((year >= 2005) & (year < 2050), near, far) / 86_400


def _series(terms: np.ndarray, angles: np.ndarray, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Sum over terms (amplitude, multiples...) of amplitude * sin(multiples . angles); angles has a row per instant."""
    return (np.sin(angles @ terms[:, 1:].T) * (terms[:, 0] * weight)).sum(1)


_MOON = np.array([(a, e, s, m, f) for e, s, m, f, a in MOON_TERMS], float)
_NUTATION = np.array(NUTATION)


def _pull(body: str, kind: str, anomalies: np.ndarray) -> np.ndarray:
    """Perturbations of a body (radians). anomalies: those of Jupiter, Saturn and Uranus, and 1."""
    terms = np.array([(a, j, s, u, math.radians(g)) for b, k, a, j, s, u, g in PERTURBATIONS if (b, k) == (body, kind)])
    return np.radians(_series(terms, anomalies)) if len(terms) else np.zeros(len(anomalies))


def _orbit(body: str, d: np.ndarray, anomalies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance, longitude and latitude (radians) as seen from the Sun."""
    node, incline, perihelion, axis, ecc, mean = (start + d * drift for start, drift in ELEMENTS[body])
    m = np.radians(mean % 360)
    x = m + ecc * np.sin(m) * (1 + ecc * np.cos(m))
    for _ in range(KEPLER_STEPS):
        x = x - (x - ecc * np.sin(x) - m) / (1 - ecc * np.cos(x))
    p, q = axis * (np.cos(x) - ecc), axis * np.sqrt(1 - ecc * ecc) * np.sin(x)
    u, i = np.arctan2(q, p) + np.radians(perihelion), np.radians(incline)
    lon = np.radians(node) + np.arctan2(np.sin(u) * np.cos(i), np.cos(u))
    return np.sqrt(p * p + q * q), lon + _pull(body, "l", anomalies), np.arcsin(np.sin(u) * np.sin(i)) + _pull(body, "b", anomalies)


def _pluto(d: np.ndarray) -> list[np.ndarray]:
    own, saturn = (np.radians((start + d * drift) % 360) for start, drift in (PLUTO_ANGLE, PLUTO_SATURN))
    out = []
    for kind in "rlb":
        (start, drift), pairs = PLUTO[kind]
        total = start + d * drift + sum(s * np.sin(i * own) + c * np.cos(i * own) for i, (s, c) in enumerate(pairs, 1))
        s, c = PLUTO_MIXED.get(kind, (0.0, 0.0))
        total = total + s * np.sin(saturn - own) + c * np.cos(saturn - own)
        out.append(total if kind == "r" else np.radians(total))
    return out


def longitudes(clock: np.ndarray, bodies: list[str] | None = None) -> dict[str, np.ndarray]:
    """Geocentric ecliptic longitudes (degrees, 0 to 360) at days since 2000-01-01 12:00 UTC."""
    days = terrestrial_days(clock)
    t, d = days / 36525, days + 1.5
    lm, dm, ms, mm, fm = (np.radians(_poly(t, p) % 360) for p in MOON_ARGUMENTS.values())
    l0, sm, om = _poly(t, (280.46646, 36000.76983, 0.0003032)) % 360, np.radians(_poly(t, (357.52911, 35999.05029, -0.0001537)) % 360), np.radians(_poly(t, (125.04452, -1934.136261)) % 360)
    centre = _poly(t, (1.914602, -0.004817, -0.000014)) * np.sin(sm) + _poly(t, (0.019993, -0.000101)) * np.sin(2 * sm) + 0.000289 * np.sin(3 * sm)
    nutation = _series(_NUTATION, np.stack([om, np.radians(l0), lm], 1))
    ecc, sun = _poly(t, (0.016708634, -0.000042037, -0.0000001267)), l0 + centre
    rs = 1.000001018 * (1 - ecc * ecc) / (1 + ecc * np.cos(sm + np.radians(centre)))
    anomalies = np.stack([*(np.radians((ELEMENTS[b][5][0] + d * ELEMENTS[b][5][1]) % 360) for b in ("Jupiter", "Saturn", "Uranus")), np.ones_like(d)], 1)
    out = {}
    for body in bodies or BODIES:
        if body == "Sun":
            found = sun - ABERRATION / rs
        elif body == "Moon":
            weight = _poly(t, (1.0, -0.002516, -0.0000074))[:, None] ** np.abs(_MOON[:, 2])
            # beside the terms: the pull of Venus, the flattening of the Earth, and Jupiter's
            more = 3958 * np.sin(np.radians(119.75 + 131.849 * t)) + 1962 * np.sin(lm - fm) + 318 * np.sin(np.radians(53.09 + 479264.290 * t))
            found = np.degrees(lm) + (_series(_MOON, np.stack([dm, ms, mm, fm], 1), weight) + more) / 1_000_000
        else:
            r, lon, lat = _pluto(d) if body == "Pluto" else _orbit(body, d, anomalies)
            x, y = r * np.cos(lat) * np.cos(lon) + rs * np.cos(np.radians(sun)), r * np.cos(lat) * np.sin(lon) + rs * np.sin(np.radians(sun))
            found = np.degrees(np.arctan2(y, x))
        out[body] = (found + nutation) % 360
    return out


def with_longitudes(df: DataFrame, ts: Column, bodies: list[str] | None = None, ahead: bool = True) -> DataFrame:
    """Adds each body's longitude at a UTC instant as lon_<body>, and with `ahead` that of a day later as next_<body>; null for a null instant."""
    wanted = list(bodies or BODIES)
    names = [f"lon_{b}" for b in wanted] + [f"next_{b}" for b in wanted] * ahead

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def found(clock: pd.Series) -> pd.DataFrame:
        now = clock.to_numpy(float)
        columns = {f"lon_{b}": x for b, x in longitudes(now, wanted).items()}
        if ahead:
            columns |= {f"next_{b}": x for b, x in longitudes(now + 1, wanted).items()}
        return pd.DataFrame(columns)

    clock = millis(ts) / 86_400_000 + 2440587.5 - 2451545.0
    placed = df.withColumn("_sky", found(clock))
    return placed.select("*", *(F.when(~F.isnan(f"_sky.{n}"), F.col(f"_sky.{n}")).alias(n) for n in names)).drop("_sky")
