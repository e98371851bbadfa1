"""Scalar functions on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def yeo_johnson(x: Column, lam: float) -> Column:
    """Power transform for a given lambda."""
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def plain_name(name: Column) -> Column:
    """Administrative name without its kind, in lower case with single blanks."""
    short = F.regexp_replace(F.lower(F.trim(name)), r"^(kelurahan|kalurahan|desa)\s+", "")
    return F.trim(F.regexp_replace(short, r"\s+", " "))


# Cause codes in the order in which they are looked for. A code holds if each group has a word in the text.
KEYWORDS = {
    "I": [["pasti ada kesalahan"]],
    "F": [["snapping"]],
    "A": [["sungai", "waduk"], ["jembatan"]],
    "B": [["bandara"], ["memang"]],
    "C": [["perbukitan", "lembah", "kontur"]],
    "D": [["pesisir"]],
    "H": [["terscraping"]],
    "E": [["osm", "google"]],
}
# What each code says of a place.
VALID = {"A": "Y", "B": "Y", "C": "Y", "D": "Y", "E": "T", "F": "T", "G": "Y", "H": "T", "I": "cek"}


def keyword_codes(text: Column, words: dict[str, list[list[str]]] = KEYWORDS) -> Column:
    """Codes whose words occur in the text, in the order of ``words``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    holds = lambda groups: F.least(F.lit(True), *[F.greatest(F.lit(False), *[low.contains(w) for w in g]) for g in groups])
    return F.filter(F.array(*[F.when(holds(g), F.lit(code)) for code, g in words.items()]), lambda c: c.isNotNull())


def validity(code: Column) -> Column:
    """Y, T or cek for a code: a letter by itself or before a blank, hyphen or point; null for others."""
    letter = F.upper(F.substring(F.trim(code), 1, 1))
    known = F.create_map(*[F.lit(x) for kv in VALID.items() for x in kv])
    return F.when(F.trim(code).rlike(r"^[A-Ia-i]([ \-.]|$)"), F.try_element_at(known, letter))


def class_of(value: Column, edges: Column) -> Column:
    """Index of the half-open class between sorted edges, the ends included in the outer ones."""
    at = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.least(F.greatest(at, F.lit(0)), F.size(edges) - 2)


def first_filled(*cols: Column) -> Column:
    """The first that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def close(a: Column, b: Column, rtol: float = 1e-6, atol: float = 2e-6) -> Column:
    """Equal within tolerances; nulls equal nulls."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))


def slug(text: Column, most: int = 70) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")), 1, most)


def local_number(x: Column, places: int) -> Column:
    """Number with points between thousands and a decimal comma."""
    return F.translate(F.format_number(x, places), ",.", ".,")


def time_bin(minutes: Column, edges: tuple = (5, 10, 15, 30, 60)) -> Column:
    out = F.when(minutes.isNull(), "tak terjangkau")
    for e in edges:
        out = out.when(minutes <= e, f"<= {e}")
    return out.otherwise(f"> {edges[-1]}")


def utm(lon: Column, lat: Column, zone: int = 49, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing on WGS 84 by the Krueger series of third order."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(alpha)), F.lit(0.0))
    m = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(alpha)), F.lit(0.0))
    return 0.9996 * big * e + 500_000, 0.9996 * big * m + (10_000_000 if south else 0)


def utm_inverse(x: Column, y: Column, zone: int = 49, south: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of ``utm``."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    big = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (y - (10_000_000 if south else 0)) / (0.9996 * big), (x - 500_000) / (0.9996 * big)
    xi2 = xi - sum((b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    eta2 = eta - sum((b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(beta)), F.lit(0.0))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi + sum((d * F.sin(2 * (j + 1) * chi) for j, d in enumerate(delta)), F.lit(0.0))
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(phi)
