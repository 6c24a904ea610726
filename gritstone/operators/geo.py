"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    h = half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_a, lon_b)
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def widest_km(points: Column) -> Column:
    """Largest distance between any two of a short array of struct(lat, lon)."""
    return F.array_max(F.flatten(F.transform(points, lambda a: F.transform(points, lambda b: haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])))))


def reconciled(km: Column) -> Column:
    """What places that disagree by at most km are worth."""
    return F.when(km <= 2, "DERIVED_MEDIUM").when(km > 2, "NEEDS_REVIEW")


def graded(lat: Column, lon: Column, state_ok: Column, kind: Column, span: Column, pin_ok: Column, district_ok: Column, backed_off: Column, box: tuple[float, float, float, float]) -> Column:
    """Status of a geocoded candidate; the first rule that holds decides. A null state_ok is an unconfirmed state; other nulls say nothing against it."""
    inside = lat.between(*box[:2]) & lon.between(*box[2:])
    out = F.when(~F.coalesce(inside, F.lit(False)) | ~state_ok, "REJECTED").when(state_ok.isNull(), "NEEDS_REVIEW")
    out = out.when((kind == "centroid") | (span > 0.1), "REJECTED").when(~pin_ok | ~district_ok, "NEEDS_REVIEW")
    return out.when(backed_off, "DERIVED_MEDIUM").when(kind == "pinpoint", "DERIVED_HIGH").otherwise("DERIVED_MEDIUM")
