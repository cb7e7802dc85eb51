"""Positions on the sky and in space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cartesian(ra_deg: Column, dec_deg: Column, distance: Column | None = None) -> dict[str, Column]:
    """x, y, z of a direction scaled by ``distance`` (unit vector when absent)."""
    ra, dec = F.radians(ra_deg), F.radians(dec_deg)
    unit = {
        "x": F.cos(dec) * F.cos(ra),
        "y": F.cos(dec) * F.sin(ra),
        "z": F.sin(dec),
    }
    return unit if distance is None else {k: distance * v for k, v in unit.items()}
