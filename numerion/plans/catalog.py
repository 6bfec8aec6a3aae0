"""All queries of the library and their SQL."""

from __future__ import annotations

from numerion.plans import images, learning, pages, pixels, rasters, readings, resampling, shapes

MODULES = (pages, pixels, rasters, resampling, shapes, learning, readings, images)


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
