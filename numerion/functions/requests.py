"""Requests, options and reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upload_status(length: Column, limit: int) -> Column:
    """400 for nothing, 413 over the limit, else 200."""
    return F.when(length.isNull() | (length == 0), 400).when(length > limit, 413).otherwise(200)


def key_status(given: Column, wanted: str | None) -> Column:
    """401 unless the key is the wanted one, if one is wanted."""
    return F.lit(200) if not wanted else F.when(given.eqNullSafe(F.lit(wanted)), 200).otherwise(401)


def range_status(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull() | value.between(low, high), 200).otherwise(422)


def output_name(path: Column, given: Column | None = None, debug: Column | None = None) -> Column:
    """Where the annotated copy of ``path`` goes: the given place, else ``<stem>_detected.png`` in the debug folder, else beside it."""
    beside = F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit("_detected.png"))
    choices = [beside]
    if debug is not None:
        choices.insert(0, F.concat(debug, F.lit("/"), F.substring_index(beside, "/", -1)))
    if given is not None:
        choices.insert(0, given)
    return F.coalesce(*choices)


def first_model(names: Column, order: tuple[str, ...] = (".onnx", ".keras", ".tflite")) -> Column:
    """The first name with a kind of ``order``, by that order; else a .keras default."""

    def of(kind: str) -> Column:
        return F.get(F.filter(names, lambda n: n.endswith(kind)), 0)

    return F.coalesce(*map(of, order), F.lit("digits.keras"))


def learning_rate(epoch: Column, base: float = 1e-3) -> Column:
    """Halved with each epoch from the fourth on."""
    return F.lit(base) * F.pow(F.lit(0.5), F.greatest(F.lit(0), epoch - 2))
