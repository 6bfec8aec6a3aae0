"""Sample pages with known text: digits drawn, then spoiled in the ways scans and photos are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from numerion.functions import kernels as K
from numerion.functions import sheet as H
from numerion.schema import IMAGE

CATEGORIES = ("plain", "inverted", "noisy", "blurred", "tilted", "underlined", "ruled", "faint", "shaded")
SAMPLE = f"image_id string, category string, lines array<string>, image {IMAGE}"


def blend(paper: np.ndarray, alpha: np.ndarray, ink: float) -> np.ndarray:
    """Ink over paper by its opacity."""
    return paper * (1 - alpha) + ink * alpha


def spoiled(img: np.ndarray, category: str, r: np.random.Generator) -> np.ndarray:
    """A page of a category; seeded by ``r``."""
    h, w = img.shape
    out = img.astype(float)
    if category == "inverted":
        out = 255 - out
    elif category == "noisy":
        out = out + r.normal(0, 12, out.shape)
    elif category == "blurred":
        out = K.gaussian(out, 5)
    elif category == "tilted":
        a = np.deg2rad(r.uniform(-4, 4))
        mid = np.array([w / 2, h / 2])
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        m = np.vstack([np.column_stack([turn, mid - turn @ mid]), [0, 0, 1]])
        out = H.warped(img, m, w, h)[..., 0].astype(float)
    elif category == "underlined":
        out[h - 16 : h - 13, 4 : w - 4] = 60
    elif category == "ruled":
        out[8::50] = np.minimum(out[8::50], 185)
    elif category == "faint":
        out = 240 - (240 - out) * 0.4
    elif category == "shaded":
        out = out * np.linspace(1.0, 0.65, w)[None]
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def pages(rows: DataFrame, seed: int = 0) -> DataFrame:
    """A page for each (image_id string, lines array<string>, category string), drawn where the row lies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, lines, category in zip(part["image_id"], part["lines"], part["category"], strict=True):
                r = np.random.default_rng([seed, *name.encode()])
                size = int(r.integers(36, 70))
                # Wide gaps: bars of digits side by side must not look like a ruled line.
                img = spoiled(K.text_image(list(lines), size, gap=size * 2 // 3), category, r)
                out.append({"image_id": name, "category": category, "lines": lines, "image": {"origin": name, "height": img.shape[0], "width": img.shape[1], "nChannels": 1, "mode": 0, "data": img.tobytes()}})
            yield pd.DataFrame(out)

    return rows.select("image_id", "lines", "category").mapInPandas(run, SAMPLE)


def category_of(number: Column) -> Column:
    """A category for each number, all alike often."""
    return F.get(F.array(*map(F.lit, CATEGORIES)), (number % len(CATEGORIES)).cast("int"))
