"""Classifiers behind one contract: ``predict`` takes (n, 28, 28) in 0..1 and gives (n, 10) scores.

A model travels with the task function and sets itself up once per worker.
New kinds subclass ``Model`` and are entered in ``KINDS``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerion.functions import kernels as K
from numerion.params import Reading

SIZE = 28


def prepared(x: np.ndarray) -> np.ndarray:
    """(n, 28, 28) float32 in 0..1; images with a value over 1 are taken as 0..255, each by itself."""
    x = np.asarray(x, np.float32)
    if x.size % (SIZE * SIZE):
        raise ValueError(f"not images of {SIZE} x {SIZE}")
    x = x.reshape(-1, SIZE, SIZE)
    top = x.max(axis=(1, 2), initial=0)
    return np.where((top > 1 + 1e-6)[:, None, None], x / 255, x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """A classifier is its ``scores``: a function of prepared images, one row of ten for each."""

    scores = staticmethod(lambda images: np.zeros((len(images), 10), np.float32))

    def predict(self, images: np.ndarray) -> np.ndarray:
        batch = prepared(images)
        return self.scores(batch) if len(batch) else Model.scores(batch)


class Convolutional(Model):
    """conv 32, pool, conv 64, conv 64, pool, dense 128, softmax over ten; 3 x 3 kernels without padding; 188,234 weights."""

    #: Weights by name and shape.
    SHAPES = {"c1": (3, 3, 1, 32), "b1": (32,), "c2": (3, 3, 32, 64), "b2": (64,), "c3": (3, 3, 64, 64), "b3": (64,), "d1": (1024, 128), "e1": (128,), "d2": (128, 10), "e2": (10,)}

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        for name, shape in self.SHAPES.items():
            if weights[name].shape != shape:
                raise ValueError(f"{name} has shape {weights[name].shape}, not {shape}")
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def load(cls, path: str) -> Convolutional:
        with np.load(path) as f:
            return cls(dict(f))

    @classmethod
    def random(cls, seed: int = 42) -> Convolutional:
        r = np.random.default_rng(seed)
        return cls({k: r.normal(0, (2 / max(1, np.prod(s[:-1]))) ** 0.5, s) if len(s) > 1 else np.zeros(s) for k, s in cls.SHAPES.items()})

    @staticmethod
    def conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        patches = np.lib.stride_tricks.sliding_window_view(x, (3, 3), axis=(1, 2))  # n, h, w, channel, 3, 3
        return np.maximum(0, np.einsum("nhwcij,ijcf->nhwf", patches, w, optimize=True) + b)

    @staticmethod
    def pool(x: np.ndarray) -> np.ndarray:
        n, h, w, c = x.shape
        return x[:, : h // 2 * 2, : w // 2 * 2].reshape(n, h // 2, 2, w // 2, 2, c).max(axis=(2, 4))

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        x = self.pool(self.conv(x[..., None], w["c1"], w["b1"]))
        x = self.pool(self.conv(self.conv(x, w["c2"], w["b2"]), w["c3"], w["b3"])).reshape(len(x), -1)
        return softmax(np.maximum(0, x @ w["d1"] + w["e1"]) @ w["d2"] + w["e2"])


class Templates(Model):
    """The nearest of ten drawn digits: what needs no training."""

    def __init__(self, heights: tuple[int, ...] = (36, 44, 52, 60, 70), strokes: tuple[int, ...] = (6, 8, 10)) -> None:
        p = Reading()
        drawn = np.array([[K.normalised(K.glyph(d, h, s) * 255.0, p).ravel() for h in heights for s in strokes] for d in range(10)])
        self.t = drawn / np.linalg.norm(drawn, axis=2, keepdims=True)

    def scores(self, x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1)
        flat = flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-9)
        return softmax(80 * np.einsum("nk,dvk->ndv", flat, self.t).max(axis=2))


class Linear(Model):
    """Softmax regression; trained with Spark's own distributed solver."""

    def __init__(self, coefficients: np.ndarray, intercepts: np.ndarray) -> None:
        self.c, self.i = coefficients, intercepts

    def scores(self, x: np.ndarray) -> np.ndarray:
        return softmax(x.reshape(len(x), -1) @ self.c.T + self.i)

    @classmethod
    def train(cls, rows: DataFrame, steps: int = 60, penalty: float = 0.01) -> Linear:
        """From (tensor array<float>, label int) rows, wherever they lie."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        data = rows.select(array_to_vector("tensor").alias("features"), F.col("label").cast("double").alias("label"))
        fitted = LogisticRegression(maxIter=steps, regParam=penalty, family="multinomial", standardization=False).fit(data)
        full = np.zeros((10, SIZE * SIZE)), np.full(10, -30.0)
        full[0][: fitted.numClasses], full[1][: fitted.numClasses] = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        return cls(*full)


class Onnx(Model):
    """An onnxruntime session, opened in the worker."""

    def __init__(self, path: str) -> None:
        self.path, self._session = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_session": None}

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self._session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1  # parallelism comes from partitions
            self._session = onnxruntime.InferenceSession(self.path, options, providers=["CPUExecutionProvider"])
        return self._session.run(None, {self._session.get_inputs()[0].name: x[..., None]})[0]


KINDS = {".npz": Convolutional.load, ".onnx": Onnx}


def load(path: str) -> Model:
    """By the file's kind; other kinds have no library here."""
    kind = path[path.rfind(".") :]
    if kind not in KINDS:
        raise ValueError(f"no back-end for {kind}")
    return KINDS[kind](path)


def augmented(rows: DataFrame, epoch: int, seed: int = 42) -> DataFrame:
    """(tensor, label) rows, each moved by up to two pixels, turned by up to ten degrees and zoomed by up to a tenth; by (seed, epoch, idx)."""
    import pandas as pd

    from numerion.functions import sheet

    def run(parts):
        for part in parts:
            out = []
            for idx, t in zip(part["idx"], part["tensor"], strict=True):
                r = np.random.default_rng([seed, epoch, int(idx)])
                a, z, (dx, dy) = np.deg2rad(r.uniform(-10, 10)), r.uniform(0.9, 1.1), r.uniform(-2, 2, 2)
                mid = (SIZE - 1) / 2
                turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) / z
                shift = np.array([mid, mid]) - turn @ [mid + dx, mid + dy]
                m = np.vstack([np.column_stack([turn, shift]), [0, 0, 1]])
                img = (np.asarray(t).reshape(SIZE, SIZE) * 255).astype(np.uint8)
                padded = np.pad(img, 1)
                out.append((sheet.warped(padded, np.array([[1, 0, 1], [0, 1, 1], [0, 0, 1.0]]) @ m, SIZE, SIZE)[..., 0].ravel() / 255.0).astype(np.float32))
            yield pd.DataFrame({"idx": part["idx"], "label": part["label"], "tensor": out})

    return rows.select("idx", "label", "tensor").mapInPandas(run, "idx long, label int, tensor array<float>")


def rendered(spark, per_digit: int = 20, seed: int = 0) -> DataFrame:
    """idx, label, tensor: digits drawn in many sizes and strokes, normalised as crops are."""
    import pandas as pd

    p = Reading()

    def run(parts):
        for part in parts:
            rows = []
            for i in part["idx"]:
                r = np.random.default_rng([seed, int(i)])
                g = K.glyph(int(i) % 10, int(r.integers(24, 90)), int(r.integers(3, 9)))
                rows.append((i, int(i) % 10, K.normalised(g * 255.0, p).astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["idx", "label", "tensor"])

    return spark.range(10 * per_digit).withColumnRenamed("id", "idx").mapInPandas(run, "idx long, label int, tensor array<float>")
