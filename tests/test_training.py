"""Training against steps written out by hand, and going on after a stop."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from numerion.operators import training as T


@pytest.fixture(scope="module")
def examples(spark):
    r = np.random.default_rng(7)
    centres = r.normal(0, 1, (3, 5))
    y = r.integers(0, 3, 400)
    x = centres[y] + r.normal(0, 0.6, (400, 5))
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(400)], "idx long, tensor array<double>, label int").repartition(4)
    val = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:7], 16) % 1000 < 250 for i in range(400)])
    return df, x, y, val


def by_hand(x, y, val, epochs, rate):
    w, out = np.zeros((3, 6)), []
    b = np.column_stack([x, np.ones(len(x))])
    for e in range(epochs + 1):
        z = b @ w.T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss, right = -np.log(p[np.arange(len(y)), y]), p.argmax(1) == y
        out.append((e, loss[~val].mean(), right[~val].mean(), loss[val].mean(), right[val].mean(), w.copy()))
        w = w - rate * 0.5 ** max(0, e - 2) * ((p - np.eye(3)[y])[~val].T @ b[~val]) / (~val).sum()
    return out


def train(df, epochs, folder=None):
    return T.train(df, epochs, classes=3, width=5, rate=0.8, share=250, folder=folder).orderBy("epoch").collect()


def test_epochs_equal_steps_by_hand(examples):
    df, x, y, val = examples
    rows = train(df, 6)
    for row, (e, loss, right, val_loss, val_right, w) in zip(rows, by_hand(x, y, val, 6, 0.8), strict=True):
        assert (row["epoch"], row["examples"], row["val_examples"]) == (e, (~val).sum(), val.sum())
        assert row["rate"] == 0.8 * 0.5 ** max(0, e - 2)
        assert np.allclose([row["loss"], row["accuracy"], row["val_loss"], row["val_accuracy"]], [loss, right, val_loss, val_right], atol=1e-9)
        assert np.allclose(row["weights"], w.ravel(), atol=1e-9)
    losses = [r["loss"] for r in rows]
    assert losses == sorted(losses, reverse=True) and rows[-1]["val_accuracy"] > 0.5 > rows[0]["val_accuracy"]


def test_a_stopped_run_goes_on(examples, tmp_path):
    df, *_ = examples
    whole, folder = train(df, 4), f"file://{tmp_path}/run"
    train(df, 2, folder)
    again = train(df, 4, folder)
    close = lambda a, b: np.allclose(a["weights"], b["weights"], atol=1e-9) and abs(a["val_loss"] - b["val_loss"]) < 1e-9
    assert len(again) == 5 and all(close(a, b) for a, b in zip(whole, again, strict=True))
    assert [r["epoch"] for r in train(df, 4, folder)] == [0, 1, 2, 3, 4] and [r["epoch"] for r in train(df, 1, folder)] == [0, 1]


def test_no_examples(spark):
    rows = train(spark.createDataFrame([], "idx long, tensor array<double>, label int"), 1)
    assert [(r["examples"], r["loss"]) for r in rows] == [(0, 0.0), (0, 0.0)] and not any(rows[-1]["weights"])
