"""Training on tiles, with its SQL: the same steps as sums over all examples and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from numerion.operators import training as T
from numerion.plans.pixels import N, PX, tiles

EPOCHS, RATE, SHARE = 5, 0.25, 200


def training_report(spark, sf_dir):
    """Rate, loss and accuracy of each epoch, on the examples learnt from and on those held out."""
    examples = tiles(spark, sf_dir).select(F.col("vec_id").alias("idx"), F.transform("t", lambda v: (v - 128) / F.lit(64.0)).alias("tensor"), "label")
    history = T.train(examples, EPOCHS, width=N * N, rate=RATE, share=SHARE)
    return history.select(F.col("epoch").cast("long").alias("epoch"), "rate", *(F.round(c, 6).alias(c) for c in T.METRICS), "examples", "val_examples")


def _sql() -> str:
    text = f"""
WITH {PX},
ex AS MATERIALIZED (SELECT vec_id, i, CAST(v - 128 AS DOUBLE) / 64.0::DOUBLE AS x FROM px UNION ALL SELECT vec_id, {N * N}, 1.0::DOUBLE FROM tiles),
lab AS MATERIALIZED (SELECT vec_id, label, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 7) AS BIGINT) % 1000 < {SHARE} AS val FROM tiles),
w0 AS MATERIALIZED (SELECT k, i, 0.0::DOUBLE AS w FROM (SELECT unnest(range(10)) AS k) a, (SELECT unnest(range({N * N + 1})) AS i) b)"""
    rows = []
    for e in range(EPOCHS + 1):
        rate = T.rate_of(e, RATE)
        text += f""",
z{e} AS MATERIALIZED (SELECT vec_id, k, sum(x * w) AS z FROM ex JOIN w{e} USING (i) GROUP BY vec_id, k),
p{e} AS MATERIALIZED (SELECT vec_id, k, exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z)) OVER (PARTITION BY vec_id) * exp(max(z) OVER (PARTITION BY vec_id)) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS place FROM z{e}),
m{e} AS (SELECT val, avg(-ln(p)) AS loss, avg(CASE WHEN place = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS n FROM p{e} JOIN lab USING (vec_id) WHERE k = label GROUP BY val)"""
        if e < EPOCHS:
            text += f""",
w{e + 1} AS MATERIALIZED (SELECT w.k, w.i, w.w - {rate}::DOUBLE * g.g AS w FROM w{e} w JOIN (SELECT p.k, x.i, sum((p.p - CASE WHEN l.label = p.k THEN 1 ELSE 0 END) * x.x) / count(*) AS g FROM p{e} p JOIN lab l USING (vec_id) JOIN ex x USING (vec_id) WHERE NOT l.val GROUP BY p.k, x.i) g USING (k, i))"""
        rows.append(
            f"SELECT CAST({e} AS BIGINT) AS epoch, {rate}::DOUBLE AS rate, round(max(loss) FILTER (WHERE NOT val), 6) AS loss, round(max(accuracy) FILTER (WHERE NOT val), 6) AS accuracy, "
            f"round(max(loss) FILTER (WHERE val), 6) AS val_loss, round(max(accuracy) FILTER (WHERE val), 6) AS val_accuracy, max(n) FILTER (WHERE NOT val) AS examples, max(n) FILTER (WHERE val) AS val_examples FROM m{e}"
        )
    return text + "\n" + "\nUNION ALL ".join(rows)


QUERIES = {"training_report": (training_report, _sql())}
