"""The threshold of the quality rules rests on every labelled document."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality


def by_hand(rows):
    good, bad = sum(q for _, q in rows), sum(1 - q for _, q in rows)
    scores = sorted({s for s, _ in rows})
    value = {s: sum(1 - q for x, q in rows if x < s) / bad - quality.COST * sum(q for x, q in rows if x < s) / good for s in scores}
    best = max(value.values())
    at = min(s for s in scores if value[s] >= best - 1e-3)
    return (at + max(s for s in scores if s < at)) / 2


def test_no_labelled_document_is_left_out_of_the_threshold(spark):
    rng = np.random.default_rng(2)
    # more than the 4000 a class that were read before: each class by itself, and both interleaved
    rows = [(i, float(round(x, 3)), int(q)) for i, (x, q) in enumerate([*((v, 1) for v in rng.normal(1, 0.5, 5000)), *((v, 0) for v in rng.normal(-1, 0.5, 5500))])]
    judged = spark.createDataFrame([(i, False, s) for i, s, _ in rows] + [(-1, True, -9.0), (None, False, -8.0), (-2, False, -7.0)], "doc_id long, base_failed boolean, llr double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(-1, 1), (None, 1)], "doc_id long, quality int")
    assert quality.threshold(judged, labels) == by_hand([(s, q) for _, s, q in rows])


def test_labels_met_by_a_shuffle_weigh_as_by_a_broadcast(spark, monkeypatch):
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{j}_"), (F.col("id") * (j + 1) % 7).cast("string")) for j in range(25)]).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 7 < 4, 1).otherwise(0).alias("quality"))
    few = quality.quality_rules(docs, labels, 1 << 8).drop("text").collect()
    monkeypatch.setattr(quality, "FEW", 0)
    many = quality.quality_rules(docs, labels, 1 << 8, whole=False)
    assert "text" not in many.columns and sorted(map(tuple, few)) == sorted(map(tuple, many.collect()))
    assert 0 < sum(r.kept for r in few) < 80
