import numpy as np
from pyspark.sql import functions as F

from trialspark.llm import quality_ranker as qr


def test_all_learnable_documents_are_learnt_from(spark, monkeypatch):
    """Only texts that a bounded sample left out (over 128 KB) tell good from bad."""
    docs = spark.range(80).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("zzz qq. "), 17_000)).otherwise(F.repeat(F.lit("abc de. "), 17_000)).alias("text")
    )
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = qr.fit(docs, labels)
    got = qr.score(docs, model, ["doc_id"]).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) == 1


def test_every_document_is_in_a_pair(spark, monkeypatch):
    monkeypatch.setattr(qr, "PAIRS", 1)
    rows = spark.range(500).select(F.col("id").alias("_id"), (F.col("id") < 430).cast("int").alias("y"), F.array(F.col("id").cast("float")).alias("x"))
    got = [(r.more[0], r.less[0]) for r in qr.pairs(rows, {0: 70, 1: 430}).collect()]
    assert len(got) == len(set(got)) == 430 * qr.ROUNDS
    assert {a for a, _ in got} == set(range(430)) and {b for _, b in got} == set(range(430, 500))


def known_rows(spark, total, good):
    x = F.array((F.xxhash64("id", F.lit(1)) % 1000 / 1000 + F.when(F.col("id") < good, 0.4).otherwise(0.0)).cast("float"), (F.xxhash64("id", F.lit(2)) % 1000 / 1000).cast("float"))
    return spark.range(total).select(F.col("id").alias("_id"), (F.col("id") < good).cast("int").alias("y"), x.alias("x"))


def test_no_pair_is_made_or_moved_for_the_fit(spark, monkeypatch):
    """Each document lies in one part, whatever the number of pairs; the weights are
    nevertheless those of all pairs."""
    monkeypatch.setattr(qr, "PAIRS", 6000)
    monkeypatch.setattr(qr, "PART", 100)
    rows, n = known_rows(spark, 700, 400), {0: 300, 1: 400}
    parts = qr._parts(rows, n).persist()
    assert parts.count() == 700 and parts.select("part").distinct().count() == 4
    scale = np.array([0.5, 0.25])
    w = qr.learn(parts, qr._rounds(n), scale, 1.0, 1e-3)
    d = np.array([np.subtract(r.more, r.less) for r in qr.pairs(rows, n).collect()]) / scale
    assert len(d) == 400 * 15
    assert np.abs((d * -(1 / (1 + np.exp(d @ w)))[:, None]).mean(0) + 1e-3 * w).max() < 1e-5


def test_a_rare_class_is_in_every_part(spark, monkeypatch):
    monkeypatch.setattr(qr, "PAIRS", 1)
    monkeypatch.setattr(qr, "PART", 50)
    rows, n = known_rows(spark, 1000, 5), {0: 995, 1: 5}
    sizes = qr._parts(rows, n).groupBy("part").agg(F.count_if("more").alias("m"), F.count_if(~F.col("more")).alias("l")).collect()
    assert sum(r.m for r in sizes) == 995 and min(r.l for r in sizes) >= qr.ROUNDS
    got = [(tuple(r.more), tuple(r.less)) for r in qr.pairs(rows, n).collect()]
    assert len({a for a, _ in got}) == len({tuple(r.x) for r in rows.where("y = 0").collect()}) and len({b for _, b in got}) == 5
