import numpy as np
from pyspark.sql import functions as F

from strataflow.operators import evaluation as ev
from strataflow.operators import typosquat


def test_intervals(spark):
    row = spark.createDataFrame([(354, 362)], "k int, n int").select(ev.wilson(F.col("k"), F.col("n")).alias("w")).first()["w"]
    assert (row["low"], row["high"]) == (0.957, 0.9888)
    assert round(ev.exact_lower(231, 231), 4) == 0.9871
    assert ev.mcnemar_p(8, 0) == 0.00781 and ev.mcnemar_p(0, 0) is None
    low, high = ev.clopper_pearson_bounds(0, 10)
    assert low == 0 and abs(high - 0.3085) < 1e-3


def test_sweep_and_bootstrap(spark):
    df = spark.createDataFrame([(i % 7, i / 100, int(i > 50)) for i in range(100)], "c int, score double, truth int")
    s = ev.threshold_sweep(df, "score", F.col("truth") == 1)
    best = ev.operating_point(s).first()
    assert best["threshold"] == 0.5 and best["tp"] == 49 and best["fp"] == 1
    ci = ev.cluster_bootstrap(df.withColumn("one", F.lit(1)), "c", "truth", "one", 400).first()
    assert ci["low"] < 0.49 < ci["high"]
    renamed = df.select(F.col("c").alias("t"), F.col("truth").alias("c"), F.lit(1).alias("w"))
    assert ev.cluster_bootstrap(renamed, "t", "c", "w", 400).first() == ci
    low, high = ev.seeded_bootstrap(np.r_[np.zeros(50), np.ones(50)])
    assert low < 0.5 < high
    assert ev.threshold_sweep(df.limit(0), "score", F.col("truth") == 1).count() == 0


def test_typosquat_techniques(spark):
    popular = spark.createDataFrame([(n, i) for i, n in enumerate(["requests", "python-dateutil", "beautifulsoup4", "django", "cryptography", "urllib3"])], "name string, rank long")
    names = [("reqeusts", "typo1"), ("python_date_util", "separator"), ("dateutil-python", "reorder"), ("d1ang0", None), ("requests-utils", "combosquat"), ("cryptografyy", "typo2"), ("django-foo", "brandjack"), ("urllib", "suffix"), ("requests", None), ("requesl5", "typo2"), ("requests2", "suffix")]
    df = spark.createDataFrame([(n,) for n, _ in names], "name string")
    rows = typosquat.candidates(df, typosquat.reference_index(popular)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.name, set()).add(r.technique)
    for n, t in names:
        if t and n != "requesl5" and n != "urllib":
            assert t in got.get(n, set()), (n, got.get(n))
    assert "requests" not in got
    best = {r.name: r for r in typosquat.best_matches(df, popular).collect()}
    assert best["reqeusts"].target == "requests" and best["reqeusts"].score == 0.85
    assert {r.name for r in typosquat.levenshtein_baseline(df, popular).collect()} >= {"urllib", "requests2"}
    assert ("reqeusts", "requests", "swapped") in {tuple(r) for r in typosquat.variant_baseline(df, popular).collect()}
