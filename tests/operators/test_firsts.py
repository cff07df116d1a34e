import random

from pyspark.sql import functions as F

from commitloom.operators import evaluation, quotas


def test_cap_equals_a_walk(spark):
    r = random.Random(6)
    rows = [(s, r.choice(["a", "a", "a", "b", None])) for s in r.sample(range(-50_000, 100_000), 3000)]
    df = spark.createDataFrame(rows, "seq long, label string").repartition(3)
    for cap in (1, 7, 400, 5000):
        seen, want = {}, []
        for s, y in sorted(rows):
            seen[y] = seen.get(y, 0) + 1
            if seen[y] <= cap:
                want.append(s)
        assert sorted(x.seq for x in quotas.cap_per_label(df, cap).collect()) == want
    assert quotas.cap_per_label(df.where("false"), 3).count() == 0


def test_split_has_each_labels_share(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") < 900, "x").otherwise("y").alias("label"))
    got = evaluation.stratified_split(df).where("is_test").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"x": 90, "y": 10}
    assert evaluation.stratified_split(df).count() == 1000
