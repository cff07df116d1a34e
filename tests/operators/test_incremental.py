import pytest
from pyspark.sql import functions as F

from commitloom import scratch
from commitloom.operators import dedup, incremental
from commitloom.plans.commit_view import commits

DATA = "/root/testdata/sf0.001"


def rows_of(spark):
    """The delivered commits with shas that repeat."""
    return commits(spark, DATA).withColumns({"repo": F.lit("r"), "sha": F.when(F.col("sha") != "", (F.col("seq") % 150).cast("string")).otherwise("")})


def marks(df):
    return {r.seq: (r.norm_md5, r.drop_reason) for r in df.collect()}


def test_batches_give_what_all_rows_at_once_give(spark, tmp_path):
    rows = rows_of(spark)
    want = marks(dedup.with_drop_reason(rows))
    got, path = {}, f"file://{tmp_path}/index"
    for i, (low, high) in enumerate([(0, 40), (40, 120), (120, 10**9), (10**9, 10**10)]):
        index = incremental.SeenKeys(spark, path, parts=4)  # read anew, as another session would
        got |= marks(incremental.deduplicate_batch(rows.where((F.col("seq") >= low) & (F.col("seq") < high)), index, f"b{i}"))
    assert got == want and {m[1] for m in want.values()} == {"sha", "diff", None}
    last = incremental.SeenKeys(spark, path)
    assert last.parts == 4 and sum(r["n"] for r in last.runs) == len({(r.kind, r.key) for run in last.runs for r in last._table(run).collect()})
    assert len(last.runs) < 4  # runs of like size were merged


def test_the_last_batch_may_be_run_again_and_older_ones_may_not(spark, tmp_path):
    rows, path = rows_of(spark), f"file://{tmp_path}/index"
    parts = [rows.where("seq < 60"), rows.where("seq >= 60")]
    first = [marks(incremental.deduplicate_batch(p, incremental.SeenKeys(spark, path, 2), str(i))) for i, p in enumerate(parts)]
    assert marks(incremental.deduplicate_batch(parts[1], incremental.SeenKeys(spark, path), "1")) == first[1]
    with pytest.raises(ValueError):
        incremental.deduplicate_batch(parts[0], incremental.SeenKeys(spark, path), "0")
    stale = incremental.SeenKeys(spark, path)
    incremental.SeenKeys(spark, path).add(spark.createDataFrame([("sha", "x")], "kind string, key string"), "2")
    with pytest.raises(RuntimeError):
        stale.add(spark.createDataFrame([("sha", "y")], "kind string, key string"), "3")


def test_tables_are_found_by_another_session_and_read_without_a_shuffle(spark, tmp_path):
    index = incremental.SeenKeys(spark, f"file://{tmp_path}/index", 4)
    held = spark.range(500).select(F.lit("sha").alias("kind"), F.col("id").cast("string").alias("key"))
    index.add(held, "0")
    spark.sql(f"DROP TABLE {index.runs[0]['name']}")  # an external table: its files stay
    again = incremental.SeenKeys(spark, f"file://{tmp_path}/index")
    asked, _ = scratch.keep(spark.range(400, 900).select(F.lit("sha").alias("kind"), F.col("id").cast("string").alias("key")))
    assert sorted(int(r.key) for r in again.seen(asked).collect()) == list(range(400, 500))
    # filters let few others through
    assert 100 <= incremental.maybe_held(asked, again._filters(again.runs[0]), 4).count() < 110
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = asked.join(again._table(again.runs[0]), ["kind", "key"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
