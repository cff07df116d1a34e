"""De-duplication and quotas over streams of commit records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitloom.functions import text as T


def deduplicate_stream(commits: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First-arrived rows of each (repo, sha), blank shas exempt, and then of each normalized diff.

    With ``event_time`` keys are forgotten after ``delay``, which bounds the state; without it every key is
    kept. The blank shas get their own key from the diff, so that one chain of two states serves all rows.
    """
    sha = T.strip(F.coalesce("sha", F.lit("")))
    rows = commits.withColumn("_md5", F.md5(T.normalize_diff(F.coalesce("diff_text", F.lit("")))))
    rows = rows.withColumn("_key", F.when(sha == "", F.concat(F.lit("|"), "_md5")).otherwise(F.concat(T.strip(F.coalesce("repo", F.lit(""))), F.lit("/"), sha)))
    drop = "dropDuplicates"
    if event_time:
        rows, drop = rows.withWatermark(event_time, delay), "dropDuplicatesWithinWatermark"
    rows = getattr(rows, drop)(["_key"]).where(T.normalize_diff(F.coalesce("diff_text", F.lit(""))) != "")
    return getattr(rows, drop)(["_md5"]).drop("_md5", "_key")


#: Rows that a task holds before it lets them go on.
HELD = 10_000


def _at_most(commits: DataFrame, cap: int, label: str) -> DataFrame:
    """Of the rows of each task the ``cap`` of each label with the smallest seqs, or somewhat more: others can't be among the first ones."""

    def first(rows: pa.Table) -> pa.Table:
        order = pa.table({"label": rows.column(label).combine_chunks(), "seq": rows.column("seq").combine_chunks(), "at": pa.array(range(len(rows)))}).sort_by([("label", "ascending"), ("seq", "ascending")])
        taken, now, n = [], object(), 0
        for x, at in zip(order.column("label").to_pylist(), order.column("at").to_pylist(), strict=True):
            now, n = (now, n + 1) if x == now else (x, 1)
            if n <= cap:
                taken.append(at)
        return rows.take(pa.array(taken, pa.int64()))

    def run(batches):
        held = None
        for batch in batches:
            own = first(pa.Table.from_batches([batch]))
            held = own if held is None else first(pa.concat_tables([held, own]))
            if len(held) > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return commits.mapInArrow(run, commits.schema)


def quota_stream(commits: DataFrame, cap: int, label: str = "label") -> DataFrame:
    """The first ``cap`` rows of each label to arrive; the state is one count for each label.

    Tasks let only as many rows of a label through as could stay, so a label's task doesn't grow with its rows.
    """
    schema = commits.schema

    def keep(key, batches: Iterator[pd.DataFrame], state):
        (n,) = state.get if state.exists else (0,)
        for pdf in batches:
            some = pdf.sort_values("seq").head(max(0, cap - n))
            n += len(some)
            yield some[schema.fieldNames()]
        state.update((n,))

    return _at_most(commits, cap, label).groupBy(label).applyInPandasWithState(keep, schema, "n long", "append", "NoTimeout")


def label_counts_stream(commits: DataFrame, label: str = "label") -> DataFrame:
    return commits.where(F.coalesce(F.col(label), F.lit("")) != "").groupBy(label).agg(F.count("*").alias("n"))
