"""Commit rows made from ``documents``, alike in Spark and DuckDB: the tables hold no diffs of their own."""

from pyspark.sql import DataFrame, SparkSession

TYPES = "'feat','fix','docs','style','refactor','perf','test','build','ci','chore','revert','wip'"
FOLDERS = "'src/','docs/','tests/','.github/workflows/','lib/core-'"
EXTS = "'py','md','rs','ts','yml','c'"

SPARK = f"""
select doc_id as seq, source as repo, case when doc_id % 13 = 0 then '' else substr(md5(cast(doc_id % 400 as string)),1,12) end as sha,
 concat(element_at(array({TYPES}), cast(doc_id % 12 as int)+1),
   case when doc_id % 3 = 0 then concat('(',lang,')') else '' end, case when doc_id % 7 = 0 then '!' else '' end, ': update ', source) as message,
 path, concat('diff --git a/', path, ' b/', path, '\\n', 'index abc1234..def5678 100644\\n', '--- a/', path, '\\n', '+++ b/', path, '\\n', '@@ -1,3 +1,3 @@\\n',
   array_join(transform(split(text,'\\n'), (l,i) -> concat(case when i % 3 = 0 then '+' when i % 3 = 1 then '-' else ' ' end, l)), '\\n')) as diff_text
from (select *, concat(element_at(array({FOLDERS}), cast(k % 5 as int)+1), 'mod', cast(k % 20 as string), '/file_', cast(k % 50 as string), '.', element_at(array({EXTS}), cast(k % 6 as int)+1)) as path
      from (select *, cast(conv(substr(md5(text),1,6),16,10) as bigint) as k from {{documents}}))
"""

DUCKDB = f"""
select doc_id as seq, source as repo, case when doc_id % 13 = 0 then '' else substr(md5(cast(doc_id % 400 as varchar)),1,12) end as sha,
 concat(([{TYPES}])[doc_id % 12 + 1],
   case when doc_id % 3 = 0 then concat('(',lang,')') else '' end, case when doc_id % 7 = 0 then '!' else '' end, ': update ', source) as message,
 path, concat('diff --git a/', path, ' b/', path, chr(10), 'index abc1234..def5678 100644', chr(10), '--- a/', path, chr(10), '+++ b/', path, chr(10), '@@ -1,3 +1,3 @@', chr(10),
   array_to_string(list_transform(string_split(text,chr(10)), lambda l, i: concat(case when (i-1) % 3 = 0 then '+' when (i-1) % 3 = 1 then '-' else ' ' end, l)), chr(10))) as diff_text
from (select *, concat(([{FOLDERS}])[k % 5 + 1], 'mod', cast(k % 20 as varchar), '/file_', cast(k % 50 as varchar), '.', ([{EXTS}])[k % 6 + 1]) as path
      from (select *, ('0x' || substr(md5(text),1,6))::BIGINT as k from documents))
"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, repo, sha, message, path, diff_text of every document."""
    return spark.sql(SPARK, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
