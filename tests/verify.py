"""python tests/verify.py NAME...: each query at sf0.01 beside its SQL, as sorted rows."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def main(names):
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    base = duckdb.connect()
    base.execute("SET TimeZone='UTC'")
    for t in TABLES:
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        df = queries[name](spark, DATA)
        got = rows(df.columns, [tuple(r.asDict(True).values()) for r in df.collect()])
        took = time.time() - began
        if name in sql:
            res = base.execute(sql[name])
            want = rows([c[0] for c in res.description], res.fetchall())
            same = got == want
            print(name, len(got[1]), len(want[1]), "SAME" if same else "DIFFERENT", f"{took:.1f}s", flush=True)
            if not same:
                print(got[0], want[0])
                for a, b in [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]:
                    print("  spark ", str(a)[:600], "\n  duckdb", str(b)[:600])
        else:
            print(name, len(got[1]), "rows only", f"{took:.1f}s", flush=True)


main(sys.argv[1:])
