import json

import pytest
from pyspark.sql import types as T

from commitloom.sources import json_arrays, records

RECORDS = [{"i": i, "s": 'a "q\\" } { ] [ , é\n' * (i % 4), "n": {"x": [1, {"y": "}"}]}, "data": [1, 2]} for i in range(60)]
DOCUMENTS = {
    "array.json": json.dumps(RECORDS),
    "object.json": json.dumps({"meta": {"data": 1, "b": [1, 2]}, "data": RECORDS, "z": [{"data": [3]}]}, indent=1),
    "empty.json": "[]",
    "empty object.json": '{"data": [ ]}\n',
    "open.json": '[{"i":1},{"i":2}',
    "comma.json": '[{"i":1},]',
    "bad element.json": '[{"i":1},\n{"i":}]',
    "lines.json": '{"i":1}\n{"i":2}\n',
    "two.json": '{"data":[{"i":1}]}\n{"data":[{"i":2}]}',
    "mixed.json": '﻿ [1, "x", null, {"i":1}]\n\n',
    "tail.json": '[{"i":1}] x',
    "no data.json": '{"nodata":[1]}',
    "brace.json": '[{"i":1}]}',
    "one.json": '{"data":[{"i":1}]}',
    "deep.json": json.dumps([{"k": [{"v": i} for i in range(200)]}, {"i": 2}]),
    "blank.json": " \n",
}


@pytest.fixture
def small(spark, monkeypatch):
    """Splits and chunks of a few records."""
    monkeypatch.setattr(json_arrays, "CHUNK", 120)
    for k, v in (("spark.sql.files.maxPartitionBytes", "300"), ("spark.sql.files.openCostInBytes", "1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def expected(text):
    """Elements of a document, or None."""
    try:
        x = json.loads(text.removeprefix("﻿"))
    except ValueError:
        return None
    x = x.get("data") if isinstance(x, dict) else x
    return x if isinstance(x, list) else None


def test_elements_equal_those_of_a_parser(spark, tmp_path, small):
    for name, text in DOCUMENTS.items():
        (tmp_path / name).write_text(text, "utf-8")
    of = lambda c: [str(tmp_path / k) for k, v in DOCUMENTS.items() if v.lstrip("﻿ ")[:1] == c]
    assert json_arrays._chunks(spark, of("[")).where("path LIKE '%array.json'").select("block").distinct().count() > 5
    found, whole = json_arrays.elements(spark, of("["), of("{"))
    whole = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.whole for r in whole.collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r.path.rsplit("/", 1)[1].replace("%20", " "), {})[r.line] = r.value
    for name in whole:
        want = expected(DOCUMENTS[name])
        assert whole[name] == (want is not None), name
        if want is not None:
            mine = got.get(name, {})
            assert [json.loads(mine[i + 1]) for i in range(len(mine))] == want, name
    assert len(whole) == len(DOCUMENTS) - 1


def test_records_of_all_files_come_in_order(spark, tmp_path, small):
    for name, text in DOCUMENTS.items():
        (tmp_path / name).write_text(text, "utf-8")
    schema = T.StructType([T.StructField("i", T.LongType())])
    got = [(r.seq >> 40, r.seq & (2**40 - 1), r.i) for r in records.read_records(spark, [str(tmp_path), str(tmp_path / "one.json")], schema).orderBy("seq").collect()]
    want = []
    for at, name in enumerate([*sorted(DOCUMENTS), "one.json"]):
        elements = expected(DOCUMENTS[name])
        if elements is not None:
            want += [(at, line, x.get("i")) for line, x in enumerate(elements, 1) if isinstance(x, dict)]
        else:
            for line, text in enumerate(DOCUMENTS[name].split("\n"), 1):
                try:
                    x = json.loads(text)
                except ValueError:
                    continue
                if isinstance(x, dict):
                    want.append((at, line, x.get("i")))
    assert got == want and len(got) > 120
