import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import types as T

from commitloom.operators.features import Spec
from commitloom.operators.scoring import Fold, Model, score
from commitloom.plans import train as training_run
from commitloom.sources import external, git, payload, records

SCHEMA = T.StructType([T.StructField("sha", T.StringType()), T.StructField("n", T.LongType())])


def test_records_of_every_shape(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"sha": "a", "n": 1}\n\nbroken\n{"sha": "é", "x": 2}\n[1]\n')
    (tmp_path / "a.json").write_text('[{"sha": "b"}, 5, {"sha": "c", "n": 3}]')
    (tmp_path / "c.json").write_text('{"data": [{"sha": "d"}]}')
    (tmp_path / "d.json").write_text('[oops\n{"sha": "e"}\n')
    with pytest.warns(UserWarning):
        paths = records.expand_inputs(spark, [str(tmp_path), str(tmp_path / "missing")])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["b.jsonl", "a.json", "c.json", "d.json"]
    rows = records.read_records(spark, [str(tmp_path)], SCHEMA).orderBy("seq").collect()
    assert [(r.seq >> 40, r.seq & 0xFFFF, r.sha, r.n) for r in rows] == [(0, 1, "a", 1), (0, 4, "é", None), (1, 1, "b", None), (1, 3, "c", 3), (2, 1, "d", None), (3, 2, "e", None)]
    (tmp_path / "e.json").write_text('{"rows": 1}')
    with pytest.raises(ValueError):
        records.read_file(spark, str(tmp_path / "e.json"), SCHEMA, strict=True)


def test_line_numbers_over_blocks(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("".join(json.dumps({"sha": str(i)}) + "\n" for i in range(1, 3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = records.read_file(spark, str(path), SCHEMA).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2999 and all(r.line == int(r.sha) for r in rows)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "fix", None), (1, "feat", "é")], "seq long, label string, x string")
    records.write_jsonl(df.coalesce(1), f"{tmp_path}/out", order="seq")
    records.write_jsonl(df.coalesce(1), f"{tmp_path}/out", append=True)
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert len(lines) == 4 and '{"label":"feat","x":"é"}' in lines and '{"label":"fix","x":null}' in lines
    records.write_labels(df, f"{tmp_path}/labels")
    assert (tmp_path / "labels").read_text() == "feat\nfix"


def test_git_history(spark, tmp_path):
    repo = tmp_path / "proj"
    repo.mkdir()

    def run(*args):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], cwd=repo, check=True, capture_output=True)

    run("init", "-q")
    for i, subject in enumerate(["feat: one", "no header", "fix(x)!: two"]):
        (repo / "f.py").write_text("line\n" * (i + 1))
        run("add", "-A")
        run("commit", "-q", "-m", subject)
    rows = {r.label: r for r in git.mine(spark, [str(repo)]).collect()}
    assert set(rows) == {"feat", "fix"} and rows["fix"].top_exts == ".py" and (rows["fix"].additions, rows["fix"].files_changed) == (1, 1)
    assert rows["feat"].url == f"local://proj/{rows['feat'].sha}" and "+line" in rows["feat"].diff_text and rows["feat"].labeled_at.endswith("Z")
    assert [r.label for r in git.mine(spark, [str(repo)], limit=1).collect()] == ["fix"]
    assert git.read_log(spark, [str(tmp_path / "none")]).count() == 0


def test_payload_and_ties(spark, tmp_path):
    spec = Spec(["aa", "bb"], [1.0, 2.0], ["src"], ["py"], [0.0] * 4, [1.0] * 4)
    fold = Fold(np.zeros((3, spec.width)), np.zeros(3), -np.ones(3), np.array([0.0, 0.0, 800.0]))
    made = payload.export_payload(spec, Model(["a", "b", "c"], [fold, Fold(np.zeros((3, spec.width)), np.zeros(3), np.zeros(3), np.full(3, 900.0))]))
    payload.write_payload(spark, made, f"{tmp_path}/model")
    again, model = payload.import_payload(payload.read_payload(spark, f"{tmp_path}/model"))
    assert again == spec and model.classes == ["a", "b", "c"]
    probs = score(spark.createDataFrame([(1, [0], [1.0])], "seq long, indices array<int>, values array<double>"), model).first().probs
    assert probs == pytest.approx([0.25, 0.25, 0.0])
    for broken in ({**made, "schema_version": 2}, {**made, "tfidf": {**made["tfidf"], "token_pattern": "("}}):
        with pytest.raises(ValueError):
            payload.import_payload(broken)


def test_two_repositories_and_forks(spark, tmp_path):
    first = tmp_path / "one"
    first.mkdir()

    def run(*args, cwd=first):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *args], cwd=cwd, check=True, capture_output=True)

    run("init", "-q")
    (first / "a b.py").write_text("x\n")
    run("add", "-A")
    run("commit", "-q", "-m", "docs: one")
    run("clone", "-q", str(first), str(tmp_path / "two"), cwd=tmp_path)
    rows = git.mine(spark, [str(first), str(tmp_path / "two") + "/"]).collect()
    assert sorted(r.repo for r in rows) == ["one", "two"] and len({r.sha for r in rows}) == 1 and all((r.files_changed, r.additions) == (1, 1) for r in rows)


def test_external_collections(spark, tmp_path):
    rows = [{"message": "feat: a\nbody", "repo": "o/r", "hash": "1", "date": "2024", "mods": [{"old_path": "a.py", "new_path": "a.py", "diff": "+x\n-y\n+++ z"}]}, {"message": "no header", "mods": [{"new_path": "b"}]}, {"message": "fix: b", "mods": []}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    kept = external.import_external(spark, [str(tmp_path / "x.jsonl")], "commitchronicle", f"{tmp_path}/out").collect()
    assert [(r.sha, r.label, r.additions, r.deletions, r.top_exts) for r in kept] == [("1", "feat", 1, 1, ".py")]
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    other = spark.createDataFrame([("fix: c", "+a", "o/p", "9"), ("fix: d", " \n", "o/p", "8"), ("fix: e", "-a", "o/p", "7")], "commit_message string, patch string, project string, hash string")
    other.coalesce(1).write.parquet(f"{tmp_path}/y.parquet")
    some = external.import_external(spark, [f"{tmp_path}/y.parquet"], "commitbench", per_label=1).collect()
    assert [(r.sha, r.label) for r in some] == [("9", "fix")]
    with pytest.raises(ValueError):
        external.read_external(spark, [], "other")


def test_training_run(spark, tmp_path):
    rows = [(i, ["feat", "fix", "docs"][i % 3], f"+++ b/{['src/a.py', 'lib/b.rs', 'docs/c.md'][i % 3]}\n+{['make new thing', 'repair broken thing', 'describe thing'][i % 3]}", "1", i % 5, 0) for i in range(90)]
    df = spark.createDataFrame([*rows, (900, None, "+x", "1", 0, 0)], "seq long, label string, diff_text string, files_changed string, additions long, deletions long")
    made = training_run.train(df, f"{tmp_path}/out", share=0.2)
    report = {r.label: r for r in made.report.collect()}
    assert report["accuracy"].precision == 1.0 and report["feat"].support == 6
    assert made.confusion.where("y = 'fix'").first().asDict() == {"y": "fix", "docs": 0, "feat": 0, "fix": 6}
    check = made.check.first()
    assert check.n == 18 and check.ok and check.max_abs_diff <= 1e-9
    assert (tmp_path / "out" / "labels.txt").read_text() == "docs\nfeat\nfix"
