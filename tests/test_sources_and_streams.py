from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.sources import files as S
from auditframe.sources import manifests as M
from auditframe.streaming import jobs as J
from tests.conftest import rows


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_case_packages_read_one_object_per_file(spark, folder):
    for i in (1, 2):
        os.makedirs(f"{folder}/batch{i}")
        with open(f"{folder}/batch{i}/case.json", "w") as f:  # equal names in two folders
            json.dump({"case_id": i, "documents": [{"id": f"d{i}{j}", "status": "CURRENT"} for j in range(2)]}, f, indent=2)
    cases = S.case_packages(spark, folder, "case_id INT, documents ARRAY<STRUCT<id: STRING, status: STRING>>")
    assert [(i, f.removeprefix("file:")) for i, f in rows(cases, "case_id", "file")] == [(i, f"{folder}/batch{i}/case.json") for i in (1, 2)]
    assert rows(S.documents_of(cases), "case_id", "pos", "id") == [(1, 0, "d10"), (1, 1, "d11"), (2, 0, "d20"), (2, 1, "d21")]


def test_closed_schema(make):
    d = make("i INT, t STRING", (1, '{"a":1,"b":2}'), (2, '{"a":1}'), (3, '{"a":1,"b":2,"z":3}'), (4, "[]"))
    assert rows(S.closed_schema_problems(d, "i", "t", ["b", "a"])) == [(2, ["b"], []), (3, [], ["z"]), (4, ["a", "b"], [])]


def test_strict_lines_report_line_numbers_across_splits(spark, folder):
    bad = {5: ("", "blank"), 17: ("[1]", "not_an_object"), 400: ('{"b": 1, "a": "x"}', "not_canonical"), 401: ("{", "not_an_object"), 950: ('{"a":"x","b":1,"c":2}', "not_canonical")}
    with open(f"{folder}/x.jsonl", "w") as f:
        for n in range(1, 1001):
            f.write((bad[n][0] if n in bad else json.dumps({"a": f"x{n}", "b": n}, separators=(",", ":"))) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        good, errors = S.strict_json_lines(spark, folder, T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())]))
        assert rows(errors, "line", "error") == sorted(((n, e) for n, (_, e) in bad.items()), key=repr)
        assert [r.line for r in good.orderBy("line").collect()] == [n for n in range(1, 1001) if n not in bad]
        assert good.where(F.col("line") != F.col("b")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_run_directories_tolerate_missing_files(spark, folder, make):
    import os

    for run, names in {"r1": ("metrics", "scores"), "r2": ("metrics",)}.items():
        os.makedirs(f"{folder}/{run}")
        for name in names:
            with open(f"{folder}/{run}/{name}.json", "w") as f:
                json.dump({"episodes" if name == "metrics" else "loss": 7}, f, indent=1)
    got = S.run_directories(spark, folder, make("run_id STRING", ("r1",), ("r2",), ("r3",)), {"metrics": ("*/metrics.json", "episodes INT"), "scores": ("*/scores.json", "loss INT")})
    assert rows(got, "run_id", "episodes", "loss", "status") == [("r1", 7, 7, "RUN"), ("r2", 7, None, "RUN"), ("r3", None, None, "NOT_RUN")]


def test_raw_files_checksums_and_manifest(spark, folder, make):
    import hashlib

    os.makedirs(f"{folder}/sub")
    for name, text in (("a.txt", b"one"), ("sub/b.txt", b"two")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(text)
    actual = S.raw_files(spark, folder)
    sha = {t: hashlib.sha256(t).hexdigest() for t in (b"one", b"two")}
    assert rows(actual) == [("a.txt", 3, sha[b"one"]), ("sub/b.txt", 3, sha[b"two"])]
    manifest = make("path STRING, bytes BIGINT, sha256 STRING", ("a.txt", 4, sha[b"one"]), ("gone", 1, "x"), ("a.txt", 4, sha[b"one"]))
    assert rows(M.manifest_problems(manifest, actual)) == [("a.txt", "duplicate"), ("a.txt", "size differs"), ("gone", "missing"), ("sub/b.txt", "unlisted")]


def test_outputs_are_not_overwritten(spark, folder, make):
    d = make("b INT, a STRING", (1, None))
    S.write_json_lines(d, f"{folder}/out")
    assert rows(spark.read.text(f"{folder}/out")) == [('{"a":null,"b":1}',)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_json_lines(d, f"{folder}/out")


def test_progress_arrives_in_several_batches(spark, folder, make):
    ddl = "model STRING, complete BOOLEAN, output_tokens INT"
    first, second = make(ddl, ("a", True, 1), ("b", False, 2)), make(ddl, ("a", False, 4))
    schema = first.schema
    first.write.parquet(f"{folder}/in/1")
    for part, want in ((None, [("a", 1, 1, 1), ("b", 1, 0, 2)]), (second, [("a", 2, 1, 5), ("b", 1, 0, 2)])):
        if part is not None:
            part.write.parquet(f"{folder}/in/2")
        stream = J.read_stream(spark, f"{folder}/in/*", schema)
        out = J.run_available(J.progress(stream), "complete", f"{folder}/out")
        assert rows(out) == want


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_version_checks_keep_state_between_batches(spark, folder, make, kind):
    ddl = f"case_id {kind}, object_id STRING, pos BIGINT, asserted_version BIGINT"
    one = 1 if kind == "BIGINT" else "one"
    batches = [[(one, "o", 2, 0), (one, "o", 1, 0), (one, "p", 3, 0)], [(one, "o", 5, 9), (one, "o", 4, 1), (one, "o", 6, None)]]
    want = {1: (True, 1), 2: (False, 1), 3: (True, 1), 4: (True, 2), 5: (False, 2), 6: (False, 2)}
    for n, batch in enumerate(batches):
        make(ddl, *batch).write.parquet(f"{folder}/in/{n}")
        stream = J.read_stream(spark, f"{folder}/in/*", make(ddl, *batch).schema)
        out = J.version_checks(stream, f"{folder}/out")
    assert {r.pos: (r.accepted, r.version) for r in out.collect()} == want


def test_versions_of_a_long_object_in_any_order_of_arrival(spark, folder, make):
    import random

    rows_, want, version = [], {}, 0
    for pos in range(3000):
        asserted = version if pos % 3 else None if pos % 2 else version + 1
        version += asserted == version
        rows_.append(("c", "o", pos, asserted))
        want[pos] = (bool(pos % 3), version)
    random.Random(1).shuffle(rows_)
    df = make("case_id STRING, object_id STRING, pos BIGINT, asserted_version BIGINT", *rows_)
    df.repartition(6).write.parquet(f"{folder}/in/0")
    out = J.version_checks(J.read_stream(spark, f"{folder}/in/*", df.schema), f"{folder}/out")
    assert {r.pos: (r.accepted, r.version) for r in out.collect()} == want


def test_a_folder_without_files_gives_an_empty_frame(spark, folder, make):
    os.makedirs(f"{folder}/in")
    schema = make("model STRING, complete BOOLEAN, output_tokens INT", ("a", True, 1)).schema
    stream = J.read_stream(spark, f"{folder}/in", schema)
    assert rows(J.run_available(J.progress(stream), "complete", f"{folder}/out")) == []
    requests = make("case_id STRING, object_id STRING, pos BIGINT, asserted_version BIGINT", ("a", "b", 1, 0)).schema
    assert rows(J.version_checks(J.read_stream(spark, f"{folder}/in", requests), f"{folder}/versions")) == []


def test_request_sessions_of_files_out_of_order(spark, folder, make):
    """Runs across batches and out of order equal the batch answer; a run is given out once, when time has passed it; what comes later is left out."""
    import datetime as dt

    ddl = "case_id STRING, request_id STRING, pos BIGINT, payload STRING, at TIMESTAMP"
    day = dt.datetime(2024, 1, 1)
    at = lambda hours: day + dt.timedelta(hours=hours)
    files = [
        [("c", "q", 2, "b", at(3)), ("c", "r", 3, "x", at(3)), ("c", "s", 4, None, at(2))],
        [("c", "q", 1, "a", at(1)), ("c", "r", 9, "x", at(5)), ("c", "s", 5, "y", at(4))],  # earlier than the first file, within the delay
        [("c", "q", 7, "a", at(40))],  # time passes the runs before
        [("c", "q", 8, "z", at(2)), ("d", "q", 1, "a", at(90))],  # too late; and time passes the rest
        [("d", "q", 1, "a", at(200))],
    ]
    schema, found = make(ddl, *files[0]).schema, []
    for n, part in enumerate(files):
        make(ddl, *part).write.parquet(f"{folder}/in/{n}")
        out = J.run_available(J.request_sessions(J.read_stream(spark, f"{folder}/in/*", schema), "4 hours"), "append", f"{folder}/out")
        found.append(rows(out, "case_id", "request_id", "first_at", "payload", "uses", "conflict"))
    done = [("c", "q", at(1), "a", 2, True), ("c", "r", at(3), "x", 2, False), ("c", "s", at(2), None, 2, True)]
    assert found[0] == found[1] == [] and found[2] == done
    assert found[4] == sorted([*done, ("c", "q", at(40), "a", 1, False), ("d", "q", at(90), "a", 1, False)], key=repr)
