"""Forms of operators that grow with their input: equal to the plain ones, and without the steps that did not scale."""
from __future__ import annotations

import os
import tempfile
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from auditframe.functions import digest_tree as D
from auditframe.functions.canon import packed, unpacked
from auditframe.operators import allocation as Al
from auditframe.operators import audit as A
from auditframe.operators import leak as L
from auditframe.operators import stats as St
from auditframe.operators.sensitivity import judged, sensitivity
from auditframe.plans import experiment, replay
from auditframe.session import in_buckets
from auditframe.sources import files as S
from tests.conftest import rows
from tests.test_contract import random_episodes, tables

HEX = "0a" * 32


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_texts_come_back_and_stay_apart(make):
    texts = [None, "", HEX, "x" + HEX, HEX.upper(), "0a", "0A", "a", "é", "\x01", "0a\n"]
    got = make("t STRING", *[(t,) for t in texts]).select("t", packed(F.col("t")).alias("k")).select("t", "k", unpacked(F.col("k")).alias("back")).collect()
    assert [r.back for r in got] == [r.t for r in got]
    assert len({bytes(r.k) for r in got if r.k is not None}) == len(texts) - 1
    assert {r.t: len(r.k) for r in got if r.t}[HEX] == 33


PLAN = "arm_id STRING, evaluation_seed INT, episode_id BIGINT, checkpoint_sha256 STRING, job_id STRING"
JOBS = [("a", 1, i, "c", f"{i:02x}" * 32) for i in range(9)] + [("a", 1, 9, "c", None), (None, 1, 10, "c", "odd")]


def test_digests_of_jobs_do_not_travel(make):
    made = Al.job_table(make("arm_id STRING, checkpoint_sha256 STRING", ("a", "c"), ("a", "d"), (None, "c")), make("evaluation_seed INT", (1,), (None,)), make("episode_id BIGINT", *[(i,) for i in range(20)], (None,), (3,)))
    got = Al.in_digest_order(made)
    below = plan_of(got).split("rangepartitioning")[1]
    assert "array_except" in below and "BuildRight, Cross" in plan_of(got).split("RoundRobin")[0] and got.columns == made.columns
    found = got.collect()
    assert rows(got) == rows(made) and [r.job_id for r in found] == sorted(r.job_id for r in found) and len(found) == 132
    odd = make(PLAN, *JOBS, *[("a", 1, 1, "c", t) for t in ("", "A", "zz", None)]).unionByName(made.select(*PLAN.replace(",", "").split()[::2]))
    mixed = Al.in_digest_order(odd).collect()
    assert rows(odd) == sorted(map(tuple, mixed), key=repr) and [r.job_id for r in mixed] == sorted((r.job_id for r in mixed), key=lambda t: (t is not None, t or ""))


def test_jobs_of_any_name_are_told_apart(make):
    records = [JOBS[0], JOBS[0], JOBS[1], ("a", 1, 1, "other", JOBS[1][4]), ("b", 2, 2, "c", JOBS[2][4]), ("a", 1, 3, "c", "x" + JOBS[3][4]), JOBS[9], JOBS[10]]
    plan, said = make(PLAN, *JOBS), make(PLAN, *records)
    known = {r[4] for r in records if r[4] is not None}
    assert rows(Al.pending(plan, said), "job_id") == sorted([(j[4],) for j in JOBS if j[4] not in known], key=repr)
    begun = make("job_id STRING", *[(j[4],) for j in JOBS[:6] * 2])
    assert rows(Al.indeterminate(begun, said), "job_id") == [(j[4],) for j in JOBS[3:6]]
    assert [r.job_id for r in Al.in_digest_order(make(PLAN, *reversed(JOBS))).collect()] == [None, *sorted(j[4] for j in JOBS if j[4])]
    got = Counter((r.job_id, r.field) for r in Al.binding_violations(said, plan).collect())
    assert got == Counter({(JOBS[1][4], "checkpoint_sha256"): 1, (JOBS[2][4], "arm_id"): 1, (JOBS[2][4], "evaluation_seed"): 1, ("x" + JOBS[3][4], "unallocated"): 1, (None, "unallocated"): 1})
    # Of the 11 jobs (one without a name) 0, 9 and 10 have true records, 1 and 2 have wrong ones, and 3 to 5 were begun.
    assert rows(Al.readiness(plan, begun, said)) == [(11, 3, 2, 3, 6, Al.BLOCKED)]
    ready = Al.readiness(plan, begun, said)
    assert "SortAggregate" not in plan_of(ready)


def test_gaps_with_unknown_keys(make):
    seen = make("a STRING, i INT", ("x", 1), ("x", 1), ("y", 1), ("z", 1), (None, 1), (None, 1))
    wanted = make("a STRING, i INT", ("x", 1), ("x", 2), ("x", 2), ("y", 1), (None, 1))
    gaps = St.coverage_gaps(seen, wanted, ["a", "i"])
    assert Counter(map(tuple, gaps.collect())) == Counter([("x", 1, "repeated"), ("x", 2, "missing"), ("z", 1, "unexpected"), (None, 1, "missing"), (None, 1, "unexpected")])
    assert "FullOuter" not in plan_of(gaps)


def test_draws_are_not_kept_in_memory(make):
    one = St.paired_bootstrap(make("id INT, treatment INT, control INT", *[(i, i % 2, i % 3) for i in range(30)]), "id", seed="s")
    assert "keys=[b#" in plan_of(one) and not [line for line in plan_of(one).splitlines() if "keys=[b#" in line and ", i#" in line.split("]")[0]]


def test_shingles_travel_as_numbers(make):
    both = make("id INT, t STRING", (1, "a b c"), (2, "a b d"), (3, "")), make("id INT, t STRING", (1, "a b c"), (2, "q"))
    got = L.contamination(*both, "id", "t", width=2)
    assert tuple(got.collect()[0])[:3] == (3, 3, 2)
    assert "bit_or(side" in plan_of(got) and "bool_or" not in plan_of(got)


def test_many_proofs_at_once(make):
    leaves = [(f"n{i % 90}", f"v{i % 7}") for i in range(200)] + [(None, "v"), ("n1", None), (None, None)]
    wanted = make("name STRING, value STRING", *{*leaves, ("n1", "other"), ("none", "v0"), ("n2", None)})
    for levels in (0, 1, 2):
        nodes = D.tree(make("name STRING, value STRING", *leaves), F.col("name"), F.col("value"), levels=levels)
        assert rows(D.verify_many(nodes, wanted)) == rows(D.verify(D.proofs(nodes, wanted), levels))
    forged = [*nodes[:-1], nodes[-1].withColumn("parts", F.array_append("parts", F.lit("x:1")))]
    assert not D.verify_many(forged, wanted).where("holds").count()
    keyed = make("k INT, name STRING, value STRING", *[(i % 2, *x) for i, x in enumerate(leaves)])
    nodes = D.tree(keyed, F.col("name"), F.col("value"), ["k"])
    asked = keyed.unionByName(make("k INT, name STRING, value STRING", (0, "none", "v"), (9, "n1", "v1")))
    assert rows(D.verify_many(nodes, asked, ["k"])) == rows(D.verify(D.proofs(nodes, asked, ["k"]), 2, ["k"]))


def test_lanes_taken_whole_and_cut_say_the_same(spark):
    lanes = A.lanes(tables(spark, random_episodes(12, 5)))
    found = [rows(A.violations(A.linked(lanes, whole)).select("episode_id", "space", "key", "pos", "event_id", "check", "detail")) for whole in (0, 40, A.WHOLE)]
    assert found[0] and found[0] == found[1] == found[2]


def test_episodes_that_lie_together_are_judged_where_they_lie(spark):
    t = tables(spark, random_episodes(12, 5))
    want = rows(sensitivity(t, "x"), "patch_id", "found", "as_expected")
    lying = {name: A.by_episode(df) for name, df in t.items()}
    moved = "Exchange hashpartitioning"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sensitivity(lying, "x")
        assert moved not in plan_of(A.linked(A.lanes(lying))) and moved not in plan_of(got)
        assert want and rows(got, "patch_id", "found", "as_expected") == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    kept = A.stored(A.lanes(lying), 40)
    found = [r for linked, keep in kept for r in rows(judged(linked, lying, "x", keep), "patch_id", "found", "as_expected")]
    assert len(kept) == 2 and sorted(found, key=repr) == want


def test_verdicts_store_what_they_judge_by_episode():
    used = experiment.verdicts.__code__.co_names
    assert "stored" in used and "materialise" not in used


def test_rows_in_buckets_come_back_and_leave_no_table(spark, make):
    df = make("k STRING, v STRUCT<a: INT, b: STRING>, `x y` INT", *[(None if i % 5 == 0 else f"k{i % 7}", (i, None), i) for i in range(50)])
    back = in_buckets(df, "k")
    assert rows(back) == rows(df) and back.columns == df.columns and "Exchange" not in plan_of(back.groupBy("k", "x y").count())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("auditframe_")]


def test_the_plan_of_jobs_is_not_stored():
    assert "materialise" not in experiment.marked_jobs.__code__.co_names


def test_a_file_per_name_in_few_folders(spark, make):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/files"
    texts = make("id BIGINT, t STRING", *[(i, f"é{i}\n") for i in range(700)], (700, None), (701, ""), (702, "a"), (702, "b"), (None, "x")).coalesce(1)
    S.write_files(texts, path, "id", "t")
    folders = os.listdir(path)
    assert len(folders) <= S.SHELVES and all(f.startswith("shelf=") for f in folders)
    found = S.raw_files(spark, path).select(F.regexp_extract("path", "name=([0-9]+)[/.]", 1).alias("name"), "bytes", "sha256")
    want = {str(i): f"é{i}\n\n" for i in range(700)} | {"700": "\n", "701": "\n", "": "x\n"}
    got = {r.name: (r.bytes, r.sha256) for r in found.collect()}
    assert found.count() == 704 and got.pop("702") in [(4, sha256(x).hexdigest()) for x in (b"a\nb\n", b"b\na\n")]
    assert got == {k: (len(v.encode()), sha256(v.encode()).hexdigest()) for k, v in want.items()}
    empty = path + "-empty"
    S.write_files(texts.limit(0), empty, "id", "t")
    assert not os.listdir(empty)


def test_raw_files_are_listed_by_tasks_as_spark_lists_them(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    names = ["a.txt", "s/b c.txt", "s/t/u/é%20.txt", "s/.h/x", "s/_h/x", "_m/x", "_k=1/y", "_metadata/z", "_metadata2", ".a.txt.crc", "p/q._COPYING_", "p/_q", "e/empty"]
    for n in names:
        os.makedirs(os.path.dirname(f"{folder}/{n}"), exist_ok=True)
        with open(f"{folder}/{n}", "w") as f:
            f.write("" if n == "e/empty" else n * 9)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    want = sorted((r.path.removeprefix("file:")[len(folder) + 1:], r.length, sha256(r.content).hexdigest()) for r in read.collect())
    monkeypatch.setattr(S, "BLOCK", 7)
    for dealt in (1, 3, 512):
        monkeypatch.setattr(S, "DEALT", dealt)
        found = S.raw_files(spark, folder)
        assert len(want) == 5 and rows(found) == want and "binaryFile" not in plan_of(found)
    assert rows(S.raw_files(spark, f"{folder}/s*", folder)) == [r for r in want if r[0].startswith("s/")]
    assert rows(S.raw_files(spark, f"{folder}/a.txt", folder)) == [r for r in want if r[0] == "a.txt"]


def test_answers_are_worked_out_once(spark):
    plan = plan_of(replay.citation_valid(spark, "/root/testdata/sf0.001"))
    assert "lineitem" not in plan and "orders" not in plan


def test_only_likely_shingles_are_put_together(make, monkeypatch):
    texts = make("id INT, t STRING", (1, "a b c d e"), (1, "x A b c"), (2, "a q c a q c"), (3, "a b"), (4, None), (5, "a z c"), (None, "q c a"))
    corpus = make("k INT, t STRING", (1, "A b c. d"), (2, "q c a q"), (3, "c"))
    few = L.source_overlap(texts, "id", "t", corpus, "k", 3)
    assert Counter((r.id, r.overlapping_shingles) for r in few.collect()) == Counter([(1, 3), (2, 2), (None, 1)])
    assert "_mark" in plan_of(few)
    monkeypatch.setattr(L, "FEW_KEYS", 0)
    many = L.source_overlap(texts, "id", "t", corpus, "k", 3)
    assert rows(many) == rows(few) and "_mark" not in plan_of(many)
