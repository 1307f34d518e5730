"""Roots that commit, proofs that stand alone, and roots that follow a history."""
from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditframe.functions import digest_tree as D
from auditframe.operators import contract as C
from auditframe.operators import evidence as E
from auditframe.operators import leak as L
from auditframe.sources import manifests as M
from tests.conftest import rows


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(x):
    return "" if x is None else f"={x}"


def root_by_hand(leaves, levels, with_value=True):
    buckets = defaultdict(list)
    for (name, value), n in Counter(leaves).items():
        place = sha(framed(name))
        buckets[place[:levels]].append((place, f"{sha(place + sha(framed(value))) if with_value else place}:{n}"))
    nodes = {p: sha("bucket" + ",".join(part for _, part in sorted(b))) for p, b in buckets.items()}
    if not leaves:
        return sha("node" if levels else "bucket")
    for level in range(levels - 1, -1, -1):
        up = defaultdict(list)
        for p, d in sorted(nodes.items()):
            up[p[:level]].append(f"{p[level]}:{d}")
        nodes = {p: sha("node" + ",".join(parts)) for p, parts in up.items()}
    return nodes[""]


LEAVES = [(f"n{i % 90}", f"v{i % 7}") for i in range(200)] + [(None, "v"), ("n1", None), ("", ""), (None, None), ("a|b", "c"), ("a", "b|c")]


@pytest.mark.parametrize("levels", [0, 1, 3])
def test_root_equals_plain_loops(make, levels):
    df = make("name STRING, value STRING", *LEAVES)
    got = [D.roots(df.repartition(n), F.col("name"), F.col("value"), levels=levels).collect()[0] for n in (1, 7)]
    assert got[0] == got[1] and tuple(got[0]) == (len(LEAVES), root_by_hand(LEAVES, levels))
    names = D.roots(df, F.col("name"), levels=levels).collect()[0].root
    assert names == root_by_hand([(n, None) for n, _ in LEAVES], levels, False)
    assert D.roots(df.limit(0), F.col("name"), F.col("value"), levels=levels).collect()[0].root == root_by_hand([], levels)


def test_every_change_changes_the_root(make):
    seen = {root_by_hand(LEAVES, 2)}
    changed = [LEAVES[1:], [*LEAVES, LEAVES[0]], [*LEAVES, ("new", None)], [(None, ""), *LEAVES[1:]], [("n0", None), *LEAVES[1:]]]
    for leaves in changed:
        seen.add(D.roots(make("name STRING, value STRING", *leaves), F.col("name"), F.col("value")).collect()[0].root)
    assert len(seen) == len(changed) + 1


def test_roots_per_key(make):
    df = make("k INT, name STRING, value STRING", *[(k, n, v) for k in range(3) for n, v in LEAVES[: 40 * (k + 1)]])
    got = {r.k: r.root for r in D.roots(df, F.col("name"), F.col("value"), ["k"]).collect()}
    assert got == {k: root_by_hand(LEAVES[: 40 * (k + 1)], 2) for k in range(3)}


@pytest.mark.parametrize("levels", [0, 2])
def test_proofs_hold_for_leaves_only(make, levels):
    df = make("name STRING, value STRING", *LEAVES)
    nodes = D.tree(df, F.col("name"), F.col("value"), levels=levels)
    wanted = make("name STRING, value STRING", *set(LEAVES), ("n0", "other"), ("absent", "v0"))
    held = {(r.name, r.value): (r.holds, r.root) for r in D.verify(D.proofs(nodes, wanted), levels).collect()}
    root = root_by_hand(LEAVES, levels)
    assert all(held[leaf] == (True, root) for leaf in set(LEAVES))
    assert not held["n0", "other"][0] and not held.get(("absent", "v0"), (False,))[0]


def test_tampered_proof_fails(make):
    nodes = D.tree(make("name STRING, value STRING", *LEAVES), F.col("name"), F.col("value"))
    proof = D.proofs(nodes, make("name STRING, value STRING", ("n5", "v5"), ("n6", "v6")))
    root = root_by_hand(LEAVES, 2)
    other = F.transform("parts", lambda p: F.concat(p, F.lit("0")))
    for level in range(3):
        bad = proof.withColumn("parts", F.when(F.col("level") == level, other).otherwise(F.col("parts")))
        assert not [r for r in D.verify(bad, 2).collect() if r.holds and r.root == root]
        missing = D.verify(proof.where(F.col("level") != level), 2).collect()
        assert not [r for r in missing if r.holds]


def test_changed_buckets(make):
    a = D.tree(make("name STRING, value STRING", *LEAVES), F.col("name"), F.col("value"))
    b = D.tree(make("name STRING, value STRING", *LEAVES[1:], ("n0", "z")), F.col("name"), F.col("value"))
    assert rows(D.changed(a, b), "prefix") == [(sha("=n0")[:2],)] and rows(D.changed(a, a)) == []


def test_roots_after_steps_equal_roots_at_rest(make):
    """Every step of random histories against the root of the state it leaves, for small chunks, several levels and crowded buckets."""
    rng = random.Random(2)
    history, states = [], []
    for e in ("e", "f"):
        now = {}
        for step in range(1, 60):
            o = f"o{rng.randint(0, 25)}"
            now[o] = (rng.choice(["s", "t", None]), step)
            history.append((e, o, step * 3, *now[o]))
            states += [(e, step * 3, name, *x) for name, x in now.items()]
    h = make("episode_id STRING, object_id STRING, step BIGINT, to_state STRING, to_version BIGINT", *history)
    s = make("episode_id STRING, step BIGINT, object_id STRING, state STRING, version BIGINT", *states)
    for levels in (0, 1, 2):
        want = rows(C.state_roots(s, ["episode_id", "step"], levels), "episode_id", "step", "root")
        assert rows(C.state_after_step(h, ["episode_id"], "step", size=10, levels=levels), "episode_id", "step", "state_root") == want


FILES = "path STRING, bytes BIGINT, sha256 STRING"


def test_manifest_lists_what_it_proves(make):
    assets = make(FILES, *[(f"p{i}", i, sha(str(i))) for i in range(50)])
    claims = make(FILES, ("p1", 1, sha("1")), ("p2", 2, sha("1")), ("p3", 4, sha("3")), ("p99", 1, sha("1")), ("p1", 1, sha("1")))
    assert rows(M.listed_assets(claims, assets), "path", "listed") == [("p1", True), ("p1", True), ("p2", False), ("p3", False), ("p99", False)]
    assert M.manifest_summary(assets.limit(0)).collect()[0].files == 0


def test_contamination_commits_to_the_sealed_set(make):
    docs = "doc_id INT, text STRING"
    one = L.contamination(make(docs, (1, "x y z")), make(docs, (1, "a b c d e f g h i j k l m n"), (2, "a b c")), "doc_id", "text").collect()[0]
    two = L.contamination(make(docs, (1, "q")), make(docs, (7, "a b c"), (8, "a b c"), (9, "a b c d e f g h i j k l m n")), "doc_id", "text").collect()[0]
    other = L.contamination(make(docs, (1, "q")), make(docs, (7, "a b d")), "doc_id", "text").collect()[0]
    assert one.sealed_commitment == two.sealed_commitment != other.sealed_commitment


def test_set_bindings_and_pack(make):
    episodes = make("set_id STRING, episode_id STRING", ("a", "1"), ("a", "2"), ("a", "2"), ("b", "3"))
    root = {r.set_id: r.root for r in D.roots(episodes.distinct(), F.col("episode_id"), None, ["set_id"]).collect()}
    runs = make("run_id STRING, set_id STRING, recorded_root STRING", ("r1", "a", root["a"]), ("r2", "b", root["a"]), ("r3", "c", root["a"]), ("r4", "a", None))
    bound = E.set_bindings(runs, episodes)
    assert rows(bound, "run_id", "status") == [("r1", "bound"), ("r2", "differs"), ("r3", "unknown_set"), ("r4", "not_recorded")]
    pack = E.pack_rows({"sets": bound.select("run_id", "status", "episodes")})
    assert ("sets", "r3", "episodes", "UNKNOWN") in rows(pack, "section", "subject", "item", "value")
    assert rows(E.pack_problems(pack, pack)) == []
    r1 = (F.col("subject") == "r1") & (F.col("item") == "status")
    tampered = pack.withColumn("value", F.when(r1, "differs").otherwise(F.col("value")))
    assert rows(E.pack_problems(tampered, pack)) == [("sets", "r1", "status", "diverges")]
    assert rows(E.pack_problems(tampered, pack, moving=["status"])) == []
    assert rows(E.pack_problems(pack.where(~r1), pack)) == [("sets", "r1", "status", "not_committed")]
    assert rows(E.pack_problems(pack, pack.where(~r1), moving=["status"])) == [("sets", "r1", "status", "not_recomputed")]
    assert rows(E.pack_problems(pack.unionByName(pack.where(r1)), pack)) == [("sets", "r1", "status", "repeated")]
    assert E.pack_root(tampered).collect()[0].root != E.pack_root(pack).collect()[0].root
