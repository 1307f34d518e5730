"""Greedy evidence selection, splits and orders over keys of any type."""
from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from auditframe.functions import ordered, quantiles
from auditframe.operators import evidence as E
from auditframe.operators import stats
from auditframe.operators import strategy as S
from tests.conftest import rows


def greedy(consumers, spans, wants, holds):
    """consumers, spans: (surface, name); wants, holds: name -> atoms."""
    used, out = set(), []
    for surface, c in sorted(consumers):
        left = [s for p, s in sorted(spans) if p == surface and (p, s) not in used]
        direct = [s for s in left if wants.get(c, set()) & holds.get(s, set())]
        pick = (direct or left or [None])[0]
        used.add((surface, pick))
        out.append((surface, c, pick, None if pick is None else "entity_direct" if direct else "surface_context"))
    return sorted(out, key=repr)


def choose(make, consumers, spans, wants, holds):
    pairs = lambda d: [(k, a) for k, atoms in d.items() for a in atoms]
    got = E.assign_spans(
        make("surface STRING, consumer STRING", *consumers), make("surface STRING, span STRING", *spans),
        make("consumer STRING, atom_id STRING", *pairs(wants)), make("span STRING, atom_id STRING", *pairs(holds)),
    )
    return rows(got, "surface", "consumer", "span", "support_scope")


@pytest.mark.parametrize("seed", range(2))
def test_choice_equals_the_sequential_one(make, seed):
    """Surfaces of different temper: no atoms, few, many, one that nearly all share; more consumers than spans and fewer."""
    rng = random.Random(seed)
    consumers, spans, wants, holds = [], [], {}, {}
    for n, (share, atoms) in enumerate([(0.0, 5), (0.2, 30), (0.9, 6), (0.95, 1)]):
        surface = f"s{n}"
        for i in range(rng.randint(3, 9)):
            name = f"c{n}{rng.random():.6f}"
            consumers.append((surface, name))
            wants[name] = {f"a{rng.randrange(atoms)}" for _ in range(3) if rng.random() < share}
        for i in range(rng.randint(3, 9)):
            name = f"p{n}{rng.random():.6f}"
            spans.append((surface, name))
            holds[name] = {f"a{rng.randrange(atoms)}" for _ in range(2) if rng.random() < share}
    assert choose(make, consumers, spans, wants, holds) == greedy(consumers, spans, wants, holds)


def test_a_shared_atom_takes_few_rounds(make, monkeypatch):
    """Two hundred consumers and spans of one atom pair up at once and not one by one."""
    calls = []
    monkeypatch.setattr(E, "_pairs_of_one_atom", lambda *a, f=E._pairs_of_one_atom: calls.append(1) or f(*a))
    consumers, spans = [("s", f"c{i:03}") for i in range(200)], [("s", f"p{i:03}") for i in range(260)]
    wants, holds = {c: {"hot"} for _, c in consumers}, {s: {"hot"} for _, s in spans}
    assert choose(make, consumers, spans, wants, holds) == greedy(consumers, spans, wants, holds)
    assert len(calls) <= 2


def test_choice_without_spans_or_consumers(make):
    assert choose(make, [("s", "c")], [], {"c": {"a"}}, {}) == [("s", "c", None, None)]
    assert choose(make, [], [("s", "p")], {}, {"p": {"a"}}) == []


def test_sides_of_text_ids(make):
    clients = make("client STRING", *[(f"client {i:02}",) for i in (7, 1, 4, 2, 9)])
    assert rows(E.client_sides(clients, "client"), "client", "side") == [("client 01", "train"), ("client 02", "train"), ("client 04", "transfer"), ("client 07", "transfer"), ("client 09", "transfer")]


def test_bootstrap_of_text_clusters_depends_on_order_alone(make):
    pairs = [(i, float(i % 3 == 0), float(i % 4 == 0)) for i in range(40)]
    a = stats.paired_bootstrap(make("id INT, treatment DOUBLE, control DOUBLE", *pairs), "id", seed="x").collect()
    b = stats.paired_bootstrap(make("id STRING, treatment DOUBLE, control DOUBLE", *[(f"e{i:03}", *x) for i, *x in pairs]).repartition(5), "id", seed="x").collect()
    assert a == b and a[0].cluster_count == 40


def test_sparse_and_large_turn_numbers(make):
    """A thousand turns far apart are one chunk, equal numbers keep their position, and 2^23 and more do not overflow."""
    ddl = "run_id INT, episode_id STRING, turn BIGINT, pos BIGINT, surface STRING, action STRING, actor_id STRING, object_versions MAP<STRING,INT>, request_is_object BOOLEAN, outcome STRING"
    base = ("s", "a", "u", {"o": 1}, True)
    turns = make(ddl, *[(1, "e", i * 10**12, i, *base, "REJECTED" if i % 2 else "APPLIED") for i in range(1000)], (1, "e", 999 * 10**12, 1000, *base, "STOP"))
    stable = S.stable_turns(turns, "pos")
    assert stable.select("_chunk").distinct().count() == 1
    found = {r.pos: r.bucket for r in S.classify_rejections(stable).collect()}
    assert found[999] == "abandon" and found[1] == "repeat" and found[1000] is None


def test_ranges_follow_any_order(spark):
    n = 5000
    df = spark.range(n).select((F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("name")).repartition(7)
    spread = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ready = ordered.ranged(df, ["k"], "name")
        assert ready.select("_chunk").distinct().count() > 1
        got = rows(ordered.positions(ready, ["k"], "name"), "k", "name", "pos")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)
    want = []
    for k in range(3):
        want += [(k, name, i + 1) for i, name in enumerate(sorted(r.name for r in df.where(F.col("k") == k).collect()))]
    assert got == sorted(want, key=repr)


def test_medians_of_several_columns(make):
    rng = random.Random(4)
    data = [(k, rng.choice([None, 1, 2, 2, 2, 9]), rng.random() if rng.random() < 0.8 else None) for k in "aab" for _ in range(201)] + [("c", None, 1.5)]
    df = make("k STRING, x INT, y DOUBLE", *data)
    middle = lambda k, i: statistics.median(v) if (v := [r[i] for r in data if r[0] == k and r[i] is not None]) else None
    assert rows(quantiles.exact_medians(df, ["k"], {"mx": "x", "my": "y"}), "k", "mx", "my") == [(k, middle(k, 1), middle(k, 2)) for k in "abc"]
