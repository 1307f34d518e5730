"""Exact and near copies, and passages of the benchmark."""
from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd

from auditframe.llm import decontaminate, exact_dedup, ngram_join
from auditframe.llm.components import components


def test_exact_groups_of_edge_cases(edge, empty):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(edge).collect()), key=repr)
    by = [g for g in got if g[0] == 1]
    assert sorted(by) == [(1, 1, 2, False), (1, 1, 2, True)]  # repeated row: one stays
    assert (6, 6, 1, True) in got  # case makes a difference
    assert [g for g in got if g[0] == 3] == [(3, 2, 3, False)] and (2, 2, 3, True) in got and (None, 2, 3, False) in got
    assert [g for g in got if g[0] == 4] == [(4, 4, 1, True)]
    assert (9, 5, 2, False) in got and (5, 5, 2, True) in got
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_case_matters(make):
    docs = make("doc_id long, text string", (2, "A b"), (1, "a  b"), (3, "a\tb"))
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_groups(docs).collect()} == {(2, 2), (1, 1), (3, 1)}


def test_drop_copies_keeps_one_row_of_each_text(edge, empty):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in edge.collect()]
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()) == sorted(set(texts))
    assert exact_dedup.drop_copies(empty).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(sets):
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {d: top(d) for d in sets}


def test_all_links_inside_components_equal_brute_force(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng, rows = np.random.default_rng(6), []
    for group in range(4):
        text = [f"g{group}w{k}" for k in range(40)]
        for k in range(20):  # near copies of one text; many link with each other, not only with the first
            one = list(text)
            one[rng.integers(40)] = f"n{k % 15}"
            rows.append((100 * group + k, " ".join(one)))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, ""), (903, None), (904, "tiny text"), (None, "Tiny text")]
    pairs, members = ngram_join.near_duplicate_links(make("doc_id long, text string", *rows))
    sets = [shingles(t) for _, t in rows]
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    want = sorted(((d, sum(linked(x, y) for j, y in enumerate(sets) if j != k)) for k, ((d, _), x) in enumerate(zip(rows, sets))), key=repr)
    got = members.collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == want
    distinct = list({frozenset(x) for x in sets if x})
    ids = {frozenset(x): next(r.set_id for r in got if r.doc_id == d) for (d, _), x in zip(rows, sets) if x}
    assert sorted(map(tuple, pairs.collect())) == sorted(tuple(sorted((ids[x], ids[y]))) for x, y in combinations(distinct, 2) if linked(x, y))
    assert {r.doc_id: r.component_id for r in got} == {r.doc_id: r.component_id for r in ngram_join.near_duplicates(make("doc_id long, text string", *rows)).collect()}


def test_components_equal_brute_force_on_chains_and_borders(make):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(60)]
    rows, number = [], 0
    for group in range(12):
        text = [f"g{group}{w}" for w in base[: 8 + 4 * group]]
        for _ in range(14):  # copies of copies drift away: chains of links and pairs on both sides of the border
            rows.append((number, " ".join(text)))
            text = list(text)
            text[rng.integers(len(text))] = f"n{number}"
            number += 1
    rows += [(1000, "tiny text"), (1001, "Tiny\ttext"), (1002, ""), (1003, None), (1004, "")]
    docs = make("doc_id long, text string", *rows)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute({d: shingles(t) for d, t in rows})


def test_large_trees_are_split(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 8)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rows = [(k, " ".join([f"s{j}" for j in range(40)] + [f"d{k // 2}q{j}" for j in range(14 + k % 2)])) for k in range(60)]
    docs = make("doc_id long, text string", *rows)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute({d: shingles(t) for d, t in rows})


def test_near_duplicates_of_edge_cases(edge, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(edge).collect()}
    assert {(1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (6, 3, 1), (None, 1, None), (None, 0, None), (7, 1, 7), (8, 1, 8), (9, 29996, 5), (5, 29996, 5)} <= got
    assert ngram_join.near_duplicates(edge).count() == edge.count()
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.drop_near_duplicates(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, 10, None}


def test_tree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(2)
    points = rng.poisson(3, (300, ngram_join.GROUPS)).astype(np.int32)
    points[100:200] = points[:100] + rng.integers(0, 2, (100, ngram_join.GROUPS))
    n = points.sum(axis=1)
    want = {
        (min(a, b), max(a, b)) for a, b in combinations(range(300), 2)
        if 7 * np.minimum(points[a], points[b]).sum() >= 3 * (n[a] + n[b]) and 4 * min(n[a], n[b]) >= 3 * max(n[a], n[b])
    }
    assert {tuple(sorted(map(int, p))) for p in ngram_join.tree_pairs(points, n)} == {tuple(map(int, p)) for p in want}
    comp = np.arange(300) % 100 // 2
    assert {tuple(sorted(map(int, p))) for p in ngram_join.tree_pairs(points, n, comp=comp)} == {p for p in want if comp[p[0]] != comp[p[1]]}


def test_copies_that_drift_apart_are_contracted_before_they_meet(make, monkeypatch):
    rng, met = np.random.default_rng(9), []
    text = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(240):
        one = list(text)
        for at in rng.choice(150, 1 + k % 3, replace=False):
            one[at] = f"d{k}n{at}"
        rows.append((k, " ".join(one)))
    links = ngram_join.forest_links

    def spy(docs, nodes, crossing):
        other = crossing.selectExpr("token", "comp AS c", "set_id AS s")
        met.append(crossing.join(other, "token").where("comp <> c AND set_id < s").select("set_id", "s").distinct().count())
        return links(docs, nodes, crossing)

    monkeypatch.setattr(ngram_join, "forest_links", spy)
    sets = {d: shingles(t) for d, t in rows}
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(make("doc_id long, text string", *rows)).collect()}
    assert got == brute(sets) and met[0] < 0.02 * 240 * 239 / 2


def test_cores_of_trees_in_parts(monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 8)
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"token": np.repeat([1, 2, 3, 4], [3, 40, 5, 2]), "comp": rng.integers(0, 3, 50), "set_id": np.arange(50), "n": 100, "private": 0})
    rows.loc[rows.token == 4, "comp"] = 7
    rows["private"] = rows.groupby("token").cumcount()
    want = {}
    for _, tree in rows.groupby("token"):
        for r in tree.itertuples():
            if len(other := tree[tree.comp != r.comp]):
                want[r.set_id] = int(other.set_id.iloc[0])
    for size in (1, 3, 7, 50):
        parts = [rows[k : k + size].reset_index(drop=True) for k in range(0, 50, size)]
        found = pd.concat(ngram_join.core_rows(iter(parts)))
        got = dict(zip(found["b"], found["a"]))
        assert len(found) == len(got) and got.items() <= want.items()
        missed = {b for b in want if b not in got}
        assert all(rows.token[b] == 2 and b < want[b] for b in missed)


def test_trees_of_the_same_nodes_are_one_that_counts_as_many(make, monkeypatch):
    passages = [(range(0, 3), 7), (range(2, 5), 5), (range(0, 2), 1), (range(20, 40), 4)]
    held = {k: [] for k in range(40)}
    for number, (nodes, size) in enumerate(passages):
        for k in nodes:
            held[k] += [100 * number + j for j in range(size)]
    rows = [(k, np.array([*tokens, 1000 + k], np.int64).tobytes(), k) for k, tokens in held.items()]
    got = ngram_join.trees(make("set_id long, prefix binary, comp long", *rows)).collect()
    trees = {}
    for r in got:
        trees.setdefault(r.token, []).append(r)
    assert all(len({(r["size"], r.times) for r in tree}) == 1 for tree in trees.values())
    found = sorted((tuple(sorted(r.set_id for r in tree)), tree[0].times) for tree in trees.values())
    assert found == sorted([((0, 1, 2), 7), ((2, 3, 4), 5), ((0, 1), 1), (tuple(range(20, 40)), 4)])
    monkeypatch.setattr(ngram_join, "LARGE", 8)  # large trees keep names of their own
    rows = pd.DataFrame({"token": np.repeat([5, 6, 7, 8], [20, 20, 3, 3]), "comp": np.arange(46), "set_id": [*range(20), *range(20), *range(3), *range(3)]})
    named = pd.concat(ngram_join.named_rows(rows[k : k + 6].reset_index(drop=True) for k in range(0, 46, 6)))
    assert len(named) == 46 and [len(set(named.k1[named.token.isin(two)])) for two in ([5, 6], [7, 8])] == [2, 1]


def test_points_tell_drifted_copies_from_links(make):
    rng, sets = np.random.default_rng(3), []
    text = [f"w{k}" for k in range(400)]
    for k in range(120):  # with each other, pairs share about three quarters of their shingles: too few by a tenth
        one = list(text)
        for at in rng.choice(400, 10, replace=False):
            one[at] = f"d{k}n{at}"
        sets.append(next(ngram_join.shingle_sets([" ".join(one)])))
    sets += [np.setdiff1d(s, s[:k + 1]) for k, s in enumerate(sets[:20])]  # and these link with the first ones
    points, n = np.array([ngram_join.counts_of(s) for s in sets]), np.array([len(s) for s in sets])
    found = {tuple(sorted(map(int, p))) for p in ngram_join.tree_pairs(points, n)}
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in combinations(range(len(sets)), 2)}
    links = {(a, b) for (a, b), c in both.items() if 4 * c >= 3 * (n[a] + n[b] - c)}
    assert len(links) >= 20 and links <= found and len(found) < 0.1 * len(both)
    full = np.array([np.full(ngram_join.GROUPS, 10), np.full(ngram_join.GROUPS, 10)])
    full[:, 0] = ngram_join.FULL  # a coordinate that both points fill bounds nothing
    assert len(ngram_join.tree_pairs(full, np.array([50_000, 50_000]))) == 1


def test_components_of_a_chain_and_a_star(make):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.label for r in components(make("a long, b long", *links)).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(text, items):
    w, hit, found = bench_words(text), set(), set()
    for item, t in items:
        v = bench_words(t)
        width = min(10, len(v))
        for i in range(len(v) - width + 1 if v else 0):
            for p in range(len(w) - width + 1):
                if w[p : p + width] == v[i : i + width]:
                    hit |= set(range(p, p + width))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(make, edge, empty):
    long = " ".join(f"t{k}" for k in range(30))
    items = [(1, long), (2, "short one, here"), (3, None), (4, "..."), (5, "t1 t2"), (10, "short one, here"), (2, "short one, here")]
    docs = [
        (1, f"before {long} after"), (2, "SHORT-one here short one here"), (3, long.replace("t15", "other")), (4, None), (5, ""), (6, " ".join(long.split()[5:14])),
        (7, "t1 t2 t1 t2"), (8, "..."), (None, long), (9, long + " " + long),
    ]
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(make("doc_id long, text string", *docs), make("item_id long, text string", *items)).collect()}
    assert got == {d: brute_hits(t, items) for d, t in docs}
    bench = make("item_id long, text string", (1, "plain text of some seven words"))
    rows = decontaminate.contamination(edge, bench)
    assert rows.count() == edge.count() and {r.doc_id for r in rows.where("n_hit > 0").collect()} == {1, 6}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(edge, bench.limit(0)).where("n_hit > 0").count() == 0
    assert {r.doc_id for r in decontaminate.drop_contaminated(edge, bench).collect()} == {None, 2, 3, 4, 5, 7, 8, 9, 10}


def test_proximity_in_either_order(make):
    docs = make("doc_id long, text string", (1, "a x x b x x x x b a"), (2, "b a"), (3, "a"))
    index = decontaminate.build_index(docs, make("term string", ("a",), ("b",)))
    got = {tuple(r) for r in decontaminate.proximity_hits(index, "a", "b", 3).collect()}
    assert got == {(1, 1, 4), (1, 10, 9), (2, 2, 1)}


def test_rows_go_by_id_and_text(make):
    """Rows without ids are judged by their texts, and of two texts under one id only the right one goes."""
    passage = " ".join(f"t{i}" for i in range(20))
    docs = make("doc_id long, text string", (None, f"x {passage}"), (None, "clean words"), (1, f"y {passage} z"), (1, "other clean words"))
    bench = make("item_id long, text string", (1, passage))
    assert sorted(r.text for r in decontaminate.drop_contaminated(docs, bench).collect()) == ["clean words", "other clean words"]
    near = make("doc_id long, text string", (None, f"{passage} end"), (3, f"{passage} fin"), (3, "quite another text of words"), (None, "no copy of anything here at all"))
    assert sorted(r.text for r in ngram_join.drop_near_duplicates(near).collect()) == ["no copy of anything here at all", "quite another text of words", f"{passage} fin"]


def test_common_shingles_do_not_depend_on_partitions(documents, monkeypatch):
    """Counts over all documents, however these are dealt out and in how many rounds their packed counts are added up."""
    monkeypatch.setattr(ngram_join, "FAN_IN", 4)
    one, many = (ngram_join.common_shingles(documents.repartition(n), "text") for n in (1, 23))
    assert len(one[0]) > 10 and all(np.array_equal(a, b) for a, b in zip(one, many))
    sets = list(ngram_join.shingle_sets([r.text for r in documents.select("text").collect()]))
    values, n = np.unique(np.concatenate(sets) >> np.uint64(64 - ngram_join.BUCKETS), return_counts=True)
    assert np.array_equal(one[0], values[n >= ngram_join.COMMON]) and np.array_equal(one[1], n[n >= ngram_join.COMMON])
