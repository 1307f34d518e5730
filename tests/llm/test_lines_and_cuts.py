"""Repeated lines, fill-in-middle and the audit of filters."""
from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditframe.llm import fill_middle, filter_audit, line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(BLANK))


def without_repeats(rows, least_chars=40, least_documents=5):
    """rows: (id, text); ids of None sort first. Gives (id, lines, dropped, text) per row."""
    rows = [(i, t or "") for i, t in rows]
    holders = defaultdict(list)
    for i, text in rows:
        for key in {key_of(line) for line in text.split("\n")}:
            if len(key) >= least_chars:
                holders[key].append(i)
    out = []
    for i, text in rows:
        gone = lambda line: len(holders.get(key_of(line), [])) >= least_documents and i != max((h for h in holders[key_of(line)] if h is not None), default=None)  # noqa: B023, E731
        lines = text.split("\n")
        kept = [line for line in lines if not gone(line)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


def test_lines_equal_brute_force(make):
    rng = random.Random(5)
    words = ["some words", "of a LINE", "that is LONG", "ünïcode 語 letters", "and more 🙂", "x"]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(40)] + ["é" * 20, "é" * 39, "é" * 40, "É" * 40, "a" * 39 + "\x85", "  " + "b" * 40 + " \t\r", "B" * 40]
    rows = [(i if i % 17 else None, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(300)] + [(301, None), (302, ""), (7, pool[0]), (7, pool[0])]
    docs = make("doc_id long, text string", *rows).repartition(9)
    got = lines_of(line_dedup.drop_repeated_lines(docs))
    assert got == without_repeats(rows)
    assert sum(g[2] for g in got) > 300


def test_lines_with_string_ids_and_small_batches(make, monkeypatch):
    rows = [(f"d{i:03}", f"{'a common line of more than forty characters ' * 2}\nits own {i}\n{'pair ' * 9}{i // 6}") for i in range(60)]
    monkeypatch.setattr(line_dedup, "BATCH", 400)
    docs = make("doc_id string, text string", *rows).repartition(7)
    assert lines_of(line_dedup.drop_repeated_lines(docs)) == without_repeats(rows)


def test_lines_of_edge_cases(edge, empty):
    done = line_dedup.drop_repeated_lines(edge, least_chars=3, least_documents=2)
    assert done.columns == [*edge.columns, "n_lines", "n_dropped"]
    assert lines_of(done) == without_repeats([(r.doc_id, r.text) for r in edge.collect()], 3, 2)
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    clash = edge.withColumns({"n_lines": F.lit(3), "lost": F.lit("x"), "k1": F.lit("y"), "batch": F.lit(None).cast("string")})
    assert line_dedup.drop_repeated_lines(clash).columns == [*clash.columns, "_n_lines", "n_dropped"]
    assert line_dedup.drop_repeated_lines(clash).count() == edge.count()


def test_lines_without_any_id(make):
    rows = [(None, "the same line in all of these rows without an id")] * 6
    assert lines_of(line_dedup.drop_repeated_lines(make("doc_id long, text string", *rows))) == without_repeats(rows)


@pytest.mark.parametrize("n", [1, 2, 500, 40_000])
def test_perfect_hash_is_minimal_and_packs(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
    low[: n // 2] = low[0]  # equal halves of different keys
    perfect = line_dedup.PerfectHash.unpacked(line_dedup.PerfectHash.of(high, low).packed())
    assert sorted(perfect.slots(high, low)) == list(range(n))
    other = perfect.slots(high ^ np.uint64(1), low)
    assert other.max() < n
    assert sum(map(len, perfect.levels)) < 6 * n + 64


def cut_by_hand(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(tokens), "plain", None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check_cuts(docs, **how):
    made = fill_middle.fill_in_middle(docs, **how)
    back = fill_middle.restore(made).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r)[:6] for r in back), key=repr) == sorted((cut_by_hand(*r, **how) for r in rows), key=repr)
    assert sorted((r.doc_id, r.restored) for r in back if r.doc_id is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    return {r.form for r in back}


def test_cuts_equal_brute_force(make, monkeypatch):
    rng = random.Random(6)
    signs = ["a", "語", "🙂", "<", "<P", "P>", ">", "<S", " ", "\n", "\t\x0b", "\x85", " ", "word"]
    rows = [(i, "".join(rng.choices(signs, k=rng.randint(0, 30)))) for i in range(600)] + [(900 + i, f"x {mark} y") for i in range(20) for mark in ("<P>", "<S>", "<M>")]
    docs = make("doc_id long, text string", *rows)
    assert check_cuts(docs, rate=90) == {"plain", "psm", "spm"}
    monkeypatch.setattr(fill_middle, "RUN", 40)
    assert check_cuts(docs, rate=100, spm=0, seed=7) == {"plain", "psm"}


def test_cuts_of_edge_cases(edge, empty):
    check_cuts(edge, rate=100)
    assert fill_middle.restore(fill_middle.fill_in_middle(empty)).count() == 0
    made = fill_middle.fill_in_middle(edge).withColumn("restored", F.lit(1))
    assert fill_middle.restore(made).columns[-1] == "_restored"


def test_marks_do_not_reach_over_texts():
    data, at = fill_middle.bytes_of(pa.array(["x<", "P>", "<P", ">", "", "<M>"]))
    assert fill_middle.marks(data, at)[1].tolist() == [5]
    with pytest.raises(ValueError):
        fill_middle.gather(data, at, np.array(["psm"] * 6))


def audit_by_hand(rows, labels):
    """rows: (id, part, text); labels: (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    fails = []
    for i, part, text in rows:
        text, w = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        bits = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                "E": i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows)}
        fails.append((part or "", {c for c, held in bits.items() if held}, i))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(f, i) for p, f, i in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                first = [(f, i) for f, i in own if c in f and not f & set(order[: step - 1])]
                out[part, order, step] = [
                    sum(not f & set(order[:step]) for f, _ in own), len(first), sum(c in f and bool(f & set(order[: step - 1])) for f, _ in own),
                    sum(f == {c} for f, _ in own), sum(i in good for _, i in first), sum(i in toxic for _, i in first),
                ]
    shapley = defaultdict(int)
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_brute_force(make):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["word", "Big", "x#", *map(str, range(rng.choice([3, 900])))], k=rng.randint(0, 400))) for _ in range(60)] + [None, "", " \t", "SHOUT"]
    rows = [(i if i % 23 else None, rng.choice(["en", "de", None]), rng.choice(texts)) for i in range(200)]
    rows += [(400 + i, "en", texts[0]) for i in range(300)] + [(3, "de", rows[3][2]), (3, "fr", rows[3][2])]  # a large group; repeated rows
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 600, 2)] + [(4, 1, 1), (4, 1, 0), (None, 1, 1)]
    got = audited(filter_audit.interaction_audit(make("doc_id long, lang string, text string", *rows), make("doc_id long, quality int, toxic int", *labels)))
    assert got == audit_by_hand(rows, labels)


def test_audit_of_edge_cases(make, edge, empty):
    labels = make("doc_id long, quality int, toxic int", (1, 1, 0), (6, 0, 1))
    rows = [(r.doc_id, r.lang, r.text) for r in edge.collect()]
    assert audited(filter_audit.interaction_audit(edge, labels)) == audit_by_hand(rows, [(1, 1, 0), (6, 0, 1)])
    assert filter_audit.interaction_audit(empty, labels).count() == 0
    assert audited(filter_audit.interaction_audit(edge, labels.limit(0))) == audit_by_hand(rows, [])


def test_copies_compare_texts_of_equal_hashes(make):
    docs = make("doc_id long, text string, hash long", (1, "ab", 5), (2, "cd", 5), (3, "cd", 5), (4, "ab", 5), (1, "ab", 5))
    assert sorted(r.doc_id for r in filter_audit.copies(docs).collect()) == [3, 4]
