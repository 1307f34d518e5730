"""Secret scan: wide candidates, and a random forest that removes false positives.

A candidate is a run of 16 or more letters, digits and + / _ = - in a text, or runs of them with dots between (dotted
tokens), without a name and = before it; and whatever is assigned to a telling name by = or :, of any length and in any
characters up to the closing quote or, unquoted, to white space, a separator or a bracket. The forest sees its length, its
character transitions (changes between kinds of characters, repeats, entropy), how much of it words of the corpus
cover, whether the text before looks like a path or address, and its neighbouring words. It is trained on labelled
findings: rows of candidates with a label; ``form_labels`` makes them from the findings themselves, for corpora without
reviewed findings: forms of keys, other known forms that are assigned to a telling name, and against them candidates that are
plain words or paths. What is uncertain stays unlabelled and is only scored.

The forest is fitted on at most SAMPLE labelled findings, the first by a hash of their place; every candidate of
every whole text is scored. Offsets are code points, the end exclusive. A NULL or empty text has no candidates; repeated
rows give their findings each; rows with NULL ids are scanned too. Without findings of both labels nothing is taken
out: the score is 1. An empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import trees
from auditframe.llm.base import bounded_sample, map_texts, stored, table
from auditframe.llm.lm import vocabulary
from auditframe.llm.registry import query

#: A run, or a dotted token of at least two long parts. A run may begin with a name and =, which is split off.
CANDIDATE = re.compile(r"[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)+|[A-Za-z0-9+/_=-]{16,}")
LEADING = re.compile(r"[A-Za-z_][A-Za-z0-9_-]{0,47}=(?=[^=])")
SIGN = re.compile("[:=]")
#: A telling name before a sign, and the value behind it: quoted, or up to white space, a separator or a bracket.
TELLING = re.compile(r"(?i)(?:secret|token|passw|pwd|api_?-?key|access_?-?key|private_?-?key|auth|credential)[A-Za-z0-9_-]{0,48}[\"']?\s{0,4}:?$")
VALUE = re.compile(r"(?i)>?\s{0,4}(?:(?:bearer|basic)\s{1,4})?(?:\"([^\"\n]{1,4096})\"|'([^'\n]{1,4096})'|([^\s\"'&<>(){}\[\],;:=][^\s\"'&<>(){}\[\],;]{0,4095}(?<![.:])))")
BEFORE = 48
SAMPLE = 20_000
ACCEPT = 0.5
#: Words of the corpus that count as covered text.
SHORTEST = 4
NAMES = re.compile(r"(?i)(secret|token|passw|pwd|api_?-?key|access|auth|credential|private)")
ASSIGNED = re.compile(r"(?i)([A-Za-z_-]*(?:secret|token|passw|pwd|key|auth|credential)[A-Za-z0-9_-]*)[\"']?\s*[:=]\s*[\"']?$")
FORMS = (("hex", re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$")), ("key", re.compile(r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$")), ("mixed", re.compile(r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]{20,}$")))
FEATURES = ("length", "changes", "repeats", "entropy", "digits", "upper", "hex", "symbols", "covered", "path", "quoted", "assigned_sign", "word_before", "name_before", "word_after")


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def coverage(text: str, known: set[str]) -> float:
    """Share of the characters that known words cover, longest first from the left."""
    low, at, covered = text.lower(), 0, 0
    while at < len(low):
        for size in range(min(12, len(low) - at), SHORTEST - 1, -1):
            if low[at : at + size] in known:
                covered, at = covered + size, at + size
                break
        else:
            at += 1
    return covered / len(text)


def describe(text: str, start: int, end: int, known: set[str]) -> list[float]:
    c, prev, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + BEFORE]
    kinds, n = [kind_of(x) for x in c], end - start
    words = re.findall(r"[A-Za-z]+", prev)
    following = re.findall(r"[A-Za-z]+", after)
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(a == b for a, b in zip(c, c[1:])) / n,
        -sum(v / n * math.log2(v / n) for v in Counter(c).values()), kinds.count(0) / n, kinds.count(2) / n,
        sum(x in "0123456789abcdefABCDEF" for x in c) / n, kinds.count(3) / n, coverage(c, known), float(bool(re.search(r"[/\\.:]\S*$", prev)) or "/" in c),
        float(prev[-1:] in ("'", '"')), float(bool(re.search(r"[:=]\s*[\"']?$", prev))), float(words[-1].lower() in known) if words else -1.0,
        float(bool(NAMES.search(" ".join(words[-2:])))), float(following[0].lower() in known) if following else -1.0,
    ]


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a text, in order; of overlapping ones the assigned value, then the first."""
    found, last = [], 0
    for sign in SIGN.finditer(text):
        at = sign.start()
        if at >= last and TELLING.search(text, max(0, at - 2 * BEFORE), at) and (m := VALUE.match(text, at + 1)):
            k = m.lastindex
            found.append((m.start(k), m.end(k)))
            last = m.end(k)
    taken, at = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while name := LEADING.match(text, start, end):
            start = name.end()
        if end - start < 16:
            start = m.start()
        while at < len(found) and found[at][1] <= start:
            at += 1
        if not (at < len(found) and found[at][0] < end):
            taken.append((start, end))
    return sorted(found + taken)


def findings(docs: DataFrame, known: dict[str, int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Stored: doc_id, start, end, assigned, form, features of every candidate."""
    shared = docs.sparkSession.sparkContext.broadcast({w for w in known if len(w) >= SHORTEST})
    columns = {
        "start": ("int", pa.int32()), "end": ("int", pa.int32()), "assigned": ("boolean", pa.bool_()), "form": ("string", pa.string()), "features": ("array<double>", pa.list_(pa.float64())),
    }

    def work(texts: list[str | None]) -> pd.DataFrame:
        rows = []
        for at, text in enumerate(texts):
            for start, end in spans(text or ""):
                form = next((name for name, p in FORMS if p.match(text[start:end])), "other")
                rows.append((at, start, end, bool(ASSIGNED.search(text[max(0, start - BEFORE) : start])), form, describe(text, start, end, shared.value)))
        return pd.DataFrame(rows, columns=["at", *columns])

    return stored(map_texts(docs, id_column, text_column, columns, lambda: work))


def form_labels(found: DataFrame) -> DataFrame:
    """features, label, place.

    A key's own form is a secret wherever it stands; where it is assigned to a telling name, so is every known form and every
    value with digits that known words do not cover. Known words without digits that are assigned are none, nor is what is
    not assigned, has no known form, and has no digits or is a path of mostly known words. All else, such as
    unassigned hex and mixed runs, stays unlabelled.
    """
    feature = lambda name: F.col("features")[FEATURES.index(name)]
    other = ~F.col("assigned") & (F.col("form") == "other")
    plain = (feature("digits") == 0) | ((feature("path") == 1) & (feature("covered") >= 0.5))
    mixed = (F.col("form") != "other") | ((feature("digits") > 0) & (feature("covered") < 0.8))
    words = (F.col("form") == "other") & (feature("digits") == 0) & (feature("symbols") == 0) & (feature("covered") >= 0.8)
    label = F.when((F.col("form") == "key") | (F.col("assigned") & mixed), 1).when((other & plain) | (F.col("assigned") & words), 0)
    return found.select("features", label.alias("label"), F.xxhash64("doc_id", "start").alias("place")).where("label is not null")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> list[dict] | None:
    rows = sorted(bounded_sample(labelled, "place", sample).collect(), key=lambda r: (r["place"], r["label"], r["features"]))
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    return trees.forest(np.array([r["features"] for r in rows]), y)


def score(found: DataFrame, forest: list[dict] | None) -> DataFrame:
    """doc_id, start, end, form, score, secret."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            p = np.mean([trees.predict(t, x) for t in forest], axis=0) if forest else np.ones(len(x))
            kept = [batch.column(c) for c in ("doc_id", "start", "end", "form")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array(p >= ACCEPT)], ["doc_id", "start", "end", "form", "score", "secret"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "start", "end", "form", "features").mapInArrow(run, f"doc_id {kind}, start int, end int, form string, score double, secret boolean")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(docs, vocabulary(docs))
    return score(found, fit(form_labels(found)))
