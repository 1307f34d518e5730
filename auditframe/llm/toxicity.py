"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is the logistic of a bias and the weights of its words (the word
itself and its beginnings, hashed into BUCKETS); a document is toxic unless all of its sentences are clean: noisy-or,
1 - product(1 - p). Only documents are labelled; the gradient reaches sentences through the noisy-or, so
the sentences to blame are found without ever having been marked.

The model is fitted on the driver from at most SAMPLE labelled documents of each label, the first by a hash of
their id; each label is weighted by the root of its share among all labelled rows. Scoring covers every sentence of every
whole text in Arrow batches; a task holds one batch and a bounded table of word weights.

A NULL or empty text has no sentence: its score is 0 and it has no offending sentences. A text without words
scores as sentences of the bias alone. Repeated rows are scored each; rows with NULL ids are scored too. With no
labelled documents, or one label only, the score is that label's share (0 without any). Labels that are NULL or of
NULL ids are not used. Other columns are not read.
"""
from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.base import crc_mod, map_texts, stored, table
from auditframe.llm.registry import query

BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6)
SAMPLE = 2500
STEPS = 250
#: Features of fewer sampled documents get no weight: they could only be learnt by heart.
LEAST_BAGS = 4
#: A worker's table of word weights starts anew beyond this many words.
TABLE = 1 << 18
OFFENDING = 0.3

WORDS = re.compile(r"[^\W\d_]+")
#: A sentence ends behind . ! or ? before white space, or at a line end.
BORDER = re.compile(r"(?<=[.!?])\s+|\n+")


def word_features(word: str) -> list[int]:
    marks = {"=" + word} | {f"{n}^{word[:n]}" for n in BEGINNINGS if len(word) >= n}
    return [crc32(m.encode("utf-8", "surrogatepass")) % BUCKETS for m in marks]


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence that is not blank, in code points."""
    found, at = [], 0
    for border in BORDER.finditer(text or ""):
        if text[at : border.start()].strip():
            found.append((at, border.start()))
        at = border.end()
    if (text or "")[at:].strip():
        found.append((at, len(text)))
    return found


def fit_weights(texts: list[str], y: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = 0.15, shrink: float = 0.01) -> tuple[float, np.ndarray]:
    """(bias, weights): full-batch Adam on the noisy-or likelihood of the bags.

    With s = -log(1 - p_document) = sum of softplus(z) over the sentences, the gradient of the
    log-likelihood of a toxic bag by z is logistic(z) * exp(-s) / (1 - exp(-s)), of a clean one -logistic(z).
    """
    ids: dict[str, int] = {}
    words_of, ends, bags = array("i"), [], []
    for bag, text in enumerate(texts):
        for start, end in sentences(text):
            words_of.extend([ids.setdefault(word, len(ids)) for word in WORDS.findall(text[start:end].lower())])
            ends.append(len(words_of))
            bags.append(bag)
    # Occurrences of words with their sentences, and the features of each word: a sentence is never expanded into features.
    word, bags = np.array(words_of, np.int64), np.array(bags, np.int64)
    sizes = np.diff(np.array([0, *ends], np.int64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    marks = [word_features(w) for w in ids]
    lengths = np.array([len(m) for m in marks], np.int64)
    flat = np.array([f for m in marks for f in m], np.int64)
    owner = np.repeat(np.arange(len(marks)), lengths)
    # In how many documents each feature stands.
    pairs = np.unique(bags[row] * max(1, len(ids)) + word)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    of = pairs % max(1, len(ids))
    inner = np.arange(lengths[of].sum()) - np.repeat(np.cumsum(lengths[of]) - lengths[of], lengths[of])
    seen = np.unique(np.repeat(pairs // max(1, len(ids)), lengths[of]) * BUCKETS + flat[np.repeat(first[of], lengths[of]) + inner])
    common = np.bincount(seen % BUCKETS, minlength=BUCKETS) >= LEAST_BAGS
    del pairs, of, inner, seen
    flat, owner = flat[common[flat]], owner[common[flat]]
    w, bias = np.zeros(BUCKETS), -4.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, np.bincount(owner, w[flat], len(marks))[word], len(sizes))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        s = np.bincount(bags, np.logaddexp(0, z), len(texts))
        up = np.exp(-s) / np.maximum(1 - np.exp(-s), 1e-9)
        dz = p * np.where(y > 0, np.minimum(up, 1e3), -1.0)[bags] * weight[bags]
        g = np.bincount(flat, np.bincount(word, dz[row], len(marks))[owner], BUCKETS) / len(texts)
        gb = dz.sum() / len(texts)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w += rate * (m / c1) / (np.sqrt(v / c2) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)  # what does not move steadily goes back to zero
        bias += rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return bias, w.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """{"share"} of label 1 among the labelled rows, and with both labels {"bias", "weights"}.

    ``labels`` has doc_id and label (0 or 1).
    """
    usable = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not counts.get(0) or not counts.get(1):
        return {"share": share}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [usable.where(F.col("label") == label).orderBy(order, "doc_id").limit(sample) for label in (0, 1)]
    chosen = stored(parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "_id"))
    # At most 2 * sample ids: a bounded broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    y = np.array([r["label"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return {"share": share}
    # Halfway between equal labels and their shares: a missed toxic document weighs more than a false alarm.
    ratio = {1: (share / y.mean()) ** 0.5, 0: ((1 - share) / (1 - y.mean())) ** 0.5}
    bias, weights = fit_weights([r["text"] or "" for r in rows], y, np.array([ratio[int(v)] for v in y]))
    return {"share": share, "bias": bias, "weights": weights}


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, offending array<struct<start, end, score>> (code points)."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    columns = {"score": ("double", pa.float64()), "n_sentences": ("int", pa.int32()), "offending": ("array<struct<start:int,end:int,score:double>>", pa.list_(span))}

    def make():
        known: dict[str, float] = {}
        weights = model.get("weights")

        def weigh(word: str) -> float:
            value = known[word] = float(weights[word_features(word)].sum())
            return value

        def work(texts: list[str | None]) -> pd.DataFrame:
            out = []
            if len(known) > TABLE:
                known.clear()
            for text in texts:
                spans = sentences(text)
                if weights is None:
                    out.append((model["share"] if spans else 0.0, len(spans), []))
                    continue
                lower, z = text and text.lower(), np.empty(len(spans))
                same = not spans or len(lower) == len(text)  # a few characters change their number in lower case
                for k, (start, end) in enumerate(spans):
                    words = WORDS.findall(lower[start:end] if same else text[start:end].lower())
                    z[k] = sum([known[w] if w in known else weigh(w) for w in words])
                z = np.clip(z + model["bias"], -40, 40)
                p = 1 / (1 + np.exp(-z))
                bad = [{"start": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in np.flatnonzero(p >= OFFENDING)]
                out.append((float(1 - np.exp(-np.logaddexp(0, z).sum())), len(spans), bad))
            return pd.DataFrame(out, columns=list(columns))

        return work

    return map_texts(docs, id_column, text_column, columns, make)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_sentences", F.size("offending").alias("n_offending")
    )
