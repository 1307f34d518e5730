"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every token is predicted from the SPAN tokens on each side: the embeddings of the neighbours, each turned by its
place, are summed into a hidden layer, and the token's probability is that of its class times that of the token
within the class (classes of equal size over the vocabulary by rank), so a prediction costs twice the root of the
vocabulary. A document's score is the sum of the log-probabilities of its tokens, each given both sides.

The vocabulary of the network are the commonest words of all documents, counted by Spark. All other words share OTHER
places of it, by hash, and a word's probability is that of its place, given both sides, times its own share of the place.
The shares come from the counts of all words of the corpus, a stored table that grows with the corpus, is joined by
word and never held whole; a word that the corpus lacks has the share of a single unseen word. So the probabilities of
all words sum to 1, no two words are merged, and junk scores below words that the corpus has often. What a
rarer word's neighbours tell about it is learned by place, not by word.

The network learns from all documents: in each
round every task trains a copy on its rows, in order, and the copies are averaged by their tokens in blocks of
parameters, so what is gathered grows with the number of tasks and no task holds more than one block of all
copies. Tokens are lower-cased words without the punctuation at their ends.

A NULL or empty text has no tokens: its sum is 0 and its mean NULL. A single token is predicted from empty
sides. Repeated rows are scored each; rows with NULL ids are scored too; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.base import map_texts, stored, table
from auditframe.llm.registry import query

#: Vocabulary, classes, places for other words, neighbours on a side, and the width of the hidden layer.
VOCABULARY, CLASSES, OTHER, SPAN, WIDTH = 4096, 64, 512, 2, 24
INSIDE = VOCABULARY // CLASSES
PAD = VOCABULARY
#: What is added to the count of every word outside the vocabulary, and the count of one that the corpus lacks.
UNSEEN = 0.5
STEP, RATE, ROUNDS = 16_384, 0.05, 1
#: Parameters that travel as one row.
BLOCK = 8192
#: Rows of a task's part that are trained on at a time.
SHAPES = {"E": (VOCABULARY + 1, WIDTH), "D": (2 * SPAN, WIDTH), "C": (WIDTH, CLASSES), "c": (CLASSES,), "W": (CLASSES, WIDTH, INSIDE), "w": (CLASSES, INSIDE)}
EDGE = string.punctuation


def word_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """word, n: how often each word stands in all documents; summed per batch before the shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, found = Counter(), Counter()
            for text in batch[text_column]:
                raw.update((text or "").lower().split())
            for token, n in raw.items():  # the ends are stripped once per token
                found[token.strip(EDGE)] += n
            found.pop("", None)
            yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"word": str, "n": "int64"})

    return docs.select(text_column).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame) -> dict[str, int]:
    """The commonest words and their numbers; the first numbers are the places of other words. At most VOCABULARY words come to the driver."""
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - OTHER).collect()
    return {r["word"]: OTHER + k for k, r in enumerate(top)}


def vocabulary(docs: DataFrame, text_column: str = "text") -> dict[str, int]:
    return commonest(word_counts(docs, text_column))


def shares(counts: DataFrame, known: dict[str, int]) -> tuple[DataFrame, np.ndarray]:
    """(stored: word, log_share of each word outside ``known`` in its place; by place the log-share of an unseen word).

    The share of a word that stands n times is (n + UNSEEN) / (all of the place + UNSEEN * (its words + 1)).
    """
    spark = counts.sparkSession
    words = spark.createDataFrame([(w,) for w in known], "word string")
    place = (F.crc32(F.col("word").cast("binary")) % OTHER).cast("int")
    rare = stored(counts.join(F.broadcast(words), "word", "left_anti").withColumn("place", place))
    sums = rare.groupBy("place").agg(F.sum("n").alias("total"), F.count("*").alias("words"))
    space = np.full(OTHER, UNSEEN)
    for r in sums.collect():  # a row per place
        space[r["place"]] = r["total"] + UNSEEN * (r["words"] + 1)
    by_place = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in enumerate(space)], "place int, space double"))
    return stored(rare.join(by_place, "place").select("word", F.log((F.col("n") + UNSEEN) / F.col("space")).alias("log_share"))), np.log(UNSEEN / space)


class Numbers(dict):
    """Tokens met (with the punctuation at their ends) and the numbers of their words; -1 for a token without a word."""

    def __init__(self, known: dict[str, int]):
        self.known = known

    def __missing__(self, token: str) -> int:
        w = token.strip(EDGE)
        value = self[token] = -1 if not w else self.known[w] if w in self.known else crc32(w.encode("utf-8", "surrogatepass")) % OTHER
        return value


class Encoder:
    """Words to numbers, with a bounded table of tokens met."""

    def __init__(self, known: dict[str, int]):
        self.met = Numbers(known)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.met) > 1 << 18:
            self.met.clear()
        return np.fromiter(map(self.met.__getitem__, tokens), np.int32, len(tokens))

    def __call__(self, text: str | None) -> np.ndarray:
        found = self.numbers((text or "").lower().split())
        return found[found >= 0]


def start(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.1, s) if k in "ECW" else np.full(s, 0.5) if k == "D" else np.zeros(s)).astype(np.float32) for k, s in SHAPES.items()}


def contexts(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, neighbours): the neighbours of each token, PAD beyond the ends of its text."""
    gap = np.full(SPAN, PAD, np.int32)
    flat = np.concatenate([gap, *[part for t in texts for part in (t, gap)]])
    at = np.flatnonzero(flat != PAD)
    return flat[at], np.stack([flat[at + o] for o in (*range(-SPAN, 0), *range(1, SPAN + 1))], axis=1)


#: By name, memory that steps use again: fresh pages for every temporary array cost more than the sums made in them.
SPACE: dict[tuple, np.ndarray] = {}


def space(name: str, rows: int, width: int, like: np.ndarray) -> np.ndarray:
    """An array of ``rows`` by ``width`` that holds anything, and holds it until the name is asked for again."""
    if rows > STEP:
        return np.empty((rows, width), like.dtype)
    if (name, like.dtype) not in SPACE:
        SPACE[name, like.dtype] = np.empty((STEP, width), like.dtype)
    return SPACE[name, like.dtype][:rows]


def raised(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, and one by its sum per row; the hidden layer is bounded, so the ceiling is never met in practice."""
    np.exp(np.minimum(z, 60, out=z), out=z)
    return 1 / (z @ np.ones(z.shape[1], z.dtype))


def forward(m: dict[str, np.ndarray], tokens: np.ndarray, near: np.ndarray):
    """Rows in order of class, their hidden layer, and the exponents of classes and of the tokens within, each with one by its sum."""
    order = np.argsort((tokens // INSIDE).astype(np.uint8), kind="stable")
    tokens, near = tokens[order], near[order]
    hidden, turned = (space(name, len(tokens), WIDTH, m["E"]) for name in ("hidden", "turned"))
    hidden[:] = 0
    for k in range(2 * SPAN):
        hidden += np.take(m["E"] * m["D"][k], near[:, k], axis=0, out=turned, mode="clip")
    np.tanh(hidden, out=hidden)
    by_class, inside = space("by_class", len(tokens), CLASSES, m["E"]), space("inside", len(tokens), INSIDE, m["E"])
    np.matmul(hidden, m["C"], out=by_class)
    by_class += m["c"]
    bounds, within = np.searchsorted(tokens // INSIDE, np.arange(CLASSES + 1)), np.empty(len(tokens), inside.dtype)
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            np.matmul(hidden[a:b], m["W"][c], out=inside[a:b])
            inside[a:b] += m["w"][c]
            within[a:b] = raised(inside[a:b])
    return order, tokens, near, hidden, by_class, raised(by_class), inside, within, bounds


def log_probability(m: dict[str, np.ndarray], tokens: np.ndarray, near: np.ndarray) -> np.ndarray:
    out = np.empty(len(tokens))
    for at in range(0, len(tokens), STEP):
        part = slice(at, at + STEP)
        order, t, _, _, by_class, one, inside, two, _ = forward(m, tokens[part], near[part])
        row = np.arange(len(t))
        # Only the shares of the tokens that stand there are worked out.
        out[at + order] = np.log(np.maximum(by_class[row, t // INSIDE] * one, 1e-12)) + np.log(np.maximum(inside[row, t % INSIDE] * two, 1e-12))
    return out


def learn(m: dict[str, np.ndarray], sums: dict[str, np.ndarray], tokens: np.ndarray, near: np.ndarray) -> None:
    """One Adagrad step on the mean log-likelihood of the tokens."""
    _, t, near, hidden, by_class, one, inside, two, bounds = forward(m, tokens, near)
    by_class *= one[:, None]
    inside *= two[:, None]
    n, row = len(t), np.arange(len(t))
    by_class[row, t // INSIDE] -= 1
    inside[row, t % INSIDE] -= 1
    g = {"C": hidden.T @ by_class / n, "c": by_class.mean(axis=0), "W": np.zeros(SHAPES["W"], np.float32), "w": np.zeros(SHAPES["w"], np.float32)}
    dh = np.matmul(by_class, m["C"].T, out=space("dh", n, WIDTH, m["E"]))
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            g["W"][c], g["w"][c] = hidden[a:b].T @ inside[a:b] / n, inside[a:b].sum(axis=0) / n
            dh[a:b] += inside[a:b] @ m["W"][c].T
    np.multiply(hidden, hidden, out=hidden)
    np.subtract(1, hidden, out=hidden)
    hidden /= n
    dh *= hidden
    g["D"], g["E"] = np.empty(SHAPES["D"], np.float32), np.zeros(SHAPES["E"], np.float32)
    part = space("part", n, WIDTH, m["E"])
    for k in range(2 * SPAN):
        np.take(m["E"], near[:, k], axis=0, out=part, mode="clip")
        g["D"][k] = np.multiply(dh, part, out=part).sum(axis=0)
        at = np.argsort(near[:, k].astype(np.uint16), kind="stable")
        ids = near[at, k]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        np.take(dh, at, axis=0, out=part, mode="clip")
        part *= m["D"][k]
        g["E"][ids[first]] += np.add.reduceat(part, first, axis=0)
    g["E"][PAD] = 0
    for k, d in g.items():
        sums[k] += d * d
        m[k] -= RATE * d / (np.sqrt(sums[k]) + 1e-7)


def flat_of(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in SHAPES])


def model_of(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[k], at = flat[at : at + size].reshape(shape).astype(np.float32), at + size
    return out


def train(docs: DataFrame, known: dict[str, int], rounds: int = ROUNDS, text_column: str = "text") -> dict[str, np.ndarray]:
    """The network after ``rounds`` of training on all documents."""
    spark, m = docs.sparkSession, start()
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((known, m))  # bounded by the vocabulary and the network's size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, first = shared.value
            own, encode, seen = {k: v.copy() for k, v in first.items()}, Encoder(known), 0
            sums = {k: np.full(s, 1e-8, np.float32) for k, s in SHAPES.items()}
            held, size = [], 0

            def step() -> None:
                tokens, near = contexts(held)
                for at in range(0, len(tokens), STEP):
                    learn(own, sums, tokens[at : at + STEP], near[at : at + STEP])

            for batch in batches:
                for text in batch["text"]:
                    held.append(encode(text))
                    size += len(held[-1])
                    if size >= 8 * STEP:
                        step()
                        seen, held, size = seen + size, [], 0
            if size:
                step()
                seen += size
            if seen:
                flat = flat_of(own)
                blocks = [flat[at : at + BLOCK] for at in range(0, len(flat), BLOCK)]
                yield pd.DataFrame({"block": np.arange(len(blocks)), "tokens": seen, "values": [b.tobytes() for b in blocks]})

        def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Blocks arrive in order; of all copies of a block only the running sum is held.
            at, total, weight = None, None, 0
            for batch in batches:
                for block, n, raw in zip(batch["block"], batch["tokens"], batch["values"]):
                    values = np.frombuffer(raw, np.float32).astype(np.float64) * n
                    if block == at:
                        total, weight = total + values, weight + n
                        continue
                    if at is not None:
                        yield pd.DataFrame({"block": [at], "values": [(total / weight).astype(np.float32).tobytes()]})
                    at, total, weight = block, values, n
            if at is not None:
                yield pd.DataFrame({"block": [at], "values": [(total / weight).astype(np.float32).tobytes()]})

        copies = stored(docs.select(F.col(text_column).alias("text")).mapInPandas(run, "block long, tokens long, values binary"))
        averaged = copies.repartition("block").sortWithinPartitions("block", "tokens", "values").mapInPandas(mean, "block long, values binary")
        rows = sorted(averaged.collect())  # as many as the network has blocks
        if rows:
            m = model_of(np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]))
    return m


def score(
    docs: DataFrame, known: dict[str, int], model: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text", counts: DataFrame | None = None,
) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum), mean (per token).

    ``counts`` are the stored word_counts of the corpus; without them a word outside ``known`` is scored as its place.
    """
    log_shares, unseen = shares(counts, known) if counts is not None else (None, np.zeros(OTHER))
    shared = docs.sparkSession.sparkContext.broadcast((known, model))
    columns = {"n_tokens": ("long", pa.int64()), "log_likelihood": ("double", pa.float64())}
    if counts is not None:
        columns["rare"] = ("string", pa.string())

    def make():
        known, m = shared.value
        encode = Encoder(known)

        def rare(tokens: list[str], found: np.ndarray) -> str | None:
            """The words outside the vocabulary and how often each stands, as lines: one string takes far less memory than lists."""
            words = Counter(tokens[k].strip(EDGE) for k in np.flatnonzero((found >= 0) & (found < OTHER)))
            return "\n".join(f"{w}\t{n}" for w, n in words.items()) or None

        def work(texts: list[str | None]) -> dict[str, list]:
            out, lines = [(np.zeros(0, np.int64), np.zeros(0))], []
            for at in range(0, len(texts), 64):
                coded = []
                for text in texts[at : at + 64]:
                    tokens = (text or "").lower().split()
                    found = encode.numbers(tokens)
                    if counts_given:
                        lines.append(rare(tokens, found))
                    coded.append(found[found >= 0])
                sizes = np.array([len(t) for t in coded])
                p = log_probability(m, *contexts(coded))
                out.append((sizes, np.add.reduceat(np.append(p, 0.0), np.minimum(np.cumsum(sizes) - sizes, len(p))) * (sizes > 0)))
            made = dict(zip(columns, (np.concatenate([o[k] for o in out]) for k in (0, 1))))
            if counts_given:
                made["rare"] = lines
            return made

        return work

    counts_given = counts is not None
    rows = map_texts(docs, id_column, text_column, columns, make)
    if counts is not None:
        rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "*"))
        line = F.split("line", "\t")
        each = rows.select("row", F.explode(F.split("rare", "\n")).alias("line")).select("row", line[0].alias("word"), line[1].cast("long").alias("times"))
        of_place = F.lit(unseen.tolist())[(F.crc32(F.col("word").cast("binary")) % OTHER).cast("int")]
        own = each.join(log_shares, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.coalesce("log_share", of_place)).alias("own"))
        rows = rows.select("row", "doc_id", "n_tokens", "log_likelihood").join(own, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("own", F.lit(0.0)))
    return rows.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean"))


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stored(word_counts(docs))
    known = commonest(counts)
    return score(docs, known, train(docs, known), counts=counts)
