"""Quality of documents by a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on the statistics of labelled documents; every path from a root to a node is a
conjunctive rule. A logistic model with an L1 penalty weighs the rules (and drops most of them); what stays is compiled
into one Spark expression over the statistics, so scoring is a projection of the scan.

The ensemble is fitted on the driver from at most SAMPLE labelled documents, the first by a hash of their id;
all documents are scored over their whole text. A NULL or empty text has zero for every statistic and is scored by the
rules that hold then. Repeated rows are scored each; rows with NULL ids are scored too. With no labelled documents, or one
label only, the score is that label's share (1 without any). Labels that are NULL or of NULL ids are not used; other columns
are not read.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import trees
from auditframe.llm.base import crc_mod, stored, table, text_of
from auditframe.llm.registry import query

SAMPLE = 8000
ROUNDS, DEPTH = 24, 3
PENALTY = 2e-3
STATISTICS = (
    "chars", "words", "lines", "word_chars", "line_words", "letters", "capitals", "digits", "symbols", "exclamations", "bars", "stops",
    "distinct_words", "distinct_lines", "longest_word",
)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and a double per name in STATISTICS; shares lie between 0 and 1."""
    texts = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("_t"))
    parts = texts.select(
        "doc_id", F.length("_t").alias("_n"), F.split("_t", r"\s+").alias("_w"), F.split("_t", r"\n+").alias("_l"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).alias("_letters"), F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).alias("_capitals"),
        F.length(F.regexp_replace("_t", r"[^#$%&*|<>{}=_~^\\@+\[\]!.0-9]+", "")).alias("_marks"),
        F.regexp_replace("_t", r"[^#$%&*|<>{}=_~^\\@+\[\]!.0-9]+", "").alias("_m"),
    )
    without = lambda pattern: F.col("_marks") - F.length(F.regexp_replace("_m", pattern, ""))
    counted = parts.select(
        "doc_id", "_n", "_letters", "_capitals", F.size("_w").alias("_words"), F.size("_l").alias("_lines"),
        F.size(F.array_distinct("_w")).alias("_dw"), F.size(F.array_distinct("_l")).alias("_dl"),
        F.array_max(F.transform("_w", F.length)).alias("_longest"),
        without("[0-9]+").alias("_digits"), without(r"[^!.0-9]+").alias("_symbols"), without("!+").alias("_exclamations"),
        without(r"\|+").alias("_bars"), without(r"\.+").alias("_stops"),
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))
    some = F.when(F.col("_n") > 0, 1.0).otherwise(0.0)
    return counted.select(
        "doc_id", F.col("_n").cast("double").alias("chars"), (F.col("_words") * some).alias("words"), (F.col("_lines") * some).alias("lines"),
        share("_n", "_words").alias("word_chars"), (share("_words", "_lines") * some).alias("line_words"),
        share("_letters", "_n").alias("letters"), share("_capitals", "_letters").alias("capitals"), share("_digits", "_n").alias("digits"),
        share("_symbols", "_n").alias("symbols"), share("_exclamations", "_n").alias("exclamations"), share("_bars", "_n").alias("bars"),
        share("_stops", "_n").alias("stops"), (share("_dw", "_words") * some).alias("distinct_words"), (share("_dl", "_lines") * some).alias("distinct_lines"),
        F.col("_longest").cast("double").alias("longest_word"),
    )


def paths(tree: dict, held: tuple = ()) -> list[tuple]:
    """The rule of every node below the root: a tuple of (feature, "<=" or ">", value)."""
    found = [held] if held else []
    if "value" in tree:
        return found
    f, at = tree["feature"], tree["at"]
    return found + paths(tree["low"], (*held, (f, "<=", at))) + paths(tree["high"], (*held, (f, ">", at)))


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, side, at in rule:
        ok &= x[:, f] <= at if side == "<=" else x[:, f] > at
    return ok


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) of an L1-penalised logistic model by accelerated proximal gradient steps."""
    z1 = np.hstack([np.ones((len(z), 1)), z])
    lipschitz = 0.25 * np.linalg.norm(z1, 2) ** 2 / len(y)
    w, momentum, t = np.zeros(z1.shape[1]), np.zeros(z1.shape[1]), 1.0
    for _ in range(steps):
        gradient = z1.T @ (1 / (1 + np.exp(-z1 @ momentum)) - y) / len(y)
        new = momentum - gradient / lipschitz
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / lipschitz, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> dict:
    """{"bias", "rules": [(weight, rule)]}"""
    grown = trees.boost(x, y, rounds=ROUNDS, depth=DEPTH, least=10)
    rules = list(dict.fromkeys(r for tree in grown["trees"] for r in paths(tree)))
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))
    distinct = np.unique(z, axis=1, return_index=True)[1] if rules else []
    rules, z = [rules[i] for i in sorted(distinct)], z[:, sorted(distinct)]
    bias, weights = lasso(z, y)
    return {"bias": bias, "rules": [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6]}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The ensemble of ``labels`` (doc_id, label 0 or 1); {"share"} alone when they hold one label or none."""
    usable = labels.where("doc_id is not null and label in (0, 1)").select(F.col("doc_id").alias("_id"), "label")
    chosen = stored(usable.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample))
    # At most ``sample`` ids: a bounded broadcast.
    taught = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = statistics(taught.select("doc_id", "text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "label", *STATISTICS).collect()
    rows.sort(key=tuple)
    y = np.array([r["label"] for r in rows], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return {"share": float(y.mean()) if len(y) else 1.0}
    return fit_rules(np.array([[r[c] for c in STATISTICS] for r in rows], float), y)


def score_column(model: dict) -> Column:
    """The score as an expression over the statistics."""
    if "share" in model:
        return F.lit(model["share"])
    z = F.lit(model["bias"])
    for weight, rule in model["rules"]:
        held = F.lit(True)
        for f, side, at in rule:
            held = held & ((F.col(STATISTICS[f]) <= at) if side == "<=" else (F.col(STATISTICS[f]) > at))
        z = z + F.when(held, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row."""
    return statistics(docs).select("doc_id", score_column(model).alias("score"))


def keep_good(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The documents that score at least ``least``, columns unchanged; one pass without a shuffle."""
    # The whole row travels in the place of the id.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    # A filter on the score alone would be moved below the statistics and compute each of them once per rule; it isn't
    # moved below a row number that it reads.
    kept = score(row, model).withColumn("_row", F.monotonically_increasing_id()).where((F.col("score") >= least) & (F.col("_row") >= 0))
    return kept.select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
