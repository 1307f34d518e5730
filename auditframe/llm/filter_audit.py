"""How the filters of a corpus interact, in every order in which they could be applied.

Filters on a document alone are columns. The filter on copies is an existential self-join: a left-semi join on the
hash, the exact text and a smaller id marks every text that a row with a smaller id holds too. The join's other side is
one row per text, its smallest id, aggregated before the shuffle, so a large group of copies is neither multiplied nor
gathered. The ids it marks and those that fail a column are united, and an aggregation by id makes one combination of
bits per document. Everything after that is counted on combinations, of which there are 2^filters per part, and
never on documents: an order of filters only regroups them.

NULL counts as the empty text, a NULL part as the empty string, a NULL condition as passed. Rows without an id have no smaller id and are nobody's, so
the filter on copies passes them by. Repeated rows are counted each; a row is no copy of one with the same id. A document
without a label is neither good nor toxic; of several labels one is enough. An empty table gives an empty
result. Columns of other names are not read.
"""
from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.base import stored, table, text_of
from auditframe.llm.registry import query

WORD_BREAK = r"[\x20\x09-\x0D]+"


def text_filters() -> dict[str, Column]:
    """When a text fails, over columns ``text``, ``words`` and ``n_words``: too short, repetitive, loud, marked up."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.col("n_words"),
        "C": 100 * (F.char_length("text") - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))) > 3 * F.char_length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def copies(docs: DataFrame) -> DataFrame:
    """doc_id and hash of the rows of ``docs`` (doc_id, text, hash) whose text a row with a smaller id holds too.

    Only texts whose hash and length stand in several rows travel.
    """
    known = docs.where("doc_id is not null").select("doc_id", "hash", F.octet_length("text").alias("size"), "text")
    again = known.groupBy("hash", "size").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    again = stored(again.select("hash", "size"))
    rows = stored(known.join(again, ["hash", "size"], "left_semi"))
    # Stored, so that the join reads two shuffles and Spark can split a text that very many rows hold.
    first = stored(rows.groupBy("hash", "text").agg(F.min("doc_id").alias("first"))).alias("f")
    r = rows.alias("r")
    smaller = (F.col("r.hash") == F.col("f.hash")) & (F.col("r.text") == F.col("f.text")) & (F.col("f.first") < F.col("r.doc_id"))
    return r.join(first, smaller, "left_semi").select("doc_id", "hash")


def combinations(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies_letter: str, part_column: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """part, mask (a bit per failed filter, in the order of the letters), n, good, toxic: one row per combination."""
    letters = [*filters, copies_letter]
    texts = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.col(f"`{part_column}`").cast("string"), F.lit("")).alias("part"), text_of(f"`{text_column}`").alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    words = texts.withColumn("words", F.array_remove(F.split("text", WORD_BREAK), "")).withColumn("n_words", F.size("words"))
    bits = sum((F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(filters.values())), F.lit(0))
    rows = stored(words.select("doc_id", "hash", "part", bits.alias("bits")))
    failures = rows.where("bits > 0").select("doc_id", "hash", "bits").unionByName(
        copies(texts.select("doc_id", "text", "hash")).select("doc_id", "hash", F.lit(1 << len(filters)).alias("bits"))
    )
    masks = failures.groupBy("doc_id", "hash").agg(F.bit_or("bits").alias("mask"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic")
    )
    r, m = rows.alias("r"), masks.alias("m")
    known = r.join(m, F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.hash") == F.col("m.hash")), "left")
    known = known.join(flags, F.col("r.doc_id") == F.col("labelled"), "left")
    return known.groupBy("part", F.coalesce("mask", F.lit(0)).alias("mask")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def orders(counts: DataFrame, letters: str) -> DataFrame:
    """Counts of every part, order of the filters and step, from the counts of combinations.

    Of all orders, a filter removes a document first in as many as there are orders, divided by the number of filters
    that the document fails.
    """
    every = ["".join(p) for p in permutations(letters)]
    bit = lambda letter: sum((F.when(letter == c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(letters)), F.lit(0))
    before = sum((F.when(F.instr(F.expr("substring(filter_order, 1, step - 1)"), c) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(letters)), F.lit(0))
    steps = counts.select("*", F.explode(F.split(F.lit(",".join(every)), ",")).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    steps = steps.withColumn("own", bit(F.expr("substring(filter_order, step, 1)"))).withColumn("before", before)
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    of = lambda column, held: F.sum(F.when(held, F.col(column)).otherwise(F.lit(0).cast("long")))
    share = F.when(fails, F.expr(f"n * {len(every)} div bit_count(mask)")).otherwise(F.lit(0).cast("long"))
    return steps.groupBy("part", "filter_order", "step").agg(
        of("n", ~fails & ~earlier).alias("kept"), of("n", fails & ~earlier).alias("removed"), of("n", fails & earlier).alias("redundant"),
        of("n", F.col("mask") == F.col("own")).alias("unique_fails"), of("good", fails & ~earlier).alias("good_lost"),
        of("toxic", fails & ~earlier).alias("toxic_lost"), F.sum(share).alias("shapley"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies_letter: str = "E", part_column: str = "lang") -> DataFrame:
    """part, filter_order, step and the counts of ``orders``; one letter names each filter."""
    filters = text_filters() if filters is None else filters
    counts = stored(combinations(docs, labels, filters, copies_letter, part_column))
    return orders(counts, "".join([*filters, copies_letter]))


@query("op13_filter_audit", r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS x FROM d
), g AS (
  SELECT part, x, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM f LEFT JOIN labels USING (doc_id) GROUP BY ALL
), k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT g.*, filter_order, step, x[ascii(filter_order[step]) - 64] AS fails,
    list_bool_or([false] || [x[ascii(filter_order[j]) - 64] FOR j IN range(1, step)]) AS earlier, len(list_filter(x, lambda v: v)) AS failed
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), c AS (
  SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM c
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
