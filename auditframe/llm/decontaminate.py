"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of postings: a row (term, doc_id, pos, before, after) for each place of an indexed
term in a training text, with the words on both sides, and one end mark per document, which gives its number of
words. Only terms that a search starts from need postings: of every window of a test item the rarest term, by
counts over all training texts. A search joins the postings with the starting terms on the term, and intersects
with the rest of the window by comparing the offset-adjusted neighbours; a run of equal words that
is as long as the window is an exact phrase match. Proximity matches are postings of two terms of a window that
lie within a distance, joined on the document and the block of positions.

A word is lower-cased in A-Z and consists of letters, digits or characters beyond ASCII. A window has ``width``
consecutive words of an item; an item of fewer words, but not none, is one window. NULL and empty texts have no
words: such a document has n_words 0 and no hits, such an item no windows. Repeated document rows of one id count
as one document for hits; repeated items are one item for the list. Rows with NULL ids keep their text statistics
and are matched as the id NULL. Empty tables give no hits or an empty result. Other columns are not read.
Built from DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm.base import ascii_lower, fresh, row_identity, small_side, stored, table, text_of
from auditframe.llm.registry import query

WIDTH = 10
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Starting terms (rows of one word and its neighbours) up to which the counted table may be broadcast: some 40 MB.
TERM_ROWS = 1 << 17


def padded_words(text: Column) -> Column:
    """The words with an empty string before the first and after the last one."""
    return F.split(F.concat(F.lit(" "), ascii_lower(text), F.lit(" ")), BREAK)


def item_words(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id, words, count: each item once, items without words left out."""
    padded = items.select(F.col(id_column).alias("item_id"), padded_words(text_of(text_column)).alias("w")).distinct()
    rows = padded.select("item_id", F.expr("slice(w, 2, size(w) - 2)").alias("words"), (F.size("w") - 2).alias("count"))
    return rows.where("count > 0")


def term_counts(docs: DataFrame, terms: DataFrame, text_column: str = "text") -> DataFrame:
    """term, n: how often each of the terms stands in all texts; a term that never does has no row."""
    words = docs.select(F.explode(padded_words(text_of(text_column))).alias("term"))
    return words.join(small_side(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def starts(items: DataFrame, counts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Places of items from which a search starts: in each window the rarest term.

    term, item_id, start (its place), count, and up to ``width - 1`` words before (nearest first) and after. A
    window with a term that no text has is left out: it occurs nowhere.
    """
    places = items.select("item_id", "words", "count", F.posexplode("words").alias("start", "term"))
    placed = places.join(counts, "term", "left").select(
        "item_id", "words", "count", F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "term", "start").alias("place")
    )
    # An item's places, in order; items are bounded pieces of text.
    per_item = placed.groupBy("item_id", "words", "count").agg(F.array_sort(F.collect_list(F.struct(F.col("place.start").alias("at"), "place"))).alias("places"))
    windows = per_item.select(
        "item_id", "words", "count",
        F.explode(F.expr(f"transform(sequence(1, greatest(count - {width} + 1, 1)), i -> array_min(transform(slice(places, i, {width}), p -> p.place)))")).alias("rarest"),
    )
    chosen = windows.where("rarest.n > 0").select("item_id", "words", "count", "rarest.term", "rarest.start").distinct()
    return chosen.select("term", "item_id", "start", "count", *neighbours(F.col("words"), F.col("start"), width))


def neighbours(words: Column, at: Column, width: int) -> tuple[Column, Column]:
    """The words before place ``at`` (from 0), nearest first, and those after it, at most width - 1 each."""
    reach = F.lit(width - 1)
    before = F.reverse(F.slice(words, F.greatest(at - reach, F.lit(0)) + 1, F.least(at, reach)))
    after = F.slice(words, at + 2, reach)
    return before.alias("before"), after.alias("after")


def build_index(docs: DataFrame, terms: DataFrame, width: int = WIDTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stored postings of ``terms`` in all texts, and an end mark (the empty term) behind each text's last word."""
    wanted = terms.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    words = docs.select(F.col(id_column).alias("doc_id"), padded_words(text_of(text_column)).alias("words"))
    places = words.select("doc_id", "words", F.posexplode("words").alias("pos", "term")).where("pos > 0")
    hits = places.join(small_side(stored(wanted)), "term", "left_semi")
    return stored(hits.select("term", "doc_id", "pos", *[
        F.when(F.col("term") != "", side).alias(name) for side, name in zip(neighbours(F.col("words"), F.col("pos"), width), ("before", "after"))
    ]))


def agreeing(ours: Column, theirs: Column) -> Column:
    """How many leading words of two arrays are equal."""
    same = F.zip_with(ours, theirs, lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def phrase_hits(index: DataFrame, searches: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, first, last: places of words (from 1) inside occurrences of a window, a row per starting place."""
    found = index.where("term != ''").alias("p").join(small_side(searches, TERM_ROWS).alias("s"), "term").select(
        "p.doc_id", "s.item_id", "p.pos", "s.count",
        agreeing(F.col("p.before"), F.col("s.before")).alias("left"), agreeing(F.col("p.after"), F.col("s.after")).alias("right"),
    )
    long_enough = F.col("left") + F.col("right") + 1 >= F.least(F.col("count"), F.lit(width))
    return found.where(long_enough).select("doc_id", "item_id", (F.col("pos") - F.col("left")).alias("first"), (F.col("pos") + F.col("right")).alias("last"))


def proximity_hits(index: DataFrame, left: str, right: str, distance: int) -> DataFrame:
    """doc_id, left_pos, right_pos: places of two indexed terms at most ``distance`` words apart, in either order.

    Positions are cut into blocks of distance + 1, so that only neighbouring blocks of one document meet.
    """
    block = F.floor(F.col("pos") / F.lit(distance + 1))
    a = index.where(F.col("term") == left).select("doc_id", F.col("pos").alias("left_pos"), block.alias("block"))
    b = index.where(F.col("term") == right).select(
        "doc_id", F.col("pos").alias("right_pos"), F.explode(F.array(block - 1, block, block + 1)).alias("block")
    )
    return a.join(b, ["doc_id", "block"]).where(F.abs(F.col("left_pos") - F.col("right_pos")) <= distance).select("doc_id", "left_pos", "right_pos").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), one row per row of ``docs``."""
    wanted = stored(item_words(items))
    counts = stored(term_counts(docs, stored(wanted.select(F.explode("words").alias("term")).distinct())))
    searches = stored(starts(wanted, counts, width))
    index = build_index(docs, searches, width)
    hits = stored(phrase_hits(index, searches, width).distinct())
    # A document has a row per hit place, summed by task before the shuffle.
    places = hits.select("doc_id", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    n_hit = places.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    item_ids = hits.select("doc_id", F.col("item_id").cast("string").alias("item_id")).distinct().groupBy("doc_id").agg(
        F.array_sort(F.collect_list("item_id")).alias("item_ids")  # at most the items of the benchmark
    )
    item_ids = item_ids.withColumnRenamed("doc_id", "_id")
    found = stored(n_hit.join(item_ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("_id", "n_hit", "item_ids"))
    ends = index.where("term = ''").select("doc_id", (F.col("pos") - 1).cast("long").alias("n_words"))
    return ends.join(small_side(found, TERM_ROWS), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any hit, columns unchanged. Rows are known by id and text: NULL ids are judged by their text,
    and of two texts under one id only the one with a hit goes."""
    own, key = fresh(docs, "_own"), fresh(docs, "_bad")
    known = docs.select(row_identity("doc_id", "text").alias("doc_id"), "text")
    bad = stored(contamination(known, items, width).where("n_hit > 0").select(F.col("doc_id").alias(key)).distinct())
    kept = docs.withColumn(own, row_identity("doc_id", "text")).join(small_side(bad), F.col(own).eqNullSafe(F.col(key)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_benchmark_decontamination", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, (SELECT DISTINCT width FROM windows))
), hits AS (SELECT doc_id, i, width, item_id FROM grams JOIN windows USING (width, gram)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
""")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
