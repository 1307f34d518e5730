"""Leak checks: what must not be published, and text shared between training and test material."""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions import digest_tree
from auditframe.functions.ordered import union_all
from auditframe.functions.text import WORD_OR_APOSTROPHE, shingle_rows, tokens
from auditframe.session import materialise

# Patterns of secrets.
SECRET_PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"sk-[A-Za-z0-9]{20,}",
    r"ghp_[A-Za-z0-9]{36}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"cfat_[A-Za-z0-9]{20,}",
    r"-----BEGIN (?:RSA|OPENSSH|EC|PGP) PRIVATE KEY-----",
    r"AIza[0-9A-Za-z_-]{35}",
    r"(?i)authorization:\s*bearer\s+[A-Za-z0-9._-]{16,}",
)
# Patterns of machine-local paths.
INTERNAL_PATTERNS = (r"/home/[a-z]+/", r"/mnt/[ce]/", r"/Users/[A-Za-z]+/", r"(?i)C:\\\\Users\\\\")
# Keys a model must never return, and the name of evaluator-only files.
FORBIDDEN_OUTPUT_KEYS = ("final_state", "reward_traps", "hidden_state", "mutations")
GOLD_NAME = r"(?i)oracle|private[-_]gold"


# --- schemas and JSON keys -----------------------------------------------------
def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Dotted names of all fields of a schema, at any depth."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            path = f"{prefix}{f.name}"
            out += [path, *field_paths(f.dataType, path + ".")]
        return out
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix)
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, prefix)
    return []


def safe_projection(df: DataFrame, allowed: Iterable[str], forbidden: Iterable[str]) -> DataFrame:
    """Allowed columns only; raises when a forbidden name is left at any depth."""
    out = df.select(*allowed)
    names = {part for path in field_paths(out.schema) for part in path.split(".")}
    caught = sorted(names & set(forbidden))
    if caught:
        raise ValueError(f"forbidden fields in a public projection: {caught}")
    return out


def has_forbidden_key(json_text: Column, keys: Iterable[str]) -> Column:
    """True when a key occurs at any depth of a JSON text, also when its name is written with escapes."""
    pattern = '"(' + "|".join(keys) + r')"\s*:'
    written_anew = F.coalesce(F.to_json(F.try_parse_json(json_text)), F.lit(""))
    return json_text.rlike(pattern) | written_anew.rlike(pattern)


def has_forbidden_top_key(json_text: Column, keys: Iterable[str]) -> Column:
    """True when a key occurs at the top level of a JSON object."""
    return F.coalesce(
        F.arrays_overlap(F.json_object_keys(json_text), F.array(*[F.lit(k) for k in keys])), F.lit(False)
    )


# --- needles in texts -------------------------------------------------------------
def shaped_leaks(texts: DataFrame, key: str, text: str, needles: DataFrame, shape: str) -> DataFrame:
    """(key, needle) for needles of one shape found in texts.

    Tokens of the shape are extracted from each text and matched by an equi-join, so
    no text is compared with every needle.
    """
    tokens = texts.select(
        key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({shape})"), F.lit(1)))).alias("needle")
    )
    return tokens.join(needles.select("needle").distinct(), "needle", "left_semi").select(key, "needle")


TOKEN = "[A-Za-z0-9]+"
#: Rows of keys up to which a stored, counted list of them is broadcast, so that texts need not move; beyond it Spark decides.
FEW_KEYS = 1 << 20


def words_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): the distinct words of each text."""
    return texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("_word"))


def rarest_words(needles: DataFrame, words: DataFrame) -> DataFrame:
    """(needle, _word, _n): of the words with separators on both sides inside a needle, the one that the fewest texts hold.

    Such a word is a whole word of every text that holds the needle. Needles without one have NULL; a needle with one that
    no text holds is in no text and drops out.
    """
    inner = F.array_distinct(F.regexp_extract_all("needle", F.lit(f"(?<=[^A-Za-z0-9])({TOKEN})(?=[^A-Za-z0-9])"), F.lit(1)))
    wanted = needles.select("needle").where("needle <> ''").distinct().select("needle", F.explode_outer(inner).alias("_word"))
    counts = words.join(wanted.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    known = wanted.join(counts, "_word", "left").withColumn("_n", F.when(F.col("_word").isNotNull(), F.coalesce("_n", F.lit(0))))
    best = known.groupBy("needle").agg(F.min(F.struct("_n", "_word")).alias("_b"))
    return best.select("needle", "_b._word", "_b._n").where("_n is null or _n > 0")


def with_texts(pairs: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Stored pairs with the texts of their keys; texts without a pair drop out where they are read."""
    keys = materialise(pairs.select(key).distinct())
    few = F.broadcast(keys) if keys.count() <= FEW_KEYS else keys
    return texts.select(key, text).join(few, key, "left_semi").join(pairs, key)


def substring_leaks(texts: DataFrame, key: str, text: str, needles: DataFrame, anchor: int = 12) -> DataFrame:
    """(key, needle) for needles of any shape and length; empty needles are in no text.

    A needle is looked up by its rarest inner word, by the counts of these words over all texts, so that a common word in a needle
    costs nothing. Needles without such a word are matched by their first characters, ``anchor`` of them or all there are; runs
    are made of the texts only for the lengths that occur, at most ``anchor`` of them. Keys of candidates
    are stored first; only the texts of these keys are compared in full.
    """
    words = words_of(texts, key, text)
    anchors = materialise(rarest_words(needles, words))
    by_word = words.join(anchors.where(F.col("_word").isNotNull()), "_word").select(key, "needle")
    wordless = anchors.where(F.col("_word").isNull()).select("needle", F.substring("needle", 1, anchor).alias("_run"))
    lengths = wordless.agg(F.collect_set(F.length("_run")).alias("_lengths"))  # one row of at most ``anchor`` numbers
    runs = F.flatten(F.transform("_lengths", lambda n: F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n)
    )).otherwise(F.array().cast("array<string>"))))
    grams = texts.crossJoin(F.broadcast(lengths)).select(key, F.explode(F.array_distinct(runs)).alias("_run"))
    by_run = grams.join(wordless, "_run").select(key, "needle")
    pairs = materialise(by_word.unionByName(by_run).distinct())
    return with_texts(pairs, texts, key, text).where(F.contains(F.col(text), F.col("needle"))).select(key, "needle")


def publish(rows: DataFrame, allowed: Iterable[str], needles: DataFrame) -> DataFrame:
    """Allowlisted columns of a small report; the query fails when a value holds a needle anywhere.

    The check is a filter on every row, so neither a selection of columns nor a count leaves it out.
    """
    public = rows.select(*allowed)
    cells = F.explode(F.array(*[F.col(c).cast("string") for c in public.columns]))
    values = public.select(cells.alias("_text")).where("_text is not null").distinct().select(F.xxhash64("_text").alias("_row"), "_text")
    hits = substring_leaks(values, "_row", "_text", needles).agg(F.count("*").alias("_hits"))
    return refuse_if(public, hits, "_hits", "private identifier in a public summary")


def refuse_if(rows: DataFrame, count: DataFrame, column: str, message: str) -> DataFrame:
    """The rows; reading any of them fails when the one-row ``count`` is not zero."""
    stop = F.when(F.col(column) > 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(count)).where(stop).drop(column)


#: What a hexadecimal digit becomes when it is combined by exclusive or with 3, 6, 5 and C, in the order 0 to F.
DIGITS = "0123456789ABCDEF"
COMBINED = {"3": "32107654BA98FEDC", "6": "67452301EFCDAB89", "5": "54761032DCFE98BA", "C": "CDEF89AB45670123"}


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal: SHA-256 over the key with the outer pad and SHA-256 over it with the inner pad and the message."""
    raw = F.encode(key, "UTF-8")
    block = F.rpad(F.when(F.octet_length(raw) > 64, F.upper(F.sha2(raw, 256))).otherwise(F.hex(raw)), 128, "0")

    def padded(pad: str) -> Column:
        high, low = COMBINED[pad[0]], COMBINED[pad[1]]
        pairs = F.transform(F.regexp_extract_all(block, F.lit(".."), F.lit(0)), lambda p: F.concat(
            F.translate(F.left(p, F.lit(1)), DIGITS, high), F.translate(F.right(p, F.lit(1)), DIGITS, low)
        ))
        return F.unhex(F.array_join(pairs, ""))

    inner = F.sha2(F.concat(padded("36"), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(padded("5C"), F.unhex(inner)), 256)


def with_canary(episodes: DataFrame, salt: Column, episode: Column) -> DataFrame:
    """Add the run's canary of each episode: a part of HMAC-SHA-256 under the run's salt."""
    return episodes.withColumn("canary", F.concat(F.lit("CANARY-"), F.left(hmac_sha256(salt, episode.cast("string")), F.lit(16))))


def canary_echoes(responses: DataFrame, episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Responses whose text holds the canary of their own run and episode."""
    return responses.join(episodes.select(*keys, "canary"), keys).where(F.contains("text", "canary")).drop("canary")


# --- patterns ------------------------------------------------------------------------
def found_patterns(text: Column, patterns: Mapping[str, str]) -> Column:
    """Array of the names of the patterns that occur in a text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def pattern_hits(texts: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, pattern) for every named pattern that occurs; one pass over the texts."""
    return texts.select(key, F.explode(found_patterns(F.col(text), patterns)).alias("pattern"))


def pattern_matches(texts: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """(key, pattern, match) for every distinct match."""
    def matches(name: str, pattern: str) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("pattern"), m.alias("match")))

    per_pattern = F.flatten(F.array(*[matches(name, p) for name, p in patterns.items()]))
    return texts.select(key, F.explode(per_pattern).alias("x")).select(key, "x.*")


def first_hits(hits: DataFrame, n: int = 50) -> DataFrame:
    """The first n hits in name order, as a report shows them."""
    return hits.orderBy(*hits.columns).limit(n)


def forbidden_words(texts: DataFrame, key: str, text: str, words: Iterable[str]) -> DataFrame:
    """(key, word) for words found as substrings, ignoring case."""
    lowered = F.lower(F.col(text))
    found = F.array(*[F.when(lowered.contains(w.lower()), F.lit(w)) for w in words])
    return texts.select(key, F.explode(F.array_compact(found)).alias("word"))


def unsafe_path(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def path_problems(entries: DataFrame, path: str) -> DataFrame:
    """Unsafe archive or manifest entries: absolute or escaping paths, links, owner names."""
    p = F.col(path)
    reasons = [F.when(unsafe_path(p), "unsafe path")]
    if "is_link" in entries.columns:
        reasons.append(F.when(F.col("is_link"), "link entry"))
    if "owner" in entries.columns:
        reasons.append(F.when(F.col("owner") != "", "identity-bearing ownership metadata"))
    return entries.select(p.alias("path"), F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def gold_leaks(texts: DataFrame, path: str, text: str, gold: DataFrame, run: int = 60) -> DataFrame:
    """Files named like evaluator-only material, or holding any ``run`` characters of a gold record on end.

    Blocks of run / 2 + 1 characters at every run / 2 characters: each run of a record holds one of its
    blocks whole.  Texts with a block are compared with the runs around it.  A shorter record counts whole.
    """
    named = texts.where(F.col(path).rlike(GOLD_NAME)).select(path, F.lit("matches evaluator-only naming").alias("reason"))
    half, size = run // 2, F.length("record")
    starts = F.when(size >= run, F.sequence(F.lit(1), size - half, F.lit(half))).otherwise(F.array(F.lit(1)))
    cut = gold.select("record").distinct().select("record", F.explode(starts).alias("_at"))
    blocks = cut.select("record", "_at", F.when(size >= run, F.substring("record", F.col("_at"), F.lit(half + 1))).otherwise(F.col("record")).alias("needle"))
    blocks = materialise(blocks)
    held = with_texts(materialise(substring_leaks(texts, path, text, blocks)), texts, path, text).join(blocks, "needle")
    around = F.sequence(F.greatest(F.col("_at") - half + 1, F.lit(1)), F.least(F.col("_at"), size - run + 1))
    whole = F.when(size >= run, F.exists(around, lambda i: F.contains(F.col(text), F.substring("record", i, F.lit(run))))).otherwise(F.lit(True))
    return named.unionByName(held.where(whole).select(path, F.lit("embeds gold content").alias("reason")).distinct())


# --- shared text -------------------------------------------------------------------
#: Levels of the digest tree over sealed shingles: 4,096 buckets, so 100 million shingles are 25,000 to a bucket.
COMMITMENT_LEVELS = 3


def contamination(
    candidates: DataFrame, sealed: DataFrame, key: str, text: str, *, width: int = 13, limit: float = 0.0
) -> DataFrame:
    """One row: distinct word shingles on each side, their overlap, ratio and verdict.

    Shingles are distinct within a text before the shuffle, and one aggregation over
    both sides gives all counts, so boilerplate repeated everywhere costs one row per
    map task.  A shingle travels as 128 bits of hashes (two pass for one with a chance of 2^-128) and the sides it was found on as
    bits of one number.  ``sealed_commitment`` is the root of the digest tree over the sealed shingles' hashes.
    """
    def side(df: DataFrame, bit: int) -> DataFrame:
        rows = shingle_rows(df, key, text, width, keep_short=True)
        return rows.select(F.xxhash64("shingle").alias("h"), F.xxhash64(F.lit("shingle"), "shingle").alias("g"), F.lit(bit).alias("side"))

    both = side(candidates, 1).unionByName(side(sealed, 2))
    merged = both.groupBy("h", "g").agg(F.bit_or("side").alias("side"))
    counts = merged.agg(
        F.count_if(F.col("side") >= 2).alias("sealed_shingles"),
        F.count_if(F.col("side") != 2).alias("candidate_shingles"),
        F.count_if(F.col("side") == 3).alias("overlap_shingles"),
    )
    # The sealed side alone, once more: the tree is over a set, so its leaves are distinct before they are counted.
    leaves = shingle_rows(sealed, key, text, width, keep_short=True).select(F.sha2("shingle", 256).alias("h")).distinct()
    root = digest_tree.roots(leaves, F.col("h"), levels=COMMITMENT_LEVELS).select(F.col("root").alias("sealed_commitment"))
    counts = counts.crossJoin(F.broadcast(root))  # one row each
    share = F.col("overlap_shingles") / F.greatest(F.lit(1), F.col("sealed_shingles"))
    return counts.withColumns({
        "overlap_ratio": F.bround(share, 6), "status": F.when(share <= limit, "PASS").otherwise("FAIL"),
    })


def source_overlap(texts: DataFrame, key: str, text: str, corpus: DataFrame, corpus_key: str, width: int = 10) -> DataFrame:
    """Per text: how many distinct shingles also occur in the corpus, and a hash of the smallest."""
    options = {"pattern": WORD_OR_APOSTROPHE, "keep_short": False}
    known = materialise(shingle_rows(corpus, corpus_key, text, width, **options).select("shingle").distinct())
    if known.count() <= FEW_KEYS:
        own = likely_shingles(texts, key, text, known, width, WORD_OR_APOSTROPHE)
    else:
        own = shingle_rows(texts, key, text, width, **options)
    return own.join(known, "shingle", "left_semi").groupBy(key).agg(
        F.count("*").alias("overlapping_shingles"),
        F.substring(F.sha2(F.min("shingle"), 256), 1, 16).alias("example_hash"),
    )


def likely_shingles(texts: DataFrame, key: str, text: str, known: DataFrame, width: int, pattern: str) -> DataFrame:
    """(key, shingle): the shingles of each text, distinct within it, whose first, middle and last word are those of a known one.

    Only these are put together; all others cost a hash of three words. ``known`` is a stored list of at most FEW_KEYS shingles.
    """
    looked = sorted({0, width // 2, width - 1})
    parts = F.split("shingle", " ")
    marks = known.select(F.xxhash64(*[F.get(parts, F.lit(k)) for k in looked]).alias("_mark")).distinct()
    words = texts.select(key, F.monotonically_increasing_id().alias("_row"), tokens(F.col(text), pattern).alias("_words"))
    starts = F.when(F.size("_words") >= width, F.sequence(F.lit(0), F.size("_words") - width))
    at = words.select("*", F.explode(starts).alias("_at")).withColumn("_mark", F.xxhash64(*[F.get("_words", F.col("_at") + k) for k in looked]))
    near = at.join(F.broadcast(marks), "_mark", "left_semi")
    return near.select(key, "_row", F.array_join(F.slice("_words", F.col("_at") + 1, width), " ").alias("shingle")).distinct().select(key, "shingle")


# --- release audit ---------------------------------------------------------------------
def gate(name: str, hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("hits")).select(F.lit(name).alias("gate"), "hits")


# Terminal states and the gates that lead to them, first match wins.
PRECEDENCE = (
    ("PRIVATE_GOLD_LEAK", ("private_gold_leak",)),
    ("SECRET_OR_IDENTIFIER_LEAK", ("secret_scan", "internal_identifier_scan")),
    ("SOURCE_OVERLAP_DETECTED", ("source_shingle_overlap",)),
)


def terminal_state(gates: DataFrame) -> DataFrame:
    """One row with the state the gates lead to."""
    def failed(names) -> Column:
        return F.coalesce(F.bool_or(F.col("gate").isin(*names) & (F.col("status") == "FAIL")), F.lit(False))

    chain = F
    for state, names in PRECEDENCE:
        chain = chain.when(failed(names), state)
    clean = F.bool_and(F.col("status") == "PASS")
    return gates.agg(
        chain.when(~clean, "RELEASE_AUDIT_PASS_WITH_LIMITATIONS").otherwise("RELEASE_AUDIT_PASS").alias("terminal_state")
    )


def release_gates(files: DataFrame, corpus: DataFrame, gold: DataFrame, manifest_problems: DataFrame) -> DataFrame:
    """Gate table over release files (path, text); corpus: corpus_id, text; gold: record."""
    secrets = {f"pattern_{i}": p for i, p in enumerate(SECRET_PATTERNS)}
    local = {f"pattern_{i}": p for i, p in enumerate(INTERNAL_PATTERNS)}
    # Everything that looks at one file at a time is counted in one pass over the texts.
    per_file = {
        "secret_scan": F.size(found_patterns(F.col("text"), secrets)),
        "internal_identifier_scan": F.size(found_patterns(F.col("text"), local)),
        "path_metadata_scan": unsafe_path(F.col("path")).cast("int"),
    }
    totals = files.agg(*[F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in per_file.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("hits")) for k in per_file])
    return union_all([
        totals.select(F.explode(cells).alias("x")).select("x.*"),
        gate("private_gold_leak", gold_leaks(files, "path", "text", gold)),
        gate("source_shingle_overlap", source_overlap(files, "path", "text", corpus, "corpus_id")),
        gate("manifest_verification", manifest_problems),
    ]).withColumn("status", F.when(F.col("hits") > 0, "FAIL").otherwise("PASS"))
