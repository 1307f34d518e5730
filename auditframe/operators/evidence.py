"""Evidence for control requirements, certificates, corpus lineage and evidence export."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions import digest_tree
from auditframe.functions.canon import half_even
from auditframe.functions.ordered import carried, positions, ranged, running_sums, union_all
from auditframe.session import materialise

# Rejection categories that are attempts to leave the permitted scope.
SCOPE_CATEGORIES = ("unauthorized", "stale_version", "precondition", "unknown_action", "already_applied", "schema", "malformed")
# Arms a certificate needs, and the log files a run should keep.
CERTIFICATE_ARMS = ("oracle_passes", "unaided_fails", "naive_retrieval_fails")
EXPECTED_LOGS = ("config.json", "transcript.jsonl", "metrics.json", "scores.json", "cost_cards.json")


def provenance(turns: DataFrame) -> DataFrame:
    """Per episode: applied actions, completeness (1.0, or NULL without an applied action), ungrounded attempts."""
    d = turns.groupBy("run_id", "episode_id").agg(
        F.count_if(F.col("outcome") == "APPLIED").alias("applied_actions"),
        F.count_if((F.col("outcome") == "REJECTED") & F.coalesce(F.col("category") == "ungrounded", F.lit(False))).alias("ungrounded_rejected"),
    )
    return d.withColumn("provenance_completeness", F.when(F.col("applied_actions") > 0, F.lit(1.0)))


def provenance_summary(per_episode: DataFrame) -> DataFrame:
    d = per_episode.groupBy("run_id").agg(
        half_even(F.avg("provenance_completeness"), 4).alias("mean_completeness"),
        F.count("provenance_completeness").alias("episodes_with_actions"),
        F.sum("ungrounded_rejected").alias("ungrounded_rejected"),
    )
    return d.withColumn("status", F.when(F.col("episodes_with_actions") > 0, "evidenced").otherwise("not_evidenced"))


def scope_attempts(turns: DataFrame) -> DataFrame:
    """Rejected turns whose category is an attempt to leave the scope."""
    return turns.where((F.col("outcome") == "REJECTED") & F.col("category").isin(*SCOPE_CATEGORIES))


def scope_violations(turns: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per run: attempts (all rejected), state changes that slipped through (NULL when never
    measured), hidden-field probes and canary echoes."""
    tried = scope_attempts(turns).groupBy("run_id").agg(F.count("*").alias("attempted"))
    d = metrics.join(tried, "run_id", "left")
    attempted = F.coalesce("attempted", F.lit(0))
    slipped = F.col("state_changes_outside_contract")
    return d.select(
        "run_id", attempted.alias("attempted"), attempted.alias("rejected"), slipped.alias("slipped"),
        F.col("forbidden_output_keys").alias("hidden_field_probes"), "canary_echoes",
        F.when(slipped.isNotNull(), "evidenced").otherwise("not_evidenced").alias("status"),
    )


def log_manifest(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Size and hash of every expected log of a run; the absent ones are not evidenced.

    expected: run_id, file; files: run_id, file, bytes, sha256.
    """
    return expected.join(files, ["run_id", "file"], "left").withColumn(
        "status", F.when(F.col("sha256").isNotNull(), "evidenced").otherwise("not_evidenced")
    )


def requirement_status(parts: dict[str, DataFrame]) -> DataFrame:
    """Per run and requirement: evidenced when any of its rows is.  Rows carry run_id and status."""
    rows = union_all([df.select("run_id", F.lit(name).alias("requirement"), "status") for name, df in parts.items()])
    found = F.bool_or(F.col("status") == "evidenced")
    return rows.groupBy("run_id", "requirement").agg(F.when(found, "evidenced").otherwise("not_evidenced").alias("status"))


def certificates(results: DataFrame) -> DataFrame:
    """Per episode: ISSUED when every needed arm has a true result.  results: episode_id, arm_id, result."""
    per_arm = results.groupBy("episode_id").agg(*[
        F.bool_and(F.when(F.col("arm_id") == arm, F.col("result"))).alias(arm) for arm in CERTIFICATE_ARMS
    ])
    every = F.lit(True)
    missing = F.lit(0)
    for arm in CERTIFICATE_ARMS:
        every = every & F.coalesce(F.col(arm), F.lit(False))
        missing = missing + F.col(arm).isNull().cast("int")
    return per_arm.withColumns({"status": F.when(every, "ISSUED").otherwise("NOT_ISSUED"), "missing_arms": missing})


def certificate_ledger(issued: DataFrame) -> DataFrame:
    return issued.groupBy("status").agg(F.count("*").alias("episodes"), F.sum("missing_arms").alias("missing_results"))


def set_variation(episodes: DataFrame, events: DataFrame, entities: DataFrame, authorizations: DataFrame, patches: DataFrame, traps: DataFrame) -> DataFrame:
    """One row: how much a set of episodes varies.

    A block of an episode (its authorizations, the kinds of its patches, the detectors of its traps, its steps in
    order) is identified by the root of its digest tree, so no block is gathered whole; an episode without rows of a block has the
    empty block, which is one more.
    """
    def block(df: DataFrame, name: Column, value: Column | None, called: str) -> DataFrame:
        return digest_tree.roots(df, name, value, ["episode_id"], 1).select("episode_id", F.col("root").alias(called))

    sizes = events.groupBy("episode_id").agg(F.count("*").alias("n_events"), F.count_distinct("surface").alias("n_surfaces"))
    roles = entities.groupBy("episode_id").agg(F.count_distinct("role").alias("n_roles"))
    d = (
        episodes.select("episode_id")
        .join(block(authorizations.distinct(), F.concat_ws("|", digest_tree.framed(F.col("action")), digest_tree.framed(F.col("role"))), None, "auth"), "episode_id", "left")
        .join(block(patches, F.col("kind"), None, "patch"), "episode_id", "left")
        .join(block(traps, F.col("detector"), None, "trap"), "episode_id", "left")
        .join(block(events, F.col("pos"), F.concat_ws("|", digest_tree.framed(F.col("surface")), digest_tree.framed(F.col("action"))), "graph"), "episode_id", "left")
        .join(sizes, "episode_id", "left").join(roles, "episode_id", "left")
    )
    distinct = lambda name: F.count_distinct(F.coalesce(name, F.lit("none")))
    return d.agg(
        F.count("*").alias("episode_count"),
        distinct("auth").alias("distinct_authorization_maps"),
        distinct("patch").alias("distinct_patch_blocks"),
        distinct("trap").alias("distinct_trap_blocks"),
        distinct("graph").alias("distinct_action_graphs"),
        F.count_distinct("n_surfaces").alias("surface_counts"),
        F.count_distinct("n_events").alias("event_counts"),
        F.count_distinct("n_roles").alias("role_counts"),
    )


# --- evidence packs --------------------------------------------------------------------
def artifact_roots(files: DataFrame, levels: int = digest_tree.LEVELS) -> DataFrame:
    """Per run: number of files, bytes, and the root over (path, bytes, sha256)."""
    value = F.concat_ws("|", F.col("bytes").cast("string"), "sha256")
    sizes = files.groupBy("run_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sizes.join(digest_tree.roots(files, F.col("path"), value, ["run_id"], levels).select("run_id", "root"), "run_id")


def set_bindings(runs: DataFrame, episodes: DataFrame, levels: int = digest_tree.LEVELS) -> DataFrame:
    """Whether every run used the episodes that its set holds now.

    runs: run_id, set_id, recorded_root; episodes: set_id, episode_id. Adds episodes, root and status: bound, differs,
    not_recorded or unknown_set.
    """
    sets = digest_tree.roots(episodes.select("set_id", "episode_id").distinct(), F.col("episode_id"), None, ["set_id"], levels)
    status = (
        F.when(F.col("root").isNull(), "unknown_set").when(F.col("recorded_root").isNull(), "not_recorded")
        .when(F.col("root") == F.col("recorded_root"), "bound").otherwise("differs")
    )
    return runs.join(sets.withColumnRenamed("leaves", "episodes"), "set_id", "left").withColumn("status", status)


def pack_rows(sections: dict[str, DataFrame], subject: str = "run_id") -> DataFrame:
    """section, subject, item, value: every column of the sections as text; what was not measured is UNKNOWN, never zero."""
    def tall(name: str, df: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("item"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("value")) for c in df.columns if c != subject])
        return df.select(F.lit(name).alias("section"), F.col(subject).cast("string").alias("subject"), F.explode(cells).alias("x")).select("section", "subject", "x.*")

    return union_all([tall(name, df) for name, df in sections.items()])


def pack_root(pack: DataFrame, levels: int = digest_tree.LEVELS) -> DataFrame:
    """One row: number of items and the root over them."""
    name = F.concat_ws("/", "section", digest_tree.framed(F.col("subject")), "item")
    return digest_tree.roots(pack, name, F.col("value"), levels=levels)


def pack_problems(committed: DataFrame, recomputed: DataFrame, moving: Iterable[str] = ()) -> DataFrame:
    """section, subject, item, problem: where a committed pack and one recomputed from the runs disagree.

    ``moving`` items may differ (what depends on when the pack was made and not on the runs), but not be missing.
    """
    keys = ["section", "subject", "item"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"{name}_n"), F.min("value").alias(name))

    a, b = side(committed, "_a"), side(recomputed, "_b")
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.alias("a").join(b.alias("b"), match, "full_outer")
    problem = (
        F.when(F.col("_a_n").isNull(), "not_committed").when(F.col("_b_n").isNull(), "not_recomputed").when(F.col("_a_n") != F.col("_b_n"), "repeated")
        .when(F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(F.col("a.item").isin(*moving), F.lit(False)), None).otherwise("diverges")
    )
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], problem.alias("problem")).where("problem is not null")


# --- lineage ---------------------------------------------------------------------------
def unique_targets(relations: DataFrame) -> DataFrame:
    """Target of each (source, predicate) that has exactly one."""
    return relations.groupBy("source_id", "predicate").agg(
        F.count("*").alias("_n"), F.min("target_id").alias("target_id")
    ).where(F.col("_n") == 1).drop("_n")


def related(trades: DataFrame, relations: DataFrame, forward: list[str], backward: str) -> DataFrame:
    """(trade_id, entity_id): the trade, its targets over some predicates, and what concerns it."""
    own = trades.select("trade_id", F.col("trade_id").alias("entity_id"))
    ahead = (
        unique_targets(relations.where(F.col("predicate").isin(*forward)))
        .join(trades.select(F.col("trade_id").alias("source_id")), "source_id", "left_semi")
        .select(F.col("source_id").alias("trade_id"), F.col("target_id").alias("entity_id"))
    )
    behind = (
        relations.where(F.col("predicate") == backward)
        .join(trades.select(F.col("trade_id").alias("target_id")), "target_id", "left_semi")
        .select(F.col("target_id").alias("trade_id"), F.col("source_id").alias("entity_id"))
    )
    return union_all([own, ahead, behind]).distinct()


def related_atoms(links: DataFrame, atoms: DataFrame) -> DataFrame:
    """(trade_id, atom_id) over the related entities; atoms: atom_id, subject_id."""
    return links.join(atoms.withColumnRenamed("subject_id", "entity_id"), "entity_id").select("trade_id", "atom_id").distinct()


def assign_spans(consumers: DataFrame, spans: DataFrame, consumer_atoms: DataFrame, span_atoms: DataFrame) -> DataFrame:
    """What a greedy choice in consumer order gives: every consumer takes the first unused span of its surface that shares an atom
    with it, else the first unused one, else none.

    consumers: surface, consumer; spans: surface, span (keys of any type that sorts, unique); consumer_atoms: consumer,
    atom_id; span_atoms: span, atom_id. Returns surface, consumer, span and support_scope (entity_direct or
    surface_context; NULL without a span).

    Choices are made in rounds, all that are certain at once. Of the consumers still waiting, let the k-th of a surface have m
    consumers before it that share no atom with a span left. These m take the first spans there are, so the first m are gone
    when its turn comes; and nobody before it can take a span at place k or later without an atom. So a span at
    place k or later is certain for the first consumer that shares an atom with it, if that one likes it best; where consumers and spans meet in
    one atom alone, they pair up in order; and consumers without an atom, ahead of all others, take the first spans
    in order. The first consumer is always certain, so rounds come to an end. A consumer with as many before it as there are
    spans gets none.
    """
    waiting, free, chosen = materialise(consumers.select("surface", "consumer")), materialise(spans.select("surface", "span")), []
    wants, holds = materialise(consumer_atoms.distinct()), materialise(span_atoms.distinct())
    while True:
        left = positions(ranged(free, ["surface"], "span"), ["surface"], "span", "idx").drop("_chunk")
        room = left.groupBy("surface").agg(F.count("*").alias("_room"))
        queue = positions(ranged(waiting, ["surface"], "consumer"), ["surface"], "consumer", "k").drop("_chunk")
        queue = materialise(queue.join(room, "surface").where(F.col("k") <= F.col("_room")).drop("_room"))
        if queue.isEmpty():
            break
        left = materialise(left)
        offered = left.join(holds, "span")
        asks = materialise(_first_spans(queue, wants, offered))
        early = asks.groupBy("surface", "atom_id").agg(F.min(F.struct("k", "m")).alias("_early"))
        gives = materialise(offered.join(early, ["surface", "atom_id"]).where(F.col("idx") > F.col("_early.m")))
        best = asks.groupBy("surface", "consumer", "k").agg(F.min("first").alias("_best"), F.count("*").alias("_atoms"))
        asked = gives.groupBy("surface", "span").agg(F.min("_early.k").alias("_early"), F.count("*").alias("_atoms"))
        liked = best.select("surface", "consumer", "k", "_best.span", "_best.idx").join(asked.drop("_atoms"), ["surface", "span"])
        dominant = liked.where((F.col("_early") == F.col("k")) & (F.col("idx") >= F.col("k"))).select("surface", "consumer", "span")
        pairs = _pairs_of_one_atom(asks, gives, best, asked)
        # Consumers without a living atom, ahead of the first that has one.
        first = best.groupBy("surface").agg(F.min("k").alias("_first_k"))
        plain = queue.join(first, "surface", "left").where(F.col("_first_k").isNull() | (F.col("k") < F.col("_first_k")))
        plain = plain.join(left.withColumnRenamed("idx", "k"), ["surface", "k"]).select("surface", "consumer", "span", F.lit("surface_context").alias("support_scope"))
        direct = dominant.unionByName(pairs).distinct().withColumn("support_scope", F.lit("entity_direct"))
        made = materialise(direct.unionByName(plain))
        chosen.append(made)
        waiting = queue.select("surface", "consumer").join(made, ["surface", "consumer"], "left_anti")
        free = left.select("surface", "span").join(made, ["surface", "span"], "left_anti")
    keys = consumers.select("surface", "consumer")
    if not chosen:
        return keys.join(spans.select("surface", "span").where("false"), "surface", "left").withColumn("support_scope", F.lit(None).cast("string"))
    return keys.join(union_all(chosen), ["surface", "consumer"], "left")


def _first_spans(queue: DataFrame, wants: DataFrame, offered: DataFrame) -> DataFrame:
    """surface, atom_id, consumer, k, m, first: per waiting consumer and atom, the first span left beyond place m.

    Consumers and spans of an atom are laid in one sequence, and the latest span is carried to the consumers.
    """
    keys = ["surface", "atom_id"]
    wanted = queue.join(wants, "consumer").join(offered.select(*keys).distinct(), keys, "left_semi")
    alive = wanted.select("surface", "consumer").distinct().withColumn("_alive", F.lit(1))
    counted = queue.join(alive, ["surface", "consumer"], "left")
    counted = running_sums(counted, ["surface"], "k", {"m": F.when(F.col("_alive").isNull(), 1).otherwise(0).cast("long")}).select("surface", "consumer", "m")
    asking = wanted.join(counted, ["surface", "consumer"])
    none = F.lit(None)
    rows = asking.select(
        *keys, F.struct((-F.col("m")).alias("p"), F.lit(0).alias("kind"), F.col("k").alias("n")).alias("at"), "consumer", "k", "m",
        none.cast(offered.select(F.struct("idx", "span")).schema[0].dataType).alias("_span"),
    ).unionByName(offered.select(
        *keys, F.struct((-F.col("idx")).alias("p"), F.lit(1).alias("kind"), F.col("idx").alias("n")).alias("at"),
        none.cast(asking.schema["consumer"].dataType).alias("consumer"), none.cast("long").alias("k"), none.cast("long").alias("m"), F.struct("idx", "span").alias("_span"),
    ))
    found = carried(ranged(rows, keys, "at"), keys, "at", {"first": F.col("_span")})
    return found.where("k is not null and first is not null").select(*keys, "consumer", "k", "m", "first")


def _pairs_of_one_atom(asks: DataFrame, gives: DataFrame, best: DataFrame, asked: DataFrame) -> DataFrame:
    """The i-th consumer and the i-th span of an atom, up to the first that has another living atom or could lose the span."""
    keys = ["surface", "atom_id"]

    def numbered(rows: DataFrame, order: str, atoms: DataFrame, by: list[str]) -> DataFrame:
        alone = rows.join(atoms.select(*by, "_atoms"), by)
        return positions(ranged(alone, keys, order), keys, order, "_i").drop("_chunk")

    a = numbered(asks.select(*keys, "consumer", "k"), "k", best, ["surface", "consumer"]).withColumnRenamed("_atoms", "_a")
    b = numbered(gives.select(*keys, "span", "idx"), "idx", asked, ["surface", "span"]).withColumnRenamed("_atoms", "_b")
    met = materialise(a.join(b, [*keys, "_i"]))
    sure = (F.col("_a") == 1) & (F.col("_b") == 1) & (F.col("idx") >= F.col("k"))
    stops = met.where(~sure).groupBy(*keys).agg(F.min("_i").alias("_stop"))
    return met.join(stops, keys, "left").where(F.col("_stop").isNull() | (F.col("_i") < F.col("_stop"))).select("surface", "consumer", "span")


def client_sides(clients: DataFrame, order: str) -> DataFrame:
    """Halve the clients in order (of any type, unique): the first n // 2 train, the rest transfer."""
    ranked = positions(ranged(clients, [], order), [], order, "_rank").drop("_chunk")
    size = clients.agg(F.count("*").alias("_n"))
    half = F.expr("_n div 2")
    return ranked.crossJoin(F.broadcast(size)).withColumn(
        "side", F.when(F.col("_rank") <= half, "train").otherwise("transfer")
    ).drop("_rank", "_n")


def first_per_side(trades: DataFrame, order: str, count: int = 2) -> DataFrame:
    """At most ``count`` trades of each side, in order."""
    rank = F.row_number().over(Window.partitionBy("side").orderBy(order))
    return trades.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")


def overlapping_values(left: DataFrame, right: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value) present on both sides; must be empty for disjoint lineages."""
    def tall(df: DataFrame) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        return df.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL")

    return tall(left).distinct().join(tall(right).distinct(), ["field", "value"], "left_semi")


def commitment_problems(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Subjects whose recorded digest is missing, unexpected or different.  Both: subject, sha256."""
    a, b = recorded.select("subject", F.col("sha256").alias("_a")), recomputed.select("subject", F.col("sha256").alias("_b"))
    problem = F.when(F.col("_b").isNull(), "not_recomputed").when(F.col("_a").isNull(), "not_recorded").when(F.col("_a") != F.col("_b"), "differs")
    return a.join(b, "subject", "full_outer").select("subject", problem.alias("problem")).where("problem IS NOT NULL")


def span_hashes(spans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Spans with the SHA-256 of their bytes and whether it is the recorded one.

    spans: artifact_id, byte_start, byte_end, text_sha256; artifacts: artifact_id, content.
    """
    piece = F.substring(F.col("content"), F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start"))
    d = spans.join(artifacts, "artifact_id", "left").withColumn("actual_sha256", F.sha2(piece, 256)).drop("content")
    return d.withColumn("matches", F.col("actual_sha256").eqNullSafe(F.col("text_sha256")))
