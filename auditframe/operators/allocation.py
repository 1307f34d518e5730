"""Jobs of a matched experiment: allocation, pending work, readiness, bindings."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.canon import digest, packed, unpacked
from auditframe.functions.ordered import union_all


#: Pairs of an arm and a seed that are sent to every task.
PAIRS = 1 << 16
#: What the id of a job is the digest of.
NAMED = ("arm_id", "episode_id", "evaluation_seed")


def job_table(arms: DataFrame, seeds: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every arm with every seed and episode, each under a digest id.

    The product is what the plan asks for.  Arms, seeds and episodes are ordinary rows of any
    number. Up to ``PAIRS`` pairs of an arm and a seed go to where the episodes are: were these sent to the pairs, a file of few
    arms would make the whole product in one task. With more pairs Spark decides which sides travel.
    """
    # A file of episodes has few splits, and each of its rows becomes many: spread over as many tasks as a shuffle has.
    spread = episodes.repartition(int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = arms.crossJoin(seeds)
    if arms.count() * seeds.count() <= PAIRS:
        pairs = F.broadcast(pairs)
    jobs = spread.crossJoin(pairs).select(*arms.columns, *seeds.columns, "episode_id")
    return jobs.withColumn("job_id", digest({c: F.col(c) for c in NAMED}))


def by_digest(df: DataFrame) -> DataFrame:
    """The rows with ``job_id`` as packed bytes, which is what travels."""
    return df.withColumn("job_id", packed(F.col("job_id")))


def in_digest_order(jobs: DataFrame) -> DataFrame:
    """The jobs by id. An id that is the digest of the job's own fields does not travel: it can't be packed any smaller, and
    is made anew where the job arrives. Any other id travels as it is."""
    own, columns = digest({c: F.col(c) for c in NAMED}), jobs.columns
    # An id is looked at once, so that the plan makes it once: an empty array stands for the digest.
    rows = jobs.withColumn("job_id", F.array_except(F.array("job_id"), F.array(own)))
    name = F.when(F.size("job_id") == 0, own).otherwise(F.get("job_id", F.lit(0)))
    return rows.repartitionByRange(name).withColumn("job_id", name).sortWithinPartitions("job_id").select(*columns)


def pending(jobs: DataFrame, recorded: DataFrame) -> DataFrame:
    left = by_digest(jobs).join(by_digest(recorded.select("job_id")), "job_id", "left_anti")
    return left.select(*jobs.columns).withColumn("job_id", unpacked(F.col("job_id")))


def indeterminate(started: DataFrame, recorded: DataFrame) -> DataFrame:
    """Jobs that were started and left no record; they must not be run again blindly."""
    left = by_digest(started.select("job_id")).join(by_digest(recorded.select("job_id")), "job_id", "left_anti")
    return left.distinct().select(unpacked(F.col("job_id")).alias("job_id"))


# States of a plan.
COMPLETE = "READY_FOR_INDEPENDENT_ATTESTATION"
EXECUTABLE = "READY_TO_EXECUTE"
BLOCKED = "BLOCKED_MISSING_OR_INVALID_INPUTS"

BOUND = ("arm_id", "evaluation_seed", "episode_id", "checkpoint_sha256")


def binding_violations(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Records whose fields differ from the plan's row, or that the plan never allocated."""
    planned = by_digest(jobs.select("job_id", F.struct(*BOUND).alias("_plan")))
    d = by_digest(records.select("job_id", *BOUND)).join(planned, "job_id", "left")
    wrong = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col("_plan")[c]), F.lit(c)) for c in BOUND
    ]))
    fields = F.when(F.col("_plan").isNull(), F.array(F.lit("unallocated"))).otherwise(wrong)
    return d.select("job_id", F.explode(fields).alias("field")).withColumn("job_id", unpacked(F.col("job_id")))


def readiness(jobs: DataFrame, started: DataFrame, records: DataFrame) -> DataFrame:
    """One row of job counts and the status they give; pending means without a record.

    Plan, starts and records become rows of one key, and one aggregation per job says what is known of it: a record's fields are
    compared with its plan inside the group. A row carries 128 bits of hashes for its job and 64 for its fields (two different
    rows pass for equal with a chance of 2^-64). Nearly every job has its own key, so rows are dealt out first; counting
    before the shuffle would only fill memory and spill.
    """
    def rows(df: DataFrame, kind: int, told: bool = True) -> DataFrame:
        fields = [x for c in BOUND for x in (F.col(c).isNull(), F.col(c).cast(jobs.schema[c].dataType))] if told else []
        said = F.xxhash64(*fields) if told else F.lit(None).cast("bigint")
        return df.select(F.xxhash64("job_id").alias("k"), F.xxhash64(F.lit("job"), "job_id").alias("l"), F.lit(kind).cast("byte").alias("kind"), said.alias("said"))

    both = union_all([rows(jobs, 0), rows(started, 1, told=False), rows(records, 2)]).repartition("k", "l")
    is_, said = lambda kind: F.col("kind") == kind, lambda kind: F.when(F.col("kind") == kind, F.col("said"))
    per_job = both.groupBy("k", "l").agg(
        F.bool_or(is_(0)).alias("planned"), F.bool_or(is_(1)).alias("run"), F.bool_or(is_(2)).alias("rec"),
        F.max(said(0)).alias("_plan"), F.min(said(2)).alias("_low"), F.max(said(2)).alias("_high"),
    ).where("planned")
    # All records of a job agree with its plan when the least and the greatest of them do.
    bad = ~(F.col("_low").eqNullSafe(F.col("_plan")) & F.col("_high").eqNullSafe(F.col("_plan")))
    rec, run = F.col("rec"), F.col("run")
    counts = per_job.agg(
        F.count("*").alias("total"),
        F.count_if(rec & ~bad).alias("verified"),
        F.count_if(rec & bad).alias("invalid"),
        F.count_if(run & ~rec).alias("indeterminate"),
        F.count_if(~rec).alias("pending"),
    )
    broken = (F.col("invalid") > 0) | (F.col("indeterminate") > 0)
    status = F.when(broken, BLOCKED).when(F.col("verified") == F.col("total"), COMPLETE).otherwise(EXECUTABLE)
    return counts.withColumn("status", status)


def ancestry_violations(receipts: DataFrame, arms: DataFrame) -> DataFrame:
    """Training receipts whose source is not the parent arm's checkpoint, or whose output is not the arm's own."""
    own = arms.select("arm_id", "source_arm", F.col("checkpoint_sha256").alias("_own"))
    parent = arms.select(F.col("arm_id").alias("source_arm"), F.col("checkpoint_sha256").alias("_parent"))
    d = receipts.join(own, "arm_id", "left").join(parent, "source_arm", "left")
    checks = F.array_compact(F.array(
        F.when(~F.col("source_checkpoint").eqNullSafe(F.col("_parent")), "source_checkpoint"),
        F.when(~F.col("output_checkpoint").eqNullSafe(F.col("_own")), "output_checkpoint"),
    ))
    return d.select("arm_id", F.explode(checks).alias("field"))


def hash_pick(items: DataFrame, group: str, item: str, seed: str, count: int) -> DataFrame:
    """``count`` items per group in the order of SHA-256(seed:item).

    A rank filter is applied before and after the shuffle, so a large group sends only
    its best few rows per partition.
    """
    key = F.sha2(F.concat(F.lit(seed + ":"), F.col(item).cast("string")), 256)
    order = Window.partitionBy(group).orderBy("_key", item)
    ranked = items.withColumn("_key", key).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= count).drop("_key")
