"""Cost cards of episodes and the denominated outcome of a run."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.canon import half_even, hours_between, ratio

# Hourly rate per role band, band per role, and the assumptions of the method.
RATE_PER_HOUR = {1: 70, 2: 89, 3: 130, 4: 191, 5: 191}
BAND_BY_ROLE = {
    "operations_analyst": 1,
    "operations_supervisor": 3,
    "product_controller": 3,
    "middle_office_controller": 3,
    "reconciliation_controller": 3,
    "collateral_manager": 4,
    "reference_data_steward": 2,
    "release_manager": 4,
}
DEFAULT_BAND = 2
ENGAGED_MINUTES = 20
CAPACITY_WHILE_OPEN = 0.05
BUSINESS_FRACTION = (5 / 7) * (8 / 24)


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def tier(largest_amount: Column, severity: Column) -> Column:
    """A with a stated positive amount, C with a material or critical severity, else D."""
    return (
        F.when(F.coalesce(largest_amount, F.lit(0)) > 0, "A")
        .when(severity.isin("material", "critical"), "C").otherwise("D")
    )


def cost_cards(episodes: DataFrame, events: DataFrame, entities: DataFrame, ledger: DataFrame, severities: DataFrame) -> DataFrame:
    """One card per episode; fewer than two primary events make it not estimable.

    episodes: episode_id, window_start, window_end; events ordered by pos;
    severities: episode_id, pos, severity (of the initial states).
    """
    roles = entities.where(F.col("role").isNotNull()).select("episode_id", F.col("id").alias("actor_id"), "role")
    band = F.coalesce(_lookup(BAND_BY_ROLE, F.col("role")), F.lit(DEFAULT_BAND))
    rate = _lookup(RATE_PER_HOUR, band).cast("long")
    primary = events.where(F.col("duplicate_of").isNull()).join(roles, ["episode_id", "actor_id"], "left")
    work = primary.groupBy("episode_id").agg(
        F.count("*").alias("events"),
        F.count_distinct("actor_id").alias("people"),
        F.sum(rate).alias("_rates"),
        F.min_by("at", "pos").alias("_first"),
        F.max_by("at", "pos").alias("_last"),
    )
    money = ledger.groupBy("episode_id").agg(F.max("amount_minor").alias("_amount"))
    severity = severities.where(F.col("severity") != "").groupBy("episode_id").agg(F.min_by("severity", "pos").alias("severity"))
    d = (
        episodes.select("episode_id", "window_start", "window_end")
        .join(work, "episode_id", "left").join(money, "episode_id", "left").join(severity, "episode_id", "left")
    )
    priced = F.coalesce(F.col("events"), F.lit(0)) >= 2
    engaged_hours = F.col("events") * (ENGAGED_MINUTES / 60)
    engaged = F.col("_rates") * (ENGAGED_MINUTES / 60)
    mean_rate = F.col("_rates") / F.col("events")

    def delay(hours: Column) -> Column:
        return F.lit(CAPACITY_WHILE_OPEN) * F.col("people") * hours * mean_rate * F.lit(BUSINESS_FRACTION)

    script_hours = F.greatest(hours_between(F.col("_first"), F.col("_last")), F.lit(0.0))
    window_hours = hours_between(F.col("window_start"), F.col("window_end"))
    script, window = delay(script_hours), delay(window_hours)

    def dollars(value: Column) -> Column:
        return F.when(priced, half_even(value, 0).cast("long"))

    return d.select(
        "episode_id",
        F.when(priced, "priced").otherwise("not_estimable").alias("status"),
        F.when(priced, tier(F.col("_amount"), F.col("severity"))).alias("tier"),
        dollars(engaged + script).alias("resolution_cost"),
        dollars(window).alias("unresolved_cost"),
        F.when(priced, F.col("people")).alias("people"),
        F.coalesce("events", F.lit(0)).alias("events"),
        F.when(priced, half_even(engaged_hours, 2)).alias("engaged_hours"),
        F.when(priced, half_even(window_hours, 1)).alias("window_hours"),
        dollars(engaged + script / 2).alias("resolution_capacity_low"),
        dollars(engaged + script * 2).alias("resolution_capacity_high"),
        dollars(window / 2).alias("unresolved_capacity_low"),
        dollars(window * 2).alias("unresolved_capacity_high"),
    )


def priced_outcomes(outcomes: DataFrame, cards: DataFrame) -> DataFrame:
    """Loss of each outcome: the resolution cost when complete, else the unresolved cost; NULL when unpriced."""
    d = outcomes.join(cards.select("episode_id", "status", "resolution_cost", "unresolved_cost"), "episode_id", "left")
    priced = F.coalesce(F.col("status") == "priced", F.lit(False))
    loss = F.when(priced, F.when(F.col("complete"), F.col("resolution_cost")).otherwise(F.col("unresolved_cost")))
    return d.withColumns({
        "expected_loss": loss,
        "null_policy_loss": F.when(priced, F.col("unresolved_cost")),
        "status": F.coalesce("status", F.lit("not_evidenced")),
    }).drop("resolution_cost", "unresolved_cost")


def run_loss(priced: DataFrame) -> DataFrame:
    """Per run: expected loss, loss of doing nothing, what was avoided, and how much was priced."""
    none = F.lit(0).cast("long")
    totals = priced.groupBy("run_id").agg(
        F.count("*").alias("episodes"),
        F.count("expected_loss").alias("priced_episodes"),
        F.coalesce(F.sum("expected_loss"), none).alias("expected_loss"),
        F.coalesce(F.sum("null_policy_loss"), none).alias("null_policy_loss"),
    )
    avoided = F.col("null_policy_loss") - F.col("expected_loss")
    return totals.withColumns({
        "unpriced_episodes": F.col("episodes") - F.col("priced_episodes"),
        "loss_avoided": avoided,
        "loss_avoided_fraction": ratio(avoided, F.col("null_policy_loss"), 4),
    })
