"""Case rules: governing documents, values from de-duplicated facts, routes.

Cases carry case_id, family, cutoff_minute; records carry the family inputs;
facts carry case_id, event_id, pos (any orderable type) and the family fields.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.ordered import positions

# Document kinds every case needs, and the operation of each family.
KINDS = ("policy", "record", "control")
OPERATIONS = {
    "settlement": "settle",
    "allocations": "allocate",
    "reconciliation": "post_adjustment",
    "margin": "issue_call",
    "permissions": "grant_scope",
    "lifecycle": "amend",
    "evidence": "attest",
    "temporal": "advance_sequence",
}
FAMILIES = tuple(OPERATIONS)


def eligible_documents(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case and kind: how many documents are current and in force, and one of them."""
    return (
        documents.where(F.col("status") == "CURRENT")
        .join(cases.select("case_id", "cutoff_minute"), "case_id")
        .where(F.col("effective_minute") <= F.col("cutoff_minute"))
        .groupBy("case_id", "kind")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    )


def authoritative(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """The one current document per case and kind; ambiguous ones are left out."""
    return eligible_documents(documents, cases).where(F.col("n") == 1).drop("n")


def authoritative_violations(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases and kinds for which the number of governing documents is not one."""
    wanted = cases.select("case_id", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    found = eligible_documents(documents, cases).select("case_id", "kind", "n")
    return (
        wanted.join(found, ["case_id", "kind"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .where(F.col("n") != 1)
    )


def last_facts(facts: DataFrame, *fields: str) -> DataFrame:
    """One row per case and event: the last by ``pos``, with the named fields or all.

    ``first_pos`` keeps where the event first appeared, which decides ties later.  Name
    the fields that are needed: only they are read and shuffled.
    """
    rest = list(fields) or [c for c in facts.columns if c not in ("case_id", "event_id", "pos")]
    return (
        facts.groupBy("case_id", "event_id")
        .agg(F.max_by(F.struct(*rest), "pos").alias("_last"), F.min("pos").alias("first_pos"))
        .select("case_id", "event_id", "first_pos", *[F.col("_last")[c].alias(c) for c in rest])
    )


def settlement_value(records: DataFrame, facts: DataFrame) -> DataFrame:
    paid = facts.groupBy("case_id").agg(F.sum(F.when(F.col("completed"), F.col("amount"))).alias("s"))
    return _with(records, paid, F.col("instruction_total") - F.coalesce("s", F.lit(0)))


def allocation_value(records: DataFrame, facts: DataFrame) -> DataFrame:
    used = facts.groupBy("case_id").agg(F.sum("quantity").alias("s"))
    return _with(records, used, F.col("block_quantity") - F.coalesce("s", F.lit(0)))


def reconciliation_value(records: DataFrame, facts: DataFrame) -> DataFrame:
    posted = facts.groupBy("case_id").agg(F.sum("amount").alias("s"))
    return _with(
        records, posted, F.col("statement_balance") - F.col("opening_balance") - F.coalesce("s", F.lit(0))
    )


def margin_call() -> Column:
    call = F.greatest(F.lit(0), F.col("exposure") - F.col("collateral") - F.col("threshold"))
    return F.when(call >= F.col("minimum_transfer"), call).otherwise(0).cast("long")


def permitted_mask() -> Column:
    return (
        F.col("requested_mask").bitwiseAND(F.col("approved_mask")).bitwiseAND(F.bitwise_not("revoked_mask"))
    ).cast("long")


def margin_value(records: DataFrame) -> DataFrame:
    return records.select("case_id", margin_call().alias("value"))


def permission_value(records: DataFrame) -> DataFrame:
    return records.select("case_id", permitted_mask().alias("value"))


def lifecycle_value(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Notional of the latest revision in force at the cutoff; NULL when there is none.

    Of equal (effective_minute, revision) the event seen first wins, so the order
    is taken from the smallest first_pos within the greatest pair.
    """
    eligible = facts.join(records.select("case_id", "cutoff_minute"), "case_id").where(
        F.col("effective_minute") <= F.col("cutoff_minute")
    )
    per_rank = eligible.groupBy("case_id", "effective_minute", "revision").agg(
        F.min_by("notional", "first_pos").alias("notional")
    )
    top = per_rank.groupBy("case_id").agg(
        F.max_by("notional", F.struct("effective_minute", "revision")).alias("s")
    )
    return _with(records, top, F.col("s"))


def evidence_value(records: DataFrame, facts: DataFrame) -> DataFrame:
    issuers = facts.where("valid").select("case_id", "issuer").distinct()
    approved = records.select("case_id", F.explode(F.array_distinct("approved_issuers")).alias("issuer"))
    hits = issuers.join(approved, ["case_id", "issuer"]).groupBy("case_id").agg(F.count("*").alias("s"))
    return _with(records, hits, F.coalesce("s", F.lit(0)))


def temporal_value(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Highest acknowledged sequence reachable from the opening one without a gap."""
    acks = (
        facts.where("acknowledged")
        .select("case_id", F.col("sequence").cast("long").alias("sequence"))
        .distinct()
        .join(records.select("case_id", "opening_sequence"), "case_id")
        .where(F.col("sequence") > F.col("opening_sequence"))
    )
    placed = positions(acks, ["case_id"], "sequence", "rank")
    reached = (
        placed.where(F.col("sequence") - F.col("rank") == F.col("opening_sequence"))
        .groupBy("case_id")
        .agg(F.max("sequence").alias("s"))
    )
    return _with(records, reached, F.coalesce("s", F.col("opening_sequence")))


def _with(records: DataFrame, part: DataFrame, value: Column) -> DataFrame:
    return records.join(part, "case_id", "left").select("case_id", value.cast("long").alias("value"))


INPUTS = (
    "instruction_total", "block_quantity", "statement_balance", "opening_balance", "exposure", "collateral",
    "threshold", "minimum_transfer", "requested_mask", "approved_mask", "revoked_mask", "cutoff_minute",
    "approved_issuers", "opening_sequence",
)


def case_inputs(cases: DataFrame, policies: DataFrame, records: DataFrame, controls: DataFrame) -> DataFrame:
    """One row per case with everything its answer depends on but the facts.

    cases: case_id, family, cutoff_minute; policies: case_id, policy_id, approval_limit,
    escalation_owner; records: case_id, record_id, risk_amount and family inputs;
    controls: case_id, control_id, supporting_evidence_verified.
    """
    record = [c for c in INPUTS if c != "cutoff_minute"]
    return (
        cases.select("case_id", "family", "cutoff_minute")
        .join(policies.select("case_id", "policy_id", "approval_limit", "escalation_owner"), "case_id")
        .join(records.select("case_id", "record_id", "risk_amount", *record), "case_id")
        .join(controls.select("case_id", "control_id", "supporting_evidence_verified"), "case_id")
    )


def case_measures(inputs: DataFrame, facts: DataFrame) -> DataFrame:
    """Inputs with the value by the rule of the family and the sums paid, quantity, amount.

    ``facts`` are all fact rows; the last row of an event counts.  Every family but
    temporal is decided by one aggregation over them; temporal needs the gap search and
    runs it on the facts of its own cases only.
    """
    in_force = F.col("effective_minute") <= F.col("cutoff_minute")
    good = F.col("valid") & F.array_contains("approved_issuers", F.col("issuer"))
    latest_first = F.struct(-F.col("effective_minute"), -F.col("revision"), F.col("first_pos"))
    last = last_facts(facts, "amount", "completed", "quantity", "effective_minute", "revision", "notional", "issuer", "valid")
    sums = (
        last.join(inputs.select("case_id", "cutoff_minute", "approved_issuers"), "case_id")
        .groupBy("case_id")
        .agg(
            F.sum(F.when(F.col("completed"), F.col("amount"))).alias("_paid"),
            F.sum("quantity").alias("_quantity"),
            F.sum("amount").alias("_amount"),
            F.min_by("notional", F.when(in_force, latest_first)).alias("_notional"),
            F.count_distinct(F.when(good, F.col("issuer"))).alias("_issuers"),
        )
    )
    temporal = inputs.where(F.col("family") == "temporal").select("case_id", "opening_sequence")
    own = facts.join(temporal.select("case_id"), "case_id", "left_semi")
    reached = temporal_value(temporal, last_facts(own, "sequence", "acknowledged"))
    zero = F.lit(0).cast("long")
    paid, quantity, amount = (F.coalesce(c, zero) for c in ("_paid", "_quantity", "_amount"))
    family = F.col("family")
    value = (
        F.when(family == "settlement", F.col("instruction_total") - paid)
        .when(family == "allocations", F.col("block_quantity") - quantity)
        .when(family == "reconciliation", F.col("statement_balance") - F.col("opening_balance") - amount)
        .when(family == "margin", margin_call())
        .when(family == "permissions", permitted_mask())
        .when(family == "lifecycle", F.col("_notional"))
        .when(family == "evidence", F.coalesce("_issuers", zero))
        .when(family == "temporal", F.col("_reached"))
    )
    return (
        inputs.join(sums, "case_id", "left")
        .join(reached.withColumnRenamed("value", "_reached"), "case_id", "left")
        .select(
            inputs["*"], value.alias("value"), paid.alias("paid"), quantity.alias("quantity"), amount.alias("amount")
        )
    )


def route_of(verified: Column, risk: Column, limit: Column) -> Column:
    return F.when(~verified, "escalate").when(risk > limit, "approve").otherwise("execute")


def diagnosis_of(verified: Column, risk: Column, limit: Column) -> Column:
    return F.when(~verified, "missing_evidence").when(risk > limit, "approval_required").otherwise("within_authority")


def operation_of(family: Column) -> Column:
    pairs = [F.lit(x) for item in OPERATIONS.items() for x in item]
    return F.create_map(*pairs)[family]


def resolve_cases(inputs: DataFrame, facts: DataFrame) -> DataFrame:
    """Expected answer per case from all its fact rows."""
    verified, risk, limit = (
        F.col("supporting_evidence_verified"), F.col("risk_amount"), F.col("approval_limit"),
    )
    return case_measures(inputs, facts).select(
        "case_id",
        "family",
        F.col("value").alias("target"),
        diagnosis_of(verified, risk, limit).alias("diagnosis"),
        route_of(verified, risk, limit).alias("route"),
        operation_of(F.col("family")).alias("operation"),
        F.array("policy_id", "record_id", "control_id").alias("evidence"),
        F.col("policy_id").alias("policy"),
        F.col("escalation_owner").alias("owner"),
    )


def business_objects(measures: DataFrame) -> DataFrame:
    """Objects that exist after the value has been executed; columns of other families are NULL."""
    value = F.col("value")
    paid = F.col("paid") + value
    allocated = F.col("quantity") + value
    closing = F.col("opening_balance") + F.col("amount") + value

    def only(family: str, column: Column) -> Column:
        return F.when(F.col("family") == family, column)

    return measures.select(
        "case_id",
        "family",
        only("settlement", paid).alias("paid"),
        F.when(F.col("family") == "settlement", F.col("instruction_total") - paid)
        .when(F.col("family") == "allocations", F.col("block_quantity") - allocated)
        .alias("remaining"),
        only("allocations", allocated).alias("allocated"),
        only("reconciliation", closing).alias("closing"),
        only("reconciliation", F.col("statement_balance") - closing).alias("residual"),
        only("margin", F.when(value != 0, "issued").otherwise("below_mta")).alias("call_status"),
        only("permissions", value).alias("active_scope"),
        only("permissions", F.col("revoked_mask").cast("long")).alias("revoked_scope"),
        only("lifecycle", value).alias("notional"),
        only("evidence", value).alias("independent_proofs"),
        only("temporal", value).alias("last_acknowledged"),
    )


def journal_balance(journal: DataFrame) -> DataFrame:
    """Sum of the journal legs per case and whether it is zero."""
    return journal.groupBy("case_id").agg(F.sum("amount").alias("total")).withColumn(
        "balanced", F.col("total") == 0
    )


def compositional_split(conditions: DataFrame, flags: list[str]) -> DataFrame:
    """Add ``split``: an odd number of true flags goes to evaluation."""
    odd = sum((F.col(f).cast("int") for f in flags), F.lit(0)) % 2 == 1
    return conditions.withColumn("split", F.when(odd, "evaluation").otherwise("development"))
