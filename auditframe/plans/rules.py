"""Queries over cases (orders with customers), facts (lineitem) and documents (orders)."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.functions.canon import cents
from auditframe.operators import rules as R
from auditframe.plans.registry import query, sql_view
from auditframe.plans.strategy import load

CUTOFF = "1998-06-30"


def minute(col):
    return F.expr(f"unix_seconds(cast({col} AS timestamp)) div 60")


# --- documents -------------------------------------------------------------
def documents(spark, sf):
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.select(
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderkey").alias("doc_id"),
        F.array(*[F.lit(k) for k in R.KINDS])[(F.col("o_orderkey") % 3).cast("int")].alias("kind"),
        F.when(F.col("o_orderstatus") == "O", "CURRENT").when(F.col("o_orderstatus") == "F", "ARCHIVED").otherwise("FUTURE").alias("status"),
        minute("o_orderdate").alias("effective_minute"),
    )


def document_cases(spark, sf):
    c = load(spark, sf, "customer", "c_custkey")
    return c.select(F.col("c_custkey").alias("case_id"), F.expr(f"unix_seconds(timestamp'{CUTOFF}') div 60").alias("cutoff_minute"))


sql_view(
    "v_docs",
    f"""SELECT o_custkey AS case_id, o_orderkey AS doc_id, (['policy', 'record', 'control'])[o_orderkey % 3 + 1] AS kind,
  CASE o_orderstatus WHEN 'O' THEN 'CURRENT' WHEN 'F' THEN 'ARCHIVED' ELSE 'FUTURE' END AS status,
  CAST(epoch(o_orderdate) AS BIGINT) // 60 AS effective_minute,
  CAST(epoch(TIMESTAMP '{CUTOFF}') AS BIGINT) // 60 AS cutoff_minute FROM orders""",
)
sql_view(
    "v_eligible",
    """SELECT d.case_id, d.kind, count(*) AS n, min(d.doc_id) AS doc_id FROM v_docs d JOIN customer ON c_custkey = d.case_id
WHERE status = 'CURRENT' AND effective_minute <= cutoff_minute GROUP BY d.case_id, d.kind""",
)


@query("authoritative_docs", "SELECT case_id, kind, doc_id FROM v_eligible WHERE n = 1")
def authoritative_docs(spark, sf):
    return R.authoritative(documents(spark, sf), document_cases(spark, sf))


@query(
    "authoritative_violations",
    """SELECT c_custkey AS case_id, k.kind, coalesce(n, 0) AS n FROM customer
CROSS JOIN (SELECT unnest(['policy', 'record', 'control']) AS kind) k
LEFT JOIN v_eligible e ON e.case_id = c_custkey AND e.kind = k.kind WHERE coalesce(n, 0) <> 1""",
)
def authoritative_violations(spark, sf):
    return R.authoritative_violations(documents(spark, sf), document_cases(spark, sf))


# --- cases, records, facts ---------------------------------------------------
def case_rows(spark, sf):
    """Cases with policy, record and control inputs, one row per order."""
    o = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = load(spark, sf, "customer", "c_custkey", "c_acctbal")
    price, balance = cents(F.col("o_totalprice")), cents(F.col("c_acctbal"))
    key = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        key.alias("case_id"),
        F.array(*[F.lit(f) for f in R.FAMILIES])[(key % 8).cast("int")].alias("family"),
        F.concat(F.lit("p"), key).alias("policy_id"),
        F.concat(F.lit("r"), key).alias("record_id"),
        F.concat(F.lit("c"), key).alias("control_id"),
        (F.substring("o_orderpriority", 1, 1).cast("long") * 5_000_000).alias("approval_limit"),
        F.concat(F.lit("queue"), key % 4).alias("escalation_owner"),
        (F.expr("o_orderkey div 8") % 2 == 0).alias("supporting_evidence_verified"),
        price.alias("risk_amount"),
        price.alias("instruction_total"),
        F.lit(500).cast("long").alias("block_quantity"),
        price.alias("statement_balance"),
        balance.alias("opening_balance"),
        price.alias("exposure"),
        balance.alias("collateral"),
        F.lit(1_000_000).cast("long").alias("threshold"),
        F.lit(20_000_000).cast("long").alias("minimum_transfer"),
        (key % 64).alias("requested_mask"),
        (F.col("o_custkey") % 64).alias("approved_mask"),
        ((key * 7) % 64).alias("revoked_mask"),
        F.expr(f"unix_seconds(timestamp'{CUTOFF}') div 60").alias("cutoff_minute"),
        F.array(F.lit(0), F.lit(1), F.lit(3)).cast("array<bigint>").alias("approved_issuers"),
        F.lit(0).cast("long").alias("opening_sequence"),
    )


FACT_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity")


def fact_rows(spark, sf):
    li = load(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", *FACT_ORDER)
    amount = cents(F.col("l_extendedprice"))
    return li.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("event_id"),
        F.struct(*FACT_ORDER).alias("pos"),
        amount.alias("amount"),
        (F.col("l_linestatus") == "F").alias("completed"),
        F.col("l_quantity").cast("long").alias("quantity"),
        minute("l_shipdate").alias("effective_minute"),
        (F.col("l_linenumber") % 3).alias("revision"),
        amount.alias("notional"),
        (F.col("l_suppkey") % 5).alias("issuer"),
        (F.col("l_returnflag") != "R").alias("valid"),
        F.col("l_linenumber").cast("long").alias("sequence"),
        (F.col("l_returnflag") != "N").alias("acknowledged"),
    )


def facts(spark, sf, *fields):
    return R.last_facts(fact_rows(spark, sf), *fields)


sql_view(
    "v_cases",
    f"""SELECT o_orderkey AS case_id,
  (['settlement', 'allocations', 'reconciliation', 'margin', 'permissions', 'lifecycle', 'evidence', 'temporal'])[o_orderkey % 8 + 1] AS family,
  'p' || o_orderkey AS policy_id, 'r' || o_orderkey AS record_id, 'c' || o_orderkey AS control_id,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 5000000 AS approval_limit, 'queue' || (o_orderkey % 4) AS owner,
  (o_orderkey // 8) % 2 = 0 AS verified, CAST(round(o_totalprice * 100) AS BIGINT) AS price,
  CAST(round(c_acctbal * 100) AS BIGINT) AS balance, o_orderkey % 64 AS requested, o_custkey % 64 AS approved,
  (o_orderkey * 7) % 64 AS revoked, CAST(epoch(TIMESTAMP '{CUTOFF}') AS BIGINT) // 60 AS cutoff_minute,
  o_orderstatus, o_custkey
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
sql_view(
    "v_fact_all",
    f"""SELECT l_orderkey AS case_id, l_linenumber AS event_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(FACT_ORDER)}) AS pos,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, l_linestatus = 'F' AS completed, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(epoch(l_shipdate) AS BIGINT) // 60 AS effective_minute, l_linenumber % 3 AS revision, l_suppkey % 5 AS issuer,
  l_returnflag <> 'R' AS valid, l_linenumber AS sequence, l_returnflag <> 'N' AS acknowledged FROM lineitem""",
)
sql_view(
    "v_facts",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, event_id ORDER BY pos DESC) AS rn,
  min(pos) OVER (PARTITION BY case_id, event_id) AS first_pos FROM v_fact_all) WHERE rn = 1""",
)


@query("facts_dedup_last", "SELECT case_id, event_id, amount, quantity, completed, issuer FROM v_facts")
def facts_dedup_last(spark, sf):
    return facts(spark, sf, "amount", "quantity", "completed", "issuer").drop("first_pos")


VALUE_SQL = {
    "settlement": "price - coalesce((SELECT sum(amount) FROM v_facts f WHERE f.case_id = c.case_id AND completed), 0)",
    "allocations": "500 - coalesce((SELECT sum(quantity) FROM v_facts f WHERE f.case_id = c.case_id), 0)",
    "reconciliation": "price - balance - coalesce((SELECT sum(amount) FROM v_facts f WHERE f.case_id = c.case_id), 0)",
    "margin": "CASE WHEN greatest(0, price - balance - 1000000) >= 20000000 THEN greatest(0, price - balance - 1000000) ELSE 0 END",
    "permissions": "requested & approved & (~revoked)",
    "lifecycle": """(SELECT arg_max(amount, (effective_minute, revision, -first_pos)) FROM v_facts f
      WHERE f.case_id = c.case_id AND effective_minute <= c.cutoff_minute)""",
    "evidence": "(SELECT count(DISTINCT issuer) FROM v_facts f WHERE f.case_id = c.case_id AND valid AND issuer IN (0, 1, 3))",
    "temporal": """coalesce((SELECT max(sequence) FROM (SELECT case_id, sequence, row_number() OVER (PARTITION BY case_id ORDER BY sequence) AS rn
      FROM (SELECT DISTINCT case_id, sequence FROM v_facts WHERE acknowledged)) s WHERE s.case_id = c.case_id AND sequence = rn), 0)""",
}
for _family, _expr in VALUE_SQL.items():
    sql_view(f"v_value_{_family}", f"SELECT case_id, CAST({_expr} AS BIGINT) AS value FROM v_cases c")


@query("value_settlement", "SELECT * FROM v_value_settlement")
def value_settlement(spark, sf):
    return R.settlement_value(case_rows(spark, sf), facts(spark, sf, "amount", "completed"))


@query("value_allocations", "SELECT * FROM v_value_allocations")
def value_allocations(spark, sf):
    return R.allocation_value(case_rows(spark, sf), facts(spark, sf, "quantity"))


@query("value_reconciliation", "SELECT * FROM v_value_reconciliation")
def value_reconciliation(spark, sf):
    return R.reconciliation_value(case_rows(spark, sf), facts(spark, sf, "amount"))


@query("value_margin", "SELECT * FROM v_value_margin")
def value_margin(spark, sf):
    return R.margin_value(case_rows(spark, sf))


@query("value_permissions", "SELECT * FROM v_value_permissions")
def value_permissions(spark, sf):
    return R.permission_value(case_rows(spark, sf))


@query("value_lifecycle", "SELECT * FROM v_value_lifecycle")
def value_lifecycle(spark, sf):
    return R.lifecycle_value(case_rows(spark, sf), facts(spark, sf, "effective_minute", "revision", "notional"))


@query("value_evidence", "SELECT * FROM v_value_evidence")
def value_evidence(spark, sf):
    return R.evidence_value(case_rows(spark, sf), facts(spark, sf, "issuer", "valid"))


@query("value_temporal", "SELECT * FROM v_value_temporal")
def value_temporal(spark, sf):
    return R.temporal_value(case_rows(spark, sf), facts(spark, sf, "sequence", "acknowledged"))


_values = " UNION ALL ".join(
    f"SELECT v.case_id, v.value FROM v_value_{f} v JOIN v_cases c USING (case_id) WHERE c.family = '{f}'" for f in VALUE_SQL
)
_operations = " ".join(f"WHEN '{f}' THEN '{op}'" for f, op in R.OPERATIONS.items())
sql_view("v_targets", _values)
sql_view(
    "v_gold",
    f"""SELECT case_id, family, t.value AS target,
  CASE WHEN NOT verified THEN 'missing_evidence' WHEN price > approval_limit THEN 'approval_required' ELSE 'within_authority' END AS diagnosis,
  CASE WHEN NOT verified THEN 'escalate' WHEN price > approval_limit THEN 'approve' ELSE 'execute' END AS route,
  CASE family {_operations} END AS operation, policy_id || ',' || record_id || ',' || control_id AS evidence,
  policy_id AS policy, owner FROM v_cases JOIN v_targets t USING (case_id)""",
)


def gold(spark, sf):
    return R.resolve_cases(case_rows(spark, sf), fact_rows(spark, sf))


@query("gold_cases", "SELECT * FROM v_gold")
def gold_cases(spark, sf):
    return gold(spark, sf).withColumn("evidence", F.array_join("evidence", ","))


@query(
    "business_objects",
    """SELECT case_id, family,
  CAST(CASE family WHEN 'settlement' THEN paid + v END AS BIGINT) AS paid,
  CAST(CASE family WHEN 'settlement' THEN price - paid - v WHEN 'allocations' THEN 500 - qty - v END AS BIGINT) AS remaining,
  CAST(CASE family WHEN 'allocations' THEN qty + v END AS BIGINT) AS allocated,
  CAST(CASE family WHEN 'reconciliation' THEN balance + amt + v END AS BIGINT) AS closing,
  CAST(CASE family WHEN 'reconciliation' THEN price - balance - amt - v END AS BIGINT) AS residual,
  CASE family WHEN 'margin' THEN CASE WHEN v <> 0 THEN 'issued' ELSE 'below_mta' END END AS call_status,
  CASE family WHEN 'permissions' THEN v END AS active_scope, CASE family WHEN 'permissions' THEN revoked END AS revoked_scope,
  CASE family WHEN 'lifecycle' THEN v END AS notional, CASE family WHEN 'evidence' THEN v END AS independent_proofs,
  CASE family WHEN 'temporal' THEN v END AS last_acknowledged
FROM (SELECT c.*, t.value AS v, coalesce(s.paid, 0) AS paid, coalesce(s.qty, 0) AS qty, coalesce(s.amt, 0) AS amt
  FROM v_cases c JOIN v_targets t USING (case_id) LEFT JOIN (SELECT case_id, sum(amount) FILTER (completed) AS paid,
    sum(quantity) AS qty, sum(amount) AS amt FROM v_facts GROUP BY case_id) s USING (case_id))""",
)
def business_objects(spark, sf):
    return R.business_objects(R.case_measures(case_rows(spark, sf), fact_rows(spark, sf)))


@query(
    "journal_balance",
    """SELECT case_id, CAST(CASE WHEN case_id % 97 = 0 THEN 1 ELSE 0 END AS BIGINT) AS total, case_id % 97 <> 0 AS balanced
FROM v_cases WHERE family IN ('settlement', 'reconciliation')""",
)
def journal_balance(spark, sf):
    """Two legs per executed case; every 97th case has a leg that is off by one."""
    c, f = case_rows(spark, sf), facts(spark, sf, "amount", "completed")
    kept = c.where(F.col("family").isin("settlement", "reconciliation"))
    values = R.settlement_value(kept.where(F.col("family") == "settlement"), f).unionByName(
        R.reconciliation_value(kept.where(F.col("family") == "reconciliation"), f)
    )
    off = F.when(F.col("case_id") % 97 == 0, 1).otherwise(0)
    legs = F.array(
        F.struct(F.lit("case_account").alias("account"), F.col("value").alias("amount")),
        F.struct(F.lit("control_account").alias("account"), (off - F.col("value")).alias("amount")),
    )
    return R.journal_balance(values.select("case_id", F.explode(legs).alias("leg")).select("case_id", "leg.*"))


@query(
    "compositional_split",
    """SELECT split, stale_policy, duplicate_event, materiality, missing_evidence, count(*) AS n FROM (
  SELECT *, CASE WHEN (stale_policy::INT + duplicate_event::INT + materiality::INT + missing_evidence::INT) % 2 = 1
    THEN 'evaluation' ELSE 'development' END AS split FROM (
  SELECT o_orderstatus = 'F' AS stale_policy, o_orderkey % 3 = 0 AS duplicate_event,
    o_totalprice > 250000 AS materiality, (o_orderkey // 8) % 2 = 1 AS missing_evidence FROM orders))
GROUP BY ALL""",
)
def compositional_split(spark, sf):
    o = load(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    flags = o.select(
        (F.col("o_orderstatus") == "F").alias("stale_policy"),
        (F.col("o_orderkey") % 3 == 0).alias("duplicate_event"),
        (F.col("o_totalprice") > 250000).alias("materiality"),
        (F.expr("o_orderkey div 8") % 2 == 1).alias("missing_evidence"),
    )
    names = flags.columns
    return R.compositional_split(flags, names).groupBy("split", *names).agg(F.count("*").alias("n"))
