"""Citations of assessments built from orders and lineitem."""
from __future__ import annotations

from pyspark.sql import functions as F

from auditframe.operators import replay as Y
from auditframe.plans.registry import query, sql_view
from auditframe.plans.rules import gold
from auditframe.session import materialise


def documents_in(evidence):
    return F.transform(evidence, lambda e: F.struct(e.alias("id"), F.sha2(e, 256).alias("sha256"))).alias("documents")


def cases(spark, sf):
    """Expected answers with three documents per case; a case without a value is left out, as it has no answer."""
    g = gold(spark, sf).where("target IS NOT NULL")
    return g.select(
        "case_id", F.lit(0).cast("long").alias("initial_value"), "target", "diagnosis", "route", "operation", "policy", "owner", "evidence", documents_in("evidence")
    )


sql_view("v_answered", "SELECT * FROM v_gold WHERE target IS NOT NULL")


@query(
    "citation_valid",
    """SELECT case_id, 3 AS pos, case_id % 7 <> 0 AND case_id % 11 <> 0 AS valid, case_id % 7 <> 0 AND case_id % 11 <> 0 AND case_id % 13 <> 0 AS complete FROM v_answered""",
)
def citation_valid(spark, sf):
    """Assessments at position 3: some cite a document read later, with a wrong hash, or not all of them."""
    # The answers are worked out once; digests of the documents are made where they are read.
    answered = materialise(cases(spark, sf).select("case_id", "evidence"))
    c = answered.select(F.lit("m").alias("model"), "case_id", "evidence", documents_in("evidence"))
    key = F.col("case_id")
    first = F.col("documents")[0]
    wrong = F.array(F.struct(first["id"].alias("id"), F.lit("0").alias("sha256")))
    cited = F.when(key % 11 == 0, F.concat(wrong, F.slice("documents", 2, 2))).when(key % 13 == 0, F.slice("documents", 1, 2)).otherwise(F.col("documents"))
    assessments = c.select("model", "case_id", F.lit(3).alias("pos"), cited.alias("citations"))
    reads = c.select("model", "case_id", F.posexplode("evidence").alias("pos", "doc_id")).select(
        "model", "case_id", F.when((key % 7 == 0) & (F.col("pos") == 0), 9).otherwise(F.col("pos")).alias("pos"), "doc_id"
    )
    documents = c.select("case_id", F.explode("documents").alias("d")).select("case_id", F.col("d.id").alias("doc_id"), "d.sha256")
    return Y.citation_validity(assessments, reads, documents, c).drop("model")
