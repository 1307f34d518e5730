"""Citations of submitted assessments against the documents read before."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.canon import packed


def citation_validity(assessments: DataFrame, reads: DataFrame, documents: DataFrame, gold: DataFrame) -> DataFrame:
    """Per assessment: citations non-empty, all of documents of the case read at a lower
    position and with the right hash; and whether they include all gold documents.

    assessments: model, case_id, pos, citations; reads: model, case_id, pos, doc_id;
    documents: case_id, doc_id, sha256; gold: case_id, evidence. Hashes travel packed, and of
    the citations only their ids go on to the comparison with the gold documents.
    """
    keys = ["model", "case_id", "pos"]
    first_read = reads.groupBy("model", "case_id", "doc_id").agg(F.min("pos").alias("_read"))
    cited = assessments.select(*keys, F.explode("citations").alias("c")).select(*keys, F.col("c.id").alias("doc_id"), packed(F.col("c.sha256")).alias("_said"))
    known = documents.select("case_id", "doc_id", packed(F.col("sha256")).alias("sha256"))
    looked = cited.join(known, ["case_id", "doc_id"], "left").join(first_read, ["model", "case_id", "doc_id"], "left")
    good = F.coalesce((F.col("_said") == F.col("sha256")) & (F.col("_read") < F.col("pos")), F.lit(False))
    judged = looked.groupBy(*keys).agg(F.bool_and(good).alias("_valid"))
    covers = F.size(F.array_except("evidence", "_ids")) == 0
    named = assessments.select(*keys, F.transform("citations", lambda c: c["id"]).alias("_ids"))
    d = named.join(judged, keys, "left").join(gold.select("case_id", "evidence"), "case_id", "left")
    valid = F.coalesce("_valid", F.lit(False))
    return d.select(*keys, valid.alias("valid"), (valid & covers).alias("complete"))
