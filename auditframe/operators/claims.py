"""Claims against evidence: support, refusals, acceptance and rendering.

Tables carry task_id; a task's supplied evidence is the evidence its propositions and
coverage name.  Qualifier maps are compared through their canonical string.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.canon import normal_text, qualifier_key
from auditframe.functions.ordered import positions, ranged

PROPOSITION = ("subject", "relation", "object", "polarity")
KEY = ["subject", "relation", "object", "polarity", "qualifier_key"]
COVERED = ["subject", "relation", "qualifier_key"]
MAX_CITED = 32  # most evidence ids a claim may name


def normalised(df: DataFrame) -> DataFrame:
    """Text fields with single blanks, and qualifiers as qualifier_key."""
    fields = {c: normal_text(F.col(c)) for c in PROPOSITION if c in df.columns}
    return df.withColumns({**fields, "qualifier_key": qualifier_key(F.col("qualifiers"))})


def citations(claims: DataFrame) -> DataFrame:
    """One row per cited evidence of a claim, with its place in the claim."""
    return claims.select(
        "task_id", "claim_id", "pos", F.posexplode("evidence_ids").alias("evidence_pos", "evidence_id"),
        *[c for c in KEY if c in claims.columns],
    )


def claim_support(claims: DataFrame, propositions: DataFrame) -> DataFrame:
    """(task_id, claim_id, supported): every cited evidence holds exactly the claimed proposition."""
    cited = citations(normalised(claims))
    known = normalised(propositions).select("task_id", "evidence_id", *KEY, F.lit(True).alias("_hit")).distinct()
    joined = cited.join(known, ["task_id", "evidence_id", *KEY], "left")
    held = joined.groupBy("task_id", "claim_id").agg(
        F.bool_and(F.col("_hit").isNotNull()).alias("_all")
    )
    return claims.select("task_id", "claim_id").join(held, ["task_id", "claim_id"], "left").select(
        "task_id", "claim_id", F.coalesce("_all", F.lit(False)).alias("supported")
    )


def citation_problems(claims: DataFrame, supplied: DataFrame) -> DataFrame:
    """Claims that cite nothing, repeat an evidence id, or cite outside the supplied set."""
    ids = F.col("evidence_ids")
    shape = F.when(F.size(ids) == 0, "empty").when(F.size(ids) > MAX_CITED, "too_many").when(
        F.size(ids) != F.size(F.array_distinct(ids)), "repeated"
    )
    own = claims.select("task_id", "claim_id", shape.alias("problem")).where("problem IS NOT NULL")
    outside = citations(claims).join(supplied, ["task_id", "evidence_id"], "left_anti").select(
        "task_id", "claim_id", F.lit("outside").alias("problem")
    ).distinct()
    return own.unionByName(outside)


def claim_errors(claims: DataFrame, propositions: DataFrame, supplied: DataFrame) -> DataFrame:
    """(task_id, claim_id, error_code): the reason a claim is refused, NULL when it stands."""
    problems = citation_problems(claims, supplied).groupBy("task_id", "claim_id").agg(
        F.bool_or(F.col("problem") == "outside").alias("_outside"), F.bool_or(F.col("problem") != "outside").alias("_shape")
    )
    d = claim_support(claims, propositions).join(problems, ["task_id", "claim_id"], "left")
    code = (
        F.when(F.col("_shape"), "VALIDATION_REJECTED").when(F.col("_outside"), "EVIDENCE_OUTSIDE_SET")
        .when(~F.col("supported"), "UNSUPPORTED_ADDITION")
    )
    return d.select("task_id", "claim_id", code.alias("error_code"))


def refusal_verdicts(refusals: DataFrame, propositions: DataFrame, coverage: DataFrame) -> DataFrame:
    """(task_id, verdict): contradicted when any supplied evidence supports what was refused,
    uncovered when no cited evidence covers it, else accepted."""
    asked = normalised(refusals)
    supported = (
        asked.join(normalised(propositions).select("task_id", *KEY).distinct(), ["task_id", *KEY], "left_semi")
        .select("task_id", F.lit(True).alias("_contradicted"))
    )
    spans = normalised(coverage).select("task_id", "evidence_id", *COVERED).distinct()
    covered = (
        asked.select("task_id", *COVERED, F.explode("evidence_ids").alias("evidence_id"))
        .join(spans, ["task_id", "evidence_id", *COVERED], "left_semi").select("task_id", F.lit(True).alias("_covered")).distinct()
    )
    verdict = F.when(F.col("_contradicted"), "contradicted").when(F.col("_covered").isNull(), "uncovered").otherwise("accepted")
    return refusals.select("task_id").join(supported, "task_id", "left").join(covered, "task_id", "left").select(
        "task_id", verdict.alias("verdict")
    )


def oracle_match(selected: DataFrame, expected: DataFrame) -> DataFrame:
    """(task_id, oracle_match): equal as bags of claims, ignoring claim ids and order.

    Claims are counted per task and content on both sides, so a task with very many
    claims is compared row by row and never gathered.
    """
    def bag(df: DataFrame, name: str) -> DataFrame:
        d = normalised(df).withColumn("_ids", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ","))
        return d.groupBy("task_id", *KEY, "_ids").agg(F.count("*").alias(name))

    both = bag(selected, "_s").join(bag(expected, "_e"), ["task_id", *KEY, "_ids"], "full_outer")
    return both.groupBy("task_id").agg(F.bool_and(F.col("_s").eqNullSafe(F.col("_e"))).alias("oracle_match"))


def acceptance(records: DataFrame, *, required_calls: int, minimum_rate: float, real_provider: bool, frozen: bool) -> DataFrame:
    """One row of counts, rates over completed calls, and boolean gates.

    records: provider_completed, selection_schema_valid, semantic_valid,
    rendered_schema_valid, oracle_match, error_code.
    """
    def errors(*codes: str) -> Column:
        return F.count_if(F.coalesce(F.col("error_code").isin(*codes), F.lit(False)))

    counts = records.agg(
        F.count("*").alias("attempted_calls"),
        F.count_if("provider_completed").alias("completed_calls"),
        F.count_if("selection_schema_valid").alias("schema_valid_selections"),
        F.count_if("semantic_valid").alias("semantic_valid_selections"),
        F.count_if("rendered_schema_valid").alias("rendered_schema_valid_objects"),
        errors("EVIDENCE_OUTSIDE_SET").alias("evidence_outside_set"),
        errors("UNSUPPORTED_ADDITION").alias("unsupported_additions"),
        errors("REFUSAL_REJECTED").alias("rejected_refusals"),
        errors("SCHEMA_INVALID", "VALIDATION_REJECTED").alias("other_validation_rejections"),
        errors("ORACLE_MISMATCH").alias("oracle_mismatches"),
        F.count_if(F.col("provider_completed") & ~F.col("oracle_match")).alias("_unmatched"),
    )
    completed = F.col("completed_calls")
    rates = counts.withColumns({
        "completion_rate": completed / F.col("attempted_calls"),
        "schema_valid_selection_rate": F.col("schema_valid_selections") / F.greatest(F.lit(1), completed),
        "rendered_schema_valid_rate": F.col("rendered_schema_valid_objects") / F.greatest(F.lit(1), completed),
    })
    gates = {
        "gate_exact_calls": F.col("attempted_calls") == required_calls,
        "gate_minimum_completed": F.col("completion_rate") >= minimum_rate,
        "gate_schema_valid": F.col("schema_valid_selections") == completed,
        "gate_semantically_valid": F.col("semantic_valid_selections") == completed,
        "gate_match_oracle": F.col("_unmatched") == 0,
        "gate_rendered_valid": F.col("rendered_schema_valid_objects") == completed,
        "gate_no_outside_evidence": F.col("evidence_outside_set") == 0,
        "gate_no_unsupported_additions": F.col("unsupported_additions") == 0,
        "gate_no_rejected_refusals": F.col("rejected_refusals") == 0,
        "gate_real_provider": F.lit(real_provider),
        "gate_frozen_task_set": F.lit(frozen),
    }
    gated = rates.withColumns(gates)
    every = F.lit(True)
    for name in gates:
        every = every & F.col(name)
    return gated.withColumn("status", F.when(every, "PASS").otherwise("FAIL")).drop("_unmatched")


def coverage_differences(tasks: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose number of tasks is not the expected one."""
    found = tasks.groupBy(*by).agg(F.count("*").alias("found"))
    wanted = expected.select(*by, F.col("n").alias("expected"))
    return found.join(wanted, by, "full_outer").where(~F.col("found").eqNullSafe(F.col("expected")))


def cited_refusals(refusals: DataFrame) -> DataFrame:
    """Refusals (task_id, evidence_ids) as what citation_markers numbers: one item per task without a claim."""
    return refusals.select("task_id", F.lit(None).cast("long").alias("claim_id"), F.lit(0).alias("pos"), "evidence_ids")


def citation_markers(claims: DataFrame) -> DataFrame:
    """Marker and citation id of each evidence of a task, by first appearance, and how many claims use it (none, for a refusal)."""
    place = F.struct(F.col("pos").cast("long").alias("pos"), F.col("evidence_pos").alias("at"))
    first = citations(claims).groupBy("task_id", "evidence_id").agg(
        F.min(place).alias("_first"), F.count_distinct("claim_id").alias("claims")
    )
    numbered = positions(ranged(first, ["task_id"], "_first"), ["task_id"], "_first", "marker_number")
    number = F.col("marker_number").cast("string")
    three = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return numbered.select(
        "task_id", "evidence_id", F.col("marker_number").cast("long").alias("marker_number"),
        F.concat(F.lit("["), number, F.lit("]")).alias("marker"), F.concat(F.lit("citation-"), three).alias("citation_id"), "claims",
    )


def marker_claims(claims: DataFrame, markers: DataFrame) -> DataFrame:
    """The claims behind each marker, one row each."""
    return citations(claims).select("task_id", "evidence_id", "claim_id").distinct().join(
        markers.select("task_id", "evidence_id", "marker"), ["task_id", "evidence_id"]
    )


def plain(text: Column) -> Column:
    """Square brackets made round, so that text cannot look like a marker."""
    return F.coalesce(normal_text(F.translate(text, "[]", "()")), F.lit(""))


def claim_sentence(subject: Column, relation: Column, object_: Column, polarity: Column, qualifiers: Column) -> Column:
    predicate = (
        F.when(polarity == "affirmed", relation).when(polarity == "negated", F.concat(F.lit("does not "), relation))
        .otherwise(F.concat(F.lit("has unknown "), relation))
    )
    pairs = F.transform(
        F.array_sort(F.map_entries(qualifiers)), lambda e: F.concat(plain(e["key"]), F.lit("="), plain(e["value"]))
    )
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit(" ("), F.array_join(pairs, ", "), F.lit(")"))).otherwise("")
    return F.concat(plain(subject), F.lit(" "), plain(predicate), F.lit(" "), plain(object_), tail, F.lit("."))


def refusal_sentence(subject: Column, relation: Column, object_: Column) -> Column:
    return F.concat(
        F.lit("The supplied evidence does not establish that "), plain(subject), F.lit(" "), plain(relation), F.lit(" "), plain(object_), F.lit(".")
    )


def _with_markers(items: DataFrame, markers: DataFrame, keys: list[str], sentence: Column) -> DataFrame:
    """The sentence and the item's markers in the order of its evidence; at most 32 markers are gathered for one."""
    marked = citations(items).join(markers.select("task_id", "evidence_id", "marker"), ["task_id", "evidence_id"])
    gathered = marked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("evidence_pos", "marker"))).alias("_m"))
    joined = items.join(gathered, keys)
    return joined.select(*keys, F.concat(sentence, F.lit(" "), F.array_join(F.transform("_m", lambda m: m["marker"]), " ")).alias("sentence"))


def rendered_claims(claims: DataFrame, markers: DataFrame) -> DataFrame:
    """One sentence with its markers per claim."""
    return _with_markers(claims, markers, ["task_id", "claim_id"], claim_sentence(*(F.col(c) for c in PROPOSITION), F.col("qualifiers")))


def rendered_refusals(refusals: DataFrame, markers: DataFrame) -> DataFrame:
    """One sentence with its markers per refusal: task_id, subject, relation, object, evidence_ids."""
    items = refusals.withColumns({"claim_id": F.lit(None).cast("long"), "pos": F.lit(0)})
    return _with_markers(items, markers, ["task_id"], refusal_sentence(F.col("subject"), F.col("relation"), F.col("object")))


def rejected_additions(expected: DataFrame, forbidden: DataFrame, propositions: DataFrame) -> DataFrame:
    """(task_id, rejected): the expected claims plus a forbidden one must not all be supported."""
    both = expected.withColumn("claim_id", F.concat(F.lit("e"), "claim_id")).unionByName(
        forbidden.withColumn("claim_id", F.concat(F.lit("f"), "claim_id"))
    )
    verdicts = claim_support(both, propositions)
    return verdicts.join(forbidden.select("task_id").distinct(), "task_id", "left_semi").groupBy("task_id").agg(
        F.bool_or(~F.col("supported")).alias("rejected")
    )
