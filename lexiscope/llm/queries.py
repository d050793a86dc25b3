"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiscope.llm import consensus, handwritten, packing, pii, quota_sample, repetition, splits, tokenize, truncation
from lexiscope.plans.registry import Query
from lexiscope.sources.tables import load

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p8_ids")
def p8_ids(spark, root):
    return tokenize.encode_corpus(load(spark, root, "documents"))


@query("p8_round_trip", "SELECT doc_id, true AS same FROM documents")
def p8_round_trip(spark, root):
    """Every document, and whether decoding its ids gives its text back."""
    return tokenize.round_trip(load(spark, root, "documents")).select("doc_id", "same")


@query("p9_placements")
def p9_placements(spark, root):
    return packing.pack(load(spark, root, "documents"), load(spark, root, "pack_capacities"))


@query("p9_fill")
def p9_fill(spark, root):
    return packing.fill_report(p9_placements(spark, root))


@query("p10_found")
def p10_found(spark, root):
    return repetition.rejected(repetition.stored_ledger(load(spark, root, "documents"), anew=True)).select("doc_id")


@query("p10_ledger")
def p10_ledger(spark, root):
    return repetition.stored_ledger(load(spark, root, "documents"))


@query("p10_ablations")
def p10_ablations(spark, root):
    return repetition.ablations(repetition.stored_ledger(load(spark, root, "documents")))


@query("p1_found")
def p1_found(spark, root):
    return handwritten.found_records(load(spark, root, "occurrences"))


@query("p1_files")
def p1_files(spark, root):
    return handwritten.classify(load(spark, root, "occurrences"))


@query("p1_evidence")
def p1_evidence(spark, root):
    """How many files each combination of evidence found."""
    return handwritten.evidence_report(load(spark, root, "occurrences"))


@query("p1_hand_written")
def p1_hand_written(spark, root):
    kept = handwritten.hand_written(load(spark, root, "occurrences"))
    return kept.select("repo_full_name", "artifact_type", "artifact_id", "matched_expression", "body_text")


@query("p3_found")
def p3_found(spark, root):
    cut = truncation.detect(load(spark, root, "occurrences"), anew=True).where("is_cut")
    return cut.select("repo_full_name", "artifact_type", "artifact_id", "matched_expression").distinct()


@query("p3_rates")
def p3_rates(spark, root):
    return truncation.cut_rates(truncation.detect(load(spark, root, "occurrences")))


@query("p7_found")
def p7_found(spark, root):
    return splits.same_repository(load(spark, root, "occurrences"), load(spark, root, "repos"))


@query("p7_classes")
def p7_classes(spark, root):
    """Every stored name with the representative of its repository: the membership that the pairs of p7_found expand."""
    return splits.classes(load(spark, root, "occurrences"), load(spark, root, "repos"))


@query("p7_label_shares")
def p7_label_shares(spark, root):
    return splits.label_shares(load(spark, root, "occurrences"), load(spark, root, "repos"), load(spark, root, "split_shares"))


@query("p7_assignment")
def p7_assignment(spark, root):
    return splits.assign(load(spark, root, "occurrences"), load(spark, root, "repos"), load(spark, root, "split_shares"))


@query("p7_shares")
def p7_shares(spark, root):
    from pyspark.sql import Window

    rows = p7_assignment(spark, root).groupBy("split_name").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_repositories"))
    return rows.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))


def _messages(spark, root):
    return consensus.pass_messages(consensus.vote_edges(load(spark, root, "nao_unanimes"), load(spark, root, "annotations_long")))


@query("p5_found")
def p5_found(spark, root):
    return consensus.wrong_gold(load(spark, root, "nao_unanimes"), consensus.item_labels(_messages(spark, root)))


@query("p5_items")
def p5_items(spark, root):
    return consensus.item_labels(_messages(spark, root))


@query("p5_annotators")
def p5_annotators(spark, root):
    return consensus.annotator_reliability(_messages(spark, root))


P2_REPORT_SQL = """
WITH k AS (SELECT DISTINCT repo_full_name, lower(trim(artifact_type)) AS artifact_type, artifact_id, lower(trim(matched_expression)) AS matched_expression FROM occurrences),
s AS (SELECT count(*) // 10 AS s FROM k),
h AS (SELECT artifact_type, matched_expression, count(*) AS available FROM k GROUP BY ALL),
r AS (SELECT t.artifact_type, t.matched_expression, t.target_share, t.min_rows, coalesce(h.available, 0) AS available,
             greatest(t.min_rows, CAST(ceil(t.target_share * s.s) AS BIGINT)) AS wanted
      FROM sampling_targets t CROSS JOIN s LEFT JOIN h USING (artifact_type, matched_expression))
"""


@query("p2_found", P2_REPORT_SQL + "SELECT artifact_type, matched_expression FROM r WHERE available < wanted")
def p2_found(spark, root):
    return p2_report(spark, root).where(~F.col("is_met")).select("artifact_type", "matched_expression")


@query("p2_report", P2_REPORT_SQL + """
SELECT artifact_type, matched_expression, target_share, min_rows, available, wanted, least(available, wanted) AS drawn,
       least(available, wanted) - wanted AS residual, available >= wanted AS is_met FROM r""")
def p2_report(spark, root):
    return quota_sample.draw(load(spark, root, "occurrences"), load(spark, root, "sampling_targets"))[1]


@query("p2_sample")
def p2_sample(spark, root):
    return quota_sample.draw(load(spark, root, "occurrences"), load(spark, root, "sampling_targets"))[0]


RECORD = ["repo_full_name", "artifact_type", "artifact_id", "matched_expression"]


@query("p6_found")
def p6_found(spark, root):
    occurrences = load(spark, root, "occurrences")
    return pii.found_types(occurrences, pii.fit(occurrences, anew=True), RECORD)


@query("p6_masked")
def p6_masked(spark, root):
    occurrences = load(spark, root, "occurrences")
    return pii.masked_table(occurrences.select(*RECORD, "author_name", "body_text"), pii.fit(occurrences))
