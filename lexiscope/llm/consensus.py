"""Problem 5: consensus labels from annotators who disagree, by message passing on the graph of label edges.

One class (the label true) stands against the rest. An edge joins an item and an annotator who voted on it. Along it run

* item to annotator: how likely the item is true by all *other* votes on it, and
* annotator to item: the log-likelihood ratio of the vote by how the annotator's votes agree with the messages of all
  *other* items: sensitivity and false-alarm rate, each with a weak prior, so a careless annotator weighs nothing, one
  who always says yes weighs little when saying so, and one who inverts counts inverted.

Rounds go on until every message stands still, the largest step counting; after ``DAMP_AFTER`` rounds a message only goes half
way, which ends swings. What has not settled after ``MAX_ROUNDS`` is told: each item has the flag ``converged``. Sums per annotator are combined map-side, so an annotator with a third of all
votes is one row per task. Each round is written to the shared folder.

Defined cases: null votes, items or annotators are no edge; repeated rows count once, and contradicting votes of one
annotator on one item both count; an item without votes has no label; an exact tie has no label; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.session import cut_lineage

MAX_ROUNDS = 40
DAMP_AFTER = 12
TOLERANCE = 5e-3
START_SLOPE = 12.0
PRIOR_RIGHT, PRIOR_WRONG = 3.0, 1.0


def vote_edges(wide: DataFrame, long: DataFrame) -> DataFrame:
    """Distinct (item_id, annotator, vote) of the wide table's raters (``voto__<name>``) and of the long table."""
    raters = [c for c in wide.columns if c.lower().startswith("voto__")]
    votes = [F.struct(F.lit(c.split("__", 1)[1]).alias("annotator"), F.col(f"`{c}`").cast("boolean").alias("vote")) for c in raters]
    own = long.select("item_id", F.col("annotator_id").alias("annotator"), F.col("is_ubw").alias("vote"))
    if votes:
        own = own.unionByName(wide.select("item_id", F.explode(F.array(*votes)).alias("v")).select("item_id", "v.annotator", "v.vote"))
    return own.dropna().distinct()


def _annotator_sums(messages: DataFrame) -> DataFrame:
    yes, p = F.col("vote").cast("double"), F.col("p")
    return messages.groupBy("annotator").agg(
        F.sum(p * yes).alias("hit"), F.sum(p).alias("pos"), F.sum((1 - p) * yes).alias("alarm"), F.sum(1 - p).alias("neg"), F.count(F.lit(1)).alias("n_votes")
    )


def _rates(own: float = 1.0):
    """Sensitivity and false-alarm rate of the annotator without the edge's own share."""
    yes, p = F.col("vote").cast("double"), F.col("p")
    sens = (F.col("hit") - own * p * yes + PRIOR_RIGHT) / (F.col("pos") - own * p + PRIOR_RIGHT + PRIOR_WRONG)
    alarm = (F.col("alarm") - own * (1 - p) * yes + PRIOR_WRONG) / (F.col("neg") - own * (1 - p) + PRIOR_RIGHT + PRIOR_WRONG)
    return F.greatest(sens, F.lit(1e-6)), F.greatest(alarm, F.lit(1e-6))


def pass_messages(edges: DataFrame) -> DataFrame:
    """Edges with p (item true by the other votes), llr (the vote's weight) and total (the item's log-odds)."""
    by_item = edges.groupBy("item_id").agg(F.sum(F.col("vote").cast("double")).alias("yes"), F.count(F.lit(1)).alias("n"))
    others = (F.col("yes") - F.col("vote").cast("double") + 0.5) / F.col("n")
    start = 1 / (1 + F.exp(-START_SLOPE * (others - 0.5)))  # a sharp start: from a flat one the rounds would creep
    messages = cut_lineage(edges.join(by_item, "item_id").select("item_id", "annotator", "vote", start.alias("p")))
    share = messages.agg(F.avg("p")).first()[0]
    if share is None:
        return messages.withColumns({"llr": F.lit(0.0), "total": F.lit(0.0), "p_before": F.col("p")})
    for turn in range(MAX_ROUNDS):
        sums = _annotator_sums(messages)
        sens, alarm = _rates()
        llr = F.when(F.col("vote"), F.log(sens / alarm)).otherwise(F.log(F.greatest(1 - sens, F.lit(1e-6)) / F.greatest(1 - alarm, F.lit(1e-6))))
        weighed = messages.join(sums, "annotator").select("item_id", "annotator", "vote", F.col("p").alias("p_before"), llr.alias("llr"))
        share = min(max(share, 1e-6), 1 - 1e-6)
        prior = F.lit(math.log(share / (1 - share)))
        totals = weighed.groupBy("item_id").agg(F.sum("llr").alias("weight"))
        joined = weighed.join(totals, "item_id")
        total = F.col("weight") + prior
        fresh = 1 / (1 + F.exp(-(total - F.col("llr"))))
        p = fresh if turn < DAMP_AFTER else (fresh + F.col("p_before")) / 2
        messages = cut_lineage(joined.select("item_id", "annotator", "vote", "llr", "p_before", total.alias("total"), p.alias("p")))
        share, moved = messages.agg(F.avg("p"), F.max(F.abs(F.col("p") - F.col("p_before")))).first()
        if moved < TOLERANCE:
            break
    return messages


def item_labels(messages: DataFrame) -> DataFrame:
    """(item_id, label, probability, agreement, n_votes, converged): agreement is the share of pairs of votes that agree, 1 for one vote."""
    n, yes = F.col("n_votes").cast("double"), F.col("yes").cast("double")
    same = (yes * (yes - 1) + (n - yes) * (n - yes - 1)) / (n * (n - 1))
    out = messages.groupBy("item_id").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("n_votes"), F.sum(F.col("vote").cast("int")).alias("yes"), F.max(F.abs(F.col("p") - F.col("p_before"))).alias("moved"))
    return out.select(
        "item_id", F.when(F.col("total") != 0, F.col("total") > 0).alias("label"), (1 / (1 + F.exp(-F.col("total")))).alias("probability"),
        F.when(F.col("n_votes") > 1, same).otherwise(1.0).alias("agreement"), "n_votes", (F.col("moved") < TOLERANCE).alias("converged"),
    )


def annotator_reliability(messages: DataFrame) -> DataFrame:
    """(annotator, n_votes, sensitivity, specificity, informedness) of every annotator."""
    total = F.col("total")
    whole = messages.withColumn("p", 1 / (1 + F.exp(-total)))
    sums = _annotator_sums(whole)
    sens = (F.col("hit") + PRIOR_RIGHT) / (F.col("pos") + PRIOR_RIGHT + PRIOR_WRONG)
    alarm = (F.col("alarm") + PRIOR_WRONG) / (F.col("neg") + PRIOR_RIGHT + PRIOR_WRONG)
    return sums.select("annotator", "n_votes", sens.alias("sensitivity"), (1 - alarm).alias("specificity"), (sens - alarm).alias("informedness"))


def wrong_gold(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id) of items whose recorded gold differs from the consensus; items without gold or label are left out."""
    gold = wide.where(F.col("gold_is_ubw").isNotNull()).select("item_id", "gold_is_ubw").distinct()
    return gold.join(labels, "item_id").where(F.col("gold_is_ubw") != F.col("label")).select("item_id").distinct()
