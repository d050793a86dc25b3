"""Queries of problem 4: results per key when a few keys hold most rows."""

from __future__ import annotations

from lexiscope.operators import skew
from lexiscope.plans.registry import query
from lexiscope.sources.tables import load

FIELDS = ["repo_full_name", "matched_expression"]

FOUND_SQL = """
WITH n AS (SELECT count(*) AS total FROM occurrences),
k AS (
  SELECT 'repo_full_name' AS field_name, repo_full_name AS key_value, count(*) AS c FROM occurrences GROUP BY repo_full_name
  UNION ALL
  SELECT 'matched_expression', matched_expression, count(*) FROM occurrences GROUP BY matched_expression)
SELECT field_name, key_value FROM k, n WHERE c * 50 >= total AND key_value IS NOT NULL
"""

PROFILE_SQL = """
WITH d AS (SELECT {key} AS key_value, artifact_type, artifact_id,
                  CASE WHEN is_censored = 0 THEN time_to_event_days END AS days FROM occurrences)
SELECT key_value, count(*) AS n_rows, count(DISTINCT (artifact_type, artifact_id)) AS n_artifacts, count(days) AS n_removed,
       sum(days) / count(days)::DOUBLE AS mean_days, max(days) AS max_days, quantile_cont(days::DOUBLE, 0.5) AS median_days
FROM d GROUP BY key_value
"""


@query("p4_found", FOUND_SQL)
def p4_found(spark, root):
    return skew.dominant_keys(load(spark, root, "occurrences"), FIELDS)


def _profile(key):
    def run(spark, root):
        facts = load(spark, root, "occurrences")
        plan = skew.plan_shards(skew.key_loads(facts, key), skew.tasks_for(facts))
        return skew.key_profile(facts, key, plan)

    return run


query("p4_profile_by_repo", PROFILE_SQL.format(key="repo_full_name"))(_profile("repo_full_name"))
query("p4_profile_by_expression", PROFILE_SQL.format(key="matched_expression"))(_profile("matched_expression"))


@query("p4_stars_by_expression", """
WITH r AS (SELECT repo_full_name, max(stars) AS stars FROM repos GROUP BY repo_full_name)
SELECT o.matched_expression, count(*) AS n_rows, count(r.stars) AS n_known, sum(r.stars)::BIGINT AS sum_stars
FROM occurrences o LEFT JOIN r USING (repo_full_name) GROUP BY o.matched_expression
""")
def p4_stars_by_expression(spark, root):
    """A join on the skewed key: large repositories are fragmented, their one row of ``repos`` goes to each fragment."""
    from pyspark.sql import functions as F

    facts = load(spark, root, "occurrences").select("repo_full_name", "artifact_id", "matched_expression")
    side = load(spark, root, "repos").groupBy("repo_full_name").agg(F.max("stars").alias("stars"))
    plan = skew.plan_shards(skew.key_loads(facts, "repo_full_name"), skew.tasks_for(facts))
    joined = skew.balanced_join(facts, side, "repo_full_name", ["artifact_id", "matched_expression"], plan)
    return joined.groupBy("matched_expression").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("stars").alias("n_known"), F.sum("stars").alias("sum_stars")
    )
