"""Queries of problems 1, 3, 6, 7 and 8, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.encoding import repair_documents
from tidelane.llm.leaks import leaked_passages
from tidelane.llm.packing import pack_documents
from tidelane.llm.stable_sample import vehicle_sample
from tidelane.llm.stays import collapse_stays
from tidelane.session import table

SAMPLE_CUT = "2025-03-03 08:00:00"


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen vehicles with their running-maximum weights."""
    return vehicle_sample(table(spark, sf_dir, "trajectories")).where("selected").drop("selected")


def p1_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of what had been ingested by a moment, stored, and carried over to all rows: who was in, who is."""
    rows = table(spark, sf_dir, "trajectories")
    early = vehicle_sample(rows.where(F.col("ingested_at") <= F.lit(SAMPLE_CUT).cast("timestamp_ntz")))
    late = vehicle_sample(rows, stored=early.select("vehicle_id", "max_weight"))
    return late.join(early.select("vehicle_id", F.col("selected").alias("was_selected")), "vehicle_id", "left").select(
        "vehicle_id", "max_weight", F.coalesce("was_selected", F.lit(False)).alias("was_selected"), "selected"
    )


def p3_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_stays(table(spark, sf_dir, "trajectories"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_stays(spark, sf_dir).where("n_readings >= 2").select(
        "vehicle_id",
        F.least("first_event", "last_event").alias("event_id_1"),
        F.greatest("first_event", "last_event").alias("event_id_2"),
    )


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "test_id").distinct()


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_documents(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_restored(spark, sf_dir).select("doc_id").distinct()


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_targets"))


QUERIES = {"p6_containers": p6_containers, "p8_found": p8_found, "p8_restored": p8_restored, "p7_found": p7_found, "p7_leaks": p7_leaks, "p1_sample": p1_sample, "p1_growth": p1_growth, "p3_found": p3_found, "p3_stays": p3_stays}

_WEIGHTS = """
    SELECT vehicle_id, sum(CAST(coalesce(floor(b - a), 0) AS BIGINT) + 1)::BIGINT AS max_weight FROM (
      SELECT vehicle_id, pass_no, min(time_seconds) AS a, max(time_seconds) AS b FROM trajectories
      WHERE vehicle_id IS NOT NULL {cut} GROUP BY ALL) GROUP BY vehicle_id
"""
_HASH = "('0x' || substr(md5('s1|' || vehicle_id), 1, 8))::BIGINT"
_STAYS = """
    WITH readings AS (
      SELECT vehicle_id, pass_no, time_seconds, min(event_id) AS e, any_value(space_index) AS s FROM trajectories
      WHERE vehicle_id IS NOT NULL AND pass_no IS NOT NULL AND time_seconds IS NOT NULL AND space_index IS NOT NULL GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN s = lag(s) OVER w THEN 0 ELSE 1 END AS new FROM readings
      WINDOW w AS (PARTITION BY vehicle_id, pass_no ORDER BY time_seconds)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY vehicle_id, pass_no ORDER BY time_seconds) AS run FROM marked),
    runs AS (SELECT vehicle_id, pass_no, run, any_value(s) AS s, count(*) AS n FROM numbered GROUP BY ALL),
    relabelled AS (SELECT vehicle_id, pass_no, run,
        CASE WHEN n <= 2 AND lag(s) OVER w = lead(s) OVER w AND abs(s - lag(s) OVER w) = 1 THEN lag(s) OVER w ELSE s END AS label
      FROM runs WINDOW w AS (PARTITION BY vehicle_id, pass_no ORDER BY run)),
    labelled AS (SELECT n.*, label, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS fresh
      FROM numbered n JOIN relabelled r USING (vehicle_id, pass_no, run)
      WINDOW w AS (PARTITION BY vehicle_id, pass_no ORDER BY time_seconds)),
    stays AS (SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id, pass_no ORDER BY time_seconds) AS stay FROM labelled),
    found AS (SELECT vehicle_id, pass_no, stay, any_value(label) AS space_index, arg_min(e, time_seconds) AS first_event,
        arg_max(e, time_seconds) AS last_event, count(*) AS n_readings, count(*) FILTER (WHERE s <> label) AS n_disturbed,
        min(time_seconds) AS start_seconds, max(time_seconds) - min(time_seconds) AS duration_seconds FROM stays GROUP BY ALL)
"""

ORACLE = {
    "p1_sample": f"""
        SELECT * FROM (SELECT vehicle_id, max_weight, {_HASH} AS id_hash FROM ({_WEIGHTS.format(cut="")}))
        WHERE id_hash < max_weight * CAST(floor(4294967296 / 3600.0) AS BIGINT)
    """,
    "p1_growth": f"""
        WITH late AS ({_WEIGHTS.format(cut="")}), early AS ({_WEIGHTS.format(cut=f"AND ingested_at <= TIMESTAMP '{SAMPLE_CUT}'")}),
        both_ AS (SELECT l.vehicle_id, greatest(l.max_weight, coalesce(e.max_weight, 0)) AS max_weight, e.max_weight AS early_weight
          FROM late l LEFT JOIN early e USING (vehicle_id))
        SELECT vehicle_id, max_weight,
          coalesce({_HASH} < early_weight * CAST(floor(4294967296 / 3600.0) AS BIGINT), false) AS was_selected,
          {_HASH} < max_weight * CAST(floor(4294967296 / 3600.0) AS BIGINT) AS selected FROM both_
    """,
    "p3_found": _STAYS + """
        SELECT vehicle_id, least(first_event, last_event) AS event_id_1, greatest(first_event, last_event) AS event_id_2
        FROM found WHERE n_readings >= 2
    """,
    "p3_stays": _STAYS + """
        SELECT vehicle_id, pass_no, space_index, first_event, last_event, n_readings, n_disturbed, start_seconds, duration_seconds FROM found
    """,
}
