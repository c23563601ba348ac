"""Queries: retries, smoke gates, schemas, transactions and the forms in which results go out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..registry import SQL, query
from ..sources.files import markdown_lines, server_events
from ..sources.tables import table
from . import evidence
from .evaluation import CASES_SQL, cases
from .textual import _asked, _preset_sql, preset_suggestion

GATE = SQL["e14_quality_gate"]
SETTINGS = "['fast', 'balanced', 'accurate'][video_id % 3 + 1]"


def gates(spark, sf_dir):
    """Warnings of each conversation, its transcription setting, scorer and duration."""
    length = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg((F.max("turn") * 30.0 + 30.0).alias("duration"))
    current = F.element_at(T.words_in(["fast", "balanced", "accurate"]), (F.col("video_id") % 3 + 1).cast("int"))
    return evidence.e14(spark, sf_dir).join(length, "video_id").withColumns({"current": current, "scorer": F.when(F.col("video_id") % 7 == 0, "clap").otherwise("whisper")})


LENGTH_SQL = "(SELECT conv_id AS video_id, max(turn) * 30.0::DOUBLE + 30.0::DOUBLE AS duration FROM conversations GROUP BY conv_id)"
GATES_SQL = f"g AS (SELECT g.video_id, codes, duration, {SETTINGS.replace('video_id', 'g.video_id')} AS current, CASE WHEN g.video_id % 7 = 0 THEN 'clap' ELSE 'whisper' END AS scorer FROM ({GATE}) g JOIN {LENGTH_SQL} d ON g.video_id = d.video_id)"


@query("e16_transcript_retry", f"WITH {GATES_SQL}, r AS (SELECT *, list_contains(codes, 'noisy_transcript_evidence') AND scorer = 'whisper' AND video_id % 5 <> 0 AND current <> 'accurate' AS retried FROM g) SELECT video_id, retried, CASE WHEN retried THEN 'accurate' ELSE current END AS quality FROM r")
def e16(spark, sf_dir):
    """Which conversations are transcribed again with the accurate setting; some have an override and are not."""
    g = gates(spark, sf_dir)
    retried = E.should_retry(F.col("codes"), F.col("scorer"), F.col("current"), F.lit("accurate"), F.col("video_id") % 5 == 0)
    return g.select("video_id", retried.alias("retried"), F.when(retried, "accurate").otherwise(F.col("current")).alias("quality"))


@query("v15_smoke_gates", f"""WITH {GATES_SQL}, f AS (SELECT video_id, list_concat(codes, list_filter([CASE WHEN duration < 120 THEN printf('video duration %.2fs below required 120.00s', duration) END, CASE WHEN scorer <> 'whisper' THEN 'audio scorer ' || scorer || ' did not match expected whisper' END], lambda x: x IS NOT NULL)) AS failures, scorer = 'whisper' AS routing_passed FROM g)
SELECT video_id, len(failures) = 0 AS passed, routing_passed, failures FROM f""")
def v15(spark, sf_dir):
    """Duration, scorer routing and quality of each conversation in one verdict."""
    f = gates(spark, sf_dir).select("video_id", E.smoke_failures(F.col("codes"), F.col("duration"), 120.0, F.col("scorer"), "whisper").alias("failures"), (F.col("scorer") == "whisper").alias("routing_passed"))
    return f.select("video_id", (F.size("failures") == 0).alias("passed"), "routing_passed", "failures")


@query("l4_schema_resolution", f"WITH {_preset_sql()}, c AS (SELECT b.schema_name AS schema_name, count(*) AS tasks, min(query_id) AS first_task FROM ps GROUP BY b.schema_name) SELECT schema_name, tasks, first_task FROM c")
def l4(spark, sf_dir):
    """Every task's preset resolved to its schema, counted by schema."""
    s = _asked(spark, sf_dir).select("query_id", preset_suggestion(F.col("query"))["schema_name"].alias("schema_name"))
    return s.groupBy("schema_name").agg(F.count(F.lit(1)).alias("tasks"), F.min("query_id").alias("first_task"))


@query("q15_transactional_replace", """
WITH n AS (SELECT c_custkey, upper(substr(md5('code-' || c_custkey), 1, 8)) AS code FROM customer WHERE c_acctbal < 0), o AS (SELECT c_custkey, upper(substr(md5('old-' || c_custkey), 1, 8)) AS code FROM customer)
SELECT o.c_custkey, o.code, n.c_custkey IS NOT NULL AS revoked FROM o LEFT JOIN n ON o.c_custkey = n.c_custkey UNION ALL SELECT c_custkey, code, false FROM n""")
def q15(spark, sf_dir):
    """The table after a replacement: owners in debt get a new code and their old one is revoked, in one result."""
    c = table(spark, sf_dir, "customer")
    code = lambda p: F.upper(F.substring(F.md5(F.concat(F.lit(p), F.col("c_custkey").cast("string"))), 1, 8)).alias("code")
    debt = F.col("c_acctbal") < 0
    old = c.select("c_custkey", code("old-"), F.coalesce(debt, F.lit(False)).alias("revoked"))
    return old.unionByName(c.filter(debt).select("c_custkey", code("code-"), F.lit(False).alias("revoked")))


@query("s20_markdown_report", f"""
WITH {CASES_SQL}, s AS (SELECT coalesce(source, '') AS source, count(*) AS n, round(avg((len(failures) = 0)::INT), 4) AS rate FROM fl GROUP BY source), l AS (SELECT 2 + row_number() OVER (ORDER BY source) AS line_no, '| ' || source || ' | ' || n || ' | ' || printf('%.4f', rate) || ' |' AS line FROM s)
SELECT 1::BIGINT AS line_no, '| source | cases | pass_rate |' AS line UNION ALL SELECT 2, '| --- | --- | --- |' UNION ALL SELECT line_no, line FROM l""")
def s20(spark, sf_dir):
    """The summary by source as lines of a Markdown table."""
    s = cases(spark, sf_dir).groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("cases"), F.format_string("%.4f", F.round(F.avg((F.size("failures") == 0).cast("int")), 4)).alias("pass_rate"))
    return markdown_lines(s, ["source", "cases", "pass_rate"], ["source"])


@query("s22_event_frames", "SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' || chr(10) || chr(10) AS frame FROM events")
def s22(spark, sf_dir):
    """Events as server-sent event frames."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", server_events(F.col("event_type"), F.struct("event_id", "user_id")).alias("frame"))
