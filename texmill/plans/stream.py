"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from texmill.plans import corpus
from texmill.registry import query
from texmill.streaming import edits as ops


@query(
    "with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as b from {events}), s as (select *, sum(case when b is null or ts - b >= interval 6 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from e) "
    "select user_id, floor(epoch(min(ts)))::bigint as started, floor(epoch(max(ts) + interval 6 hour))::bigint as ended, count(*) as n from s group by user_id, s"
)
def debounce_sessions(spark, sf_dir):
    found = ops.sessions(corpus.rows(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "6 hours")
    return found.select("user_id", F.unix_timestamp("started").alias("started"), F.unix_timestamp("ended").alias("ended"), "n")


@query("select user_id, arg_max(event_type, (ts, event_id)) as value from {events} group by user_id")
def latest_state(spark, sf_dir):
    rows = corpus.rows(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id"))
    return ops.latest(rows, "user_id", F.col("event_type"), "order").select("user_id", "value")


_EDITS = "select user_id as doc_id, event_type as text, event_id % 3 = 0 as saved, cast(event_id as double) as edited from {events}"


@query(f"with l as (select doc_id, arg_max(text, edited) as text, arg_max(saved, edited) as saved, max(edited) as edited from ({_EDITS}) x group by doc_id) select doc_id, text, edited from l where not saved")
def unsaved_documents(spark, sf_dir):
    return ops.unsaved_now(corpus.rows(spark, sf_dir, _EDITS))


_LOG = "select o_orderkey as job_id, case when o_orderkey % 3 = 0 then 'working' else 'Page '||cast(o_orderkey % 20 + 1 as varchar(9))||' of 40' end as line from {orders}"


@query(f"select job_id, job_id % 20 + 1 as page, 40 as pages, (job_id % 20 + 1) / 40.0 as share from ({_LOG}) x where job_id % 3 <> 0")
def progress_lines(spark, sf_dir):
    return ops.progress(corpus.rows(spark, sf_dir, _LOG))
