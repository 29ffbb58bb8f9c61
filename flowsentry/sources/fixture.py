"""The oracle-checked ``flows`` view, derived from the driver's ``events`` table.

The driver ships no flow data, so each event becomes one flow (``row_id`` is
the event id).  The same SQL text serves Spark and DuckDB; only the expression
that turns ``ts`` into epoch microseconds differs.  The column formulas are a
fixed test fixture, not library logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .partitioning import ensure_parallelism

SPARK_EPOCH_US = "unix_micros(cast(ts as timestamp))"
DUCKDB_EPOCH_US = "epoch_us(ts)"

# Fixed fixture text (FIXTURES.md part 1); ``{us}`` and ``{events}`` are filled in.
_EVENTS_CTE = """
  select event_id, {us} as us, user_id % 200 as u, event_type, value,
         cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
         cast(floor(event_id / 240) as bigint) as b, event_id % 12 as m
  from {events}"""

_FLOWS_SELECT = """
select event_id as row_id,
  case when m = 0 then '10.0.9.9'
       when m = 1 then concat('10.1.', cast(floor(b / 250) as bigint), '.', b % 250)
       when m = 2 then concat('10.2.0.', u % 3)
       else concat('10.0.0.', u) end as src_ip,
  case when m = 0 then concat('172.17.', cast(floor(event_id / 3000) as bigint), '.', cast(floor(event_id / 12) as bigint) % 250)
       when m = 1 then '192.168.2.1'
       when m = 2 then '192.168.3.1'
       when value < 4 then concat('10.9.0.', k % 2)
       when event_type = 'signup' then concat('172.16.0.', k % 8)
       else concat('192.168.1.', k % 100) end as dst_ip,
  cast(20000 + event_id % 40000 as double) as src_port,
  cast(case when value < 4 then 1 + k when m = 1 then 22 when k % 10 = 0 then 22 when k % 10 = 1 then 8080
            when k % 10 < 6 then 443 else 1024 + k * 100 end as double) as dst_port,
  case when m in (1, 2) then 'TCP'
       else case event_type when 'click' then 'UDP' when 'signup' then 'icmp' when 'purchase' then '17'
            when 'error' then case when k < 10 then 'gre' else 'TCP' end else 'TCP' end end as protocol,
  cast(0 as int) as tos,
  cast(ceil(case when value < 4 then value else value * 5 end) as double) as packets,
  cast(ceil(case when value < 4 then value else value * 5 end)
       * (case when k % 50 = 3 then 6000 else 40 + (k * 37) % 1400 end) as double) as bytes,
  cast(1 + k % 3 as double) as flows,
  case when m = 1 then cast(1704067200 + b * 3600 + event_id % 60 as double)
       else cast(us as double) / 1000000 end as start_time,
  case when m = 1 then cast(1704067200 + b * 3600 + event_id % 60 as double)
       else cast(us as double) / 1000000 end
    + cast(case when k % 7 = 0 then 0 else k % 50 end as double) / 10 as end_time,
  case when m = 0 then 'THREAT_SCAN' when m = 1 then 'EDGE_BURST' when k % 50 = 3 then 'THREAT_EXFIL' else 'BENIGN' end as label
from e"""


def flows_sql(us: str, events: str = "events") -> str:
    """``with e as (...) select ...`` text for one engine."""
    return "with e as (" + _EVENTS_CTE.format(us=us, events=events) + ")" + _FLOWS_SELECT


def flows_cte_duckdb() -> str:
    """The fixture as two CTE members (``e``, ``flows``) for DuckDB oracle text."""
    return ("e as (" + _EVENTS_CTE.format(us=DUCKDB_EPOCH_US, events="events") + "),\n"
            "flows as (" + _FLOWS_SELECT + ")")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, spread over the cluster's cores if it arrives in
    fewer splits (the derivation below then runs in parallel)."""
    return ensure_parallelism(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet"), "event_id")


def labelled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows plus the ground-truth ``label`` column."""
    events = read_events(spark, sf_dir)
    return spark.sql(flows_sql(SPARK_EPOCH_US, "{events}"), events=events)


def load_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows in the ingest schema (``row_id`` + the 11 flow columns)."""
    return labelled_flows(spark, sf_dir).drop("label")
