"""Views over the given tables that stand in for catalogs. The statements run on Spark and on DuckDB alike.

``{name}`` stands for a table or another view. ``frame`` gives a view as a DataFrame, ``sql`` as a DuckDB subquery chain.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SECONDS = "CAST(round(value*60) AS INT) * INTERVAL '1' SECOND"
TEXT = "CAST({} AS VARCHAR(40))"
_TS, _END = TEXT.format("ts"), TEXT.format(f"ts + {SECONDS}")


def _dashed(t: str) -> str:
    return f"replace(replace({t}, ' ', 'T'), ':', '_')"


def _packed(t: str) -> str:
    return f"replace(replace(replace({t}, '-', ''), ':', ''), ' ', 'T')"


VIEWS = {
    "src": f"""SELECT event_id, user_id % 8 AS cam_id, ts AS starttime, ts + {SECONDS} AS endtime,
        ts + {SECONDS} + CAST(event_id % 97 AS INT) * INTERVAL '1' MINUTE AS modified_time,
        CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 5000 + 1 END AS file_size
        FROM {{events}} WHERE event_type IN ('view','click','signup')""",
    "videos": f"SELECT event_id, user_id % 8 AS cam_id, ts AS starttime, ts + {SECONDS} AS endtime FROM {{events}} WHERE event_type IN ('view','click','error')",
    "outp": """SELECT user_id % 8 AS cam_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS from_dt, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) + INTERVAL '1' HOUR AS to_dt,
        CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) + CAST(event_id % 9 AS INT) * INTERVAL '1' HOUR AS modified_time FROM {events} WHERE event_type = 'purchase'""",
    "frame_seq": "SELECT user_id % 8 AS cam_id, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN ts - INTERVAL '3' HOUR ELSE ts END AS frame_ts, event_id % 50 AS frame_id FROM {events}",
    "frame_feed": "SELECT user_id % 8 AS cam_id, event_id AS seq, CASE WHEN event_id % 13 = 0 THEN ts - INTERVAL '3' HOUR ELSE ts END AS frame_ts, event_id % 50 AS frame_id, ts AS taken FROM {events}",
    "copies": f"""SELECT event_id, user_id % 8 AS cam_id, ts AS from_ts, ts + {SECONDS} AS to_ts, CAST(c AS INT) AS copy_no, CASE WHEN c = 0 THEN ts ELSE ts + INTERVAL '20' MINUTE END AS bucket_ts,
        CASE WHEN event_id % 17 = 0 AND c = 1 THEN 0 ELSE 100 END AS size
        FROM {{events}} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 AS c) k WHERE event_type = 'view' AND (c = 0 OR event_id % 5 = 0)""",
    "recorder": """SELECT event_id, event_type || CAST(user_id % 4 AS VARCHAR(10)) AS cam, ts AS start_ts, event_id % 3 = 0 AS det_c, event_id % 4 = 0 AS det_nc FROM {events}""",
    "frame_files": "SELECT user_id % 8 AS cam_id, ts FROM {events} WHERE event_type IN ('click','error')",
    "backgrounds": "SELECT DISTINCT user_id % 8 AS cam_id, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS bucket FROM {events} WHERE event_type = 'click' AND event_id % 3 > 0",
    "tasks": """SELECT o_orderkey AS jobid, substring(o_orderpriority, 1, 1) AS name,
        CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'TIMEOUT' ELSE 'FAILED' END AS state, CAST(o_orderkey % 7200 AS INT) AS elapsed_s, 7200 AS timelimit_s,
        CAST(1 + o_orderkey % 4 AS INT) AS ncpus, CAST(2097152 AS DOUBLE) AS reqmem_kib, CAST(o_orderkey % 1000 AS DOUBLE) AS own_rss, CAST(o_orderkey % 500 AS DOUBLE) AS own_cpu FROM {orders}""",
    "steps": """SELECT l_orderkey AS jobid, CASE WHEN l_linenumber = 1 THEN 'batch' WHEN l_linenumber = 2 THEN 'extern' ELSE 'step' END AS step, l_extendedprice * 20 AS maxrss_kib, l_quantity * 60 AS totalcpu_s FROM {lineitem}""",
    "listing_a": "SELECT o_orderkey AS rel, CAST(floor(o_totalprice) AS BIGINT) AS size FROM {orders}",
    "listing_b": """SELECT o_orderkey AS rel, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS size FROM {orders} WHERE o_orderkey % 10 <> 3
        UNION ALL SELECT -1 - o_orderkey AS rel, CAST(floor(o_totalprice) AS BIGINT) AS size FROM {orders} WHERE o_orderkey % 100 = 7""",
    # names: two forms, some broken
    "named": f"""SELECT event_id, user_id, ts, value, CASE WHEN event_id % 29 = 0 THEN 'broken_' || CAST(event_id AS VARCHAR(20)) || '.mp4'
        WHEN event_id % 2 = 0 THEN 'Cam_' || CAST(user_id % 8 AS VARCHAR(10)) || '_' || {_dashed(_TS)} || 'Z--' || {_dashed(_END)} || 'Z.bbb'
        ELSE 'cam-' || CAST(user_id % 8 AS VARCHAR(10)) || '_' || {_packed(_TS)} || '.299Z--' || {_packed(_END)} || '.929Z.mp4' END AS file_name FROM {{events}}""",
    # times to the second, and names of frames; some have no time
    "frames": f"""SELECT user_id % 8 AS cam_id, event_id, CASE WHEN event_id % 31 = 0 THEN 'frame_' || CAST(event_id AS VARCHAR(20)) || '.png'
        ELSE 'frame_' || substring({_packed(_TS)}, 1, 15) || '.png' END AS file_name FROM {{events}} WHERE event_type IN ('click','error')""",
    "rec_files": f"""SELECT event_id, event_type || CAST(user_id % 4 AS VARCHAR(10)) || '_' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE replace(replace(substring({_TS}, 1, 19), ' ', 'T'), ':', '-') END || '.h264' AS file_name,
        CASE WHEN event_id % 21 = 0 THEN NULL ELSE ts END AS mtime, event_id % 3 = 0 AS det_c, event_id % 4 = 0 AS det_nc FROM {{events}}""",
    # side-cars beside recordings
    "rec_listing": """SELECT event_type || '_' || CAST(event_id AS VARCHAR(20)) || '.h264' AS file_name FROM {events}
        UNION ALL SELECT event_type || '_' || CAST(event_id AS VARCHAR(20)) || '-detections-c.parquet' AS file_name FROM {events} WHERE event_id % 3 = 0
        UNION ALL SELECT event_type || '_' || CAST(event_id AS VARCHAR(20)) || '-detections-polo-nc.parquet' AS file_name FROM {events} WHERE event_id % 4 = 0""",
    "frame_videos": "SELECT event_id, user_id % 8 AS cam_id, ts, event_id % 3 <> 1 AS has_txt FROM {events} WHERE event_type = 'signup'",
    "durations": """SELECT o_orderkey AS jobid, CASE WHEN o_orderkey % 50 = 0 THEN 'UNLIMITED' WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR(10)) || '-01:02:03'
        WHEN o_orderkey % 3 = 1 THEN '12:' || CAST(10 + o_orderkey % 50 AS VARCHAR(10)) || ':07.250' ELSE CAST(o_orderkey % 60 AS VARCHAR(10)) || ':30' END AS dur,
        CASE WHEN o_orderkey % 5 = 0 THEN '4G' WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 4000 AS VARCHAR(10)) || 'Mc' WHEN o_orderkey % 5 = 2 THEN '1.5Gn' WHEN o_orderkey % 5 = 3 THEN CAST(o_orderkey % 900000 AS VARCHAR(10)) || 'K' ELSE '512' END AS mem,
        CAST(1 + o_orderkey % 4 AS INT) AS cpus, CAST(1 + o_orderkey % 2 AS INT) AS nodes FROM {orders}""",
    "probs": "SELECT vec_id, label, embedding FROM {embeddings}",
    "points": "SELECT event_id, user_id % 8 AS cam_id, ts, CAST(event_id % 400 AS DOUBLE) AS x, CAST(event_id * 7 % 300 AS DOUBLE) AS y FROM {events}",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table if no view has that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: frame(spark, sf_dir, t) for t in used})


def sql(query: str) -> str:
    """``query`` for DuckDB, the views that it names put before it."""
    names: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in names:
                need(VIEWS[name])
                names.append(name)

    need(query)
    views = [f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n]).replace('TIMESTAMP_NTZ', 'TIMESTAMP')})" for n in names]
    own = query.strip()
    head = "WITH RECURSIVE " if own.upper().startswith("WITH RECURSIVE") else "WITH "
    if own.upper().startswith("WITH"):
        own = re.sub(r"^WITH( RECURSIVE)?\s+", "", own, flags=re.I)
        return head + ", ".join([*views, own]) if views else head + own
    return (head + ", ".join(views) + " " if views else "") + own
