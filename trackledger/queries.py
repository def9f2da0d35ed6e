"""The registered queries over the given tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackledger.fixtures import frame, sql
from trackledger.functions import names as N
from trackledger.functions import numbers as M
from trackledger.operators import accounting, audit, detections, rollup, windows
from trackledger.plans import planning, status
from trackledger.sources import listing, snapshots
from trackledger.sources.shared import mounted_scratch, scratch, written
from trackledger.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None, *views: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of views as a query; times are read and written as UTC."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(*[frame(spark, sf_dir, v) for v in views])

        QUERIES[name] = run
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return add


c = F.col
DAY = "strftime({}, '%Y%m%d')"

# ------------------------------------------------------------------ names, keys, times
_PARSED = r"""
  regexp_extract(file_name, '^[Cc]am[_-](\d+)_', 1) AS cam_text,
  regexp_replace(regexp_replace(regexp_extract(file_name, '^[Cc]am[_-]\d+_([0-9T_:.-]+?)Z--', 1), '^(\d{4})-?(\d{2})-?(\d{2})T(\d{2})_?(\d{2})_?(\d{2})(\.\d{1,6})?(\.\d+)?$', '\1-\2-\3 \4:\5:\6\7'), '^$', '') AS s_text,
  regexp_replace(regexp_extract(file_name, '--([0-9T_:.-]+?)Z\.', 1), '^(\d{4})-?(\d{2})-?(\d{2})T(\d{2})_?(\d{2})_?(\d{2})(\.\d{1,6})?(\.\d+)?$', '\1-\2-\3 \4:\5:\6\7') AS e_text
"""
_NAMES = f"p AS (SELECT event_id, user_id, ts, value, file_name, {_PARSED} FROM named), parsed AS (SELECT event_id, user_id, ts, value, file_name, TRY_CAST(nullif(cam_text, '') AS INTEGER) AS cam_id, TRY_CAST(nullif(s_text, '') AS TIMESTAMP) AS starttime, TRY_CAST(nullif(e_text, '') AS TIMESTAMP) AS endtime FROM p)"


@query("parse_name", f"WITH {_NAMES} SELECT event_id, cam_id, starttime, endtime FROM parsed", "named")
def _(named: DataFrame) -> DataFrame:
    return named.select("event_id", N.parse_name(c("file_name")).alias("p")).select("event_id", "p.*")


@query("camera_id", r"SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN 99 END, TRY_CAST(nullif(regexp_extract(file_name, '^[Cc]am[_-](\d+)', 1), '') AS INTEGER)) AS cam_id FROM named", "named")
def _(named: DataFrame) -> DataFrame:
    return named.select("event_id", N.camera_id(c("file_name"), F.when(c("event_id") % 5 == 0, 99)).alias("cam_id"))


@query("start_key", f"WITH {_NAMES} SELECT event_id, CASE WHEN cam_id IS NOT NULL AND starttime IS NOT NULL THEN cam_id || '|' || strftime(starttime, '%Y-%m-%dT%H:%M:%S') END AS start_key FROM parsed", "named")
def _(named: DataFrame) -> DataFrame:
    p = named.select("event_id", N.parse_name(c("file_name")).alias("p"))
    return p.select("event_id", N.start_key(c("p.cam_id"), c("p.starttime")).alias("start_key"))


_BUCKET = "(date_trunc('hour', {0}) + CAST(floor(minute({0}) / 20) * 20 AS INT) * INTERVAL 1 MINUTE)"


@query("bucket_path", f"SELECT event_id, strftime({_BUCKET.format('ts')}, '%Y/%m/%d/%H/%M') AS bucket FROM events", "events")
def _(events: DataFrame) -> DataFrame:
    return events.select("event_id", N.bucket_path(c("ts")).alias("bucket"))


@query("bucket_path_of_epoch", "SELECT event_id, strftime(date_trunc('hour', ts) + CAST(floor(minute(ts) / 15) * 15 AS INT) * INTERVAL 1 MINUTE, '%Y/%m/%d/%H/%M') AS bucket FROM events", "events")
def _(events: DataFrame) -> DataFrame:
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c("ts")) / F.lit(1e6)
    return events.select("event_id", N.bucket_path_of_epoch(seconds, 15).alias("bucket"))


@query("name_prefix", "SELECT event_id, 'Cam_' || (user_id % 8) || '_' || strftime(ts, '%Y-%m-%dT%H_%M_%S') AS prefix FROM events", "events")
def _(events: DataFrame) -> DataFrame:
    return events.select("event_id", N.name_prefix(c("user_id") % 8, c("ts")).alias("prefix"))


_NAME = "'Cam_' || cam_id || '_' || strftime({0}, '%Y-%m-%dT%H_%M_%S') || CASE WHEN strftime({0}, '%f') = '000000' THEN '' ELSE '.' || strftime({0}, '%f') END || 'Z--' || strftime({1}, '%Y-%m-%dT%H_%M_%S') || CASE WHEN strftime({1}, '%f') = '000000' THEN '' ELSE '.' || strftime({1}, '%f') END || 'Z.bbb'"
_SEC = "CASE WHEN event_id % 2 = 0 THEN date_trunc('second', starttime) ELSE starttime END"


@query("build_name", f"SELECT event_id, {_NAME.format(_SEC, 'endtime')} AS file_name FROM videos", "videos")
def _(videos: DataFrame) -> DataFrame:
    start = F.when(c("event_id") % 2 == 0, N.ntz(F.date_trunc("second", "starttime"))).otherwise(c("starttime"))
    return videos.select("event_id", N.build_name(c("cam_id"), start, c("endtime")).alias("file_name"))


@query("expected_path", f"SELECT event_id, strftime({_BUCKET.format('starttime')}, '%Y/%m/%d/%H/%M') || '/' || {_NAME.format('starttime', 'endtime')} AS path FROM videos", "videos")
def _(videos: DataFrame) -> DataFrame:
    return videos.select("event_id", N.expected_path(c("cam_id"), c("starttime"), c("endtime")).alias("path"))


_DATE = "CASE WHEN event_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 4 = 1 THEN strftime(ts, '%Y/%m/%d') WHEN event_id % 4 = 2 THEN strftime(ts, '%Y%m%d') ELSE 'day ' || strftime(ts, '%d') END"


def _dates(events: DataFrame) -> DataFrame:
    k = c("event_id") % 4
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy/MM/dd")).when(k == 2, F.date_format("ts", "yyyyMMdd")).otherwise(F.concat(F.lit("day "), F.date_format("ts", "dd")))
    return events.select("event_id", text.alias("d"))


@query("normalize_date", rf"WITH x AS (SELECT event_id, regexp_replace({_DATE}, '[-/]', '', 'g') AS d FROM events) SELECT event_id, CASE WHEN regexp_full_match(d, '\d{{8}}') THEN d END AS day FROM x", "events")
def _(events: DataFrame) -> DataFrame:
    return _dates(events).select("event_id", N.normalize_date(c("d")).alias("day"))


@query("day_key", rf"WITH x AS (SELECT event_id, {_DATE} AS d FROM events) SELECT event_id, CASE WHEN regexp_full_match(d, '\d{{8}}|\d{{4}}-\d{{2}}-\d{{2}}') THEN replace(d, '-', '') END AS day FROM x", "events")
def _(events: DataFrame) -> DataFrame:
    return _dates(events).select("event_id", N.day_key(c("d")).alias("day"))


@query("day_of", f"SELECT event_id, {DAY.format('ts')} AS day FROM events", "events")
def _(events: DataFrame) -> DataFrame:
    return events.select("event_id", N.day_of(c("ts")).alias("day"))


@query("frame_day", r"SELECT event_id, nullif(substring(regexp_extract(file_name, '(\d{8}T\d{6})', 1), 1, 8), '') AS day FROM frames", "frames")
def _(frames: DataFrame) -> DataFrame:
    return frames.select("event_id", N.frame_day(c("file_name")).alias("day"))


_FT = r"TRY_CAST(nullif(regexp_replace(regexp_extract(file_name, '(\d{8}T\d{6})', 1), '^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$', '\1-\2-\3 \4:\5:\6'), '') AS TIMESTAMP)"


@query("frame_time", f"SELECT event_id, {_FT} AS frame_time FROM frames", "frames")
def _(frames: DataFrame) -> DataFrame:
    return frames.select("event_id", N.frame_time(c("file_name")).alias("frame_time"))


@query("time_bucket", "SELECT event_id, date_trunc('hour', ts) AS by_hour, CAST(date_trunc('day', ts) AS TIMESTAMP) AS by_day, CAST(date_trunc('day', ts) AS TIMESTAMP) + CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 25200) * 25200 AS INT) * INTERVAL 1 SECOND AS by_7h FROM events", "events")
def _(events: DataFrame) -> DataFrame:
    return events.select("event_id", N.time_bucket(c("ts"), "hour").alias("by_hour"), N.time_bucket(c("ts"), "day").alias("by_day"), N.time_bucket(c("ts"), 25200).alias("by_7h"))


@query("config_tag", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'count_w' || (event_id % 10) || '_n' || (event_id % 200) || '_int' || (event_id % 60) || 's' ELSE 'int' || (event_id % 60) || 's_win' || CASE WHEN event_id % 3 = 1 THEN 'hour' ELSE 'day' END END AS tag FROM events", "events")
def _(events: DataFrame) -> DataFrame:
    k = c("event_id") % 3
    return events.select("event_id", N.config_tag(c("event_id") % 60, F.when(k == 1, "hour").when(k == 2, "day"), c("event_id") % 10, c("event_id") % 200).alias("tag"))


ROUTES = [("click", "polo"), ("purchase", "hd"), ("error0", "polo")]


@query("prefix_route", "SELECT event_id, CASE WHEN cam LIKE 'click%' THEN 'polo' WHEN cam LIKE 'purchase%' THEN 'hd' WHEN cam LIKE 'error0%' THEN 'polo' ELSE 'default' END AS model FROM recorder", "recorder")
def _(recorder: DataFrame) -> DataFrame:
    return recorder.select("event_id", N.prefix_route(c("cam"), ROUTES).alias("model"))


_STEM = r"regexp_replace(file_name, '\.[^.]*$', '')"
_REC = rf"coalesce(TRY_CAST(regexp_replace(regexp_extract({_STEM}, '_(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}-\d{{2}}-\d{{2}})$', 1), '^(\d{{4}}-\d{{2}}-\d{{2}})T(\d{{2}})-(\d{{2}})-(\d{{2}})$', '\1 \2:\3:\4') AS TIMESTAMP), mtime, TIMESTAMP '0001-01-01 00:00:00')"


@query("recorder_time", f"SELECT event_id, strftime({_REC}, '%Y-%m-%d %H:%M:%S') AS recorder_time FROM rec_files", "rec_files")
def _(rec_files: DataFrame) -> DataFrame:
    return rec_files.select("event_id", F.date_format(N.recorder_time(c("file_name"), c("mtime")), "yyyy-MM-dd HH:mm:ss").alias("recorder_time"))


@query("recorder_camera", "SELECT event_id, split_part(file_name, '_', 1) AS cam FROM rec_files", "rec_files")
def _(rec_files: DataFrame) -> DataFrame:
    return rec_files.select("event_id", N.recorder_camera(c("file_name")).alias("cam"))


_MODEL = "CASE WHEN file_name LIKE 'click%' THEN 'polo' WHEN file_name LIKE 'purchase%' THEN 'hd' WHEN file_name LIKE 'error0%' THEN 'polo' ELSE 'default' END"


@query("sidecar_name", f"SELECT event_id, {_STEM} || CASE WHEN {_MODEL} = 'polo' THEN '-detections-polo' ELSE '-detections' END || CASE WHEN det_c THEN '-c' ELSE '-nc' END || '.parquet' AS sidecar FROM rec_files", "rec_files")
def _(rec_files: DataFrame) -> DataFrame:
    return rec_files.select("event_id", N.sidecar_name(c("file_name"), N.prefix_route(c("file_name"), ROUTES), c("det_c")).alias("sidecar"))


ROOTS = [("https://blog.", "/never"), ("https:/", "/secure"), ("http:/", "/plain")]


@query("remap_path", "SELECT page_id, CASE WHEN url LIKE 'https://%' THEN '/secure' || substring(url, 7) WHEN url LIKE 'http://%' THEN '/plain' || substring(url, 6) ELSE url END AS path FROM pages", "pages")
def _(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", N.remap_path(c("url"), ROOTS).alias("path"))


# ------------------------------------------------------------------ numbers
@query("duration_seconds", r"""SELECT jobid, CASE WHEN dur = 'UNLIMITED' THEN NULL WHEN contains(dur, '-') THEN CAST(split_part(dur, '-', 1) AS DOUBLE) * 86400 + 3723
  WHEN len(dur) - len(replace(dur, ':', '')) = 2 THEN CAST(split_part(dur, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(dur, ':', 2) AS DOUBLE) * 60 + CAST(split_part(dur, ':', 3) AS DOUBLE)
  ELSE CAST(split_part(dur, ':', 1) AS DOUBLE) * 60 + CAST(split_part(dur, ':', 2) AS DOUBLE) END AS seconds FROM durations""", "durations")
def _(d: DataFrame) -> DataFrame:
    return d.select("jobid", M.duration_seconds(c("dur")).alias("seconds"))


@query("memory_kib", r"""SELECT jobid, CAST(regexp_extract(mem, '^([0-9.]+)', 1) AS DOUBLE) * CASE WHEN contains(mem, 'G') THEN 1048576 WHEN contains(mem, 'K') THEN 1 ELSE 1024 END
  * CASE WHEN mem LIKE '%c' THEN cpus WHEN mem LIKE '%n' THEN nodes ELSE 1 END AS kib FROM durations""", "durations")
def _(d: DataFrame) -> DataFrame:
    return d.select("jobid", M.memory_kib(c("mem"), c("cpus"), c("nodes")).alias("kib"))


_DUR = "CASE WHEN {0} IS NULL THEN '-' WHEN {0} >= 86400 THEN ({0} // 86400) || 'd' || lpad(CAST({0} % 86400 // 3600 AS VARCHAR), 2, '0') || 'h' || lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN {0} >= 3600 THEN ({0} // 3600) || 'h' || lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') || 's' ELSE ({0} // 60) || 'm' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') || 's' END"


@query("format_duration", f"SELECT o_orderkey, {_DUR.format('(o_orderkey * 37)')} AS d FROM orders", "orders")
def _(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", M.format_duration(c("o_orderkey") * 37).alias("d"))


_KIB = "CASE WHEN {0} IS NULL THEN '-' WHEN {0} >= 1048576 THEN CAST(CAST(floor({0} / 1048576 * 10 + 0.5) AS BIGINT) // 10 AS VARCHAR) || '.' || CAST(CAST(floor({0} / 1048576 * 10 + 0.5) AS BIGINT) % 10 AS VARCHAR) || 'G' ELSE CAST(CAST(floor({0} / 1024 + 0.5) AS BIGINT) AS VARCHAR) || 'M' END"


@query("format_kib", f"SELECT o_orderkey, {_KIB.format('(o_totalprice * 13)')} AS m FROM orders", "orders")
def _(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", M.format_kib(c("o_totalprice") * 13).alias("m"))


@query("format_percent", "SELECT event_id, CAST(CAST(floor(value / 100 * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS p FROM events", "events")
def _(e: DataFrame) -> DataFrame:
    return e.select("event_id", M.format_percent(c("value") / 100).alias("p"))


@query("round_memory", "SELECT o_orderkey, CAST(greatest(ceil(o_totalprice / 40 / 256) * 256, 1024) AS BIGINT) AS mib, CASE WHEN CAST(greatest(ceil(o_totalprice / 40 / 256) * 256, 1024) AS BIGINT) % 1024 = 0 THEN (CAST(greatest(ceil(o_totalprice / 40 / 256) * 256, 1024) AS BIGINT) // 1024) || 'G' ELSE CAST(greatest(ceil(o_totalprice / 40 / 256) * 256, 1024) AS BIGINT) || 'M' END AS text FROM orders", "orders")
def _(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", M.round_memory(c("o_totalprice") / 40).alias("mib"), M.memory_text(c("o_totalprice") / 40).alias("text"))


@query("round_minutes", "SELECT o_orderkey, CAST(greatest(ceil(o_orderkey * 7 / 300) * 5, 10) AS BIGINT) AS minutes FROM orders", "orders")
def _(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", M.round_minutes(c("o_orderkey") * 7).alias("minutes"))


def _probabilities(probs: DataFrame) -> DataFrame:
    return probs.select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.lit(0.5) + x.cast("double")).alias("p"))


_P12 = "SELECT vec_id, list_transform(embedding[1:12], lambda x: 0.5 + CAST(x AS DOUBLE)) AS p FROM embeddings"


@query("decode_bits", f"WITH q AS ({_P12}) SELECT vec_id, array_to_string(list_transform(p, lambda x: CASE WHEN x > 0.5 THEN 1 ELSE 0 END), '') AS bits, CAST(list_sum(list_transform(range(12), lambda i: CASE WHEN p[i + 1] > 0.5 THEN 1 << (11 - i) ELSE 0 END)) AS BIGINT) AS id FROM q", "embeddings")
def _(e: DataFrame) -> DataFrame:
    bits = M.decode_bits(c("p"))
    return _probabilities(e).select("vec_id", F.array_join(bits.cast("array<string>"), "").alias("bits"), M.bits_to_id(bits).alias("id"))


@query("bit_confidence", f"WITH q AS ({_P12}) SELECT vec_id, round(list_product(list_transform(p, lambda x: abs(x - 0.5) * 2)), 9) AS confidence FROM q", "embeddings")
def _(e: DataFrame) -> DataFrame:
    return _probabilities(e).select("vec_id", F.round(M.bit_confidence(c("p")), 9).alias("confidence"))


@query("coerce_numeric", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 6 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number FROM events", "events")
def _(e: DataFrame) -> DataFrame:
    text = F.when(c("event_id") % 6 == 0, c("event_type")).otherwise(c("event_id").cast("string"))
    return detections.coerce_columns(e.select("event_id", text.alias("number")), ["number"])


# ------------------------------------------------------------------ days, windows, catalogs
@query("filter_days", f"SELECT event_id, {DAY.format('ts')} AS day FROM events WHERE {DAY.format('ts')} IN ('20240103', '20240110')", "events")
def _(e: DataFrame) -> DataFrame:
    return windows.filter_days(e.select("event_id", N.day_of(c("ts")).alias("day")), ["20240103", "20240110", "20240103"])


@query("select_days", f"SELECT DISTINCT {DAY.format('ts')} AS day FROM events WHERE {DAY.format('ts')} BETWEEN '20240105' AND '20240120' ORDER BY 1 DESC LIMIT 7", "events")
def _(e: DataFrame) -> DataFrame:
    return windows.select_days(e.select(N.day_of(c("ts")).alias("day")), "20240105", "20240120", 7)


@query("catalog_days", f"SELECT DISTINCT {DAY.format('starttime')} AS day FROM videos", "videos", "src")
def _(videos: DataFrame, src: DataFrame) -> DataFrame:
    return windows.catalog_days(videos, src)


@query("day_range", "SELECT p_partkey, array_to_string(list_transform(generate_series(DATE '2024-02-25' + CAST(p_partkey % 5 AS INT), DATE '2024-02-25' + CAST(p_partkey % 5 AS INT) + CAST(p_size AS INT), INTERVAL 1 DAY), lambda d: strftime(d, '%Y%m%d')), ' ') AS days FROM part", "part")
def _(part: DataFrame) -> DataFrame:
    start = F.date_add(F.lit("2024-02-25").cast("date"), (c("p_partkey") % 5).cast("int"))
    return part.select("p_partkey", F.array_join(windows.day_range(start, F.date_add(start, c("p_size").cast("int"))), " ").alias("days"))


@query("day_windows", f"WITH d AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS m FROM events), h AS (SELECT unnest(range(0, 24, 7)) AS h) SELECT {DAY.format('m')} AS day, m + CAST(h AS INT) * INTERVAL 1 HOUR AS from_dt, least(m + CAST(h + 7 AS INT) * INTERVAL 1 HOUR, m + INTERVAL 1 DAY) AS to_dt FROM d, h", "events")
def _(e: DataFrame) -> DataFrame:
    return windows.day_windows(e.select(N.day_of(c("ts")).alias("day")), 7)


_UNITS = """wins AS (SELECT w AS from_dt, w + INTERVAL 1 HOUR AS to_dt FROM (SELECT unnest(generate_series(date_trunc('day', min(starttime)), date_trunc('day', max(endtime)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS w FROM src)),
  wu AS (SELECT cam_id, from_dt, to_dt, max(modified_time) AS latest_src_mtime FROM src JOIN wins ON starttime < to_dt AND endtime > from_dt GROUP BY ALL)"""
_WS = f"""{_UNITS}, outs AS (SELECT cam_id, from_dt, to_dt, max(modified_time) AS out_mtime FROM outp GROUP BY ALL),
  ws AS (SELECT {DAY.format('wu.from_dt')} AS day, wu.cam_id, wu.from_dt, wu.to_dt, latest_src_mtime, out_mtime, CASE WHEN outs.cam_id IS NULL THEN 'missing' WHEN latest_src_mtime > out_mtime THEN 'stale' ELSE 'done' END AS status
  FROM wu LEFT JOIN outs ON wu.cam_id = outs.cam_id AND wu.from_dt = outs.from_dt AND wu.to_dt = outs.to_dt)"""


@query("window_units", f"WITH {_UNITS} SELECT * FROM wu", "src")
def _(src: DataFrame) -> DataFrame:
    return windows.window_units(src)


@query("window_units_of_days", f"WITH {_UNITS} SELECT * FROM wu WHERE strftime(from_dt, '%Y%m%d') IN (SELECT DISTINCT {DAY.format('starttime')} FROM src WHERE day(starttime) % 4 = 0)", "src")
def _(src: DataFrame) -> DataFrame:
    days = src.where(F.dayofmonth("starttime") % 4 == 0).select(N.day_of(c("starttime")).alias("day"))
    return windows.window_units(src, days=days)


@query("window_status", f"WITH {_WS} SELECT * FROM ws", "src", "outp")
def _(src: DataFrame, outp: DataFrame) -> DataFrame:
    return status.window_status(src, outp)


_KEY = "cam_id || '|' || strftime(starttime, '%Y-%m-%dT%H:%M:%S')"
_DS = f"""sk AS (SELECT {_KEY} AS k, bool_or(file_size > 0) AS good, max(({{'g': file_size > 0, 'n': {_NAME.format('starttime', 'endtime')}}})).n AS found FROM src GROUP BY 1),
  ds AS (SELECT event_id, cam_id, starttime, endtime, {DAY.format('starttime')} AS day, coalesce(found, {_NAME.format('starttime', 'endtime')}) AS expected, CASE WHEN good THEN 'done' WHEN good IS NOT NULL THEN 'zero_byte_stub' ELSE 'missing' END AS status FROM videos LEFT JOIN sk ON {_KEY} = k)"""


@query("detect_status", f"WITH {_DS} SELECT * FROM ds", "videos", "src")
def _(videos: DataFrame, src: DataFrame) -> DataFrame:
    return status.detect_status(videos, src)


@query("undetected_videos", f"WITH {_DS} SELECT event_id, cam_id, starttime, endtime FROM ds WHERE status <> 'done'", "videos", "src")
def _(videos: DataFrame, src: DataFrame) -> DataFrame:
    return status.undetected_videos(videos, src)


@query("pending_units", f"WITH {_WS} SELECT * FROM ws WHERE status <> 'done'", "src", "outp")
def _(src: DataFrame, outp: DataFrame) -> DataFrame:
    return status.pending_units(status.window_status(src, outp))


_COUNTS = "count(*) AS total, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status IN ('missing', 'stale', 'pending', 'zero_byte_stub')) AS pending, count(*) FILTER (WHERE status LIKE 'skipped%') AS skipped"
_PCT = "CASE WHEN done + pending > 0 THEN 100.0 * done / (done + pending) ELSE 100.0 END"


@query("by_day", f"WITH {_WS}, n AS (SELECT day, {_COUNTS} FROM ws GROUP BY day) SELECT *, CAST({_PCT} AS DOUBLE) AS pct FROM n", "src", "outp")
def _(src: DataFrame, outp: DataFrame) -> DataFrame:
    return rollup.by_day(status.window_status(src, outp))


@query("stage_totals", f"WITH {_DS}, n AS (SELECT {_COUNTS} FROM ds) SELECT *, round(CAST({_PCT} AS DOUBLE), 2) AS pct FROM n", "videos", "src")
def _(videos: DataFrame, src: DataFrame) -> DataFrame:
    return rollup.stage_totals(status.detect_status(videos, src))


@query("status_counts", f"WITH {_DS} SELECT status, count(*) AS n FROM ds GROUP BY status", "videos", "src")
def _(videos: DataFrame, src: DataFrame) -> DataFrame:
    return rollup.status_counts(status.detect_status(videos, src))


@query("pending_days", f"WITH {_DS} SELECT string_agg(DISTINCT day, ' ' ORDER BY day) AS days FROM ds WHERE status <> 'done'", "videos", "src")
def _(videos: DataFrame, src: DataFrame) -> DataFrame:
    return rollup.pending_days(status.detect_status(videos, src)).select(F.array_join("days", " ").alias("days"))


_REPORT = f"{_WS}, {_DS}, rep AS (SELECT 'detect' AS stage, day, status FROM ds UNION ALL SELECT 'save_detect', day, status FROM ws)"


def _report(videos: DataFrame, src: DataFrame, outp: DataFrame) -> DataFrame:
    return status.progress_report({"detect": status.detect_status(videos, src), "save_detect": status.window_status(src, outp)})


@query("progress_report", f"WITH {_REPORT} SELECT *, NULL AS reason FROM rep UNION ALL SELECT 'rpi', NULL, 'unavailable', 'no catalog' UNION ALL SELECT 'tracking', NULL, 'unavailable', 'no outputs yet'", "videos", "src", "outp")
def _(videos: DataFrame, src: DataFrame, outp: DataFrame) -> DataFrame:
    return status.progress_report({"detect": status.detect_status(videos, src), "save_detect": status.window_status(src, outp), "rpi": None, "tracking": "no outputs yet"})


@query("stage_summary", f"WITH {_REPORT}, n AS (SELECT stage, {_COUNTS}, min(day) AS first_day, max(day) AS last_day FROM rep GROUP BY ROLLUP (stage)) SELECT *, round(CAST({_PCT} AS DOUBLE), 2) AS pct, pending > 0 AS any_pending FROM n", "videos", "src", "outp")
def _(videos: DataFrame, src: DataFrame, outp: DataFrame) -> DataFrame:
    return rollup.stage_summary(_report(videos, src, outp))


@query("by_day_all", f"WITH {_REPORT}, n AS (SELECT stage, day, {_COUNTS} FROM rep GROUP BY stage, day) SELECT *, CAST({_PCT} AS DOUBLE) AS pct FROM n", "videos", "src", "outp")
def _(videos: DataFrame, src: DataFrame, outp: DataFrame) -> DataFrame:
    return rollup.by_day(_report(videos, src, outp), "stage")


@query("attention_days", f"WITH {_WS}, n AS (SELECT day, {_COUNTS} FROM ws GROUP BY day), p AS (SELECT *, CAST({_PCT} AS DOUBLE) AS pct, greatest(count(*) OVER () - 14, 0) AS more FROM n WHERE pending > 0) SELECT * FROM p ORDER BY day DESC LIMIT 14", "src", "outp")
def _(src: DataFrame, outp: DataFrame) -> DataFrame:
    return rollup.attention_days(status.window_status(src, outp))


@query("overview", f"WITH {_REPORT}, n AS (SELECT stage, {_COUNTS} FROM rep GROUP BY stage) SELECT stage, stage || ': ' || done || '/' || (done + pending) || ' done, ' || skipped || ' skipped' AS line FROM n", "videos", "src", "outp")
def _(videos: DataFrame, src: DataFrame, outp: DataFrame) -> DataFrame:
    return rollup.overview(_report(videos, src, outp))


@query("work_orders", f"WITH {_REPORT} SELECT stage, string_agg(DISTINCT day, ' ' ORDER BY day) AS days, bool_or(status = 'zero_byte_stub') AS has_stubs, coalesce(string_agg(DISTINCT day, ' ' ORDER BY day) FILTER (WHERE status = 'zero_byte_stub'), '') AS stub_days FROM rep WHERE status <> 'done' GROUP BY stage", "videos", "src", "outp")
def _(videos: DataFrame, src: DataFrame, outp: DataFrame) -> DataFrame:
    return rollup.work_orders(_report(videos, src, outp))


# ------------------------------------------------------------------ catalogs of listings
@query("video_catalog", f"WITH {_NAMES} SELECT event_id, file_name, cam_id, starttime, endtime FROM parsed WHERE lower(file_name) LIKE '%.mp4'", "named")
def _(named: DataFrame) -> DataFrame:
    return listing.video_catalog(named.select("event_id", "file_name"), (".MP4",))


@query("output_catalog", f"WITH {_NAMES} SELECT cam_id, starttime AS from_dt, endtime AS to_dt, ts AS modified_time FROM parsed WHERE cam_id IS NOT NULL AND starttime IS NOT NULL", "named")
def _(named: DataFrame) -> DataFrame:
    return listing.output_catalog(named.withColumn("mtime", c("ts")))


@query("sidecar_catalog", "SELECT event_type || '_' || event_id || '.h264' AS file_name, event_id % 3 = 0 AS detections_clahe, event_id % 4 = 0 AS detections_noclahe FROM events", "rec_listing")
def _(rec_listing: DataFrame) -> DataFrame:
    return listing.sidecar_catalog(rec_listing)


@query("latest_mtime_by_day", f"SELECT {DAY.format('starttime')} AS day, max(modified_time) AS latest_mtime FROM src GROUP BY 1", "src")
def _(src: DataFrame) -> DataFrame:
    return listing.latest_mtime_by_day(src.select(N.day_of(c("starttime")).alias("day"), c("modified_time").alias("mtime")))


@query("stale_days", f"""WITH now_ AS (SELECT {DAY.format('starttime')} AS day, max(modified_time) AS m FROM src GROUP BY 1), seen AS (SELECT {DAY.format('starttime')} AS day, max(modified_time) AS m FROM src WHERE event_id % 10 <> 3 AND {DAY.format('starttime')} < '20240125' GROUP BY 1)
  SELECT now_.day FROM now_ LEFT JOIN seen ON now_.day = seen.day WHERE seen.day IS NULL OR now_.m > seen.m UNION (SELECT day FROM now_ ORDER BY day DESC LIMIT 2)""", "src")
def _(src: DataFrame) -> DataFrame:
    day = src.select(N.day_of(c("starttime")).alias("day"), c("modified_time").alias("mtime"), "event_id")
    return listing.stale_days(listing.latest_mtime_by_day(day), listing.latest_mtime_by_day(day.where("event_id % 10 <> 3 and day < '20240125'")), 2)


@query("frame_inventory", f"SELECT {DAY.format('ts')} AS day, cam_id, string_agg(DISTINCT CAST(ts AS VARCHAR), ' ' ORDER BY CAST(ts AS VARCHAR)) AS names, count(*) AS n FROM frame_files GROUP BY ALL", "frame_files")
def _(frame_files: DataFrame) -> DataFrame:
    inv = listing.frame_inventory(frame_files.select(N.day_of(c("ts")).alias("day"), "cam_id", c("ts").cast("string").alias("file_name")))
    return inv.withColumn("names", F.array_join("names", " "))


@query("files_of_day", f"WITH {_NAMES} SELECT event_id, file_name FROM parsed WHERE {DAY.format('starttime')} = '20240107' AND file_name LIKE '%.mp4'", "named")
def _(named: DataFrame) -> DataFrame:
    return listing.files_of_day(named.select("event_id", "file_name"), "20240107", r"\.mp4$")


@query("valid_basic", "SELECT event_id, file_size > 0 AS valid FROM src", "src")
def _(src: DataFrame) -> DataFrame:
    return src.select("event_id", listing.valid_basic(c("file_size")).alias("valid"))


@query("union_days", "SELECT event_id, cam_id, starttime, file_size FROM src WHERE event_id % 2 = 0 UNION ALL SELECT event_id, cam_id, starttime, NULL FROM src WHERE event_id % 2 = 1", "src")
def _(src: DataFrame) -> DataFrame:
    cols = ["event_id", "cam_id", "starttime"]
    return listing.union_days([src.where("event_id % 2 = 0").select(*cols, "file_size"), src.where("event_id % 2 = 1").select(*cols)])


@query("latest_snapshot", f"SELECT event_id, {DAY.format('ts')} AS snapshot FROM events WHERE {DAY.format('ts')} = (SELECT max({DAY.format('ts')}) FROM events)", "events")
def _(e: DataFrame) -> DataFrame:
    return snapshots.latest_snapshot(e.select("event_id", N.day_of(c("ts")).alias("snapshot")))


@query("load_history", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS generated_at, value AS detect_pct, event_id % 100 AS detect_pending, CAST(NULL AS DOUBLE) AS rpi_pct, CAST(NULL AS BIGINT) AS rpi_pending FROM events WHERE event_id % 9 <> 0", "events")
def _(e: DataFrame) -> DataFrame:
    stage = F.struct(c("value").alias("pct"), (c("event_id") % 100).alias("pending"))
    line = F.when(c("event_id") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), F.struct(stage.alias("detect")).alias("stages"))))
    return snapshots.load_history(e.select(line.alias("line")), ["detect", "rpi"])


@query("recent_submissions", "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, event_type AS jobname, strftime(ts, '%Y%m%d') || ' ' || user_id AS dates, CAST(event_id AS VARCHAR) AS job_ids FROM events WHERE event_type IN ('view', 'click') ORDER BY 1 DESC LIMIT 20", "events")
def _(e: DataFrame) -> DataFrame:
    led = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), c("event_type").alias("jobname"), F.array(N.day_of(c("ts")), c("user_id").cast("string")).alias("dates"), F.array(c("event_id").cast("string")).alias("job_ids"))
    return snapshots.recent_submissions(led, ["view", "click"], 20)


@query("encode_work", "SELECT CAST(to_json({'cam_id': cam_id, 'from_dt': strftime(from_dt, '%Y-%m-%dT%H:%M:%S.%fZ')}) AS VARCHAR) AS line FROM outp", "outp")
def _(outp: DataFrame) -> DataFrame:
    return planning.encode_work(outp, ["cam_id", "from_dt"])


@query("decode_work", "SELECT CAST(cam_id AS INTEGER) AS cam_id, from_dt, to_dt FROM outp", "outp")
def _(outp: DataFrame) -> DataFrame:
    return planning.decode_work(planning.encode_work(outp, ["cam_id", "from_dt", "to_dt"]))


_FIELDS = ["jobid", "name", "state", "elapsed"]


@query("read_accounting", "SELECT CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 4 = 1 THEN '.batch' ELSE '' END AS jobid, o_orderpriority AS name, o_orderstatus AS state, '' AS elapsed, o_orderkey % 4 = 1 AS is_step FROM orders WHERE o_orderkey % 4 < 2", "orders")
def _(o: DataFrame) -> DataFrame:
    k = c("o_orderkey") % 4
    job = F.concat(c("o_orderkey").cast("string"), F.when(k == 1, ".batch").when(k == 2, "_[1-9]").otherwise(""))
    line = F.concat_ws("|", job, "o_orderpriority", "o_orderstatus", F.lit(""))
    return accounting.read_accounting(o.select(F.when(k == 3, F.concat(line, F.lit("|more"))).otherwise(line).alias("value")), _FIELDS)


# ------------------------------------------------------------------ audits and folds
@query("backward_time", "WITH x AS (SELECT cam_id, frame_ts <= lag(frame_ts) OVER (PARTITION BY cam_id ORDER BY seq) AS b FROM frame_seq) SELECT cam_id, coalesce(bool_or(b), false) AS has_backward FROM x GROUP BY cam_id", "frame_seq")
def _(frame_seq: DataFrame) -> DataFrame:
    return audit.backward_time(frame_seq, ["cam_id"], "seq", "frame_ts")


@query("container_stats", "SELECT cam_id, arg_min(frame_ts, seq) AS first_ts, arg_max(frame_ts, seq) AS last_ts, count(*) AS n_frames FROM frame_seq GROUP BY cam_id", "frame_seq")
def _(frame_seq: DataFrame) -> DataFrame:
    return audit.container_stats(frame_seq, ["cam_id"], "seq", "frame_ts")


_OVER = f"""WITH RECURSIVE o AS (SELECT {DAY.format('starttime')} AS day, cam_id, event_id, starttime, endtime, row_number() OVER (PARTITION BY {DAY.format('starttime')}, cam_id ORDER BY starttime, event_id) AS rn FROM src),
  f AS (SELECT day, cam_id, event_id, starttime, endtime, rn, false AS flagged, endtime AS last_end FROM o WHERE rn = 1
    UNION ALL SELECT o.day, o.cam_id, o.event_id, o.starttime, o.endtime, o.rn, o.starttime < f.last_end, CASE WHEN o.starttime < f.last_end THEN f.last_end ELSE o.endtime END FROM f JOIN o ON o.day = f.day AND o.cam_id = f.cam_id AND o.rn = f.rn + 1)"""


@query("overlapping_containers", f"{_OVER} SELECT day, cam_id, event_id, starttime, endtime, flagged FROM f", "src")
def _(src: DataFrame) -> DataFrame:
    return audit.overlapping_containers(src.withColumn("day", N.day_of(c("starttime"))), ["day", "cam_id"])


@query("audit_totals", f"{_OVER} SELECT day, count(*) AS files, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE NOT flagged) AS kept FROM f GROUP BY ROLLUP (day)", "src")
def _(src: DataFrame) -> DataFrame:
    return audit.audit_totals(audit.overlapping_containers(src.withColumn("day", N.day_of(c("starttime"))), ["day", "cam_id"]))


_B = "(date_trunc('hour', {0}) + CAST(floor(minute({0}) / 20) * 20 AS INT) * INTERVAL 1 MINUTE)"


@query("duplicate_copies", f"SELECT event_id, copy_no, count(*) OVER (PARTITION BY cam_id, event_id) AS n_copies, row_number() OVER (PARTITION BY cam_id, event_id ORDER BY CASE WHEN {_B.format('from_ts')} = {_B.format('bucket_ts')} THEN 0 ELSE 1 END, copy_no DESC) > 1 AS flagged FROM copies", "copies")
def _(copies: DataFrame) -> DataFrame:
    return audit.duplicate_copies(copies.withColumn("path", -c("copy_no")), ["cam_id", "event_id"]).select("event_id", "copy_no", "n_copies", "flagged")


@query("missing_bucket_copies", f"""WITH w AS (SELECT DISTINCT event_id AS name, unnest(generate_series({_B.format('from_ts')}, {_B.format('to_ts')}, INTERVAL 20 MINUTE)) AS bucket FROM copies WHERE copy_no = 0 AND size > 0)
  SELECT w.name, w.bucket FROM w WHERE NOT EXISTS (SELECT 1 FROM copies x WHERE x.event_id = w.name AND {_B.format('x.bucket_ts')} = w.bucket AND x.size > 0)""", "copies")
def _(copies: DataFrame) -> DataFrame:
    files = copies.where("copy_no = 0").select(c("event_id").alias("name"), "from_ts", "to_ts", "size")
    return audit.missing_bucket_copies(files, copies.select(c("event_id").alias("name"), N.bucket_start(c("bucket_ts")).alias("bucket"), "size"))


@query("missing_bucket_ranges", f"""WITH f AS (SELECT event_id AS name, from_ts, CASE WHEN event_id % 5 = 0 THEN to_ts + INTERVAL 3 HOUR ELSE to_ts END AS to_ts FROM copies WHERE copy_no = 0 AND size > 0), w AS (SELECT DISTINCT name, unnest(generate_series({_B.format('from_ts')}, {_B.format('to_ts')}, INTERVAL 20 MINUTE)) AS bucket FROM f),
  m AS (SELECT w.name, w.bucket FROM w WHERE NOT EXISTS (SELECT 1 FROM copies x WHERE x.event_id = w.name AND {_B.format('x.bucket_ts')} = w.bucket AND x.size > 0)),
  g AS (SELECT *, bucket - CAST(row_number() OVER (PARTITION BY name ORDER BY bucket) AS INT) * INTERVAL 20 MINUTE AS run FROM m) SELECT name, min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS n_buckets FROM g GROUP BY name, run""", "copies")
def _(copies: DataFrame) -> DataFrame:
    end = F.when(c("event_id") % 5 == 0, c("to_ts") + F.make_dt_interval(hours=F.lit(3))).otherwise(c("to_ts"))
    files = copies.where("copy_no = 0").select(c("event_id").alias("name"), "from_ts", end.alias("to_ts"), "size")
    return audit.missing_bucket_ranges(files, copies.select(c("event_id").alias("name"), N.bucket_start(c("bucket_ts")).alias("bucket"), "size"))


_REC_CLASS = "rc AS (SELECT coalesce(a.rel, b.rel) AS rel, a.size AS source_size, b.size AS dest_size, CASE WHEN a.rel IS NULL THEN 'only_dest' WHEN b.rel IS NULL THEN 'only_source' WHEN a.size = b.size THEN 'match' ELSE 'size_differs' END AS status FROM listing_a a FULL JOIN listing_b b ON a.rel = b.rel)"


@query("reconcile_listings", f"WITH {_REC_CLASS} SELECT * FROM rc", "listing_a", "listing_b")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return audit.reconcile_listings(a, b)


_EXT = "CAST(rel AS VARCHAR) || CASE WHEN rel % 3 = 0 THEN '.MP4' WHEN rel % 3 = 1 THEN '.mp4' ELSE '.txt' END AS rel, size"


@query("reconcile_by_extension", f"WITH a AS (SELECT {_EXT} FROM listing_a WHERE rel % 3 IN (0, 1)), b AS (SELECT {_EXT} FROM listing_b WHERE rel % 3 IN (0, 1)) SELECT coalesce(a.rel, b.rel) AS rel, a.size AS source_size, b.size AS dest_size, CASE WHEN a.rel IS NULL THEN 'only_dest' WHEN b.rel IS NULL THEN 'only_source' WHEN a.size = b.size THEN 'match' ELSE 'size_differs' END AS status FROM a FULL JOIN b ON a.rel = b.rel", "listing_a", "listing_b")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    named = lambda df: df.select(F.concat(c("rel").cast("string"), F.when(c("rel") % 3 == 0, ".MP4").when(c("rel") % 3 == 1, ".mp4").otherwise(".txt")).alias("rel"), "size")
    return audit.reconcile_listings(named(a), named(b), (".mp4",))


@query("reconcile_verdicts", f"WITH {_REC_CLASS} SELECT count(*) FILTER (WHERE status = 'size_differs') = 0 AS common_agree, count(*) FILTER (WHERE status <> 'match') = 0 AS equal FROM rc", "listing_a", "listing_b")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return audit.reconcile_verdicts(audit.reconcile_listings(a, b))


@query("short_outputs", """WITH p AS (SELECT user_id AS file, max(ts) AS last_ts FROM events WHERE event_type <> 'error' OR user_id % 3 > 0 GROUP BY 1), f AS (SELECT user_id AS file, CASE WHEN user_id % 10 = 0 THEN NULL ELSE max(ts) END AS nominal_end FROM events GROUP BY user_id)
  SELECT f.file, last_ts, CASE WHEN last_ts IS NULL THEN false WHEN nominal_end IS NULL THEN true ELSE NOT (epoch_us(nominal_end) - epoch_us(last_ts) > 300000000) END AS valid FROM f LEFT JOIN p ON f.file = p.file""", "events")
def _(e: DataFrame) -> DataFrame:
    files = e.groupBy(c("user_id").alias("file")).agg(F.max("ts").alias("m")).select("file", F.when(c("file") % 10 != 0, c("m")).alias("nominal_end"))
    return audit.short_outputs(files, e.where("event_type <> 'error' or user_id % 3 > 0").select(c("user_id").alias("file"), "ts"))


@query("stray_dirs", r"WITH x AS (SELECT DISTINCT CASE WHEN page_id % 40 = 0 THEN split_part(split_part(url, '://', 2), '.', 1) ELSE '2026' END AS dir FROM pages) SELECT dir FROM x WHERE NOT regexp_full_match(dir, '[0-9]+')", "pages")
def _(pages: DataFrame) -> DataFrame:
    top = F.when(c("page_id") % 40 == 0, F.split(F.split("url", "://")[1], r"\.")[0]).otherwise("2026")
    return audit.stray_dirs(pages.select(F.concat(top, F.lit("/07/01/x.bbb")).alias("path")))


_MONO = "mono AS (SELECT cam_id, seq, frame_ts, frame_id FROM (SELECT *, max(frame_ts) OVER (PARTITION BY cam_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM frame_seq) WHERE m IS NULL OR frame_ts > m)"


@query("monotonic_frames", f"WITH {_MONO} SELECT * FROM mono", "frame_seq")
def _(frame_seq: DataFrame) -> DataFrame:
    return audit.monotonic_frames(frame_seq, ["cam_id"])


_SPLIT = "sc AS (SELECT cam_id, seq, frame_ts, frame_id, CAST(sum(n) OVER (PARTITION BY cam_id ORDER BY seq) AS BIGINT) AS container FROM (SELECT *, CASE WHEN frame_id < lag(frame_id) OVER (PARTITION BY cam_id ORDER BY seq) THEN 1 ELSE 0 END AS n FROM frame_seq))"


@query("split_containers", f"WITH {_SPLIT} SELECT * FROM sc", "frame_seq")
def _(frame_seq: DataFrame) -> DataFrame:
    return audit.split_containers(frame_seq, ["cam_id"])


@query("dedup_containers", f"WITH {_SPLIT}, k AS (SELECT cam_id, container, CAST(date_trunc('day', arg_min(frame_ts, seq)) AS TIMESTAMP) AS first_ts, count(*) AS n_frames FROM sc GROUP BY cam_id, container) SELECT cam_id, first_ts, n_frames, container FROM (SELECT *, row_number() OVER (PARTITION BY cam_id, first_ts, n_frames ORDER BY container) AS r FROM k) WHERE r = 1", "frame_seq")
def _(frame_seq: DataFrame) -> DataFrame:
    stats = audit.container_stats(audit.split_containers(frame_seq, ["cam_id"]), ["cam_id", "container"], "seq", "frame_ts")
    return audit.dedup_containers(stats.select("cam_id", "container", N.ntz(F.date_trunc("day", "first_ts")).alias("first_ts"), "n_frames"), ["cam_id", "first_ts", "n_frames"], "container")


def _sub(seconds: int, start: str = "WITH RECURSIVE ") -> str:
    return f"""{start}t AS (SELECT strftime(ft, '%Y%m%d') AS day, cam_id, file_name, ft, row_number() OVER (PARTITION BY strftime(ft, '%Y%m%d'), cam_id ORDER BY file_name, ft) AS rn FROM (SELECT cam_id, file_name, {_FT} AS ft FROM frames) WHERE ft IS NOT NULL),
  s AS (SELECT day, cam_id, file_name, ft, rn, true AS kept, ft AS last FROM t WHERE rn = 1
    UNION ALL SELECT t.day, t.cam_id, t.file_name, t.ft, t.rn, t.ft >= s.last + INTERVAL {seconds} SECOND, CASE WHEN t.ft >= s.last + INTERVAL {seconds} SECOND THEN t.ft ELSE s.last END FROM s JOIN t ON t.day = s.day AND t.cam_id = s.cam_id AND t.rn = s.rn + 1)"""


def _timed(frames: DataFrame) -> DataFrame:
    return frames.select("cam_id", "file_name", N.frame_time(c("file_name")).alias("ts")).withColumn("day", N.frame_day(c("file_name")))


@query("subsample_frames", f"{_sub(3600)} SELECT day, cam_id, file_name, ft AS ts FROM s WHERE kept", "frames")
def _(frames: DataFrame) -> DataFrame:
    return audit.subsample_frames(_timed(frames), ["day", "cam_id"], "ts", "file_name", 3600)


_EXPECTED = "e AS (SELECT DISTINCT day, cam_id, 'background_' || strftime(date_trunc('hour', ft), '%Y%m%dT%H%M%S') || '.000000.000Z.png' AS name FROM s WHERE kept)"


@query("expected_backgrounds", f"{_sub(1800)}, {_EXPECTED} SELECT * FROM e", "frames")
def _(frames: DataFrame) -> DataFrame:
    return status.expected_backgrounds(_timed(frames).drop("ts"), 1800, "hour")


_THERE = f"x AS (SELECT {DAY.format('bucket')} AS day, cam_id, 'background_' || strftime(bucket, '%Y%m%dT%H%M%S') || '.000000.000Z.png' AS name FROM backgrounds)"
_PRESENT = f"{_THERE}, pr AS (SELECT e.day, e.cam_id, count(*) = count(x.name) AS present FROM e LEFT JOIN x ON e.day = x.day AND e.cam_id = x.cam_id AND e.name = x.name GROUP BY ALL)"


def _existing(backgrounds: DataFrame) -> DataFrame:
    return backgrounds.select(N.day_of(c("bucket")).alias("day"), "cam_id", F.concat(F.lit("background_"), F.date_format("bucket", "yyyyMMdd'T'HHmmss"), F.lit(".000000.000Z.png")).alias("name"))


@query("all_expected_present", f"{_sub(1800)}, {_EXPECTED}, {_PRESENT} SELECT * FROM pr", "frames", "backgrounds")
def _(frames: DataFrame, backgrounds: DataFrame) -> DataFrame:
    return status.all_expected_present(status.expected_backgrounds(_timed(frames).drop("ts"), 1800, "hour"), _existing(backgrounds), ["day", "cam_id"])


_BU = r"n AS (SELECT nullif(substring(regexp_extract(file_name, '(\d{8}T\d{6})', 1), 1, 8), '') AS day, cam_id, count(*) AS n_frames FROM frames GROUP BY ALL), bu AS (SELECT n.day, n.cam_id, n_frames, coalesce(kept, 0) AS kept FROM n LEFT JOIN (SELECT day, cam_id, count(*) AS kept FROM s WHERE kept GROUP BY ALL) k ON n.day = k.day AND n.cam_id = k.cam_id)"


@query("background_units", f"{_sub(1800)}, {_BU} SELECT * FROM bu", "frames")
def _(frames: DataFrame) -> DataFrame:
    return status.background_units(frames, interval=1800)


@query("background_units_of_source", r"""WITH RECURSIVE t AS (SELECT cam_id, file_name, ft, row_number() OVER (PARTITION BY cam_id ORDER BY file_name, ft) AS rn FROM (SELECT cam_id, file_name, FT AS ft FROM frames) WHERE ft IS NOT NULL),
  s AS (SELECT cam_id, rn, true AS kept, ft AS last FROM t WHERE rn = 1 UNION ALL SELECT t.cam_id, t.rn, t.ft >= s.last + INTERVAL 7200 SECOND, CASE WHEN t.ft >= s.last + INTERVAL 7200 SECOND THEN t.ft ELSE s.last END FROM s JOIN t ON t.cam_id = s.cam_id AND t.rn = s.rn + 1)
  SELECT 'archive' AS day, cam_id, n_frames, coalesce(kept, 0) AS kept FROM (SELECT cam_id, count(*) AS n_frames FROM frames GROUP BY 1) LEFT JOIN (SELECT cam_id, count(*) AS kept FROM s WHERE kept GROUP BY 1) USING (cam_id)""".replace("FT AS", f"{_FT} AS"), "frames")
def _(frames: DataFrame) -> DataFrame:
    return status.background_units(frames, interval=7200, label="archive")


@query("background_status", f"""{_sub(1800)}, {_EXPECTED}, {_PRESENT}, {_BU}, cams AS (SELECT DISTINCT {DAY.format('ts')} AS day, user_id % 9 AS cam_id FROM events)
  SELECT cams.day, cams.cam_id, coalesce(n_frames, 0) AS n_frames, 'int1800s_winhour' AS tag, CASE WHEN coalesce(n_frames, 0) = 0 THEN 'skipped_no_frames' WHEN coalesce(kept, 0) < 12 THEN 'skipped_min_frames' WHEN present THEN 'done' ELSE 'pending' END AS status
  FROM cams LEFT JOIN bu ON cams.day = bu.day AND cams.cam_id = bu.cam_id LEFT JOIN pr ON cams.day = pr.day AND cams.cam_id = pr.cam_id""", "events", "frames", "backgrounds")
def _(e: DataFrame, frames: DataFrame, backgrounds: DataFrame) -> DataFrame:
    cams = e.select(N.day_of(c("ts")).alias("day"), (c("user_id") % 9).alias("cam_id"))
    return status.background_status(cams, frames, _existing(backgrounds), 1800, "hour", min_frames=12)


@query("resolve_tag", """WITH g AS (SELECT DISTINCT user_id AS unit, 'tag' || (user_id % 3) AS guess FROM events), x AS (SELECT DISTINCT user_id AS unit, 'tag' || (event_id % 4) AS tag FROM events WHERE event_id % 40 = user_id % 40), l AS (SELECT unit, list(tag ORDER BY tag) AS tags FROM x GROUP BY unit)
  SELECT g.unit, CASE WHEN list_contains(tags, guess) OR coalesce(len(tags), 0) <> 1 THEN guess ELSE tags[1] END AS tag, CASE WHEN list_contains(tags, guess) OR tags IS NULL THEN '' WHEN len(tags) = 1 THEN 'only other tag' ELSE 'several tags' END AS note FROM g LEFT JOIN l ON g.unit = l.unit""", "events")
def _(e: DataFrame) -> DataFrame:
    guess = e.select(c("user_id").alias("unit"), F.concat(F.lit("tag"), (c("user_id") % 3).cast("string")).alias("guess")).distinct()
    there = e.where("event_id % 40 = user_id % 40").select(c("user_id").alias("unit"), F.concat(F.lit("tag"), (c("event_id") % 4).cast("string")).alias("tag"))
    return status.resolve_tag(guess, there, ["unit"])


_FV = f"fv AS (SELECT {DAY.format('ts')} AS day, cam_id, count(*) AS n_videos, bool_or(has_txt) AS txt FROM frame_videos GROUP BY ALL), ff AS (SELECT DISTINCT {DAY.format('ts')} AS day, cam_id FROM frame_files WHERE cam_id <> 3)"
_FS = "fs AS (SELECT fv.day, fv.cam_id, n_videos, CASE WHEN NOT txt THEN 'skipped_no_txt' WHEN ff.day IS NOT NULL THEN 'done' ELSE 'pending' END AS status FROM fv LEFT JOIN ff ON fv.day = ff.day AND fv.cam_id = ff.cam_id)"


def _frame_status(videos: DataFrame, files: DataFrame) -> DataFrame:
    return status.frame_status(videos.select(N.day_of(c("ts")).alias("day"), "cam_id", "has_txt"), files.where("cam_id <> 3").select(N.day_of(c("ts")).alias("day"), "cam_id"))


@query("frame_status", f"WITH {_FV}, {_FS} SELECT * FROM fs", "frame_videos", "frame_files")
def _(videos: DataFrame, files: DataFrame) -> DataFrame:
    return _frame_status(videos, files)


@query("frame_units", f"WITH {_FV}, {_FS} SELECT * FROM fs WHERE status = 'pending'", "frame_videos", "frame_files")
def _(videos: DataFrame, files: DataFrame) -> DataFrame:
    return status.pending_units(_frame_status(videos, files))


@query("frame_sources", "SELECT event_id FROM frame_videos WHERE has_txt", "frame_videos")
def _(videos: DataFrame) -> DataFrame:
    v = videos.select("event_id", F.concat(F.lit("cam-"), c("event_id").cast("string")).alias("stem"), "has_txt")
    return status.frame_sources(v, v.where("has_txt").select("stem")).select("event_id")


@query("sidecar_status", "SELECT event_id, CASE WHEN det_nc THEN 'done' ELSE 'missing' END AS status FROM recorder", "recorder")
def _(recorder: DataFrame) -> DataFrame:
    return status.sidecar_status(recorder.select("event_id", c("det_c").alias("detections_clahe"), c("det_nc").alias("detections_noclahe")), contrast=False).select("event_id", "status")


# ------------------------------------------------------------------ detections
def _frames_of(e: DataFrame) -> DataFrame:
    p = F.transform(F.slice("embedding", 1, 12), lambda x: F.lit(0.5) + x.cast("double"))
    d = F.transform(F.sequence(F.lit(0), (c("vec_id") % 3).cast("int")), lambda i: F.struct(((c("vec_id") + i) % 2).cast("int").alias("detection_type"), (c("vec_id") % 100 + i).cast("double").alias("x"), (c("vec_id") % 70).cast("double").alias("y"), p.alias("bits")))
    ts = N.ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=c("vec_id").cast("int"))
    return e.select((c("vec_id") % 8).cast("int").alias("cam_id"), ts.alias("ts"), d.alias("detections"))


@query("detections", f"""WITH q AS ({_P12}), r AS (SELECT vec_id, p, unnest(range(vec_id % 3 + 1)) AS i FROM q WHERE vec_id % 8 = 2 AND vec_id >= 60)
  SELECT TIMESTAMP '2024-01-01 00:00:00' + CAST(vec_id AS INT) * INTERVAL 1 MINUTE AS timestamp, CAST(vec_id % 8 AS INTEGER) AS cam_id, CAST((vec_id + i) % 2 AS INTEGER) AS detection_type, CAST(vec_id % 100 + i AS DOUBLE) AS x_pixels, CAST(vec_id % 70 AS DOUBLE) AS y_pixels,
  CASE WHEN (vec_id + i) % 2 = 1 THEN CAST(list_sum(list_transform(range(12), lambda k: CASE WHEN p[k + 1] > 0.5 THEN 1 << (11 - k) ELSE 0 END)) AS BIGINT) END AS bee_id, CASE WHEN (vec_id + i) % 2 = 1 THEN round(list_product(list_transform(p, lambda x: abs(x - 0.5) * 2)), 9) END AS bee_id_confidence FROM r""", "embeddings")
def _(e: DataFrame) -> DataFrame:
    d = detections.detections(_frames_of(e), cam=2, start="2024-01-01 01:00:00")
    return d.withColumn("bee_id_confidence", F.round("bee_id_confidence", 9))


@query("track_points", f"WITH t AS (SELECT user_id || '|' || {DAY.format('ts')} AS track_id, user_id % 8 AS cam_id, event_id, ts, row_number() OVER (PARTITION BY user_id, {DAY.format('ts')} ORDER BY event_id) - 1 AS detection_index FROM events) SELECT cam_id, track_id, CAST(detection_index AS INTEGER) AS detection_index, event_id AS frame_id, ts AS timestamp FROM t", "events")
def _(e: DataFrame) -> DataFrame:
    point, track = F.struct(c("event_id").alias("frame_id"), c("ts").alias("timestamp")), F.concat_ws("|", c("user_id").cast("string"), N.day_of(c("ts")))  # a track ends with its day
    return detections.track_points(e.groupBy((c("user_id") % 8).alias("cam_id"), track.alias("track_id")).agg(F.array_sort(F.collect_list(point)).alias("detections")))


@query("read_detections", f"SELECT event_id, user_id % 8 AS cam_id, {DAY.format('ts')} AS day, ts AS timestamp FROM events WHERE user_id % 8 = 2 AND ts >= TIMESTAMP '2024-01-03 05:00:00' AND ts < TIMESTAMP '2024-01-05 00:00:00'", "events")
def _(e: DataFrame) -> DataFrame:
    path = scratch(e.sparkSession)
    snapshots.write_detections(e.select(c("ts").alias("timestamp"), (c("user_id") % 8).alias("cam_id"), "event_id"), path)
    got = snapshots.read_detections(e.sparkSession, path, 2, "2024-01-03 05:00:00", "2024-01-05 00:00:00")
    return got.withColumn("cam_id", c("cam_id").cast("long"))


@query("verify_run", "SELECT event_type AS run, count(DISTINCT user_id) AS files, count(*) AS frames, CAST(sum(event_id % 4 + 1) AS BIGINT) AS tagged, CAST(sum(event_id % 3 + 1) AS BIGINT) AS untagged FROM events GROUP BY 1", "events")
def _(e: DataFrame) -> DataFrame:
    arr = lambda n: F.sequence(F.lit(0), (c("event_id") % n).cast("int"))
    return detections.verify_run(e.select(c("event_type").alias("run"), c("user_id").alias("file"), arr(4).alias("tagged"), arr(3).alias("untagged")), ["run"])


@query("compare_runs", """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 AND user_id % 50 <> 1 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, a.n AS a, b.n AS b FROM a FULL JOIN b ON a.user_id = b.user_id)
  SELECT user_id, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST(abs(a - b) AS DOUBLE) / greatest(a, b) END AS rel_diff, coalesce(CAST(abs(a - b) AS DOUBLE) / CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END > 0.10, true) AS differs FROM j""", "events")
def _(e: DataFrame) -> DataFrame:
    count = lambda w: e.where(w).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return detections.compare_runs(count("event_id % 2 = 0 and user_id % 50 <> 1"), count("event_id % 2 = 1"), "user_id", "n")


@query("link_candidates", "SELECT p.cam_id, p.event_id AS a, q.event_id AS b, (epoch_us(q.ts) - epoch_us(p.ts)) / 1e6 AS dt, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) AS dist FROM points p JOIN points q ON p.cam_id = q.cam_id AND q.ts > p.ts AND epoch_us(q.ts) - epoch_us(p.ts) <= 900000000 AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 0.9 * (epoch_us(q.ts) - epoch_us(p.ts)) / 1e6", "points")
def _(points: DataFrame) -> DataFrame:
    return detections.link_candidates(points.withColumnRenamed("event_id", "id"), speed=0.9, gap=900).withColumn("dist", F.floor(c("dist") * 1e6 + 0.5) / 1e6)  # round() goes through text, a microsecond a row


@query("with_recorder_start", "SELECT event_id, cam, start_ts AS recorder_start FROM recorder", "recorder")
def _(recorder: DataFrame) -> DataFrame:
    starts = recorder.select("event_id", c("start_ts").alias("recorder_start"))
    return detections.with_recorder_start(recorder.select("event_id", "cam"), starts, "event_id")


@query("sample_rows", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5", "events")
def _(e: DataFrame) -> DataFrame:
    return detections.sample_rows(e.select("event_type", "event_id", "ts"), 5, ["event_type"], [c("ts"), c("event_id")]).drop("ts")


# ------------------------------------------------------------------ accounting
_MS = """st AS (SELECT jobid, max(maxrss_kib) FILTER (WHERE step <> 'extern') AS rss, max(maxrss_kib) AS any_rss, max(totalcpu_s) FILTER (WHERE step = 'batch') AS cpu FROM steps GROUP BY jobid),
  ms AS (SELECT tasks.* EXCLUDE (own_rss, own_cpu), own_rss, own_cpu, coalesce(rss, greatest(any_rss, own_rss)) AS maxrss_kib, coalesce(cpu, own_cpu) AS totalcpu_s FROM tasks LEFT JOIN st ON tasks.jobid = st.jobid)"""


@query("merge_steps", f"WITH {_MS} SELECT * FROM ms", "tasks", "steps")
def _(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    return accounting.merge_steps(tasks, steps)


@query("nearest_rank", "SELECT name, min(elapsed_s) AS q0, quantile_disc(elapsed_s, 0.5) AS q50, quantile_disc(elapsed_s, 0.95) AS q95, max(elapsed_s) AS q100 FROM tasks GROUP BY name", "tasks")
def _(tasks: DataFrame) -> DataFrame:
    return accounting.nearest_rank(tasks, "name", "elapsed_s", {"q0": 0, "q50": 0.5, "q95": 0.95, "q100": 1.0}).withColumns({q: c(q).cast("int") for q in ("q50", "q95", "q100")})


@query("state_counts", "SELECT name, state, count(*) AS n FROM tasks GROUP BY ALL", "tasks")
def _(tasks: DataFrame) -> DataFrame:
    return accounting.state_counts(tasks.withColumn("state", F.when(c("state") == "TIMEOUT", F.concat("state", F.lit(" by 42"))).otherwise(c("state"))))


_Q = ", ".join(f"quantile_disc({col}, {q}) AS {col}_{n}" for col in ("elapsed_s", "maxrss_kib", "mem_eff", "time_eff", "cpu_eff", "per_item") for n, q in (("p50", 0.5), ("p95", 0.95), ("max", 1.0)))
_RS = f"""{_MS}, en AS (SELECT *, nullif(maxrss_kib, 0) / nullif(reqmem_kib, 0) AS mem_eff, CAST(elapsed_s AS DOUBLE) / timelimit_s AS time_eff, nullif(totalcpu_s, 0) / (elapsed_s * ncpus) AS cpu_eff, bool_or(state = 'COMPLETED') OVER (PARTITION BY name) AS any_done FROM ms WHERE elapsed_s > 0),
  ei AS (SELECT *, CASE WHEN state = 'COMPLETED' OR NOT any_done THEN CAST(elapsed_s AS DOUBLE) / CASE WHEN name = '1' THEN 50 ELSE 32 END END AS per_item FROM en),
  hd AS (SELECT name, count(*) AS tasks, arg_min(reqmem_kib, jobid) AS reqmem_kib, CASE WHEN name = '1' THEN 50 ELSE 32 END AS chunk FROM ms GROUP BY name),
  rs AS (SELECT hd.*, x.* EXCLUDE (name) FROM hd LEFT JOIN (SELECT name, min(elapsed_s) AS elapsed_s_min, count(*) AS terminal, count(*) FILTER (WHERE state = 'COMPLETED') AS completed, count(*) FILTER (WHERE state = 'FAILED' AND elapsed_s < 60) AS short_failures, {_Q} FROM ei GROUP BY name) x ON hd.name = x.name)"""


def _summary(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    chunks = tasks.sparkSession.createDataFrame([("1", 50)], "name string, chunk int")
    return accounting.resource_summary(accounting.merge_steps(tasks, steps), chunks)


@query("resource_summary", f"WITH {_RS} SELECT * FROM rs", "tasks", "steps")
def _(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    return _summary(tasks, steps)


@query("right_size", f"""WITH {_RS}, ch AS (SELECT *, greatest(1, floor(10800 / (per_item_p95 * 1.5))) AS ck FROM rs)
  SELECT name, CAST(greatest(ceil(maxrss_kib_p95 * 1.3 / 1024 / 256) * 256, 1024) AS BIGINT) AS mem_mib, CAST(greatest(ceil(elapsed_s_p95 * 1.5 / 300) * 5, 10) AS BIGINT) AS minutes, CAST(ck AS BIGINT) AS chunk, CAST(greatest(ceil(ck * per_item_p95 * 1.5 / 300) * 5, 10) AS BIGINT) AS chunk_minutes, completed < greatest(3.0, 0.1 * terminal) AS low_evidence FROM ch""", "tasks", "steps")
def _(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    return accounting.right_size(_summary(tasks, steps))


_PC = "CAST(CAST(floor({0} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"
_MEM = "CAST(greatest(ceil(maxrss_kib_p95 * 1.3 / 1024 / 256) * 256, 1024) AS BIGINT)"


@query("resource_table", f"WITH {_RS} SELECT name, tasks, {_DUR.format('CAST(elapsed_s_p50 AS BIGINT)')} AS elapsed_p50, {_DUR.format('CAST(elapsed_s_p95 AS BIGINT)')} AS elapsed_p95, {_KIB.format('maxrss_kib_p95')} AS rss_p95, {_PC.format('time_eff_p50')} AS time_eff, {_PC.format('mem_eff_p50')} AS mem_eff, CASE WHEN {_MEM} % 1024 = 0 THEN ({_MEM} // 1024) || 'G' ELSE {_MEM} || 'M' END AS memory FROM rs", "tasks", "steps")
def _(tasks: DataFrame, steps: DataFrame) -> DataFrame:
    return accounting.resource_table(_summary(tasks, steps))


# ------------------------------------------------------------------ planning
@query("not_queued", "SELECT event_id FROM videos WHERE event_id % 7 <> 0", "videos")
def _(videos: DataFrame) -> DataFrame:
    return planning.not_queued(videos.select("event_id"), videos.where("event_id % 7 = 0").select("event_id"), "event_id")


def _plan(source: str, order: str, size: int, item: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return f"SELECT {key}(rn - 1) // {size} AS chunk_id, count(*) AS n, string_agg({item}, ' ' ORDER BY rn) AS items FROM (SELECT *, row_number() OVER ({over}ORDER BY {order}) AS rn FROM {source}) GROUP BY {key}(rn - 1) // {size}"


def _flat(plan: DataFrame) -> DataFrame:
    return plan.withColumn("items", F.array_join(c("items").cast("array<string>"), " "))


@query("chunk", _plan("events", "ts, event_id", 100, "CAST(event_id AS VARCHAR)"), "events")
def _(e: DataFrame) -> DataFrame:
    return _flat(planning.chunk(e.select("ts", "event_id"), [c("ts"), c("event_id")], 100, "event_id"))


@query("plan_detect", f"WITH {_DS}, cap AS (SELECT * FROM ds WHERE status <> 'done' ORDER BY event_id LIMIT 640) {_plan('cap', 'starttime, cam_id, event_id', 32, 'CAST(event_id AS VARCHAR)')}", "videos", "src")
def _(videos: DataFrame, src: DataFrame) -> DataFrame:
    return _flat(planning.plan_detect(status.pending_units(status.detect_status(videos, src)), 32, 20, "event_id"))


_WITEM = "cam_id || '|' || strftime(from_dt, '%Y-%m-%dT%H:%M:%S') || '|' || strftime(to_dt, '%Y-%m-%dT%H:%M:%S')"


@query("plan_windows", f"WITH {_WS}, cap AS (SELECT * FROM ws WHERE status <> 'done' ORDER BY from_dt, cam_id LIMIT 500) {_plan('cap', 'from_dt, cam_id', 50, _WITEM)}", "src", "outp")
def _(src: DataFrame, outp: DataFrame) -> DataFrame:
    return _flat(planning.plan_windows(status.pending_units(status.window_status(src, outp)), 50, 10))


@query("plan_sidecars", f"WITH m AS (SELECT {_MODEL} AS model, file_name, {_REC} AS t FROM rec_files WHERE NOT det_c), cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY t, file_name) AS r0 FROM m) WHERE r0 <= 600) {_plan('cap', 'r0', 150, 'file_name', 'model')}", "rec_files")
def _(rec_files: DataFrame) -> DataFrame:
    return _flat(planning.plan_sidecars(rec_files.where("not det_c"), ROUTES, 150, 4))


@query("split_even", "SELECT event_id, ntile(7) OVER (ORDER BY ts, event_id) AS worker FROM events", "events")
def _(e: DataFrame) -> DataFrame:
    return planning.split_even(e.select("ts", "event_id"), [c("ts"), c("event_id")], 7).select("event_id", "worker")


@query("chunk_stats", f"WITH p AS ({_plan('events', 'event_id', 32, 'CAST(event_id AS VARCHAR)')}) SELECT count(*) AS chunks, CAST(sum(n) AS BIGINT) AS items, avg(n) AS avg_items FROM p", "events")
def _(e: DataFrame) -> DataFrame:
    return planning.chunk_stats(planning.chunk(e.select("event_id"), [c("event_id")], 32, "event_id"))


@query("new_ids", "WITH x AS (SELECT CAST(rel AS VARCHAR) AS id FROM listing_b EXCEPT SELECT CAST(rel AS VARCHAR) FROM listing_a) SELECT id, row_number() OVER (ORDER BY TRY_CAST(id AS BIGINT) NULLS LAST, id) AS place FROM x", "listing_a", "listing_b")
def _(a: DataFrame, b: DataFrame) -> DataFrame:
    return planning.new_ids(a.select(c("rel").cast("string").alias("id")), b.select(c("rel").cast("string").alias("id")))


@query("remaining_days", f"SELECT DISTINCT {DAY.format('ts')} AS day FROM events WHERE {DAY.format('ts')} NOT IN (SELECT {DAY.format('ts')} FROM events WHERE day(ts) % 3 = 0)", "events")
def _(e: DataFrame) -> DataFrame:
    days = e.select(N.day_of(c("ts")).alias("day")).distinct()
    return planning.remaining_days(days, e.where(F.dayofmonth("ts") % 3 == 0).select(N.day_of(c("ts")).alias("day")))


# ------------------------------------------------------------------ streams, run over all that is there
def _stream(spark: SparkSession, sf_dir: str, view: str) -> tuple[DataFrame, str]:
    """A view as a stream of files, and a folder for the run."""
    work = scratch(spark)
    rows = frame(spark, sf_dir, view)
    rows = rows.withColumns({n: c(n).cast("timestamp") for n, t in rows.dtypes if t == "timestamp_ntz"})
    rows.write.parquet(f"{work}/in")
    return feeds.read_parquet_stream(spark, f"{work}/in", rows.schema), work


def _streamed(name: str, oracle: str, view: str, build: Callable[[DataFrame], DataFrame], last: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        source, work = _stream(spark, sf_dir, view)
        feeds.drain(build(source), f"{work}/out", f"{work}/state")
        out = last(spark.read.parquet(f"{work}/out"))
        return out.withColumns({n: N.ntz(c(n)) for n, t in out.dtypes if t == "timestamp"})

    QUERIES[name] = run
    ORACLE_SQL[name] = sql(oracle)


_streamed(
    "stream_hourly_units",
    "WITH w AS (SELECT user_id % 8 AS cam_id, date_trunc('hour', ts) AS from_dt, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM w WHERE from_dt + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY",
    "events", lambda s: feeds.stream_hourly_units(s.withColumn("cam_id", c("user_id") % 8)), lambda out: out,
)
_streamed(
    "stream_dedup",
    "SELECT DISTINCT user_id % 8 AS cam_id, date_trunc('hour', ts) AS first_ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS last_ts FROM events",
    "events",
    lambda s: feeds.stream_dedup(s.select((c("user_id") % 8).alias("cam_id"), F.date_trunc("hour", "ts").alias("first_ts"), (F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).alias("last_ts"))), lambda out: out,
)


BATCHES = 4


def _batches(spark: SparkSession, sf_dir: str, view: str, order: str) -> tuple[DataFrame, str]:
    """A view as a stream of several batches that follow each other in ``order``, and a folder for the run."""
    work, rows = scratch(spark), frame(spark, sf_dir, view)
    rows = rows.withColumns({n: c(n).cast("timestamp") for n, t in rows.dtypes if t == "timestamp_ntz"})
    dealt = written(planning.split_even(rows, [c(order)], BATCHES))
    for i in range(1, BATCHES + 1):
        dealt.where(c("worker") == i).drop("worker").coalesce(1).write.mode("append").parquet(f"{work}/in")  # a file each, in turn
    return feeds.read_parquet_stream(spark, f"{work}/in", rows.schema, files_per_batch=1), work


def _monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source, work = _batches(spark, sf_dir, "frame_seq", "seq")
    feeds.drain_batches(source.select("cam_id", "seq", "frame_ts"), lambda batch, i: feeds.stream_monotonic(batch, i, f"{work}/out", ["cam_id"]), f"{work}/state")
    return spark.read.parquet(f"{work}/out").drop("batch").withColumn("frame_ts", N.ntz(c("frame_ts")))


QUERIES["stream_monotonic"] = _monotonic
ORACLE_SQL["stream_monotonic"] = sql(f"WITH {_MONO} SELECT cam_id, seq, frame_ts FROM mono")


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source, work = _batches(spark, sf_dir, "events", "event_id")
    feeds.drain_batches(source.select(N.day_of(c("ts")).alias("day")), lambda batch, i: feeds.submit_days(batch, i, f"{work}/ledger"), f"{work}/state")
    return snapshots.read_ledger(spark, f"{work}/ledger")


QUERIES["stream_submissions"] = _submissions
ORACLE_SQL["stream_submissions"] = sql(f"WITH x AS (SELECT {DAY.format('ts')} AS day, ntile(4) OVER (ORDER BY event_id) - 1 AS run FROM events) SELECT day, CAST(min(run) AS VARCHAR) AS run FROM x WHERE day IS NOT NULL GROUP BY day")


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, work = _batches(spark, sf_dir, "frame_feed", "seq")
        cut = feeds.stream_containers(source, silence_s=5400, delay="2 hours")
        feeds.drain(cut, f"{work}/out", f"{work}/state")
    finally:
        spark.conf.set(provider, before)
    out = spark.read.parquet(f"{work}/out")
    return out.withColumns({n: N.ntz(c(n)) for n in ("first_ts", "last_ts")})


QUERIES["stream_containers"] = _containers
ORACLE_SQL["stream_containers"] = sql("""WITH w AS (SELECT max(taken) - INTERVAL 2 HOUR AS mark FROM frame_feed),
  x AS (SELECT *, CASE WHEN frame_id < lag(frame_id) OVER o OR taken - lag(taken) OVER o > INTERVAL 5400 SECOND THEN 1 ELSE 0 END AS n FROM frame_feed, w WHERE taken <= date_trunc('millisecond', mark) WINDOW o AS (PARTITION BY cam_id ORDER BY seq)),
  y AS (SELECT *, sum(n) OVER (PARTITION BY cam_id ORDER BY seq) AS container FROM x),
  z AS (SELECT cam_id, CAST(container AS BIGINT) AS container, arg_min(frame_ts, seq) AS first_ts, arg_max(frame_ts, seq) AS last_ts, count(*) AS n_frames, max(taken) AS taken, max(container) OVER (PARTITION BY cam_id) AS newest FROM y GROUP BY cam_id, container)
  SELECT cam_id, container, first_ts, last_ts, n_frames FROM z, w WHERE container < newest OR taken + INTERVAL 5400 SECOND < date_trunc('millisecond', mark)""")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source, work = _stream(spark, sf_dir, "frame_seq")
    shifted = source.select("cam_id", "seq", F.when(c("seq") % 13 == 0, c("frame_ts") - F.expr("INTERVAL 20 DAYS")).otherwise(c("frame_ts")).alias("ts"))
    q = shifted.writeStream.foreachBatch(lambda batch, i: feeds.stream_late(batch.sparkSession, batch, i, f"{work}/now", f"{work}/late", days=12)).option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{work}/late").drop("batch").withColumn("ts", N.ntz(c("ts")))


QUERIES["stream_late"] = _late
ORACLE_SQL["stream_late"] = sql("WITH x AS (SELECT cam_id, seq, CASE WHEN seq % 13 = 0 THEN frame_ts - INTERVAL 20 DAY ELSE frame_ts END AS ts FROM frame_seq) SELECT * FROM x WHERE ts < (SELECT max(ts) FROM x) - INTERVAL 12 DAY")


# ------------------------------------------------------------------ sinks and sources, written and read again
@query("conform", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(NULL AS DOUBLE) AS weight, CAST(value AS DOUBLE) AS value FROM events", "events")
def _(e: DataFrame) -> DataFrame:
    shape = e.sparkSession.createDataFrame([], "event_id string, event_type string, weight double, value double").schema
    return snapshots.conform(e.select("value", "event_id", "event_type", "ts"), shape)


@query("write_snapshot", "SELECT event_id, value, CASE WHEN event_id % 2 = 0 THEN '20260701' ELSE '20260702' END AS snapshot FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0", "events")
def _(e: DataFrame) -> DataFrame:
    path, rows = scratch(e.sparkSession), e.select("event_id", "value")
    snapshots.write_snapshot(rows.where("event_id % 2 = 0"), path, "20260701")
    snapshots.write_snapshot(rows, path, "20260702")
    snapshots.write_snapshot(rows.where("event_id % 2 <> 0 and event_id % 3 = 0"), path, "20260702")  # replaces that one and no other
    return snapshots.read_snapshots(e.sparkSession, path)


@query("empty_snapshot", "SELECT event_id, '20260701' AS snapshot FROM events WHERE event_id % 2 = 0", "events")
def _(e: DataFrame) -> DataFrame:
    path, rows = scratch(e.sparkSession), e.select("event_id")
    snapshots.write_snapshot(rows.where("event_id % 2 = 0"), path, "20260701")
    snapshots.write_snapshot(rows, path, "20260702")
    snapshots.write_snapshot(rows.where("event_id < 0"), path, "20260702")  # replaced by nothing: the newest snapshot is empty now
    return snapshots.read_snapshots(e.sparkSession, path).unionByName(snapshots.read_latest_snapshot(e.sparkSession, path))


@query("append_ledger", "SELECT event_id, CAST(event_id % 3 AS VARCHAR) AS run FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, '0' FROM events WHERE event_id % 6 = 0", "events")
def _(e: DataFrame) -> DataFrame:
    path, spark = scratch(e.sparkSession), e.sparkSession
    for run in ("0", "1", "1", "2"):
        snapshots.append_ledger(e.where(c("event_id") % 3 == int(run)).select("event_id"), path, run)
    snapshots.compact_ledger(spark, path)
    snapshots.append_ledger(e.where("event_id % 6 = 0").select("event_id"), path, "0")  # told again, with fewer entries, after compaction
    return snapshots.read_ledger(spark, path)


@query("write_report", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type || ' ' || CAST(user_id AS VARCHAR) AS tags FROM events", "events")
def _(e: DataFrame) -> DataFrame:
    path = scratch(e.sparkSession)
    snapshots.write_report(e.select("event_id", F.array(c("event_type"), c("user_id").cast("string")).alias("tags")), path)
    return e.sparkSession.read.option("header", True).csv(path)


_STATUS = "CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 7 = 0 THEN 'skipped_no_txt' ELSE 'done' END"


@query("save_report", f"""WITH u AS (SELECT {DAY.format('ts')} AS day, {_STATUS} AS status FROM events)
  SELECT 'frames' AS stage, day, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'pending') AS pending FROM u GROUP BY day""", "events")
def _(e: DataFrame) -> DataFrame:
    path, spark = scratch(e.sparkSession), e.sparkSession
    units = e.select(N.day_of(c("ts")).alias("day"), F.expr(_STATUS).alias("status"))
    for at, some in (("2026-07-01T10:00:00", units.where("status = 'done'")), ("2026-07-01T11:00:00", units)):
        snapshots.save_report(status.progress_report({"frames": some}), path, at)
    return snapshots.load_report(spark, path)["by_day"].select(c("stage").cast("string").alias("stage"), c("day").cast("string").alias("day"), "done", "pending")


@query("write_detections", f"SELECT user_id % 8 AS cam_id, {DAY.format('ts')} AS day, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY ALL", "events")
def _(e: DataFrame) -> DataFrame:
    path = scratch(e.sparkSession)
    rows = e.select(c("ts").alias("timestamp"), (c("user_id") % 8).alias("cam_id"), "event_id")
    snapshots.write_detections(rows, path)
    snapshots.write_detections(rows.where("cam_id = 3"), path)  # again: these days and cameras are replaced
    back = e.sparkSession.read.parquet(path)
    return back.groupBy(c("cam_id").cast("long").alias("cam_id"), c("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("failures", "SELECT event_id, 'ValueError: file ' || event_id || ' is cut short' AS error FROM events WHERE event_id % 5 = 0", "events")
def _(e: DataFrame) -> DataFrame:
    def work(i: int) -> int:
        if i % 5 == 0:
            raise ValueError(f"file {i} is cut short")
        return i

    done = detections.map_with_errors(e.select("event_id"), work, "event_id")
    return detections.failures(done).select("event_id", "error")


_FILES = f"f AS (SELECT {DAY.format('ts')} AS day, user_id % 8 AS cam, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL), files AS (SELECT day, 'cam_' || cam || '.txt' AS file_name, n, CASE WHEN n % 5 = 0 THEN '' ELSE CAST(n AS VARCHAR) END AS body FROM f)"


def _file_tree(e: DataFrame, root: str, which: str = "true") -> DataFrame:
    """(day, cam, n, path): tasks write a file for every day and camera under ``root``, with the number of its events; some stay empty."""
    counts = e.groupBy(N.day_of(c("ts")).alias("day"), (c("user_id") % 8).cast("long").alias("cam")).agg(F.count(F.lit(1)).alias("n"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [f"{root}/{day}/cam_{cam}.txt" for day, cam in zip(batch["day"], batch["cam"], strict=True)]
            for path, n in zip(paths, batch["n"], strict=True):
                part = f"{root}.part/{uuid.uuid4().hex}"  # moved when it is whole: a feed may be reading
                for name in (path, part):
                    os.makedirs(os.path.dirname(name), exist_ok=True)
                with open(part, "w") as f:
                    f.write(str(n) if n % 5 else "")
                os.replace(part, path)
            yield batch.assign(path=paths)

    return written(counts.where(f"day is not null and {which}").mapInPandas(put, "day string, cam long, n long, path string"))


def _even(raw: bytes) -> bool:
    return int(raw) % 2 == 0


def _listed(files: DataFrame, *columns: str) -> DataFrame:
    return files.select(c("day").cast("string").alias("day"), "file_name", c("size").cast("long").alias("size"), *columns)


@query("validate_files", f"WITH {_FILES} SELECT day, file_name, body <> '' AND n % 2 = 0 AS valid FROM files", "events")
def _(e: DataFrame) -> DataFrame:
    made = _file_tree(e, mounted_scratch(e.sparkSession))
    return detections.validate_files(made, _even).select("day", F.concat(F.lit("cam_"), c("cam").cast("string"), F.lit(".txt")).alias("file_name"), "valid")


@query("refresh_catalog", f"WITH {_FILES} SELECT day, file_name, CAST(length(body) AS BIGINT) AS size, CASE WHEN CAST(day AS INT) % 3 = 0 THEN body <> '' AND n % 2 = 0 ELSE body <> '' END AS is_valid FROM files", "events")
def _(e: DataFrame) -> DataFrame:
    spark, work = e.sparkSession, mounted_scratch(e.sparkSession)
    root, catalog = f"{work}/files", f"{work}/catalog"
    _file_tree(e, root, "cast(day as int) % 3 = 0")
    listing.refresh_catalog(spark, root, catalog, deep=lambda rows: detections.validate_files(rows, _even, "full_path"))
    _file_tree(e, root, "cast(day as int) % 3 <> 0")
    listing.refresh_catalog(spark, root, catalog)  # the new days only: what was read before stays
    return _listed(listing.read_catalog(spark, catalog), "is_valid")


@query("read_listing", f"WITH {_FILES} SELECT day, file_name, CAST(length(body) AS BIGINT) AS size FROM files", "events")
def _(e: DataFrame) -> DataFrame:
    root = f"{mounted_scratch(e.sparkSession)}/files"
    _file_tree(e, root)
    return _listed(listing.read_listing(e.sparkSession, root).withColumn("day", c("top")))


_HOURS = f"h AS (SELECT {DAY.format('ts')} AS day, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL)"


def _nested_tree(e: DataFrame, root: str) -> DataFrame:
    """Tasks write a file for every hour of events, at YYYY/MM/DD/HH/n.txt below ``root``; its size is the number of events modulo 100."""
    hours = e.groupBy(N.day_of(c("ts")).alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")).where("day is not null")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for day, hour, n in batch.itertuples(index=False):
                folder = f"{root}/{day[:4]}/{day[4:6]}/{day[6:]}/{hour:02d}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/n.txt", "w") as f:
                    f.write("x" * (n % 100))
            yield batch

    return written(hours.mapInPandas(put, "day string, hour int, n long"))


def _thinned(hours: DataFrame, root: str) -> DataFrame:
    """Tasks take files away: of every fifth day all files, every seventh day altogether; and add one to hour 3 of every eleventh."""

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for day, hour in batch[["day", "hour"]].itertuples(index=False):
                folder = f"{root}/{day[:4]}/{day[4:6]}/{day[6:]}"
                if int(day) % 7 == 0:
                    shutil.rmtree(f"{folder}/{hour:02d}", ignore_errors=True)
                    with contextlib.suppress(OSError):  # the day's folder goes with its last hour
                        os.rmdir(folder)
                elif int(day) % 5 == 0:
                    with contextlib.suppress(FileNotFoundError):  # a task may run twice
                        os.remove(f"{folder}/{hour:02d}/n.txt")
                elif int(day) % 11 == 0 and hour == 3:
                    with open(f"{folder}/{hour:02d}/more.txt", "w") as f:
                        f.write("more")
            yield batch

    return written(hours.mapInPandas(change, "day string, hour int, n long"))


_NESTED = f"""{_HOURS}, was AS (SELECT day, replace(strftime(strptime(day, '%Y%m%d'), '%Y/%m/%d'), ' ', '') || '/' || lpad(CAST(hour AS VARCHAR), 2, '0') AS dir, hour, n % 100 AS size FROM h),
  now_ AS (SELECT day, dir || '/n.txt' AS path, size FROM was WHERE CAST(day AS INT) % 7 <> 0 AND CAST(day AS INT) % 5 <> 0 UNION ALL SELECT day, dir || '/more.txt', 4 FROM was WHERE CAST(day AS INT) % 7 <> 0 AND CAST(day AS INT) % 5 <> 0 AND CAST(day AS INT) % 11 = 0 AND hour = 3)"""


@query("nested_catalog", f"WITH {_NESTED} SELECT day, path, CAST(size AS BIGINT) AS size FROM now_", "events")
def _(e: DataFrame) -> DataFrame:
    spark, work = e.sparkSession, mounted_scratch(e.sparkSession)
    root, catalog = f"{work}/files", f"{work}/catalog"
    hours = _nested_tree(e, root)
    listing.refresh_catalog(spark, root, catalog)
    _thinned(hours, root)
    listing.refresh_catalog(spark, root, catalog)
    return listing.read_catalog(spark, catalog).select("day", "path", "size")


@query("stream_changes", f"""WITH {_NESTED} SELECT 'added' AS change, day, dir || '/n.txt' AS path, CAST(size AS BIGINT) AS size, CAST(1 AS BIGINT) AS version FROM was
  UNION ALL SELECT 'removed', day, dir || '/n.txt', CAST(size AS BIGINT), 2 FROM was WHERE CAST(day AS INT) % 7 = 0 OR CAST(day AS INT) % 5 = 0
  UNION ALL SELECT 'added', day, path, CAST(size AS BIGINT), 2 FROM now_ WHERE path LIKE '%more.txt'""", "events")
def _(e: DataFrame) -> DataFrame:
    spark, work = e.sparkSession, mounted_scratch(e.sparkSession)
    root, catalog, out = f"{work}/files", f"{work}/catalog", f"{work}/changes"
    hours = _nested_tree(e, root)
    listing.refresh_catalog(spark, root, catalog)
    feeds.stream_changes(spark, catalog, out, f"{work}/state", once=True).awaitTermination()
    _thinned(hours, root)
    listing.refresh_catalog(spark, root, catalog)
    for _ in range(2):  # it goes on where it stopped; started again without a new commit, it tells nothing more
        feeds.stream_changes(spark, catalog, out, f"{work}/state", once=True).awaitTermination()
    return feeds.read_changes(spark, out).select("change", "day", "path", "size", "version")


@query("stream_catalog", f"WITH {_FILES} SELECT day, file_name, CAST(length(body) AS BIGINT) AS size FROM files", "events")
def _(e: DataFrame) -> DataFrame:
    spark, work = e.sparkSession, mounted_scratch(e.sparkSession)
    root, catalog, out = f"{work}/files", f"{work}/catalog", f"{work}/changes"
    for which in ("cast(day as int) % 3 = 0", "true"):  # new days, and days that are written again
        _file_tree(e, root, which)
        listing.refresh_catalog(spark, root, catalog)
        feeds.stream_changes(spark, catalog, out, f"{work}/state", once=True).awaitTermination()
    told = feeds.read_changes(spark, out)
    return _listed(listing.newest_copy(told, ["path"], "version").where("change <> 'removed'"))


@query("long_files", f"""WITH f AS (SELECT event_id AS name, from_ts, from_ts + CAST(event_id % 120 AS INT) * INTERVAL 1 HOUR AS to_ts FROM copies WHERE copy_no = 0 AND size > 0),
  n AS (SELECT name, len(generate_series({_B.format('from_ts')}, {_B.format('to_ts')}, INTERVAL 20 MINUTE)) AS buckets FROM f) SELECT name, CAST(buckets AS BIGINT) AS buckets FROM n WHERE buckets > 200""", "copies")
def _(copies: DataFrame) -> DataFrame:
    files = copies.where("copy_no = 0").select(c("event_id").alias("name"), "from_ts", (c("from_ts") + F.make_dt_interval(hours=(c("event_id") % 120).cast("int"))).alias("to_ts"), "size")
    return audit.long_files(files)
