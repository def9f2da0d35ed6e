"""Names, keys and times: everything that is read out of, or built into, file and directory names. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of names.
STAMP = r"(\d{4})-?(\d{2})-?(\d{2})T(\d{2})_?(\d{2})_?(\d{2})(?:\.(\d{1,6}))?(?:\.\d+)?Z"
VIDEO = rf"^[Cc]am[_-](\d+)_({STAMP})--({STAMP})\."
CAMERA = r"^[Cc]am[_-](\d+)"
FRAME = r"(\d{8}T\d{6})"
# End of fixed values.


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def stamp(text: Column) -> Column:
    """A time stamp of either form, or null."""
    plain = F.regexp_replace(F.regexp_replace(text, f"^{STAMP}$", "$1-$2-$3 $4:$5:$6.$7"), r"\.$", "")
    return F.when(text.rlike(f"^{STAMP}$"), plain.try_cast("timestamp_ntz"))


def parse_name(name: Column) -> Column:
    """struct(cam_id, starttime, endtime) of a recording's name; all null where it has another form."""
    fits = name.rlike(VIDEO)
    cam = F.when(fits, F.regexp_extract(name, VIDEO, 1).try_cast("int"))
    # the end stamp's group lies behind the seven of the start stamp
    return F.struct(cam.alias("cam_id"), stamp(F.regexp_extract(name, VIDEO, 2)).alias("starttime"), stamp(F.regexp_extract(name, VIDEO, 10)).alias("endtime"))


def camera_id(name: Column, known: Column | None = None) -> Column:
    """The camera's number: one that is known already, else from the name's beginning."""
    found = F.regexp_extract(name, CAMERA, 1).try_cast("int")
    return found if known is None else F.coalesce(known, found)


def start_key(cam: Column, start: Column) -> Column:
    """``cam|yyyy-MM-ddTHH:mm:ss``, the fraction cut off; null if either part is."""
    return F.when(cam.isNotNull() & start.isNotNull(), F.concat(cam.cast("string"), F.lit("|"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss")))


def bucket_start(ts: Column, minutes: int = 20) -> Column:
    """Start of the bucket of ``minutes`` within the hour."""
    minute = (F.floor(F.minute(ts) / minutes) * minutes).cast("int")
    return ntz(F.date_trunc("hour", ts)) + F.make_dt_interval(mins=minute)


def bucket_path(ts: Column, minutes: int = 20) -> Column:
    """``YYYY/MM/DD/HH/MM`` of the bucket; the directory where a recording that starts at ``ts`` lives."""
    return F.date_format(bucket_start(ts, minutes), "yyyy/MM/dd/HH/mm")


def bucket_path_of_epoch(seconds: Column, minutes: int = 20) -> Column:
    """``bucket_path`` of a time in seconds since 1970 (UTC, fractions allowed), whatever the session's time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return bucket_path(start + F.make_dt_interval(secs=F.floor(seconds)), minutes)


def name_prefix(cam: Column, start: Column) -> Column:
    """What a recording's name begins with, to the second: the blank-free stamp ends the number, so cam 1 is not cam 11."""
    return F.concat(F.lit("Cam_"), cam.cast("string"), F.lit("_"), F.date_format(start, "yyyy-MM-dd'T'HH_mm_ss"))


def name_stamp(ts: Column) -> Column:
    """A time in a name; the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH_mm_ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", F.concat(whole, F.lit("Z"))).otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH_mm_ss.SSSSSS"), F.lit("Z")))


def build_name(cam: Column, start: Column, end: Column, ext: str = "bbb") -> Column:
    return F.concat(F.lit("Cam_"), cam.cast("string"), F.lit("_"), name_stamp(start), F.lit("--"), name_stamp(end), F.lit(f".{ext}"))


def expected_path(cam: Column, start: Column, end: Column, ext: str = "bbb") -> Column:
    """Where the output of a recording is expected."""
    return F.concat_ws("/", bucket_path(start), build_name(cam, start, end, ext))


def normalize_date(text: Column) -> Column:
    """Eight digits, without ``-`` and ``/``; null for anything else."""
    digits = F.regexp_replace(text, "[-/]", "")
    return F.when(digits.rlike(r"^\d{8}$"), digits)


def day_key(dirname: Column) -> Column:
    """The day of a directory named YYYYMMDD or YYYY-MM-DD, or null."""
    return F.when(dirname.rlike(r"^(\d{8}|\d{4}-\d{2}-\d{2})$"), F.replace(dirname, F.lit("-"), F.lit("")))


def day_of_path(path: Column) -> Column:
    """Day of a path whose first part is a day (see ``day_key``) or whose first three parts are YYYY, MM and DD; else null."""
    part = lambda i: F.get(F.split(path, "/"), F.lit(i))
    nested = part(0).rlike("^[0-9]{4}$") & part(1).rlike("^[0-9]{2}$") & part(2).rlike("^[0-9]{2}$")
    return F.coalesce(day_key(part(0)), F.when(nested, F.concat(part(0), part(1), part(2))))


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def frame_day(name: Column) -> Column:
    return F.nullif(F.substring(F.regexp_extract(name, FRAME, 1), 1, 8), F.lit(""))


def frame_time(name: Column) -> Column:
    """The time in a frame's name, or null where it has none or none that exists."""
    text = F.regexp_extract(name, FRAME, 1)
    shaped = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    return F.nullif(shaped, F.lit("")).try_cast("timestamp_ntz")


def time_bucket(ts: Column, window: str | int) -> Column:
    """Start of the hour, the day, or the ``window`` seconds counted from midnight."""
    if window in ("hour", "day"):
        return ntz(F.date_trunc(window, ts))
    if int(window) <= 0:
        raise ValueError("window is hour, day, or a positive number of seconds")
    midnight = ntz(F.date_trunc("day", ts))
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return midnight + F.make_dt_interval(secs=(F.floor(second / int(window)) * int(window)).cast("decimal(18,6)"))


def config_tag(interval: Column, window: Column, window_size: Column, images: Column) -> Column:
    """The directory of one background configuration."""
    n = F.coalesce(interval, F.lit(0)).cast("string")
    return F.when(F.coalesce(window, F.lit("")) != "", F.concat(F.lit("int"), n, F.lit("s_win"), window)).otherwise(
        F.concat(F.lit("count_w"), window_size.cast("string"), F.lit("_n"), images.cast("string"), F.lit("_int"), n, F.lit("s"))
    )


def prefix_route(name: Column, rules: list[tuple[str, str]], default: str = "default") -> Column:
    """The model of the first rule (prefix, model) that fits."""
    out = F.lit(default)
    for prefix, model in reversed(rules):
        out = F.when(name.startswith(prefix), model).otherwise(out)
    return out


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def recorder_time(name: Column, mtime: Column) -> Column:
    """The time behind the last ``_`` of a recorder's file, else its mtime, else the earliest time."""
    last = F.regexp_replace(F.substring_index(stem(name), "_", -1), r"^(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})$", "$1 $2:$3:$4")
    return F.coalesce(F.when(last.rlike(r"^\d{4}-\d{2}-\d{2} "), last.try_cast("timestamp_ntz")), mtime, F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def recorder_camera(name: Column) -> Column:
    """All before the first ``_``."""
    return F.substring_index(name, "_", 1)


def sidecar_name(name: Column, model: Column, contrast: Column) -> Column:
    """The detections file beside a recording."""
    middle = F.when(model == "polo", "-detections-polo").otherwise("-detections")
    return F.concat(stem(name), middle, F.when(contrast, "-c").otherwise("-nc"), F.lit(".parquet"))


def remap_path(path: Column, roots: list[tuple[str, str]]) -> Column:
    """Exchange the first fitting root (whole path components); other paths stay."""
    out = path
    for old, new in reversed(roots):
        old, new = old.rstrip("/"), new.rstrip("/")
        out = F.when(path == old, new).when(path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(out)
    return out
