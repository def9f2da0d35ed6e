"""Tables whose readers see one version, whatever is being written or has died half-way.

A versioned folder holds one or more tables, parted by the same key columns (a day, a snapshot, a run). A commit writes new rows
for some keys beside all others, then a new manifest that names for every key the folder with its rows, and last one small marker
file, created only if no other writer has that number. Readers take the newest marker that is whole and read just the folders that
its manifest names: rows of a commit that never got its marker are in no manifest. A key that is replaced by nothing keeps a line
without a folder in the manifest, its tombstone.

    commits/0000000003            marker: stamp, key columns, schemas
    manifest/0000000003-<id>      (table, keys, _key, stamp or null, n_rows)
    data/<table>/<stamp>/_key=<digest of the keys>/
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackledger.sources.shared import names_in, put_new, remove, text_of


def _key(by: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in by])))


class Versioned:
    """The versioned folder at ``path``. One writer at a time commits; a second one that began from the same version fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---------------------------------------------------------------- what is there
    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.path}/commits") if n.isdigit())

    def marker(self, version: int) -> dict | None:
        """A version's marker, or None if it isn't there or was never finished."""
        try:
            found = json.loads(text_of(self.spark, f"{self.path}/commits/{version:010d}"))
            return found if found.get("whole") else None
        except (ValueError, OSError):
            return None
        except Exception as e:  # Hadoop's own kind of missing file
            if "FileNotFound" in str(e):
                return None
            raise

    def current(self) -> int:
        """The newest whole version; 0 where nothing has been committed."""
        return next((n for n in reversed(self._numbers()) if self.marker(n)), 0)

    def described(self, version: int | None = None) -> dict:
        """The marker of a version (the newest); an error where there is none."""
        found = self.marker(self.current() if version is None else version)
        if found is None:
            raise FileNotFoundError(f"no such version in {self.path}")
        return found

    def manifest(self, version: int | None = None) -> DataFrame:
        """(table, keys, _key, stamp, n_rows): a line for every key of every table; without stamp where the key has no rows."""
        m = self.described(version)
        return self.spark.read.schema(StructType.fromJson(m["manifest_schema"])).parquet(f"{self.path}/manifest/{m['stamp']}")

    def read(self, table: str, where: Column | str | None = None, version: int | None = None) -> DataFrame:
        """Rows of a table; ``where`` is a condition on the key columns, by which folders are chosen before anything is read."""
        m = self.described(version)
        if table not in m["schemas"]:
            raise KeyError(table)
        lines = self.manifest(m["version"]).where((F.col("table") == table) & F.col("stamp").isNotNull())
        if where is not None:
            lines = lines.where(where)
        return self._rows(m, table, [(r["stamp"], r["_key"]) for r in lines.select("stamp", "_key").collect()])  # a name for each key

    def _rows(self, m: dict, table: str, folders: list[tuple[str, str]]) -> DataFrame:
        schema = StructType.fromJson(m["schemas"][table])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{table}/{stamp}/_key={key}" for stamp, key in sorted(folders)])

    def changes(self, table: str, identity: list[str], since: int, until: int) -> DataFrame:
        """Rows that differ between two versions (0: before all), with ``change``: added, removed or changed. Folders that both share aren't read."""
        new = self.described(until)
        line = lambda v, name: self.manifest(v).where((F.col("table") == table) & F.col("stamp").isNotNull()).select("_key", F.col("stamp").alias(name))
        if since:
            both = line(since, "old").join(line(until, "new"), "_key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
        else:
            both = line(until, "new").withColumn("old", F.lit(None).cast("string"))
        pairs = both.select("_key", "old", "new").collect()  # a name for each changed key
        columns = [f.name for f in StructType.fromJson(new["schemas"][table])]
        sides = [self._rows(m, table, [(r[side], r["_key"]) for r in pairs if r[side]]) for m, side in ((self.described(since) if since else new, "old"), (new, "new"))]
        before, after = (df.select(*[F.col(c).alias(f"{c}") for c in columns], F.lit(True).alias("_there")) for df in sides)
        joined = before.alias("a").join(after.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in identity], "full_outer")
        differs = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
        change = F.when(F.col("a._there").isNull(), "added").when(F.col("b._there").isNull(), "removed").when(differs, "changed")
        return joined.select(change.alias("change"), *[F.when(F.col("b._there"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns]).where("change is not null")

    # ---------------------------------------------------------------- writing
    def commit(self, tables: dict[str, DataFrame], by: list[str], replaced: DataFrame | None = None, since: int | None = None, key: tuple[str, ...] | None = None) -> int:
        """Replace some keys' rows in all ``tables``; returns the new version.

        The keys are those of ``replaced`` (columns ``by``) and those that rows have. A key without rows in a table reads as empty there.
        With ``key`` all rows are of that one key, whose columns are put to them here: tasks write them as they come, with no
        shuffle and no sort. (Columns of one value compress to nothing, so a shuffle would look small and go to one task, whatever it sorts.)
        ``since`` is the version that the rows were made from: if another has been committed meanwhile, that is an error.
        """
        base = self.current()
        if since is not None and since != base:
            raise RuntimeError(f"{self.path} has version {base} by now, not {since}")
        before = self.marker(base) if base else None
        if before and before["by"] != by:
            raise ValueError(f"the tables of {self.path} are parted by {before['by']}")
        number = max([base, *self._numbers()]) + 1  # a marker that was begun and never finished keeps its number
        stamp = f"{number:010d}-{uuid.uuid4().hex}"
        schemas, lines = dict(before["schemas"]) if before else {}, []
        for name, rows in tables.items():
            rows = rows if key is None else rows.withColumns(dict(zip(by, map(F.lit, key), strict=True)))
            schemas[name] = json.loads(rows.schema.json())
            to = f"{self.path}/data/{name}/{stamp}"
            if key is not None:
                one = self._one(by, key)
                folder = f"{to}/_key={one.first()['_key']}"
                rows.write.parquet(folder)
                n_rows = self.spark.read.schema(rows.schema).parquet(folder).count()
                lines.append(one.select(F.lit(name).alias("table"), *by, "_key", F.lit(stamp).alias("stamp"), F.lit(n_rows).cast("long").alias("n_rows")).where("n_rows > 0"))
                continue
            rows.withColumn("_key", _key(by)).hint("rebalance", "_key").write.partitionBy("_key").parquet(to)
            keyed = StructType.fromJson(schemas[name]).add("_key", "string")
            there = self.spark.read.schema(keyed).parquet(to)
            lines.append(there.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), *by, "_key", F.lit(stamp).alias("stamp"), "n_rows"))
        wanted = [x.select(*by, "_key") for x in lines] + ([self._one(by, key)] if key is not None else []) + ([replaced.select(*by).distinct().withColumn("_key", _key(by))] if replaced is not None else [])
        keys = reduce(DataFrame.unionByName, wanted).dropDuplicates(["_key"])
        named = F.explode(F.array(*map(F.lit, tables)))
        new = reduce(DataFrame.unionByName, lines).select("table", "_key", "stamp", "n_rows")
        manifest = keys.withColumn("table", named).join(new, ["table", "_key"], "left").select("table", *by, "_key", "stamp", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        if before:
            old = self.manifest(base)
            manifest = manifest.unionByName(old.join(keys.select("_key", named.alias("table")), ["_key", "table"], "left_anti").select(*manifest.columns))
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest/{stamp}")
        said = {"version": number, "stamp": stamp, "by": by, "schemas": schemas, "manifest_schema": json.loads(manifest.schema.json()), "whole": True}
        put_new(self.spark, f"{self.path}/commits/{number:010d}", json.dumps(said))
        return number

    def _one(self, by: list[str], key: tuple[str, ...]) -> DataFrame:
        return self.spark.createDataFrame([key], ", ".join(f"`{c}` string" for c in by)).withColumn("_key", _key(by))

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the newest ``keep`` versions reads: older versions, and what commits left that died. Not while one is being made."""
        whole = [n for n in self._numbers() if self.marker(n)]
        kept = whole[-keep:]
        if not kept:
            return
        used = {(r["table"], r["stamp"]) for n in kept for r in self.manifest(n).where("stamp is not null").select("table", "stamp").distinct().collect()}  # a name for each commit
        for n in whole[:-keep]:
            remove(self.spark, f"{self.path}/commits/{n:010d}")
        stamps = {self.marker(n)["stamp"] for n in kept}
        for name in names_in(self.spark, f"{self.path}/manifest"):
            if name not in stamps:
                remove(self.spark, f"{self.path}/manifest/{name}")
        for table in names_in(self.spark, f"{self.path}/data"):
            for stamp in names_in(self.spark, f"{self.path}/data/{table}"):
                if (table, stamp) not in used:
                    remove(self.spark, f"{self.path}/data/{table}/{stamp}")
