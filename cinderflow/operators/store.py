"""Tables on Parquet in buckets with a log of commits: upsert, key-value metadata, cache with time to live."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "batch_seq") -> DataFrame:
    """Existing rows and new ones; of one key the new row with the greatest `order` wins, and of equal ones the greatest in the
    order of its values, so that the result depends on the rows alone. Columns must be of ordered types."""
    columns = existing.columns
    both = existing.withColumn("__o", F.lit(-1).cast("long")).unionByName(new.select(*columns, F.col(order).cast("long").alias("__o")))
    picked = both.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct("__o", *columns)).alias("row"))
    return picked.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    """Tables below one folder, each in `buckets` parts by a hash of its key, and a log of commits.

    A commit upserts into any number of tables at once. It writes new files for the buckets that its rows fall into, leaves all others as they
    are, and then adds one file to the log, which names the new files: before that file is whole readers see the old state of all
    tables, after it the new one. Log files are numbered and never overwritten, so of two writers that began from one state the second gets
    `Conflict` and can begin again. What a writer that stopped has left behind is in no log, and `vacuum` deletes it.

    The log has a line for each bucket that was ever rewritten; a reader takes the newest of each. `compact` writes them as one file.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _log(self) -> list[tuple[int, dict]]:
        """(number, content) of the log files, from the last that stands for all before it; one that was cut off counts for nothing."""
        log = self._path(f"{self.folder}/log")
        if not self._fs.exists(log):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json"))
        found: list[tuple[int, dict]] = []
        for name in reversed(names):
            stream = self._fs.open(self._path(f"{self.folder}/log/{name}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                content = json.loads(text)
            except ValueError:
                content = {"tables": {}}
            found.append((int(name[:20]), content))
            if content.get("whole"):
                break
        return found[::-1]

    def state(self) -> tuple[int, dict[str, dict[int, str]]]:
        """The last number of the log, and for each table the folder of each of its buckets."""
        number, tables = 0, {}
        for number, content in self._log():
            for name, parts in content["tables"].items():
                tables.setdefault(name, {}).update({int(k): v for k, v in parts.items()})
        return number, tables

    def has(self, table: str) -> bool:
        return table in self.state()[1]

    def read(self, table: str) -> DataFrame:
        """The rows of a table."""
        parts = self.state()[1].get(table)
        if not parts:
            raise LookupError(f"no table {table}")
        return self._rows(sorted(set(parts.values())))

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{f}" for f in folders))

    def commit(self, key: dict[str, str], upserts: dict[str, DataFrame] | None = None, wholes: dict[str, DataFrame] | None = None, order: str = "batch_seq") -> int:
        """Upserts rows (`upserted`, by key[table] and `order`) and replaces whole tables, all at once; the commit's number."""
        number, tables = self.state()
        changed: dict[str, dict[int, str]] = {}
        for name, rows in (wholes or {}).items():
            changed[name] = self._write(name, rows, key[name], range(self.buckets))
        for name, rows in (upserts or {}).items():
            marked = rows.withColumn("__bucket", self._bucket(key[name]))
            touched = sorted(r[0] for r in marked.select("__bucket").distinct().collect())  # at most `buckets` numbers
            kept = tables.get(name, {})
            if not touched and name in tables:
                continue
            old = [kept[b] for b in touched if b in kept]
            before = self._rows(old) if old else rows.drop(order).limit(0)
            # a table's first commit writes all buckets, so that its columns are known whatever is touched later
            changed[name] = self._write(name, upserted(before, rows, key[name], order), key[name], touched if name in tables else range(self.buckets))
        return self._publish(number + 1, {"tables": changed})

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, key: str, touched: Iterable[int]) -> dict[int, str]:
        folder = f"{table}/{uuid.uuid4().hex}"
        marked = rows.withColumn("__bucket", self._bucket(key)).hint("rebalance", "__bucket")  # a large bucket is written by several tasks
        marked.write.partitionBy("__bucket").parquet(f"{self.folder}/{folder}")
        rows.limit(0).write.parquet(f"{self.folder}/{folder}/none")  # what a bucket without rows reads as
        full = {s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{folder}"))}
        return {b: f"{folder}/__bucket={b}" if f"__bucket={b}" in full else f"{folder}/none" for b in touched}

    def _publish(self, number: int, content: dict) -> int:
        path = self._path(f"{self.folder}/log/{number:020d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as problem:
            if "exist" in str(problem):
                raise Conflict(f"commit {number} was made by another writer") from problem
            raise
        try:
            stream.write(bytearray(json.dumps(content), "utf-8"))
        finally:
            stream.close()
        return number

    def compact(self) -> int:
        """One log file that stands for all before it."""
        number, tables = self.state()
        return self._publish(number + 1, {"tables": tables, "whole": True})

    def vacuum(self) -> list[str]:
        """Deletes the files that no bucket of the present state has; not for use beside a writer or a reader of an older state. What went."""
        _, tables = self.state()
        live = {v for parts in tables.values() for v in parts.values()}
        gone = []
        for name in tables:
            for version in self._fs.listStatus(self._path(f"{self.folder}/{name}")):
                for part in self._fs.listStatus(version.getPath()) if version.isDirectory() else []:
                    inside = f"{name}/{version.getPath().getName()}/{part.getPath().getName()}"
                    if part.isDirectory() and inside not in live:
                        self._fs.delete(part.getPath(), True)
                        gone.append(inside)
        return sorted(gone)


def emptied(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def latest_values(entries: DataFrame) -> DataFrame:
    """key, value: of each key the entry set last (seq)."""
    return entries.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def cache_key(namespace: Column | str, *parts: Column, length: int = 32) -> Column:
    """Prefix of SHA-256 over the parts; numbers take four decimals first."""
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.substring(F.sha2(F.concat_ws("_", space, *parts), 256), 1, length)


def fresh(entries: DataFrame, now: Column, allow_stale: bool = False) -> DataFrame:
    """The newest entry of each key, if its age is within its ttl (seconds) or stale ones are allowed; corrupt ones (null payload) never."""
    good = entries.where("payload is not null")
    newest = good.groupBy("namespace", "key").agg(F.max_by(F.struct("payload", "created_at", "ttl"), "created_at").alias("e")).select("namespace", "key", "e.*")
    age = F.unix_timestamp(now) - F.unix_timestamp("created_at")
    marked = newest.withColumn("is_fresh", age <= F.col("ttl"))
    return marked if allow_stale else marked.where("is_fresh")
