"""Tables as logs of changes: commits are appended, a version is the number of its last commit, and no file is ever changed in place."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConflictError(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


class ChangeLog:
    """A table of rows with a key, below a folder that all writers share.

    A commit writes its rows to a new folder, then one small log entry under the next version's name. The entry appears whole by a rename that
    fails where the name is taken, so of two writers from one version one wins and the other gets a ``ConflictError``; a crash before the rename leaves the
    table as it was. A snapshot is the newest row of each key up to a version. ``compact`` writes a snapshot as a commit of its own, from which
    later snapshots begin; earlier versions stay readable. The folder's file system must rename atomically, as HDFS does.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _entries(self, version: int | None = None) -> list[dict]:
        folder = self._path(f"{self.root}/log")
        if not self._fs.exists(folder):
            return []
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(folder))
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if numbers != list(range(len(numbers))):
            raise RuntimeError(f"the log of {self.root} has a gap")
        if version is not None:
            if not -1 <= version < len(numbers):
                raise ValueError(f"no version {version} of {self.root}")
            numbers = numbers[: version + 1]
        if not numbers:
            return []
        # From the last snapshot on; entries are small and read by the driver.
        out = []
        for n in reversed(numbers):
            stream = self._fs.open(self._path(self._name(n)))
            try:
                entry = json.loads(bytes(stream.readAllBytes()))
            finally:
                stream.close()
            out.append(entry)
            if entry["kind"] == "snapshot":
                break
        return out[::-1]

    def _name(self, version: int) -> str:
        return f"{self.root}/log/{version:012d}.json"

    def version(self) -> int:
        """The number of the last commit; -1 before the first."""
        entries = self._entries()
        return entries[-1]["version"] if entries else -1

    def commit(self, rows: DataFrame, read: int, kind: str = "upsert") -> int:
        """Commit a change made from version ``read``; the new version.

        ``upsert`` sets rows whole, ``delete`` takes keys out (other columns are ignored), ``snapshot`` is the whole table from now on, ``append`` adds
        rows to a table that is read by ``contents``. Of rows of one commit that share a key, the one that comes first by hash counts.
        """
        if kind not in ("upsert", "delete", "snapshot", "append"):
            raise ValueError(f"unknown kind of change {kind}")
        rows = rows.select(*self.keys) if kind == "delete" else rows
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self._append({"version": read + 1, "kind": kind, "folder": folder, "schema": rows.schema.json()})

    def _append(self, entry: dict) -> int:
        jvm, target = self.spark._jvm, self._path(self._name(entry["version"]))
        if entry["version"] and not self._fs.exists(self._path(self._name(entry["version"] - 1))):
            raise ValueError(f"no version {entry['version'] - 1} of {self.root}")
        self._fs.mkdirs(target.getParent())
        draft = self._path(f"{self.root}/log/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            context.rename(draft, target, options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(target):
                raise ConflictError(f"version {entry['version']} of {self.root} was committed by another writer") from e
            raise
        return entry["version"]

    def _changes(self, version: int | None) -> DataFrame:
        """The rows of all commits since the last snapshot, with __version and whether they are deletions (__gone)."""
        entries = self._entries(version)
        if not entries:
            raise ValueError(f"{self.root} has no version yet")
        every = None
        for e in entries:
            part = self.spark.read.schema(StructType.fromJson(json.loads(e["schema"]))).parquet(f"{self.root}/{e['folder']}")
            part = part.withColumns({"__version": F.lit(e["version"]), "__gone": F.lit(e["kind"] == "delete")})
            every = part if every is None else every.unionByName(part, allowMissingColumns=True)
        return every

    def contents(self, version: int | None = None) -> DataFrame:
        """All rows of the last snapshot and of the commits after it, for tables that are written whole or appended to."""
        return self._changes(version).drop("__version", "__gone")

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest by default): of each key the newest row, unless that is a deletion."""
        every = self._changes(version)
        columns = [c for c in every.columns if c not in (*self.keys, "__version", "__gone")]
        order = F.struct("__version", (-F.xxhash64(*columns).cast("decimal(20,0)")).alias("h")) if columns else F.col("__version")
        rows = every.groupBy(*self.keys).agg(F.max_by(F.struct("__gone", *columns), order).alias("__row")).filter("not __row.__gone")
        return rows.select(*self.keys, *[F.col(f"__row.{c}").alias(c) for c in columns])

    def update(self, change, tries: int = 3) -> int:
        """Commit the rows that ``change(snapshot)`` gives; when another writer was faster, again from the newer snapshot, up to ``tries`` times."""
        for k in range(tries):
            read = self.version()
            try:
                return self.commit(change(self.snapshot(read)), read)
            except ConflictError:
                if k == tries - 1:
                    raise

    def compact(self) -> int:
        """One snapshot in place of all changes so far, as a new version of the same content."""
        read = self.version()
        return self.commit(self.snapshot(read), read, "snapshot")
