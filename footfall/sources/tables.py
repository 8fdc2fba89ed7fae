"""Reading input tables and replacing derived ones."""

from __future__ import annotations

import tempfile
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from footfall.sources import schemas

#: Folders of versions, the file that says one is complete, and the one that a writer holds.
VERSION = "version-"
MARK = "_COMPLETE"
CLAIM = "_WRITER"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; only a local session may leave the setting out."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="footfall-")
    return f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"


class TableBusy(RuntimeError):
    """Another writer is replacing the table."""


@dataclass(frozen=True)
class TableStore:
    """Tables in a folder every executor can reach, or in a catalog database.

    Exactly one of ``root`` and ``database`` is given. Input tables and derived
    tables may live in different stores. With ``buckets``, the derived tables of a database are clustered by the key that the jobs group and
    join them by: readers then shuffle none of them by that key.
    """

    spark: SparkSession
    root: str | None = None
    database: str | None = None
    format: str = "parquet"
    buckets: int | None = None

    def __post_init__(self) -> None:
        if (self.root is None) == (self.database is None):
            raise ValueError("give either a root folder or a database")
        if self.buckets is not None and self.database is None:
            raise ValueError("buckets are kept in a catalog: give a database")

    def read(self, name: str) -> DataFrame:
        """A table in its declared columns; an unlisted table as it is."""
        if self.root is not None:
            versions = self._complete(name)
            folder = f"{self.root}/{name}/{versions[-1]}" if versions else f"{self.root}/{name}"
            df = self.spark.read.format(self.format).load(folder)
        else:
            df = self.spark.table(f"{self.database}.{name}")
        return schemas.check_schema(df, name) if name in {**schemas.INPUTS, **schemas.TABLES} else df

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write a derived table in full, in place of any earlier one, and return it as stored.

        The new version is written beside the old one, and readers are switched to it only when it is complete: a failed
        write leaves the table as it was. The version before stays, for those who still read it; older ones are removed after the switch.
        Reading it back ends the lineage: whatever is built on the table does not
        repeat the work behind it when an executor is lost.

        One writer at a time: a second one gets ``TableBusy`` before it writes anything. ``release`` frees a table whose writer died.
        """
        checked = schemas.check_schema(df, name)
        self._claim(name)
        try:
            if self.root is not None:
                self._replace_folder(name, checked)
            elif self._is_plain(name):
                self._replace_location(name, checked)
            else:
                self._replace_view(name, checked)
        finally:
            self.release(name)
        return self.read(name)

    # --- one writer: a file or a table that only one can create

    def _claim(self, name: str) -> None:
        try:
            if self.root is not None:
                files, mark = self._files(f"{self.root}/{name}/{CLAIM}")
                files.create(mark, False).close()
            else:
                self.spark.sql(f"create table {self.database}.{name}{CLAIM} (claimed int) using {self.format}")
        except Exception as error:
            taken = "already exists" in str(error) or "ALREADY_EXISTS" in str(error)
            raise TableBusy(f"{name} is being replaced by another writer, or release() it") from error if taken else error

    def release(self, name: str) -> None:
        """Give up the claim of a writer on a table: its own, or that of one that died."""
        if self.root is not None:
            files, mark = self._files(f"{self.root}/{name}/{CLAIM}")
            files.delete(mark, False)
        else:
            self.spark.sql(f"drop table if exists {self.database}.{name}{CLAIM}")

    # --- folders: a version counts once it has its mark, a single file made after all others

    def _files(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _versions(self, name: str) -> list[str]:
        files, folder = self._files(f"{self.root}/{name}")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(n for n in names if n.startswith(VERSION))

    def _complete(self, name: str) -> list[str]:
        def marked(version: str) -> bool:
            files, mark = self._files(f"{self.root}/{name}/{version}/{MARK}")
            return files.exists(mark)

        return [v for v in self._versions(name) if marked(v)]

    def _replace_folder(self, name: str, df: DataFrame) -> None:
        before = self._versions(name)
        number = int(before[-1].split("-")[1]) + 1 if before else 1
        version = f"{VERSION}{number:09d}-{uuid.uuid4().hex[:8]}"
        df.write.format(self.format).save(f"{self.root}/{name}/{version}")
        files, mark = self._files(f"{self.root}/{name}/{version}/{MARK}")
        files.create(mark, False).close()
        oldest = self._complete(name)[-2:][0]
        for old in self._versions(name):
            if old < oldest:
                files, folder = self._files(f"{self.root}/{name}/{old}")
                files.delete(folder, True)

    # --- catalog: a view names the current version

    def _version(self, name: str, df: DataFrame, **options: str) -> str:
        """Store a new version as a table of its own, clustered if the store has buckets."""
        version = f"{name}__{VERSION.rstrip('-')}{time.time_ns():020d}"
        key = schemas.CLUSTER_KEYS.get(name) if self.buckets else None
        # One file for each bucket: a task writes the buckets that it holds.
        writer = (df.repartition(self.buckets, key) if key else df).write.format(self.format).options(**options)
        (writer.bucketBy(self.buckets, key).sortBy(key) if key else writer).saveAsTable(f"{self.database}.{version}")
        return version

    def _replace_view(self, name: str, df: DataFrame) -> None:
        version = self._version(name, df)
        self.spark.sql(f"create or replace view {self.database}.{name} as select * from {self.database}.{version}")
        kept = sorted(t.name for t in self.spark.catalog.listTables(self.database) if t.name.startswith(f"{name}__{VERSION.rstrip('-')}"))
        for old in kept[: kept.index(version)][:-1]:
            self.spark.sql(f"drop table if exists {self.database}.{old}")

    # --- catalog: a plain table that others made; its location is switched, which readers see at once or not at all

    def _is_plain(self, name: str) -> bool:
        full = f"{self.database}.{name}"
        return self.spark.catalog.tableExists(full) and self.spark.catalog.getTable(full).tableType != "VIEW"

    def _replace_location(self, name: str, df: DataFrame) -> None:
        """Staged replace of a plain table: a complete folder is written, then becomes its location in one catalog operation.

        The table keeps its name, columns and layout, so there is no moment without it. A table of other columns, partitions or format is refused
        before anything is written.
        """
        full = f"{self.database}.{name}"
        fields = [(f.name.lower(), f.dataType) for f in self.spark.table(full).schema.fields]
        facts = {r[0]: r[1] for r in self.spark.sql(f"describe table extended {full}").collect()}
        told = facts.get("# Partition Information") is None and facts.get("Num Buckets") is None and (facts.get("Provider") or "").lower() == self.format
        if fields != [(f.name.lower(), f.dataType) for f in df.schema.fields] or not told:
            raise ValueError(f"{full} has other columns, format or layout than the declared table; drop or rename it first")
        before, place = facts["Location"], f"{name}__{VERSION.rstrip('-')}{time.time_ns():020d}"
        home = self.spark.sql(f"describe database {self.database}").where("info_name = 'Location'").first()[1].rstrip("/")
        df.write.format(self.format).save(f"{home}/{place}")
        self.spark.sql(f"alter table {full} set location '{home}/{place}'")
        self.spark.catalog.refreshTable(full)
        files, folder = self._files(home)
        mine = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().startswith(f"{name}__{VERSION.rstrip('-')}"))
        for old in mine[: mine.index(place)][:-1]:
            if not before.rstrip("/").endswith(old):
                files, folder = self._files(f"{home}/{old}")
                files.delete(folder, True)
