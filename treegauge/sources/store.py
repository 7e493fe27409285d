"""A folder with the tables of many scans: projects, scans, and what hangs on a scan."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from treegauge.sources.tables import drop_scans, file_system, read_scan_table, remove, write_scan_table

# Tables partitioned by scan_id.
FACTS = ("metrics", "matches", "errors", "summaries")


@dataclass(frozen=True)
class ScanStore:
    """Fact tables partitioned by scan, and the small tables `projects` and `scans`, which are replaced as a whole."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write_facts(self, tables: dict[str, DataFrame], scans: Iterable[int]) -> None:
        """Rows of these scans in the tables given; a scan written again is replaced, also where it has no rows any more."""
        scans = list(scans)
        for table, rows in tables.items():
            if table not in FACTS:
                raise ValueError(f"{table} is none of {FACTS}")
            write_scan_table(rows, self.path(table), scans=scans)

    def read_facts(self, table: str, scan_id: int | None = None, schema: StructType | None = None) -> DataFrame:
        return read_scan_table(self.spark, self.path(table), scan_id, schema)

    def replace(self, table: str, rows: DataFrame) -> None:
        """Another content for `projects` or `scans`; the old one stays until the new one is complete."""
        new = f"{self.path(table)}-new-{uuid.uuid4().hex}"
        rows.write.parquet(new)
        self._move(table, new)

    def read(self, table: str) -> DataFrame:
        """`projects` or `scans`; a replacement that was complete but not in place yet is put there first."""
        fs, path = file_system(self.spark, self.path(table))
        if not fs.exists(path):
            _, pattern = file_system(self.spark, f"{self.path(table)}-new-*/_SUCCESS")
            for done in fs.globStatus(pattern) or ():
                fs.rename(done.getPath().getParent(), path)
                break
        return self.spark.read.parquet(self.path(table))

    def _move(self, table: str, new: str) -> None:
        remove(self.spark, self.path(table))
        fs, old = file_system(self.spark, self.path(table))
        fs.rename(file_system(self.spark, new)[1], old)

    def purge(self, name: str) -> None:
        """Everything of one project goes: the stored partitions of its scans, their records, and the project's own.

        The ids that are to go are written down first and forgotten last, so a purge that has failed is finished by calling it
        again. No row of a fact table is read.
        """
        note = f"{self.root}/_purge-{hashlib.md5(name.encode()).hexdigest()}"
        fs, done = file_system(self.spark, f"{note}/_SUCCESS")
        if not fs.exists(done):
            gone = self.read("projects").where(F.col("name") == name).select("project_id")
            ids = self.read("scans").join(gone, "project_id").select("project_id", "scan_id")
            ids.unionByName(gone.withColumn("scan_id", F.lit(None).cast("long")), allowMissingColumns=True).write.mode("overwrite").parquet(note)
        doomed = self.spark.read.parquet(note)
        for row in doomed.where("scan_id IS NOT NULL").select("scan_id").distinct().toLocalIterator():
            for table in FACTS:
                drop_scans(self.spark, self.path(table), [row["scan_id"]])
        for table in ("scans", "projects"):
            self.replace(table, self.read(table).join(F.broadcast(doomed.select("project_id").distinct()), "project_id", "left_anti"))
        remove(self.spark, note)
