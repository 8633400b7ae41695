"""Sets of tables that change together: written beside the old ones, audited, then published at once.

A base folder holds ``versions/<name>/<table>`` and ``manifest``, a small
Parquet table with a row per published version.  Readers take the folder
named by the newest row.  Publishing appends that row as one file, which
Spark's commit makes visible at once; until then, and for good if a build
or an audit fails, every table of the last version stays as it was.
Replaced versions are left to the lifetime rule of the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

MANIFEST = "version long, folder string, tables array<string>, published_at timestamp"


class AuditFailed(Exception):
    """A table of the new version breaks a rule."""


@dataclass
class Draft:
    """A version that is being written."""
    spark: SparkSession
    base: str
    folder: str = field(default_factory=lambda: f"versions/{uuid.uuid4().hex}")
    rows: dict[str, int] = field(default_factory=dict)

    def path(self, table: str) -> str:
        return f"{self.base.rstrip('/')}/{self.folder}/{table}"

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None,
              metrics: dict[str, Column] | None = None) -> dict:
        """Rows and further aggregates of the table, taken from the write."""
        seen = sinks.write_observed(df, self.path(table), partition_by=partition_by, metrics=metrics)
        self.rows[table] = int(seen.get("rows", 0))
        return seen

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def publish(self) -> int:
        """Make this version the current one; returns its number."""
        version = (newest(self.spark, self.base) or {"version": 0})["version"] + 1
        row = (self.spark.createDataFrame([(version, self.folder, sorted(self.rows))],
                                          "version long, folder string, tables array<string>")
               .withColumn("published_at", F.current_timestamp()).coalesce(1))
        row.write.mode("append").parquet(f"{self.base.rstrip('/')}/manifest")
        return version


def newest(spark: SparkSession, base: str):
    """The manifest row of the current version, or None.  Of two with one number the greater folder name counts."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{base.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("version"), F.desc("folder")).first()


def read_current(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A table of the current version."""
    row = newest(spark, base)
    if row is None or table not in row["tables"]:
        raise LookupError(f"{table} has not been published in {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/{row['folder']}/{table}")


def replace_together(spark: SparkSession, base: str, builds: dict[str, Callable[[], DataFrame]],
                     audit: Callable[[Draft], None] | None = None) -> dict[str, int]:
    """Build, write, audit and publish all tables, or leave the old ones; rows by table."""
    draft = Draft(spark, base)
    for name, build in builds.items():
        draft.write(name, build())
    if audit:
        audit(draft)
    draft.publish()
    return draft.rows
