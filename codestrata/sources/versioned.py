"""A folder of parquet files with immutable version manifests.

Layout: data/<name>/*.parquet, deletes/<name>/*.parquet (deletion vectors:
`file`, `row_index`), versions/<n>.json. A version file is written once, under
an exclusive name; whoever loses the race sees FileExistsError. Files that no
version names were left by a failed run and are ignored.

The folder is reached through the file system that all executors share. A
version's manifest is read on the driver; its size follows the number of
writes, not of rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    number: int
    files: dict[str, list[str]] = field(default_factory=dict)  # data folder -> folders of deletion vectors
    processed: dict[str, int] = field(default_factory=dict)  # source -> its version contained in this one


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        os.makedirs(f"{self.root}/versions", exist_ok=True)

    def numbers(self) -> list[int]:
        return sorted(int(x[:-5]) for x in os.listdir(f"{self.root}/versions") if x.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The given version, the last one by default; 0 is empty."""
        number = (self.numbers() or [0])[-1] if number is None else number
        if number == 0:
            return Version(0)
        with open(f"{self.root}/versions/{number:020d}.json") as f:
            return Version(**json.load(f))

    def _publish(self, v: Version) -> Version:
        name = f"{self.root}/versions/{v.number:020d}.json"
        part = f"{self.root}/versions/.{uuid.uuid4().hex}"
        with open(part, "w") as f:
            json.dump({"number": v.number, "files": v.files, "processed": v.processed}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(part, name)  # fails if another writer has taken this number
        finally:
            os.unlink(part)
        return v

    def append(self, rows: DataFrame, processed: dict[str, int] | None = None) -> Version:
        """Add rows; `processed` is saved in the same commit."""
        at, name = self.version(), f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return self._publish(Version(at.number + 1, at.files | {name: []}, at.processed | (processed or {})))

    def delete(self, condition) -> Version:
        """Mark the rows where `condition` holds as deleted, by deletion vectors."""
        at, files = self.version(), {}
        for name, marks in at.files.items():
            hit = self._file(name, marks).where(condition).select(F.col("_file").alias("file"), F.col("_row").alias("row_index"))
            mark = f"deletes/{uuid.uuid4().hex}"
            hit.write.parquet(f"{self.root}/{mark}")
            empty = self.spark.read.schema("file string, row_index long").parquet(f"{self.root}/{mark}").isEmpty()
            files[name] = marks if empty else [*marks, mark]
        return self._publish(Version(at.number + 1, files, at.processed))

    def replace(self, condition, rows: DataFrame) -> Version:
        """Delete and append in one commit."""
        at, files = self.version(), {}
        for name, marks in at.files.items():
            mark = f"deletes/{uuid.uuid4().hex}"
            self._file(name, marks).where(condition).select(F.col("_file").alias("file"), F.col("_row").alias("row_index")).write.parquet(f"{self.root}/{mark}")
            files[name] = [*marks, mark]
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return self._publish(Version(at.number + 1, files | {name: []}, at.processed))

    def _file(self, name: str, marks: list[str]) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}")
        df = df.withColumns({"_file": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "_row": F.col("_metadata.row_index")})
        if marks:
            gone = self._marks(marks)
            df = df.join(gone, (F.col("_file") == F.col("file")) & (F.col("_row") == F.col("row_index")), "left_anti")
        return df

    def _marks(self, marks: list[str]) -> DataFrame:
        return self.spark.read.schema("file string, row_index long").parquet(*[f"{self.root}/{m}" for m in marks])

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of a version; None for one without files."""
        v, out = self.version(number), None
        for name, marks in v.files.items():
            df = self._file(name, marks).drop("_file", "_row")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def changes(self, since: int, until: int | None = None) -> DataFrame | None:
        """Rows by which version `until` differs from `since`, with `_change`
        ('insert' or 'delete'). Only added files, removed files and new
        deletion vectors are read. None if the versions are equal."""
        a, b, parts = self.version(since), self.version(until), []
        for name in b.files.keys() - a.files.keys():
            parts.append(self._file(name, b.files[name]).withColumn("_change", F.lit("insert")))
        for name in a.files.keys() - b.files.keys():
            parts.append(self._file(name, a.files[name]).withColumn("_change", F.lit("delete")))
        for name in a.files.keys() & b.files.keys():
            if new := [m for m in b.files[name] if m not in a.files[name]]:
                live = self._file(name, a.files[name])
                gone = self._marks(new)
                parts.append(live.join(gone, (F.col("_file") == F.col("file")) & (F.col("_row") == F.col("row_index")), "left_semi").withColumn("_change", F.lit("delete")))
        out = None
        for p in parts:
            p = p.drop("_file", "_row")
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out


def process_new(source: VersionedTable, sink: VersionedTable, name: str, work: Callable[[DataFrame], DataFrame]) -> Version:
    """Run `work` over the rows by which `source` changed since the sink's last
    commit, and append its result together with the source version reached.

    Result and position are published by one rename, so a run that fails
    anywhere before leaves the sink as it was and the next one takes the same
    rows again; one that has published never takes them twice. Without changes
    nothing is committed, and the sink's version is returned as it is.
    """
    done, until = sink.version().processed.get(name, 0), source.version().number
    delta = source.changes(done, until) if until > done else None
    if delta is None:
        return sink.version()
    return sink.append(work(delta), {name: until})
