"""Transfer jobs: a named reader, steps between, a named writer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.pipeline import Pipeline
from . import files

#: Readers take the session and their options, writers the rows and theirs.
READERS: dict[str, Callable[..., DataFrame]] = {
    "manifest": files.manifest, "text": files.texts, "binary": files.binaries, "nfs": files.binaries, "s3": files.binaries, "glusterfs": files.binaries, "jdbc": files.jdbc,
    "questions": files.questions, "parquet": lambda spark, path: spark.read.parquet(path),
}
WRITERS: dict[str, Callable[..., object]] = {
    "csv": files.write_csv, "jsonl": files.write_lines, "files": lambda df, **o: files.export_files(df, **o).count(), "nfs": lambda df, **o: files.export_files(df, **o).count(),
    "s3": lambda df, **o: files.export_files(df, **o).count(), "glusterfs": lambda df, **o: files.export_files(df, **o).count(), "parquet": lambda df, path: df.write.mode("overwrite").parquet(path),
}


@dataclass(frozen=True)
class Job:
    """reader and writer: (name, options); steps: a chain of operators."""

    reader: tuple[str, dict]
    writer: tuple[str, dict]
    steps: list[tuple[str, dict]] = field(default_factory=list)

    @classmethod
    def parse(cls, spec: str) -> Job:
        """A job from JSON: {"reader": {"name", "options"}, "writer": {...}, "steps": [[name, options]]}; what is unknown raises."""
        s = json.loads(spec)
        ends = [(s[k]["name"], s[k].get("options", {})) for k in ("reader", "writer")]
        for (name, _), known in zip(ends, (READERS, WRITERS)):
            if name not in known:
                raise ValueError(f"unknown connector {name!r}")
        return cls(*ends, [(n, dict(o)) for n, o in s.get("steps", [])])

    def run(self, spark: SparkSession) -> None:
        rows = READERS[self.reader[0]](spark, **self.reader[1])
        rows = Pipeline(self.steps).transform(rows) if self.steps else rows
        WRITERS[self.writer[0]](rows, **self.writer[1])
