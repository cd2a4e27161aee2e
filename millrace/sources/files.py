"""Readers and writers: manifests, texts, binaries, tables, and new files of a folder."""

from __future__ import annotations

import base64
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import unique_names

MANIFEST = "fileId string, fileName string, filePath string, fileType string, fileSize long, metadata string"


def manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """One JSON object a line, with the columns that loading adds."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST")
    same = {f"sourceFile{n}": F.col(f"file{n}") for n in ("Id", "Name", "Type", "Size")}
    return df.withColumns(same | {"totalPageNum": F.lit(0), "extraFilePath": F.lit(""), "extraFileType": F.lit("")})


def inline_manifest(spark: SparkSession, blob: str, schema: str = MANIFEST) -> DataFrame:
    """A manifest given as base64 of its lines."""
    lines = [(x,) for x in base64.b64decode(blob).decode().splitlines() if x.strip()]
    return spark.createDataFrame(lines, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, size, text without byte-order mark and with LF line ends."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^\\x{FEFF}", ""), "\r\n?", "\n")
    return raw.select(F.col("path").alias("filePath"), F.col("length").alias("fileSize"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("fileType"), text.alias("text"))


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as bytes, from a mounted folder, S3 (s3a://), GlusterFS or NFS mounts alike."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def new_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Files below a folder, but dot files, that the catalogue (filePath) doesn't have."""
    found = binaries(spark, path).select(F.col("path").alias("filePath"), F.col("length").alias("fileSize"), F.element_at(F.split("path", "/"), -1).alias("fileName"))
    return found.filter(~F.col("fileName").startswith(".")).withColumn("fileId", F.md5("filePath")).join(known.select("filePath"), "filePath", "left_anti")


#: JDBC drivers by the kind of database.
DRIVERS = {"mysql": "com.mysql.cj.jdbc.Driver", "starrocks": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver", "opengauss": "org.opengauss.Driver", "edb": "com.edb.Driver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "db2": "com.ibm.db2.jcc.DB2Driver", "sybase": "com.sybase.jdbc4.jdbc.SybDriver", "dm": "dm.jdbc.driver.DmDriver"}


def jdbc(spark: SparkSession, kind: str, url: str, table: str, user: str = "", password: str = "", column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    """A table through JDBC; with a numeric column and bounds it is read in partitions."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, driver=DRIVERS[kind], user=user, password=password)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def questions(spark: SparkSession, path: str, chain: bool = False) -> DataFrame:
    """Instruction records, one JSON a line: lines without the needed keys go, malformed JSON stops the read."""
    fields = ("question", "instruction", "output", "chain_of_thought") if chain else ("instruction", "input", "output")
    need = ("question", "instruction", "output") if chain else ("instruction", "output")
    df = spark.read.schema(", ".join(f"{f} string" for f in fields)).json(path, mode="FAILFAST")
    return df.filter(" AND ".join(f"{n} IS NOT NULL" for n in need))


def question_document(spark: SparkSession, path: str, chain: bool = False) -> DataFrame:
    """Instruction records of whole JSON documents (an array or one object each), checked as a whole: a record without the needed keys stops the read."""
    fields = ("question", "instruction", "output", "chain_of_thought") if chain else ("instruction", "input", "output")
    need = ("question", "instruction", "output") if chain else ("instruction", "output")
    df = spark.read.schema(", ".join(f"{f} string" for f in fields)).json(path, mode="FAILFAST", multiLine=True)
    whole = F.lit(True)
    for n in need:
        whole = whole & F.col(n).isNotNull()
    checked = F.when(whole, F.col(need[0])).otherwise(F.raise_error(F.concat(F.lit(f"a record lacks one of {', '.join(need)}: "), F.to_json(F.struct(*fields)))))
    return df.withColumn(need[0], checked)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row; nothing for no rows."""
    if not df.isEmpty():
        df.write.mode("overwrite").json(path)


def export_files(df: DataFrame, folder: str, name: str = "fileName", value: str = "text", kind: str | None = None) -> DataFrame:
    """Write every row's text (or bytes) to a file of its own in a folder and return name, path and size of each.

    The folder is any that pyarrow can open: a mounted one (NFS, GlusterFS), s3:// or hdfs://. kind: the files' new
    extension. Equal names become stem_1.ext, stem_2.ext and so on. A task that is run again writes the same files.
    """
    ends = F.regexp_replace(F.col(name), r"(?s)^(.+?)(?:\.[^.]*)?$", f"$1.{kind}") if kind else F.col(name)
    rows = df.select(ends.alias("name"), F.col(value).alias("value"), F.sha2(F.col(value).cast("binary"), 256).alias("by"), F.lit("").alias("folder"))
    rows = unique_names(rows, "folder", "name", "by").select("name", F.col("value").cast("binary").alias("value"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        for frame in frames:
            for n, v in zip(frame["name"], frame["value"]):
                with files.open_output_stream(f"{base}/{n}") as f:
                    f.write(v or b"")
            yield pd.DataFrame({"name": frame["name"], "path": [f"{folder.rstrip('/')}/{n}" for n in frame["name"]], "size": [len(v or b"") for v in frame["value"]]})

    return rows.mapInPandas(write, "name string, path string, size long")


def unpack(archive: str, to: str) -> list[str]:
    """Unpack a zip or tar.gz on the driver; members that would leave the folder are refused."""
    base = Path(to).resolve()
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            names = z.namelist()
            if any(not (base / n).resolve().is_relative_to(base) for n in names):
                raise ValueError("a member lies outside the folder")
            z.extractall(base)
    else:
        with tarfile.open(archive) as t:
            names = t.getnames()
            t.extractall(base, filter="data")
    return names


