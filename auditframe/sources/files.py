"""Readers and writers of the file kinds evaluation records come in."""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions.canon import KEEP_NULLS


def case_packages(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per file, below a directory at any depth, with the file's full path: names may repeat between folders."""
    files = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return files.withColumn("file", F.col("_metadata.file_path"))


def closed_schema_problems(texts: DataFrame, key: str, text: str, fields: Iterable[str]) -> DataFrame:
    """Objects whose top-level keys are not exactly the wanted ones: (key, missing, unknown)."""
    wanted = F.array(*[F.lit(f) for f in fields])
    found = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    d = texts.select(
        key, F.array_sort(F.array_except(wanted, found)).alias("missing"), F.array_sort(F.array_except(found, wanted)).alias("unknown")
    )
    return d.where((F.size("missing") > 0) | (F.size("unknown") > 0))


def documents_of(cases: DataFrame) -> DataFrame:
    """Documents of case packages, one row each, with their place."""
    return cases.select("case_id", F.posexplode("documents").alias("pos", "d")).select("case_id", "pos", "d.*")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file name and line number, without moving the lines.

    Each split numbers its own lines; a table with one row per split says how many
    lines of the file come before it.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_start"), F.count("*").alias("_lines"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_block", "_start", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    return lines.join(offsets, ["file", "_block"]).select(
        "file", (F.col("_id") - F.col("_start") + F.col("_before") + 1).alias("line"), "value"
    )


def strict_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): a blank line, a line that is no object, or one that is not canonical
    JSON of the schema is an error (file, line, error)."""
    lines = numbered_lines(spark, path)
    ordered = T.StructType(sorted(schema.fields, key=lambda f: f.name))
    parsed = lines.withColumn("_row", F.from_json("value", ordered))
    bare = F.trim("value")
    error = (
        F.when(bare == "", "blank")
        .when(~bare.startswith("{") | F.try_parse_json("value").isNull(), "not_an_object")
        .when(~F.to_json("_row", KEEP_NULLS).eqNullSafe(F.col("value")), "not_canonical")
    )
    judged = parsed.withColumn("error", error)
    rows = judged.where("error IS NULL").select("file", "line", "_row.*")
    return rows, judged.where("error IS NOT NULL").select("file", "line", "error")


#: Folders that the files of ``write_files`` are dealt to, so that Spark lists them as tasks and no folder holds them all.
SHELVES = 512


def write_files(df: DataFrame, path: str, name: str, value: str) -> None:
    """A text file per name, ``shelf=<n>/name=<name>.<task>.txt``, with the values of the name in a task, each ended by a newline.

    Tasks write the files themselves, without the commands per file that Spark's local writer runs; a file appears whole and a
    task that is run again writes the same files. Only Spark reaches a folder of another file system than the machines' own: there its writer
    makes ``shelf=<n>/name=<name>/``.
    """
    own = F.coalesce(F.col(name).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = df.select(F.pmod(F.xxhash64(own), F.lit(SHELVES)).alias("shelf"), own.alias("name"), F.col(value).alias("value"))
    folder = path.removeprefix("file:")
    if ":" in folder.split("/")[0]:
        rows.write.partitionBy("shelf", "name").text(path)
        return
    folder = "/" + folder.lstrip("/") if folder.startswith("/") else folder
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, last, out, n = TaskContext.get().partitionId(), f"{folder}/.{uuid.uuid4().hex}", None, None, 0

        def close() -> None:
            out.close()
            os.makedirs(f"{folder}/shelf={last[0]}", exist_ok=True)
            os.replace(part, f"{folder}/shelf={last[0]}/name={last[1]}.{task:05d}.txt")

        for batch in batches:
            for shelf, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (shelf, key) != last:
                    if out:
                        close()
                    out, last, n = open(part, "wb"), (shelf, key), n + 1
                out.write((text or b"") + b"\n")
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = rows.withColumn("value", F.col("value").cast("binary")).sortWithinPartitions("shelf", "name")
    ordered.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number


#: Folders that ``raw_files`` looks for, level by level, before it deals them to tasks, and bytes that a task reads at a time.
DEALT, BLOCK = 512, 1 << 20


def raw_files(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Every file under a directory: relative path, size and SHA-256; empty files are passed over.

    Tasks list the folders, the found names are dealt out anew, and tasks read the files a block at a time, so the driver knows
    some folders and no file. What is no directory of the machines' own (another file system, a pattern, a single file) is left to
    Spark's reader, which lists all files on the driver, and then a file must fit in a row.
    """
    base = (root or path).rstrip("/")
    folder = path.removeprefix("file:")
    folder = "/" + folder.strip("/") if folder.startswith("/") else folder.rstrip("/")
    if ":" in folder.split("/")[0] or any(x in folder for x in "*?[{\\") or not os.path.isdir(folder):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        bare = F.regexp_replace("path", "^file:/+", "/")
        return files.select(F.substr(bare, F.lit(len(base) + 2)).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    # Tasks get the functions themselves and need no library of their own.
    def listed(folder: str) -> Iterator[os.DirEntry]:
        """What Spark's readers see in a folder: they pass over names with a dot or an underscore in front (not folder `_metadata`), and copies under way."""
        with os.scandir(folder) as entries:
            for e in entries:
                hidden = e.name.startswith(".") or e.name.startswith("_") and "=" not in e.name and not (e.name.startswith(("_metadata", "_common_metadata")) and e.is_dir())
                if not hidden and not e.name.endswith("._COPYING_"):
                    yield e

    def below(folder: str, deep: bool) -> Iterator[str]:
        """The files in a folder, with those of the folders below it if it is to be searched deep."""
        for e in listed(folder):
            if e.is_dir():
                if deep:
                    yield from below(e.path, deep)
            else:
                yield e.path

    # Folders that were looked through are searched for their own files only, the last level found for all below.
    seen, level = [], [os.path.abspath(folder)]
    while level and len(level) < DEALT:
        more = [*islice((e.path for f in level for e in listed(f) if e.is_dir()), 64 * DEALT + 1)]
        if len(more) > 64 * DEALT:
            break
        seen, level = [*seen, *level], more
    asked = [*((f, False) for f in seen), *((f, True) for f in level)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, deep in zip(*(c.to_pylist() for c in batch.columns)):
                names = below(f, deep)
                while some := [*islice(names, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["path"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, sizes, sums = batch.column(0).to_pylist(), [], []
            for p in paths:
                with open(p, "rb") as f:
                    size, sha = 0, sha256()
                    while block := f.read(BLOCK):
                        size += len(block)
                        sha.update(block)
                sizes.append(size)
                sums.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], ["path", "bytes", "sha256"])

    folders = spark.createDataFrame(asked, "folder string, deep boolean").repartition(min(tasks, len(asked)))
    files = folders.mapInArrow(found, "path string").repartition(tasks).mapInArrow(hashed, "path string, bytes bigint, sha256 string")
    return files.where("bytes > 0").withColumn("path", F.substr("path", F.lit(len(base) + 2)))


def file_contents(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("artifact_id"), "content")


def checksum_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file of "<sha256>  <path>" lines."""
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).select(parts[1].alias("path"), parts[0].alias("sha256"))


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file with its full path, with the columns of any name=value folders."""
    texts = spark.read.text(path, wholetext=True)
    folders = [c for c in texts.columns if c != "value"]
    return texts.select(F.col("_metadata.file_path").alias("file"), *folders, F.col("value").alias("text"))


def run_directories(
    spark: SparkSession, root: str, runs: DataFrame, kinds: dict[str, tuple[str, str]], run_pattern: str = "([^/]+)/[^/]+$"
) -> DataFrame:
    """One row per listed run with the fields of each file kind; what is missing stays NULL.

    kinds: name to (glob below root, DDL schema), for example {"metrics": ("*/metrics.json",
    "episodes INT")}.  run_pattern captures the run in a file path; field names must
    differ between kinds.  status is RUN when the first kind is there.
    """
    out = runs.select(F.col("run_id").cast("string").alias("run_id"))
    first = next(iter(kinds))
    for name, (glob, schema) in kinds.items():
        part = spark.read.schema(schema).option("multiLine", True).json(f"{root}/{glob}")
        run = F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1)
        out = out.join(part.select(run.alias("run_id"), "*", F.lit(True).alias(f"_has_{name}")), "run_id", "left")
    out = out.withColumn("status", F.when(F.col(f"_has_{first}"), "RUN").otherwise("NOT_RUN"))
    return out.drop(*[f"_has_{name}" for name in kinds])


def canonical_lines(df: DataFrame) -> DataFrame:
    """Rows as canonical JSON, one text column."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), KEEP_NULLS).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Canonical JSON lines; refuses to write over a completed output."""
    canonical_lines(df).write.mode("errorifexists").text(path)


def write_new(df: DataFrame, path: str) -> None:
    """Parquet; refuses to write over a completed output."""
    df.write.mode("errorifexists").parquet(path)
