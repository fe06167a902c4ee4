"""Table access: Parquet tables, CSV exports, the cleaned-table sink."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_table(
    spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None
) -> DataFrame:
    """Parquet table of a folder. A given schema saves the job that reads file footers."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


class BadRows(ValueError):
    """A CSV table does not fit the schema asked for."""


CORRUPT = "_corrupt_record"
BAD_VALUES = "_bad_values"


HEADER_JOBS = 16  # header lines read at the same time
# What a text column can be, from narrow to wide: the first type that holds every populated value.
# The pattern keeps out what a cast alone would let pass, such as a bare year as a date.
_LATTICE = [
    ("boolean", r"(?i)true|false"),
    ("int", r"[+-]?\d+"),
    ("bigint", r"[+-]?\d+"),
    ("decimal(38,0)", r"[+-]?\d+"),
    ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|NaN|[+-]?Infinity"),
    ("date", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("timestamp", r"\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?"),
]


def csv_ingest(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    typed: bool = False,
    multiline: bool = False,
    on_bad: str = "fail",
) -> DataFrame:
    """Load one or many CSV files with headers; quotes inside quoted fields are doubled.

    The header line of every file is read at once (one short job a file), and its columns are
    matched by name: files may order them differently. Files that do not have the same columns are
    refused, unless a schema asks only for columns that all of them have. Files without a line are empty.

    Without a schema every column is text, which costs no extra pass and lets the parse operators report
    what would not convert. ``typed=True`` finds the narrowest type that holds every populated value of a
    column (``infer_types``; it reads the files once more) and then reads as with that schema.
    ``multiline`` accepts line breaks inside quotes but makes a file unsplittable.

    A line with too many or too few fields, or a value that does not convert, stops the job
    (``on_bad="fail"``), or is kept and flagged (``"flag"``): ``_corrupt_record`` then holds the line, and
    ``_bad_values`` names the columns whose text became NULL. ``ingest_account`` counts both.
    """
    if on_bad not in ("fail", "flag"):
        raise ValueError("on_bad is 'fail' or 'flag'")
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    headers = _headers(spark, path, multiline)
    names = [f.name for f in kinds] if kinds else list(next(iter(headers), ()))
    for header, files in headers.items():
        if missing := [n for n in names if n not in header]:
            raise BadRows(f"no column {', '.join(missing)} in the header {', '.join(header)} of {files[0]}")
        if kinds is None and (surplus := [n for n in header if n not in names]):
            raise BadRows(f"column {', '.join(surplus)} of {files[0]} is not in every file")
    parts = []
    for header, files in headers.items():
        text = StructType([StructField(n, StringType()) for n in [*header, CORRUPT]])
        part = reader.schema(text).option("columnNameOfCorruptRecord", CORRUPT).csv(path if len(headers) == 1 else files)
        parts.append(part.select(*names, CORRUPT))
    if not parts:
        rows = spark.createDataFrame([], StructType([StructField(n, StringType()) for n in [*names, CORRUPT]]))
    else:
        rows = reduce(DataFrame.unionAll, parts)
    if on_bad == "fail":
        # Every kept column hangs on the check, so a narrow read of the table is checked too.
        stop = F.raise_error(F.concat(F.lit("malformed CSV line: "), F.col(CORRUPT)))
        rows = rows.select(*[F.when(F.col(CORRUPT).isNotNull(), stop.cast("string")).otherwise(F.col(n)).alias(n)
                             for n in names])
    if typed and kinds is None:
        sound = rows.filter(F.col(CORRUPT).isNull()) if on_bad == "flag" else rows
        kinds = infer_types(sound, names)
    if kinds is None:
        return rows
    values, bad = [], []
    for f in kinds:
        raw = F.col(f.name)
        value = raw if isinstance(f.dataType, StringType) else raw.try_cast(f.dataType)
        failed = raw.isNotNull() & value.isNull()
        bad.append(F.when(failed, F.lit(f.name)))
        if on_bad == "fail" and not isinstance(f.dataType, StringType):
            stop = F.raise_error(F.concat(F.lit(f"{f.name}: does not convert: "), raw)).cast(f.dataType)
            value = F.when(failed, stop).otherwise(value)
        values.append(value.alias(f.name))
    if on_bad == "fail":
        return rows.select(*values)
    return rows.select(*values, CORRUPT, F.array_compact(F.array(*bad)).alias(BAD_VALUES))


def _headers(spark: SparkSession, path: str, multiline: bool) -> dict[tuple[str, ...], list[str]]:
    """The files of a path by their header, in the order of the files. Only header lines are read."""
    files = sorted(unquote(f) for f in spark.read.text(path).inputFiles())

    def header(file: str) -> tuple[str, ...]:
        reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        return tuple(reader.csv(file).columns)

    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        found = list(pool.map(header, files))
    grouped: dict[tuple[str, ...], list[str]] = {}
    for columns, file in zip(found, files):
        if columns:
            grouped.setdefault(columns, []).append(file)
    return grouped


def infer_types(rows: DataFrame, names: Sequence[str]) -> StructType:
    """The narrowest type for each text column that holds all its populated values, in one aggregate.

    Whole numbers beyond 64 bits stay exact as decimals. A column without values, or with values of
    several kinds, is text. Dates need year, month and day.
    """
    def fits(name: str, kind: str, pattern: str):
        value = F.col(name)
        return value.rlike(rf"\A(?:{pattern})\z") & value.try_cast(kind).isNotNull()

    counts = [F.count(n).alias(f"{i}") for i, n in enumerate(names)]
    counts += [F.count_if(fits(n, kind, pattern)).alias(f"{i} {kind}")
               for i, n in enumerate(names) for kind, pattern in _LATTICE]
    found = rows.agg(*counts).first() if names else {}
    kinds = []
    for i, n in enumerate(names):
        held = [kind for kind, _ in _LATTICE if found[f"{i}"] and found[f"{i} {kind}"] == found[f"{i}"]]
        kinds.append(f"`{n.replace('`', '``')}` {held[0] if held else 'string'}")
    return StructType.fromDDL(", ".join(kinds)) if kinds else StructType([])


def ingest_account(flagged: DataFrame) -> DataFrame:
    """``column_name, row_count, malformed_lines, bad_values`` of each column of a table read with ``on_bad="flag"``.

    ``bad_values`` counts what did not convert; in one aggregate, whatever the number of columns.
    """
    names = [n for n in flagged.columns if n not in (CORRUPT, BAD_VALUES)]
    bad = F.col(BAD_VALUES) if BAD_VALUES in flagged.columns else F.array().cast("array<string>")
    # A corrupt-record column alone may not be asked of a CSV scan, so the other columns are touched as well.
    total = flagged.agg(
        F.count(F.lit(1)).alias("row_count"), F.count(CORRUPT).alias("malformed_lines"),
        *[F.count_if(F.array_contains(bad, n)).alias(f"bad {i}") for i, n in enumerate(names)],
        *[F.count(n).alias(f"seen {i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(n).alias("column_name"), F.col("row_count"), F.col("malformed_lines"),
                     F.col(f"bad {i}").alias("bad_values")) for i, n in enumerate(names)]
    return total.select(F.inline(F.array(*rows)))


def write_cleaned(
    df: DataFrame, path: str, raw_paths: Sequence[str] = (), partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write a cleaned table to Parquet and read it back with its own types and column order.

    Raw inputs are never written over. An empty text in a partition column would come back as
    NULL and stops the job.
    """
    spark = df.sparkSession
    for raw in raw_paths:
        if _parts(path)[:len(_parts(raw))] == _parts(raw):
            raise ValueError(f"{path} lies in the raw input {raw}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    checked = df
    for c in partition_by:
        if isinstance(kinds[c], StringType):
            stop = F.raise_error(F.lit(f"empty text in partition column {c}")).cast("string")
            checked = checked.withColumn(c, F.when(F.col(c) == "", stop).otherwise(F.col(c)))
    writer = checked.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


class NotPublished(ValueError):
    """A written table does not hold what was to be written; nothing was published."""


def publish_cleaned(
    df: DataFrame, path: str, unique: Sequence[str] = (), raw_paths: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write a cleaned table beside ``path``, check what can be read back, and publish it by one rename.

    Readers see no table or the whole one. Read back, the table must have the rows that were written (they are
    counted while they are written), the same columns and types, and no two rows with the same ``unique``
    columns, NULL included. Otherwise the written files go and ``NotPublished`` is raised. An existing table is
    never written over.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    goal = jvm.org.apache.hadoop.fs.Path(path)
    files = goal.getFileSystem(conf)
    if files.exists(goal):
        raise NotPublished(f"{path} exists")
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    counted = Observation()
    try:
        back = write_cleaned(df.observe(counted, F.count(F.lit(1)).alias("n")), staging, raw_paths, partition_by)
        found = spark.read.parquet(staging).select(*df.columns)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        if differing := [f.name for f in found.schema
                         if f.name not in partition_by and f.dataType.simpleString() != kinds[f.name]]:
            raise NotPublished(f"{', '.join(differing)} of {path} came back with another type")
        if (n := back.count()) != counted.get["n"]:
            raise NotPublished(f"{n} of {counted.get['n']} rows of {path} came back")
        if unique:
            repeated = back.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").take(1)
            if repeated:
                raise NotPublished(f"{path} holds {repeated[0].asDict()} more than once")
        if not files.rename(jvm.org.apache.hadoop.fs.Path(staging), goal):
            raise NotPublished(f"{staging} could not be renamed to {path}")
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(staging), True)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _parts(path: str) -> list[str]:
    return [part for part in path.removeprefix("file:").split("/") if part]


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Put an intermediate table into shared storage and read it back.

    For frames that several passes read: the work behind them runs once, and an executor lost
    later costs a re-read only.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_MADE: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """New folder name in the shared storage the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to storage that all executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
    _MADE.append(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared folders that operators made inside the block when it ends.

    Results must be written or collected inside it: they may still read those folders.
    """
    begin = len(_MADE)
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in _MADE[begin:]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
        del _MADE[begin:]
