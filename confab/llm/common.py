"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bounded sample is the rows below a threshold of a 63-bit hash, found a few bits at a time, from the highest on: by
#: these shifts, while more than SAMPLE_SLACK of the bound is open.
SAMPLE_SHIFTS, SAMPLE_SLACK = (51, 39, 27, 15, 3, 0), 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, one of this machine in local mode; an
    error on a cluster, whose machines would not see each other's."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="confab-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: lineage ends here. The files go when
    the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/confab-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: Column, size: Column, most: int, by: str | None = None) -> DataFrame:
    """Rows of the least hashes of ``key``, as many as keep the sum of ``size`` within ``most`` (for each value of
    ``by``, if given). Sums by the hash's highest bits tell in which bucket the bound is reached, sums by the next bits
    where in it, and so on, so the sample is about full at every size, and one comparison a row picks it. Rows larger
    than the bound are left out; rows that share a hash are taken together, and where the first of these exceed the
    bound the sample begins after them, so it is only empty if nothing fits."""
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    size = F.coalesce(size, F.lit(0))
    group = F.col(by).cast("string") if by else F.lit("")
    fitting = df.where(size <= most)
    left: dict[str | None, int] = {}
    spans: dict[str | None, tuple[int, int]] = {}
    inside = lambda g, a, b: group.eqNullSafe(F.lit(g)) & (h >= a) & (h < b)
    either = lambda found: functools.reduce(Column.__or__, (inside(g, *ab) for g, ab in found.items()), F.lit(False))
    open_: dict[str | None, tuple[int, int]] | None = None
    level = 0
    while open_ is None or open_:
        shift = SAMPLE_SHIFTS[level]
        rows = fitting if open_ is None else fitting.where(either(open_))
        sums: dict[str | None, list[tuple[int, int]]] = {}
        for r in rows.groupBy(group.alias("g"), F.shiftrightunsigned(h, shift).alias("b")).agg(F.sum(size).alias("s")).collect():
            sums.setdefault(r.g, []).append((r.b, r.s))
        cut: dict[str | None, tuple[int, int]] = {}
        for g, buckets in sums.items():
            room, (start, end) = left.get(g, most), spans.get(g, (0, 0))
            for b, s in sorted(buckets):
                if s > room:
                    end = b << shift
                    if room > SAMPLE_SLACK * most:
                        cut[g] = (end, (b + 1) << shift)
                    break
                room, end = room - s, (b + 1) << shift
            left[g], spans[g] = room, (start, end)
        level += 1
        if level == len(SAMPLE_SHIFTS):
            # What is cut now shares one hash. Groups that have nothing yet go on behind it.
            cut = {g: (b, 1 << 63) for g, (_, b) in cut.items() if left[g] == most}
            spans |= {g: (a, a) for g, (a, _) in cut.items()}
            level = 0
        open_ = {g: (a, min(b, (1 << 63) - 1)) for g, (a, b) in cut.items()}
    return df.where(either({g: (a, min(b, (1 << 63) - 1)) for g, (a, b) in spans.items()}) & (size <= most))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows as Python values, converted a slice at a time, so that long texts are not all held twice."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def lean(run):
    """A function for mapInArrow that gives its memory back to the system when a task ends: Python workers live on and
    would hold it beside the JVM's heap."""

    @functools.wraps(run)
    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def row_mapper(make: Callable[[], Callable[[tuple], Iterable[tuple]]], names: tuple[str, ...], schema: pa.Schema):
    """A function for mapInArrow: ``make()`` runs once a task and gives the function from a row to rows."""

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in it:
            yield from batches((out for values in rows_of(batch, *names) for out in row(values)), schema)

    return run
