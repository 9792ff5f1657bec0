"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* only the named id and text columns are read; every other input column is carried through untouched;
* where a result column has the name of an input column, the result replaces it;
* names that begin with two underscores are the operators' own, input columns don't have them;
* a null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # workers that start elsewhere find this package where the driver has it, if no path is set for them
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def file_place() -> Column:
    """A number of a row of a Parquet table: a hash of its file and its place there, the same in each read."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all other characters kept. Texts of ASCII alone take the byte-wise path of lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: together too wide for chance collisions at 10^12 rows."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5CA1AB1E), *cols)


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder of spark.checkpoint.dir; a folder of our own only on one machine, where it is unset."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not shared:
            import tempfile

            shared = tempfile.mkdtemp(prefix="scorelake-checkpoints-")
        context.setCheckpointDir(shared)
    return df.checkpoint()


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later filters read as values: a filter on a generated column doesn't repeat its expression."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.explode(F.array(made)).alias("__made")).select(*df.columns, "__made.*")


def join_spread(rows: DataFrame, found: DataFrame, keys: list[str], how: str, salts: int = 16) -> DataFrame:
    """rows joined with found, a small table of one row a key: a key that many rows hold is dealt to `salts` tasks.

    found is repeated for each salt, so any salt of a row gives the same result."""
    salted = found.withColumn("__salt", F.explode(F.array(*(F.lit(k).cast("long") for k in range(salts)))))
    spread = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return spread.join(salted, [*keys, "__salt"], how).drop("__salt")


def merged(docs: DataFrame, **results: Column) -> DataFrame:
    """docs with result columns, which replace input columns of the same name."""
    return docs.withColumns(results)


def give_back() -> None:
    """Freed memory goes to the system: a driver or a worker has more to run, and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, with its memory given back at a task's end: workers wait for other tasks beside an executor's heap."""

    @wraps(run)
    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return all_of


def slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about most_bytes of text each (one row at least), so memory stays bounded."""
    for batch in batches:
        n, at, held = batch.num_rows, 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i in range(n):
            if held and held + sizes[i] > most_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += sizes[i]
        if at < n:
            yield batch.slice(at, n - at)
