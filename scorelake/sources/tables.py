"""Sources and sinks: CSV, JSON, tables, name lists, small report bundles."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a schema one pass; without, types are inferred in a pass of their own."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_sas(spark: SparkSession, paths: Sequence[str], schema: str, encoding: str = "latin-1") -> DataFrame:
    """SAS7BDAT files, one task each, read in chunks."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                yield from pd.read_sas(path, encoding=encoding, chunksize=50_000)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInPandas(run, schema)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", stamp: bool = False, partition_by: Sequence[str] = ()) -> None:
    out = df.withColumn("py_inserttime", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")) if stamp else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def insert_rows(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """By name, not by place. With overwrite, of a partitioned table just the partitions in df, where the session's
    partitionOverwriteMode is dynamic."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name, overwrite=overwrite)


def read_table(spark: SparkSession, name: str, partition: str | None = None) -> DataFrame:
    table = spark.table(name)
    return table.where(partition) if partition else table


def key_shard(keys: Sequence[str], n: int):
    """The shard of a row among n, for extracts in parallel parts."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def union_all(frames: Sequence[DataFrame], tag: str | None = None, names: Sequence[str] = ()) -> DataFrame:
    """By name; columns missing on a side are null. With a tag, a column tells the frames apart."""
    tagged = [df.withColumn(tag, F.lit(n)) for df, n in zip(frames, names)] if tag else list(frames)
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def join_all(frames: Sequence[DataFrame], on: Sequence[str], how: str = "left") -> DataFrame:
    """The frames joined one after the other on the keys; a column that is there already gets the frame's number."""
    out = frames[0]
    for i, df in enumerate(frames[1:], 1):
        clash = [c for c in df.columns if c not in on and c in out.columns]
        out = out.join(df.withColumnsRenamed({c: f"{c}_{i}" for c in clash}), list(on), how)
    return out


def run_script(spark: SparkSession, text: str, **values) -> DataFrame | None:
    """Each statement of a SQL script, after its comments are removed and {names} filled; the last one's result."""
    from ..functions.sqltext import remove_comments, split_statements

    out = None
    for statement in split_statements(remove_comments(text)):
        out = spark.sql(statement.format(**values) if values else statement)
    return out


def parsed_schema(lines: Sequence[str]) -> dict[str, str]:
    """Names and types of descriptions such as '<column id, type bigint>'."""
    out = {}
    for line in lines:
        parts = [p.strip(" <>") for p in line.split(",")]
        out[parts[0].removeprefix("column").strip()] = parts[1].removeprefix("type").strip(" =")
    return out


def pull_parts(spark: SparkSession, name: str, keys: Sequence[str], n: int, folder: str) -> list[str]:
    """A table as n Parquet folders by a hash of its keys, written in one pass."""
    shard = key_shard(keys, n)
    spark.table(name).withColumn("part", shard).write.mode("overwrite").partitionBy("part").parquet(folder)
    return [f"{folder}/part={k}" for k in range(n)]


def push_parts(spark: SparkSession, paths: Sequence[str], name: str, overwrite: bool = True) -> int:
    """Parquet folders into one table; the rows it then has."""
    save_table(spark.read.parquet(*paths), name, "overwrite" if overwrite else "append")
    return spark.table(name).count()


def read_names(path: str, lower: bool = False) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [(s.lower() if lower else s.upper()) for line in f if (s := line.strip())]


def write_names(names: Sequence[str], path: str, sep: str = "\n", quote: str = "double") -> None:
    mark = {"double": '"', "single": "'", "none": ""}[quote]
    with open(path, "w", encoding="utf-8") as f:
        f.write(sep.join(f"{mark}{n}{mark}" for n in names))


def write_report(folder: str, sheets: Mapping[str, DataFrame | None], most_rows: int = 100_000) -> dict[str, str]:
    """Report tables by unique sheet names: up to most_rows rows as one CSV file, larger ones as a Parquet folder."""
    os.makedirs(folder, exist_ok=True)
    out: dict[str, str] = {}
    for name, df in sheets.items():
        if df is None:
            continue
        if df.limit(most_rows + 1).count() > most_rows:
            out[name] = os.path.join(folder, f"{sheet_name(name, set(out))}.parquet")
            df.write.mode("overwrite").parquet(out[name])
            continue
        out[name] = os.path.join(folder, f"{sheet_name(name, set(out))}.csv")
        df.toPandas().to_csv(out[name], index=False)
    return out


def sheet_name(name: str, taken: set[str] = frozenset()) -> str:
    """At most 31 characters without :\\/?*[], made unique by a number."""
    base = "".join("_" if c in ':\\/?*[]' else c for c in name)[:31] or "sheet"
    out, k = base, 1
    while out in taken:
        k += 1
        out = f"{base[: 31 - len(str(k)) - 1]}_{k}"
    return out


def save_model(folder: str, model_json: str, **metadata) -> None:
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "model.json"), "w", encoding="utf-8") as f:
        json.dump({"format": 1, "model": json.loads(model_json), "metadata": metadata}, f)


def load_model(folder: str) -> tuple[str, dict]:
    with open(os.path.join(folder, "model.json"), encoding="utf-8") as f:
        found = json.load(f)
    return json.dumps(found["model"]), found["metadata"]
