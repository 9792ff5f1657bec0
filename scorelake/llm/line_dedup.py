"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble by position.

DataFrame functions only. The text itself moves once (the join of documents with their dropped positions); lines move as
128-bit hashes. Counting is pre-aggregated on the map side, so a line that a third of all documents hold is one row per
map task; the join that tells documents of their dropped lines is a plain shuffle join, which adaptive execution splits
where one hash is hot.

Defined cases: a null or empty text is one empty line; rows with a null id neither count nor lose lines; rows that share
an id are one document; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hash128, lower_ascii, merged

#: The white space that a line's key loses at both ends (0x20 and 0x09-0x0D).
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the text's remaining lines, n_lines (before dropping) and n_dropped.

    A key of at least min_chars code points in at least min_docs documents stays only in the smallest id that holds it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    h1, h2 = hash128(F.col("key"))
    lines = (
        named.where("id IS NOT NULL")
        .select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "row", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    if min_docs <= 2:  # two different ids exist exactly where the least and the greatest differ
        counted = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        shared = counted.where(F.lit(min_docs < 2) | (F.col("first") < F.col("last")))
    else:
        held = lines.select("h1", "h2", "id").distinct()
        shared = held.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    shared = cut_lineage(shared.select("h1", "h2", "first"))
    dropped = (
        lines.join(shared, ["h1", "h2"])
        .where(F.col("id") != F.col("first"))
        .groupBy("id", "row")
        .agg(F.collect_set("pos").alias("__drop"))
        .select(F.col("id").alias("__id"), F.col("row").alias("__row"), "__drop")
    )
    kept = F.when(F.col("__drop").isNull(), text).otherwise(
        F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop")),
                lambda i: F.get(F.col("__lines"), i),
            ),
            "\n",
        )
    )
    joined = docs.join(dropped, (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__row")), "left")
    out = joined.withColumn("__lines", F.split(text, "\n", -1))
    n_dropped = F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long")
    result = {"n_lines": F.size("__lines").cast("long"), "n_dropped": n_dropped, text_col: kept}
    return merged(out, **result).drop("__id", "__row", "__drop", "__lines")
