"""N-gram Jaccard join: size-aware, light sets by enumerated subsets and heavy sets by inverted lists.

Texts become sets of hashed word shingles; equal sets are one class. Two classes link at Jaccard similarity >= 0.8.

* Light (both sets of at most `boundary` shingles): each set lists all its subsets of the size that its partner's size
  demands, for every partner size that can link; linked sets share such a subset.
* Heavy (the larger set above the boundary): inverted lists of prefixes. A global order puts frequent shingles last
  (frequencies from a counter table over the whole corpus, of a size that follows it up to a bound; any fixed order is
  exact, this one keeps lists short. Beyond the bound a counter is shared by ever more shingles: rare ones then come in an
  order of chance among themselves, but a shingle far more frequent than a counter's share still comes last). Linked sets share a shingle among their first n - ceil(0.8 n) + 1. Size and position bounds discard the rest.
* The boundary minimises subsets listed plus list entries and the partners expected for each, from the size histogram.

What leaves the operator is components, so not all pairs are needed: each list has a hub (the member
with the fewest rare shingles before the list's), and each class is first proposed to the one hub it shares most lists with. Links are verified on whole sets, components are formed, and then
every list that still holds several components proposes just its pairs across components. A pair within one component
cannot change the result, so nothing is lost, and a group of near copies costs its size, not its square.

Defined cases: texts without words have 0 shingles and link with nothing; fewer words than a shingle are one shingle; rows
of one id are one document; rows with a null id have their count and a null component.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, gives_back, slices
from .components import components

#: Shingle length in words, similarity (a ratio of integers), and the largest boundary that the cost may choose.
WORDS, NEED, OF, LIGHT = 5, 80, 100, 12
#: The frequency table has a counter for so many bytes of text, as a power of 2 between these.
COUNTER_BYTES, LEAST_COUNTERS, MOST_COUNTERS = 128, 1 << 16, 1 << 26
#: Candidate documents whose ids, or classes whose components, are broadcast at most; beyond, shuffle joins find them.
MOST_BROADCAST = 1_000_000
#: Bytes of text that are hashed at a time (one text at least): about 50 bytes of memory for each.
HASHED = 1 << 19

_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P, _S32 = 0x9E3779B97F4A7C15, np.uint64(32)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _K1
    h = (h ^ (h >> np.uint64(33))) * _K2
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(max(n, 2 * HASHED), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


_BYTES = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))[_BYTES]
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_WEIGHT = mix(np.arange(1000, 1000 + WORDS, dtype=np.uint64) * np.uint64(_P)) | np.uint64(1)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending. Words are hashed as polynomials in their bytes, by prefix sums."""
    raw = [t.encode() for t in texts]
    buffer = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    power, inverse = _powers(len(buffer) + 1)
    word = ~_BLANK[buffer]
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[buffer] * power[: len(buffer)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    limits = np.cumsum([len(r) + 1 for r in raw])
    bounds = np.concatenate(([0], np.searchsorted(starts, limits)))
    n = len(hashes)
    rolled = np.zeros(max(n - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        rolled += hashes[k : n - WORDS + 1 + k] * _WEIGHT[k] if n >= WORDS else rolled
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(mix(np.array([(hashes[a:b] * _WEIGHT[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def least(n: int) -> int:
    """Shingles that a set of n shares with any set it links to."""
    return -(-NEED * n // OF)


def counters(s: np.ndarray, size: int) -> np.ndarray:
    return (s >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """The counters that are not 0, as distances and values: a task sends what it has seen, whatever the table's size."""
    at = np.flatnonzero(counts)
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + counts[at].astype(np.uint32).tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    steps, values = np.split(np.frombuffer(zlib.decompress(data), dtype=np.uint32), 2)
    out = np.zeros(size, dtype=np.uint64)
    out[np.cumsum(steps, dtype=np.int64)] = values
    return out


def in_steps(table: np.ndarray, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """Slices of the table: what is computed from one is small, however large the table is."""
    return (table[at : at + step] for at in range(0, len(table), step))


def expected_partners(table: np.ndarray) -> float:
    """Entries that a list holds, expected over the entries."""
    squares = sum(float((t.astype(np.float64) ** 2).sum()) for t in in_steps(table))
    return squares / max(float(table.sum(dtype=np.float64)), 1.0)


def octaves(table: np.ndarray) -> np.ndarray:
    """Frequencies in eighths of an octave: a byte a counter orders all that fit 32 bits."""
    out = np.empty(len(table), dtype=np.uint8)
    for t, o in zip(in_steps(table), in_steps(out)):
        o[:] = np.floor(8 * np.log2(1.0 + t))
    return out


def profile(size: int):
    """Class and size of each row, and at a task's end its part of the frequency table, in slices."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = np.zeros(size, dtype=np.uint32), ["id", "n", "hi", "lo", "slice", "counts"]
        kind = None
        for batch in slices(batches, 1, HASHED):
            kind = batch.column(0).type
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()])
            sign = [signature(s) for s in sets]
            at, times = np.unique(counters(np.concatenate(sets), size), return_counts=True)
            seen[at] += times.astype(np.uint32)
            m = len(sets)
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([a for a, _ in sign], pa.int64()), pa.array([b for _, b in sign], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if kind is not None:
            parts = [packed(p) for p in np.split(seen, 64)]
            nothing = [pa.nulls(64, k) for k in (kind, pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(range(64), pa.int32()), pa.array(parts, pa.binary())], names)

    return run


def add_up(size: int):
    """Counters of one slice added, up to the largest that fits."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, dtype=np.uint64)
        for part in parts["counts"]:
            total += unpacked(part, size)
        return pd.DataFrame({"slice": [parts["slice"].iloc[0]], "counts": [packed(np.minimum(total, np.uint64(0xFFFFFFFF)))]})

    return run


def choose_boundary(sizes: dict[int, int], partners: float) -> int:
    """sizes: how many classes have each size up to LIGHT; partners: entries expected in a list of the inverted index."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, rows in sizes.items():
            if n <= boundary:
                total += rows * sum(math.comb(n, least(b)) for b in range(n, min(boundary, OF * n // NEED) + 1) if least(b) <= n)
            if n >= least(boundary + 1):
                total += rows * (n - least(n) + 1) * (1 + partners)
        return total

    return min(range(LIGHT + 1), key=lambda b: (cost(b), b))


def entries(frequency, size: int, boundary: int):
    """(key, hi, n, pos) of each class: its subsets (pos -1) if light, its prefix in the global order if it can be heavy's."""
    smallest = least(boundary + 1)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = frequency.value, set()
        for batch in slices(batches, 0, HASHED):
            keys, his, ns, positions = [], [], [], []
            for s in shingle_sets([t or "" for t in batch.column(0).to_pylist()]):
                n = len(s)
                if not n:
                    continue
                both = signature(s)
                if both in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(both)
                hi = both[0]
                own = []
                if n <= boundary:
                    for b in range(n, min(boundary, OF * n // NEED) + 1):
                        if least(b) <= n:
                            picks = np.array(list(combinations(range(n), least(b))))
                            own.append(mix(mix(s)[picks].sum(axis=1, dtype=np.uint64) + np.uint64(b)))
                if own:
                    keys.append(light := np.concatenate(own))
                    positions.append(np.full(len(light), -1, dtype=np.int32))
                if n >= smallest:
                    prefix = n - least(n) + 1
                    order = np.lexsort((s, table[counters(s, size)]))[:prefix]
                    keys.append(s[order])
                    positions.append(np.arange(prefix, dtype=np.int32))
                made = sum(map(len, keys)) - sum(map(len, his))
                his.append(np.full(made, hi, dtype=np.int64))
                ns.append(np.full(made, n, dtype=np.int32))
            if keys:
                columns = [np.concatenate(keys).view(np.int64), *(np.concatenate(c) for c in (his, ns, positions))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "hi", "n", "pos"])

    return run


@gives_back
def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, HASHED):
        sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()])
        sign = [signature(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a for a, _ in sign], pa.int64()), pa.array([b for _, b in sign], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
            ["rep", "hi", "lo", "shingles"],
        )


@gives_back
def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, x, y) whose sets x and y link, as (u, v)."""
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            small, large = (a, b) if len(a) < len(b) else (b, a)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            keep.append(OF * both >= NEED * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["u", "v"])


def possible(a: str, b: str):
    """Size and position bounds of two list entries; a subset's entry (pos -1) has passed its own."""
    na, nb, pa_, pb = (F.col(f"{x}.{y}").cast("long") for y in ("n", "pos") for x in (a, b))
    sizes = (F.greatest(na, nb) * NEED <= F.least(na, nb) * OF) & ((pa_ < 0) == (pb < 0))
    # overlap >= 0.8 / 1.8 * (na + nb); a first shared shingle leaves at most this much behind it
    return sizes & ((pa_ < 0) | ((1 + F.least(na - pa_ - 1, nb - pb - 1)) * (NEED + OF) >= NEED * (na + nb)))


def _with_later(i):
    """Pairs of the i-th of the sets s with each behind it."""
    return F.transform(F.sequence(i + 1, F.size("s") - 1), lambda j: F.struct(F.get("s", i).alias("x"), F.get("s", j).alias("y")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", boundary: int | None = None) -> DataFrame:
    """id, n_shingles and component_id of each row of docs."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    total = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    counted = min(max(1 << (total // COUNTER_BYTES).bit_length(), LEAST_COUNTERS), MOST_COUNTERS)
    told = cut_lineage(named.mapInArrow(profile(counted), f"id {kind}, n int, hi long, lo long, slice int, counts binary"))
    rows = told.where("slice IS NULL").select("id", "n", "hi", "lo")
    # parts of the table are added in two steps, so that no task holds more than a few hundred of them
    parts = told.where("slice IS NOT NULL").select("slice", "counts", (F.spark_partition_id() / 256).cast("int").alias("some"))
    added = parts.groupBy("slice", "some").applyInPandas(add_up(counted // 64), "slice int, counts binary").groupBy("slice").applyInPandas(add_up(counted // 64), "slice int, counts binary")
    table = np.zeros(counted, dtype=np.uint32)
    for r in added.collect():  # 64 rows of bounded size
        table[r["slice"] * (counted // 64) :][: counted // 64] = unpacked(r["counts"], counted // 64)
    classes = cut_lineage(rows.where("n > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n")))
    if boundary is None:
        small = {r["n"]: r["count"] for r in classes.where(F.col("n") <= LIGHT).groupBy("n").count().collect()}
        boundary = choose_boundary(small, expected_partners(table))
    frequency = spark.sparkContext.broadcast(octaves(table))  # of bounded size
    del table
    listed = named.select("text").mapInArrow(entries(frequency, counted, boundary), "key long, hi long, n int, pos int")
    # a list's entry without a neighbour of fitting size, or a list of two that cannot link, ends here
    by_key, by_size = Window.partitionBy("key"), Window.partitionBy("key").orderBy("n")
    n, below, above = F.col("n").cast("long"), F.lag("n").over(by_size).cast("long"), F.lead("n").over(by_size).cast("long")
    near = F.coalesce(below * OF >= n * NEED, F.lit(False)) | F.coalesce(n * OF >= above * NEED, F.lit(False))
    place = F.struct("pos", "hi", "n")
    lists = listed.withColumn("near", near).where("near").withColumns(
        {"hub": F.min(place).over(by_key), "tail": F.max(place).over(by_key), "last": F.max("hi").over(by_key), "first": F.min("hi").over(by_key), "size": F.count("*").over(by_key)}
    )
    lists = lists.where("first < last").where((F.col("size") > 2) | possible("hub", "tail"))
    lists = cut_lineage(lists.select("key", "hi", "n", "pos", "hub").distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the classes of pairs (a, b) of class hashes, as ids of representatives."""
        pairs = cut_lineage(pairs)
        his = pairs.select(F.explode(F.array("a", "b")).alias("hi")).distinct()
        wanted = cut_lineage(classes.join(his, "hi", "left_semi"))
        ids = wanted.select(F.col("rep").alias("id")).distinct()
        few = wanted.count() <= MOST_BROADCAST
        if few:
            ids = F.broadcast(ids)
        known = wanted.select("hi", "lo", "rep")
        if few:
            known = F.broadcast(known)
        sets = named.join(ids, "id", "left_semi").mapInArrow(whole_sets, f"rep {kind}, hi long, lo long, shingles binary")
        # dealt by hi once: that serves both the distinct classes and the join below
        sets = sets.join(known, ["hi", "lo", "rep"], "left_semi").repartition("hi").dropDuplicates(["hi", "lo"])
        # each set is sent once to the places of its pairs, and from there to its pairs; a pair of one hash has both its sets
        ends = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("hi"))
        held = ends.join(sets, "hi").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("rep", "shingles"))).alias("s"))
        each = F.flatten(F.transform(F.sequence(F.lit(0), F.size("s") - 2), _with_later))
        both = held.where(F.size("s") > 1).select(F.explode(each).alias("p"))
        found = both.select(F.col("p.x.rep").alias("u"), F.col("p.y.rep").alias("v"), F.col("p.x.shingles").alias("x"), F.col("p.y.shingles").alias("y"))
        return cut_lineage(found.mapInArrow(linked, f"u {kind}, v {kind}"))

    ordered = (F.least("one.hi", "two.hi").alias("a"), F.greatest("one.hi", "two.hi").alias("b"))

    def stars(of: DataFrame) -> DataFrame:
        """Each member with the one hub that it shares most lists with: no more pairs than members."""
        pairs = of.select(F.struct("hi", "n", "pos").alias("one"), F.col("hub").alias("two")).where(F.col("one.hi") != F.col("two.hi")).where(possible("one", "two"))
        counted = pairs.groupBy(F.col("one.hi").alias("one"), F.col("two.hi").alias("two")).agg(F.count("*").alias("m"))
        best = counted.groupBy("one").agg(F.max(F.struct("m", "two")).alias("best")).select("one", F.col("best.two").alias("two"))
        return best.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()

    def coloured(links: DataFrame) -> DataFrame:
        """The entries of lists that hold several components; a component's colour is its least class hash."""
        members = components(links).join(classes.select("hi", "rep"), F.col("rep") == F.col("node"))
        colours = members.join(members.groupBy("component").agg(F.min("hi").alias("c")), "component").groupBy("hi").agg(F.min("c").alias("c"))
        colours = cut_lineage(colours)
        if colours.count() <= MOST_BROADCAST:
            colours = F.broadcast(colours)
        every = lists.join(colours, "hi", "left").select("key", "hi", "n", "pos", F.coalesce("c", "hi").alias("c"))
        several = every.withColumns({"low": F.min("c").over(by_key), "high": F.max("c").over(by_key)}).where("low < high")
        return cut_lineage(several.select("key", "hi", "n", "pos", "c"))

    clash = classes.groupBy("hi").agg(F.count("*").alias("m")).where("m > 1").select(F.col("hi").alias("a"), F.col("hi").alias("b"))
    tried = cut_lineage(stars(lists).unionByName(clash).distinct())
    links = verified(tried)
    left = coloured(links)
    one, two = left.alias("one"), left.alias("two")
    across = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("one.c") < F.col("two.c")) & possible("one", "two")).select(*ordered).distinct()
    more = verified(across.join(tried, ["a", "b"], "left_anti"))
    own = rows.join(classes.select("hi", "lo", "rep"), ["hi", "lo"], "left")
    # rows of one id with different texts: their classes hang together
    ids = own.groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    same = own.join(ids, "id").where("rep != low").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    reached = components(links.unionByName(more).unionByName(same))
    own = own.join(reached, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")))
    return own.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
