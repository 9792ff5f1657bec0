"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

DataFrame functions only. A document is contaminated by an item where one of its windows of the item's length in words has
a weighted shingle similarity of at least 0.8 with it (five words a shingle, weighted by its characters, as sets).

1. Which windows are fingerprinted (a lossless prefilter; all windows of all lengths would be too many). An item's rarest
   words (by their count in the whole corpus) are taken until the shingles that hold one carry over a fifth of the item's
   weight. A window that reaches 0.8 misses at most a fifth, so it holds such a shingle and with it an anchor; and the
   surroundings of each of its anchors hold at least 0.8 of the item's weight. Windows of an item's length about such
   places are formed, each once.
2. Windows get 64-bit SimHash fingerprints. Items are indexed by their length and by 8 blocks of 8 bits with all values
   within 2 bits; windows are joined with the index on (length, block, value). All items within RADIUS = 23 bits of a
   fingerprint are found that way, whichever item its anchor is of. (A window at similarity 0.8 expects 10 differing bits.)
3. Candidates within the radius are verified exactly.

Items come in blocks of bounded size (a stated query set against all rows); what is broadcast is one block. Texts are
keyed by a 128-bit hash, so copies are examined once, however many there are.

Defined cases: a null or empty text matches nothing; an item of fewer words than a shingle has no shingles and matches
nothing; a document shorter than an item has one window, itself; repeated rows and repeated items each get their pairs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import computed, cut_lineage, hash128, join_spread, lower_ascii
from .license_scan import words_of

#: Shingle length, similarity in hundredths, radius in bits (of 8 blocks, one is then within RADIUS // 8), and the words of
#: a block of items.
WORDS, NEED, RADIUS, BLOCK_WORDS = 5, 80, 23, 200_000


def weight(shingles: Column) -> Column:
    return F.char_length(F.array_join(shingles, "")).cast("long")


def shingles_of(words: Column) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda j: F.array_join(F.slice(words, j + 1, F.lit(WORDS)), " "))
    return F.when(F.size(words) >= WORDS, each).otherwise(F.array().cast("array<string>"))


def simhash(shingles: Column) -> Column:
    """Bit k is set where the shingles whose hash has bit k carry more than half of the weight. Two bits' sums to a long."""
    hashed = F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("h"), F.char_length(s).cast("long").alias("w")))
    high = F.lit(1 << 32).cast("long")

    def lanes(x: Column, k: int) -> Column:
        low = F.shiftrightunsigned(x["h"], 2 * k).bitwiseAND(F.lit(1).cast("long"))
        up = F.shiftrightunsigned(x["h"], 2 * k + 1).bitwiseAND(F.lit(1).cast("long"))
        return (low + up * high) * x["w"]

    zero = F.struct(*(F.lit(0).cast("long").alias(f"s{k}") for k in range(32)))
    sums = F.aggregate(hashed, zero, lambda a, x: F.struct(*((a[f"s{k}"] + lanes(x, k)).alias(f"s{k}") for k in range(32))))
    bits = F.transform(
        F.array(F.struct(sums.alias("s"), weight(shingles).alias("w"))),
        lambda x: _packed([(x["s"][f"s{k // 2}"] % high if k % 2 == 0 else F.shiftright(x["s"][f"s{k // 2}"], 32)) * 2 > x["w"] for k in range(64)]),
    )
    return F.get(bits, 0)


def _packed(bits: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for k, bit in enumerate(bits):
        one = 1 << k if k < 63 else -(1 << 63)
        out = out.bitwiseOR(F.when(bit, F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def choose_anchors(words: list[str], frequency: dict[str, int]) -> list[str]:
    parts = {tuple(words[j : j + WORDS]) for j in range(len(words) - WORDS + 1)}
    size = {p: len(" ".join(p)) for p in parts}
    total, covered, out = sum(size.values()), set(), []
    for word in sorted(set(words), key=lambda w: (frequency.get(w, 0), w)):
        if 100 * sum(size[p] for p in covered) > (100 - NEED) * total:
            break
        if own := {p for p in parts if word in p} - covered:
            covered |= own
            out.append(word)
    return out


#: Types of the columns of a block's tables.
_TYPES = {"word": pa.string(), "item": pa.int32(), "words": pa.list_(pa.string()), "item_words": pa.list_(pa.string()), "anchors": pa.list_(pa.string())}


def local_table(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A table of a block in the plan itself. A list of rows would start Python workers on the executors to convert it, which
    then wait there beside the heap."""
    return spark.createDataFrame(pa.table({name: pa.array(values, _TYPES[name]) for name, values in columns.items()}))


def _matches(texts: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    """h1, h2, item, similarity for texts (h1, h2, words) and one block of items (number, words)."""
    spark = texts.sparkSession
    vocabulary = local_table(spark, {"word": sorted({w for _, ws in items for w in ws})})
    counted = texts.select(F.explode("words").alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}  # at most the words of a block
    chosen = [(number, words, choose_anchors(words, frequency)) for number, words in items]
    anchors = sorted({a for *_, own in chosen for a in own})
    longest = max(len(words) for _, words in items)
    table = local_table(spark, dict(zip(("item", "item_words", "anchors"), zip(*chosen))))
    table = table.withColumn("own", F.array_distinct(shingles_of(F.col("item_words")))).withColumns({"need": weight(F.col("own")), "mark": simhash(F.col("own")), "n": F.size("item_words")})
    by_anchor = table.select("item", "n", "anchors", "own", "need", F.explode("anchors").alias("word"))
    masks = sorted({a | b for a in (0, *(1 << k for k in range(8))) for b in (0, *(1 << k for k in range(8)))})
    near = F.array(*(F.lit(m) for m in masks))
    values = F.concat(*(F.transform(near, _valued(F.col("mark"), b)) for b in range(8)))
    index = table.select("n", "item", "mark", F.explode(values).alias("v")).select("n", "item", "mark", "v.*")

    # one word of each text at a time meets the anchors; what lies about a place is cut out only where one is met
    words = F.col("words")
    known = local_table(spark, {"word": anchors})
    start = F.greatest(F.col("pos") - (longest - 1), F.lit(0))
    places = texts.select("h1", "h2", words, F.posexplode(words).alias("pos", "word")).join(F.broadcast(known), "word")
    places = places.select("h1", "h2", "word", "pos", start.alias("start"), F.slice(words, start + 1, F.col("pos") - start + longest).alias("region"))
    # copies of a text end here; a fixed number of parts deals the places out evenly, as few bytes are much work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = places.repartition(tasks, "h1", "h2", "pos").dropDuplicates(["h1", "h2", "pos"])
    places = computed(places, parts=shingles_of(F.col("region")), at=F.col("pos") - F.col("start"))
    found = places.join(F.broadcast(by_anchor), "word")
    found = found.where(weight(F.array_intersect("own", "parts")) * 100 >= F.col("need") * NEED)
    before = F.filter(F.sequence(F.lit(0), F.col("at")), lambda i: (i < F.col("at")) & F.array_contains(F.col("anchors"), F.get(F.col("region"), i)))
    low = F.greatest(F.col("at") - F.col("n") + 1, F.coalesce(F.array_max(before) + 1, F.lit(0)), F.lit(0))
    top = F.greatest(F.least(F.col("at"), F.size("region") - F.col("n")), F.lit(0))
    found = computed(found, low=low, top=top).where("low <= top")
    windows = found.select("h1", "h2", "n", "start", "parts", F.explode(F.sequence("low", "top")).alias("s"))
    window = F.array_distinct(F.slice("parts", F.col("s") + 1, F.greatest(F.col("n") - (WORDS - 1), F.lit(0))))
    windows = windows.select("h1", "h2", "n", (F.col("start") + F.col("s")).alias("first"), window.alias("window"))
    windows = windows.repartition(tasks, "h1", "h2", "first", "n").dropDuplicates(["h1", "h2", "first", "n"])
    windows = computed(windows, print=simhash(F.col("window")))

    blocks = F.array(*(F.struct(F.lit(b).alias("block"), _bits(F.col("print"), b).alias("value")) for b in range(8)))
    looked = windows.select("h1", "h2", "n", "first", "print", "window", F.explode(blocks).alias("v")).select("h1", "h2", "n", "first", "print", "window", "v.*")
    close = looked.join(F.broadcast(index), ["n", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("mark"))) <= RADIUS)
    # a pair that agrees in several blocks is verified at the first of them
    moved = [F.bit_count(_bits(F.col("print").bitwiseXOR(F.col("mark")), b)) <= RADIUS // 8 for b in range(8)]
    least = F.coalesce(*(F.when(m, F.lit(b)) for b, m in enumerate(moved)))
    close = close.where(least == F.col("block")).drop("n").join(F.broadcast(table.select("item", "own", "need")), "item")
    close = computed(close, both=weight(F.array_intersect("window", "own")), size=weight(F.col("window")))
    close = close.withColumn("all", F.col("size") + F.col("need") - F.col("both"))
    close = close.where("both > 0").where(F.col("both") * 100 >= F.col("all") * NEED)
    return close.groupBy("h1", "h2", "item").agg(F.max(F.col("both") / F.col("all")).alias("similarity"))


def _bits(mark: Column, b: int) -> Column:
    """The b-th block of 8 bits."""
    return F.shiftrightunsigned(mark, 8 * b).bitwiseAND(F.lit(255).cast("long")).cast("int")


def _valued(mark: Column, b: int):
    return lambda m: F.struct(F.lit(b).alias("block"), _bits(mark, b).bitwiseXOR(m).alias("value"))


def matching_texts(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(matches of distinct texts: h1, h2, item number, similarity; items with their numbers)."""
    spark = docs.sparkSession
    lowered = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    h1, h2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    texts = computed(docs.select(h1.alias("h1"), h2.alias("h2"), lowered.alias("low")), words=words_of(F.col("low"))).drop("low")
    tokens = words_of(lower_ascii(F.coalesce(F.col(item_text), F.lit(""))))
    each = items.select(tokens.alias("words")).where(F.size("words") >= WORDS).distinct()
    total = each.agg(F.sum(F.size("words"))).first()[0] or 0
    parts, out = total // BLOCK_WORDS + 1, None
    keyed = []
    for part in range(parts):
        rows = each.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part).collect()  # about BLOCK_WORDS words
        block = [(k, list(r["words"])) for k, r in enumerate(sorted(rows, key=lambda r: list(r["words"])))]
        if not block:
            continue
        numbered = local_table(spark, dict(zip(("item", "words"), zip(*block)))).withColumn("item_hash", F.xxhash64("words", F.lit(1)))
        keyed.append(numbered.select("item", "item_hash", "words"))
        match = _matches(texts, block).join(F.broadcast(numbered.select("item", "item_hash", "words")), "item").drop("item")
        out = match if out is None else out.unionByName(match)
    if out is None:
        out = spark.createDataFrame([], "h1 long, h2 long, similarity double, item_hash long, words array<string>")
    return cut_lineage(out), tokens


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs id, item_id, similarity: each row of docs with each item that one of its windows matches."""
    matches, tokens = matching_texts(docs, items, text_col, item_text)
    named = items.select(F.col(item_id).alias("item_id"), tokens.alias("words"))
    h1, h2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"))
    # a text's matches are few (the items it holds); they are repeated for the salts, not the rows
    pairs = join_spread(rows, matches, ["h1", "h2"], "inner").join(named, "words")
    return pairs.select(F.col("id").alias(id_col), "item_id", "similarity")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of docs whose text no item matches, with all their columns."""
    matches, _ = matching_texts(docs, items, text_col, item_text)
    bad = matches.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    h1, h2 = hash128(F.coalesce(F.col(text_col), F.lit("")))
    return join_spread(docs.withColumns({"__h1": h1, "__h2": h2}), bad, ["__h1", "__h2"], "left_anti").select(*docs.columns)
