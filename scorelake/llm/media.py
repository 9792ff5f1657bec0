"""Media columns: content-defined payload chunking.

A text's bytes, padded with zeros to a positive multiple of 64, are the payload: 8-bit samples of a mono WAV file. A
rolling gear hash cuts payloads where its low bits are zero. Chunks are named by their SHA-256; Spark joins keep each
digest once, and an ordered chunk list (a recipe) per distinct payload rebuilds the medium, which is read back, checked
against every digest and measured.

Rows move as digests; chunk bytes move once to their digest, compressed. Recipes of a single chunk are rebuilt where their
chunk lies; only larger ones are brought together, one payload to a group, so no group is larger than one document.
Copies share one recipe, so a text that a third of all rows hold is rebuilt once.

Defined cases: a null or empty text is 64 zero bytes; repeated rows get equal values; a null id stays null.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Chunk sizes in bytes (least, most) and the bits of the gear hash that are zero at a cut: 16 KiB apart on average.
LEAST, MOST, BITS, RATE = 4096, 65536, 14, 8000


def gear():
    """256 fixed random words: the first bytes of SHA-256 of each byte value."""
    import numpy as np

    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:2], "little") for b in range(256)], dtype=np.uint16)


def cuts(payload: bytes, table, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the payload's chunks. hash = (hash << 1) + gear[byte]: its low 16 bits depend on the last 16 bytes alone,
    so four doublings compute them for all positions at once."""
    import numpy as np

    n = len(payload)
    if n <= least:
        return [n]
    h = table[np.frombuffer(payload, dtype=np.uint8)]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << step
        h = h + shifted
    spots = np.flatnonzero((h & np.uint16((1 << bits) - 1)) == 0) + 1
    ends, at = [], 0
    while n - at > least:
        i = int(np.searchsorted(spots, at + least))
        end = min(int(spots[i]) if i < len(spots) else n, at + most, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples(medium: bytes) -> bytes:
    with wave.open(io.BytesIO(medium)) as w:
        return w.readframes(w.getnframes())


def feature(payload: bytes) -> str:
    """Mean level, root mean square about it, share of crossings of the middle, and distinct samples."""
    import numpy as np

    x = np.frombuffer(payload, dtype=np.uint8)
    mean = int(x.sum(dtype=np.int64)) / len(x)
    power = int((x.astype(np.int64) ** 2).sum()) / len(x) - mean * mean
    high = x >= 128
    return f"mean={mean:.4f};rms={max(power, 0.0) ** 0.5:.4f};cross={np.count_nonzero(high[1:] != high[:-1]) / len(x):.6f};distinct={np.count_nonzero(np.bincount(x, minlength=256))}"


def chunked(docs: DataFrame, with_bytes: bool) -> DataFrame:
    """with_bytes: digest and compressed bytes of the chunks, each digest once a task as far as a bounded memory reaches.
    Else id, payload digest, n_bytes and the ordered chunk digests of each row."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table, squeeze, seen = gear(), zstandard.ZstdCompressor(level=3), set()
        for batch in slices(batches, 1):
            digests, blobs, rows = [], [], ([], [], [])
            for text in batch.column(1).to_pylist():
                payload, n = payload_of(text)
                at, own = 0, []
                for end in cuts(payload, table):
                    part = payload[at:end]
                    own.append(digest := hashlib.sha256(part).digest())
                    if with_bytes and digest not in seen:
                        if len(seen) >= 200_000:
                            seen.clear()
                        seen.add(digest)
                        digests.append(digest)
                        blobs.append(squeeze.compress(part))
                    at = end
                if not with_bytes:
                    for column, value in zip(rows, (hashlib.sha256(b"".join(own)).digest() if len(own) > 1 else own[0], n, own)):
                        column.append(value)
            if with_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["digest", "bytes"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.binary()))],
                    ["id", "recipe", "n_bytes", "chunks"],
                )

    return docs.mapInArrow(run, "digest binary, bytes binary" if with_bytes else f"id {kind}, recipe binary, n_bytes long, chunks array<binary>")


def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """recipe, chunks (digest, bytes in order) -> the medium's digests and features, read back from its stored bytes."""
    import zstandard

    open_up = zstandard.ZstdDecompressor()
    for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
        rows = ([], [], [], [], [], [], [])
        for recipe, names, blobs in zip(*(batch.column(i).to_pylist() for i in range(3))):
            parts = [open_up.decompress(b) for b in blobs]
            for name, part in zip(names, parts):
                if hashlib.sha256(part).digest() != name:
                    raise ValueError(f"a stored chunk differs from its digest {name.hex()}")
            if (hashlib.sha256(b"".join(names)).digest() if len(names) > 1 else names[0]) != recipe:
                raise ValueError(f"the chunks found are not those of recipe {recipe.hex()}")
            medium = wav(b"".join(parts))
            back = samples(medium)
            row = (recipe, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), feature(back))
            for column, value in zip(rows, row):
                column.append(value)
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], MEDIA_NAMES)


MEDIA_NAMES = ["recipe", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
MEDIA_SCHEMA = "recipe binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def chunk_store(docs: DataFrame) -> DataFrame:
    """digest, bytes (zstandard): each chunk of the corpus once."""
    return chunked(docs, True).dropDuplicates(["digest"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the columns measured on the rebuilt medium, a row for each row of docs."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = chunked(named, False)
    store = chunk_store(named)
    recipes = lists.select("recipe", "chunks").dropDuplicates(["recipe"])
    single = recipes.where(F.size("chunks") == 1).select("recipe", F.col("chunks")[0].alias("digest"))
    several = recipes.where(F.size("chunks") > 1).select("recipe", F.posexplode("chunks").alias("pos", "digest"))
    wanted = single.select("recipe", F.lit(0).alias("pos"), "digest", F.lit(True).alias("alone")).unionByName(several.withColumn("alone", F.lit(False)))
    found = wanted.join(store, "digest")
    alone = found.where("alone").select("recipe", F.array("digest").alias("digests"), F.array("bytes").alias("blobs"))
    parts = found.where("NOT alone").groupBy("recipe").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("parts"))
    together = parts.select("recipe", F.col("parts.digest").alias("digests"), F.col("parts.bytes").alias("blobs"))
    media = alone.unionByName(together).mapInArrow(rebuilt, MEDIA_SCHEMA)
    out = lists.select("id", "recipe", "n_bytes").join(media, "recipe", "left")
    lost = F.raise_error(F.concat(F.lit("no medium for recipe "), F.hex("recipe")))
    out = out.withColumn("payload_sha256", F.when(F.col("payload_sha256").isNull(), lost).otherwise(F.col("payload_sha256"))).drop("recipe")
    return out.withColumnRenamed("id", id_col)

