"""Packing: cost-balanced assignment of tokenised documents to sequences.

A piece of n tokens costs linear * n + quadratic * n**2 (attention within the piece). Documents are cut at multiples of
the capacity; full pieces are sequences of their own. The rest is dealt by hash to buckets of about bucket_bytes of text;
in a bucket, pieces go in descending order to the cheapest sequence that has room for them. A bucket opens just as many
sequences as its tokens need, so a piece that fits nowhere whole is cut into the widest gaps, and only the last sequence
of a bucket is padded: under 2048 of about two million tokens.

Ids: the library's byte-level BPE. Where the vocabulary file proves that merge order is id order (it is then a rank file),
ids come from the rank encoder with the same pattern, which gives equal ids several times faster.

Defined cases: a null or empty text is the end token alone; repeated rows (also of one id) are documents of their own; an
empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import Tuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, slices


def byte_alphabet() -> dict[str, int]:
    """Characters that a byte-level vocabulary writes for the 256 bytes: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(vocabulary: str, pattern: str | None = None):
    """A function from texts to lists of ids, without added tokens and without special meaning of any string."""
    with open(vocabulary) as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"] for t in spec.get("added_tokens", ())}
    ids, alphabet = model["vocab"], byte_alphabet()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [ids[a + b] for a, b in merges]
    ranked = made == sorted(made) and len(set(made)) == len(made) and max([ids[c] for c in alphabet]) < min(made)
    plain = (spec.get("normalizer"), (spec.get("pre_tokenizer") or {}).get("type"), (spec.get("pre_tokenizer") or {}).get("add_prefix_space"))
    if pattern and ranked and plain == (None, "ByteLevel", False):
        import tiktoken

        ranks = {bytes(alphabet[c] for c in token): i for token, i in ids.items() if token not in special}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [fast.encode_ordinary(t) for t in texts]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.encode_special_tokens = True
    return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def assign(lengths, capacity: int, linear: float, quadratic: float):
    """(piece, start in it, length, sequence, offset) for pieces shorter than capacity; as few sequences as their tokens need."""
    import numpy as np

    total = int(sum(lengths))
    if not total:
        return []
    n = -(-total // capacity)
    room = np.full(n, capacity, dtype=np.int64)
    room[-1] = total - capacity * (n - 1)
    size, cost, out, late = room.copy(), np.zeros(n), [], []
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])

    def put(i: int, start: int, length: int, k: int) -> None:
        out.append((i, start, length, k, int(size[k] - room[k])))
        room[k] -= length
        cost[k] += linear * length + quadratic * length * length

    for i in order:
        open_cost = np.where(room >= lengths[i], cost, np.inf)
        k = int(open_cost.argmin())
        if open_cost[k] < np.inf:
            put(i, 0, lengths[i], k)
        else:
            late.append(i)
    gaps = sorted(np.flatnonzero(room), key=lambda k: -room[k])
    at = 0
    for i in late:
        start = 0
        while start < lengths[i]:
            k = gaps[at]
            length = int(min(room[k], lengths[i] - start))
            put(i, start, length, k)
            start += length
            at += room[k] == 0
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    bucket_bytes: int = 4 << 20,
    salt_col: str | None = None,
) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    salt_col: a long that a second read of the row repeats; it deals pieces of equal id and tokens to several buckets."""
    salt = F.col(salt_col) if salt_col else F.lit(0)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), salt.cast("long").alias("salt"))
    total = named.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = total // bucket_bytes + 1
    kind = named.schema["doc_id"].dataType.simpleString()

    @gives_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = encoder(vocabulary, pattern)
        for batch in slices(batches, 1):
            keys, rows = batch.column(0), ([], [], [], [], [], [])
            for k, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids.append(end_id)
                tokens = np.array(ids, dtype="<u4")
                for start in range(0, len(ids), capacity):
                    part = tokens[start : start + capacity]
                    whole = len(part) == capacity
                    row = (k, start, len(part), zlib.crc32(part.tobytes()), len(ids), None if whole else part.astype("<u2").tobytes() if part.max() < 65536 else part.tobytes())
                    for column, value in zip(rows, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [keys.take(at := pa.array(rows[0], pa.int32())), *(pa.array(c, pa.int64()) for c in rows[1:5]), pa.array(rows[5], pa.binary()), batch.column(2).take(at)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "salt"],
            )

    def place(key: Tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        length, crc, ids, start = (table.column(c).to_pylist() for c in ("length", "ids_crc32", "ids", "start"))
        full = [i for i, n in enumerate(length) if n == capacity]
        rest = [i for i, n in enumerate(length) if n < capacity]
        out = [(i, start[i], capacity, crc[i], k, 0) for k, i in enumerate(full)]
        for r, begin, n, k, offset in assign([length[i] for i in rest], capacity, linear, quadratic):
            i = rest[r]
            sum32 = crc[i]
            if n < length[i]:
                tokens = np.frombuffer(ids[i], dtype="<u2" if len(ids[i]) == 2 * length[i] else "<u4")
                sum32 = zlib.crc32(tokens[begin : begin + n].astype("<u4").tobytes())
            out.append((i, start[i] + begin, n, sum32, len(full) + k, offset))
        columns = list(zip(*out))
        rows, first = pa.array(columns[0], pa.int32()), key[0].as_py() << 32
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(rows),
                "start": pa.array(columns[1], pa.int64()),
                "length": pa.array(columns[2], pa.int64()),
                "ids_crc32": pa.array(columns[3], pa.int64()),
                "doc_tokens": table.column("doc_tokens").take(rows),
                "sequence_id": pa.array([first + k for k in columns[4]], pa.int64()),
                "offset": pa.array(columns[5], pa.int64()),
            }
        )

    pieces = named.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, salt long")
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(buckets)).cast("long")).drop("salt")
    packed = dealt.groupBy("bucket").applyInArrow(
        place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return packed.withColumnRenamed("doc_id", id_col)
