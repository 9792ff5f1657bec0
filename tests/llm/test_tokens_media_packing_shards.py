import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from scorelake.llm import media, packing, queries, sharding, token_count
from scorelake.llm.common import documents

from .conftest import odd_texts


def whole(model, text):
    return len(model.encode(text or ""))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))


def test_token_counts_equal_the_library(spark, odd, empty, library):
    path = queries.vocabulary("piece_bpe_32k.model")
    assert token_count.token_counts(empty, path).count() == 0
    got = token_count.token_counts(odd, path, limit=100).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == Counter(
        (r["doc_id"], len(t.encode()), n, n > 100) for r, t in zip(odd.collect(), texts) for n in [whole(library, t)]
    )


def test_normaliser_is_read_from_the_model(tmp_path):
    path = queries.vocabulary("piece_bpe_32k.model")
    assert token_count.keeps_texts(path)
    spec = lambda *parts: bytes([26, len(body := b"".join(parts))]) + body
    for n, (parts, keeps) in enumerate([((b"\x20\x00",), True), ((b"\x20\x01",), False), ((b"\x12\x02ab", b"\x20\x00"), False), ((b"\x18\x00\x20\x00",), False), ((), False)]):
        (file := tmp_path / f"m{n}").write_bytes(spec(*parts))
        assert token_count.keeps_texts(str(file)) == keeps


def test_splices_of_chunks_equal_whole_texts(library):
    counter = token_count.Counter(queries.vocabulary("piece_bpe_32k.model"), chunk_chars=20, overlap=3)
    assert counter.proven
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "😀", "▁", "<s>", "x" * 30, " b", ","]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        assert counter.count_all([text]) == [whole(library, text)], repr(text)


def test_media_round_trip(spark, odd, empty):
    assert media.media_columns(empty).count() == 0
    got = media.media_columns(odd).collect()
    assert len(got) == odd.count()
    want = Counter()
    for r in odd.collect():
        payload, n = media.payload_of(r["text"])
        medium = media.wav(payload)
        want[(r["doc_id"], n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), media.feature(payload))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], *(r[c] for c in media.MEDIA_NAMES[1:])) for r in got) == want


def test_media_by_an_independent_reader(spark):
    """The stored form's fields read from its bytes, without the module's reader."""
    import struct

    for text in ("", "abc", "Straße " * 9000):
        payload, n = media.payload_of(text)
        medium = media.wav(payload)
        riff, size, wave_, fmt, length, kind, channels, rate, _, _, bits, data, held = struct.unpack("<4sI4s4sIHHIIHH4sI", medium[:44])
        assert (riff, wave_, fmt, data) == (b"RIFF", b"WAVE", b"fmt ", b"data") and size == len(medium) - 8
        assert (length, kind, channels, rate, bits, held) == (16, 1, 1, media.RATE, 8, len(payload)) and medium[44:] == payload
        assert payload == text.encode() + bytes(len(payload) - n) and len(payload) % 64 == 0 and len(payload) > 0 and len(payload) - n < 64 + 64 * (n == 0)


def test_a_lost_or_moved_chunk_is_seen():
    import pyarrow as pa
    import zstandard

    parts = [b"a" * 64, b"b" * 64]
    names, blobs = [hashlib.sha256(p).digest() for p in parts], [zstandard.ZstdCompressor().compress(p) for p in parts]
    recipe = hashlib.sha256(b"".join(names)).digest()
    kinds = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
    batch = lambda n, b: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(([recipe], [n], [b]), kinds)], ["recipe", "digests", "blobs"])
    assert next(media.rebuilt(iter([batch(names, blobs)]))).num_rows == 1
    for n, b in ((names[:1], blobs[:1]), (names[::-1], blobs[::-1]), (names, blobs[::-1])):
        with pytest.raises(ValueError):
            list(media.rebuilt(iter([batch(n, b)])))


def test_cuts_follow_the_rolling_hash():
    table, rng = media.gear(), random.Random(3)
    data = rng.randbytes(60_000)
    ends = media.cuts(data, table, least=64, most=2048, bits=8)
    h, want, start = 0, [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(table[b])) & 0xFFFF
        if len(data) - start > 64 and (i + 1 - start >= 64 and h & 0xFF == 0 or i + 1 - start == 2048):
            want.append(i + 1)
            start = i + 1
    assert ends == want + [len(data)] * (start < len(data))
    moved = media.cuts(b"inserted" + data, table, least=64, most=2048, bits=8)
    assert len({e - 8 for e in moved} & set(ends)) > len(ends) // 2


def test_packing_places_each_id_once(spark, odd, empty, sf):
    args = (queries.vocabulary("byte_bpe_50k.json"), queries.bpe_pattern())
    assert packing.pack(empty, *args).count() == 0
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(args[0])
    library.encode_special_tokens = True
    for docs in (odd, documents(spark, sf)):
        pieces, sequences, total = defaultdict(list), defaultdict(list), 0
        for r in packing.pack(docs, *args, bucket_bytes=200_000).collect():
            pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            total += r["length"]
        texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
        want = Counter()
        for (doc_id, text), n in texts.items():
            ids = [*library.encode(text, add_special_tokens=False).ids, 1]
            crc = lambda a, b: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))  # noqa: E731, B023
            own = pieces[doc_id, len(ids)]
            assert {(a, n_, c) for a, n_, c in own} >= {(a, n_, crc(a, a + n_)) for a, n_, c in own} or len([k for k in texts if k[0] == doc_id]) > 1
            want[doc_id, len(ids)] += n * len(ids)
        assert {k: sum(n for _, n, _ in v) for k, v in pieces.items()} == dict(want)
        for s in sequences.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(sequences) * 2048 - total <= 2048 * (total // 40_000 + 8)


def test_pieces_tile_their_documents(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["one", "two", "Straße", "x" * 9], k=rng.choice([1, 50, 700, 3000]))), i % 3) for i in range(60)], "doc_id long, text string, bucket int")
    pieces, tokens = defaultdict(list), {}
    for r in packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), queries.bpe_pattern(), bucket_bytes=50_000, salt_col="doc_id").collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        tokens[r["doc_id"]] = r["doc_tokens"]
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at
            at += length
        assert at == tokens[i]
    assert set(pieces) == set(range(60))


def test_cost_is_spread_better_than_by_first_fit():
    """Against first fit of the same descending pieces. A piece longer than half a sequence sets its sequence's cost, so
    the pieces here are shorter."""
    rng = random.Random(6)
    lengths = [min(900, int(rng.paretovariate(1.1) * 40)) for _ in range(4000)]
    cost = lambda n: n + n * n / 2048
    balanced = defaultdict(float)
    for _, _, n, k, _ in packing.assign(lengths, 2048, 1.0, 1 / 2048):
        balanced[k] += cost(n)
    room, fitted = [], []
    for n in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(2048)
            fitted.append(0.0)
        room[k] -= n
        fitted[k] += cost(n)
    mean = lambda costs: sum(costs) / len(costs)
    dev = lambda costs: (sum((c - mean(costs)) ** 2 for c in costs) / len(costs)) ** 0.5
    assert dev(sorted(balanced.values())[1:]) < dev(sorted(fitted)[1:]) / 2


def test_full_sequences_balance_cost():
    rng = random.Random(4)
    lengths = [rng.randint(1, 2047) for _ in range(500)]
    placed = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    fill, got = Counter(), Counter()
    for i, start, n, k, offset in placed:
        fill[k] += n
        got[i] += n
    assert [got[i] for i in range(500)] == lengths
    assert sorted(fill.values())[1:] == [2048] * (len(fill) - 1)


def test_flow_moves_the_fewest_bytes():
    """Against the closed form for one class a shard: a shard above its share sends just its excess."""
    blocks = [(0, 0, 50, 500), (0, 1, 10, 1000), (1, 0, 5, 50), (2, 0, 6, 60), (5, 0, 9, 90)]
    spans = sharding.plan_transfers(blocks, 4)
    rows, moved = Counter(), 0
    for old, cls, lo, hi, shard, _ in spans:
        rows[shard] += hi - lo
        size = next(b[3] / b[2] for b in blocks if b[:2] == (old, cls))
        moved += (hi - lo) * size * (old != shard)
    assert sum(rows.values()) == 80 and max(rows.values()) - min(rows.values()) <= 1
    assert moved == (40 + 9) * 10  # shard 0 keeps its ten large rows and ten small ones; 5 is no longer a shard


def test_resharding(spark, odd, empty, sf, tmp_path):
    old = F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "utf-8")), F.lit(6))
    assert sharding.reshard(empty, old, 4).count() == 0
    for docs in (odd, documents(spark, sf)):
        got = sharding.reshard(docs, old, 5, bucket_rows=7).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        shards = defaultdict(list)
        for r in got:
            shards[r["shard"]].append(r["slot"])
        assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and set(shards) == set(range(5))
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    docs = documents(spark, sf).withColumns({"shard": F.lit("x"), "slot": F.lit(1), "size": F.lit("y"), "spans": F.lit(2)})
    moved = sharding.reshard(docs, old, 5).cache()
    path = str(tmp_path / "shards")
    sharding.rewrite_affected(moved, path)
    rows = moved.select("doc_id", "text", "shard", "slot", "old_shard", "spans").collect()
    touched = {s for r in rows if r["shard"] != r["old_shard"] for s in (r["shard"], r["old_shard"])}
    back = spark.read.parquet(path).select("doc_id", "text", "shard", "slot", "old_shard", "spans").collect()
    assert Counter(map(tuple, back)) == Counter(tuple(r) for r in rows if r["shard"] in touched)


def test_the_fewest_bytes_move(spark):
    """Against enumeration: each old shard must lose so many rows, and its smallest are the fewest bytes."""
    rng = random.Random(9)
    rows = [(i, "z" * rng.choice([0, 3, 5, 40, 41, 300, 301, 302, 2000]), rng.choice([0, 0, 0, 1, 2, 4])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int")
    got = sharding.reshard(docs, F.col("old"), 4, bucket_rows=3).select("size", "old_shard", "shard").collect()
    moved = sum(r["size"] for r in got if r["old_shard"] != r["shard"])
    least = 0
    for shard in {o for *_, o in rows}:
        sizes = sorted(len(t) + 1 for _, t, o in rows if o == shard)
        least += sum(sizes[: len(sizes) - 60] if shard < 4 and len(sizes) > 60 else sizes if shard >= 4 else [])
    assert moved == least
