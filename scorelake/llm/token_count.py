"""Token counts with overlap resynchronisation.

A position is a *stable boundary* where a character other than a space is followed by a space. No piece of the vocabulary
holds a space after another character (proven piece by piece when the model is loaded), and merges only ever make pieces
of the vocabulary, so no merge crosses such a position: what lies left and right of it is encoded independently.

* A document of more than one chunk is encoded in overlapping chunks, with the offset of each token. Two neighbours are
  spliced at a stable boundary inside their overlap at which both encodings start a token. Where they have none in common
  the overlap is doubled, at last to the rest of the document.
* Inside a document of one chunk, stable segments repeat over a corpus, so their counts are remembered (a bounded table);
  the sum over segments is the library's count by the same proof. This saves time and changes no count.

The model's own normaliser is read from the model file: it must map no characters, keep all white space and mark words by
a leading space. Where that or the proof fails, documents are encoded whole by the library.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows get equal counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

SPACE = "▁"
_runs = re.compile(" *[^ ]+| +$")


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message: an int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind, size = key & 7, 0
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def keeps_texts(model_file: str) -> bool:
    """Whether the model's normaliser leaves texts as they are, but for the marker of spaces and one before the text.

    Fixed values: field 3 of the model is its normaliser, whose fields are 2: character map, 3: marker before the text,
    4: extra spaces removed, 5: spaces marked (these three are on where absent)."""
    with open(model_file, "rb") as f:
        spec = next((value for number, value in fields(f.read()) if number == 3), b"")
    own = dict(fields(spec))
    return not own.get(2) and own.get(3, 1) == 1 and own.get(4, 1) == 0 and own.get(5, 1) == 1


class Counter:
    def __init__(self, model_file: str, chunk_chars: int = 2_048, overlap: int = 128, most_segments: int = 1_000_000):
        import numpy as np
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        probe = "  a \n\tb  c éﬁ é "
        self.surface = np.array([1 if self.library.is_byte(i) else len(p.encode()) - 2 * p.count(SPACE) for i, p in enumerate(pieces)])
        self.proven = keeps_texts(model_file) and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.chunk, self.overlap = chunk_chars, overlap
        self.most = most_segments
        self.known: dict[str, int] = {}

    def segments(self, text: str) -> list[str]:
        """Stable segments without the space that each but the first starts with: the library's marker stands for it."""
        if "  " in text or text[0] == " ":
            first, *rest = _runs.findall(text)
            return [first, *(s[1:] for s in rest)]
        return text.split(" ")

    def count_all(self, texts: list[str]) -> list[int]:
        """Token counts. Segments not yet known go to the library in one call."""
        short = [self.proven and 0 < len(t) <= self.chunk and SPACE not in t for t in texts]
        parts = [self.segments(t) if ok else () for t, ok in zip(texts, short)]
        if len(self.known) > self.most:
            self.known.clear()
        self.known[""] = 1  # a single space at the end
        get, totals, missing = self.known.get, [], {}
        for i, segments in enumerate(parts):
            counts = list(map(get, segments))
            if None in counts:
                for s, n in zip(segments, counts):
                    if n is None:
                        missing.setdefault(s, []).append(i)
                totals.append(sum(filter(None, counts)))
            else:
                totals.append(sum(counts))
        for (s, rows), ids in zip(missing.items(), self.library.encode(list(missing), num_threads=1)):
            self.known[s] = n = len(ids)
            for i in rows:
                totals[i] += n
        return [n if ok else self.count(t) for t, n, ok in zip(texts, totals, short)]

    def count(self, text: str) -> int:
        if not self.proven or SPACE in text or len(text) <= self.chunk:
            return len(self.library.encode(text))
        return self.spliced(text)

    def starts(self, text: str, at: int, end: int):
        """Byte offsets, from `at` on, at which the encoding of text[at:end] starts a token, and their number."""
        import numpy as np

        ids = self.library.encode(text[at:end])
        ends = np.cumsum(self.surface[ids]) - 1  # less the marker that the library puts before a text
        return np.concatenate(([0], ends[:-1])), len(ids)

    def spliced(self, text: str) -> int:
        import numpy as np

        total, at, done = 0, 0, 0  # done: tokens of the current chunk that the chunk before has counted
        begin, n = self.starts(text, 0, min(len(text), self.chunk))
        end = min(len(text), self.chunk)
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(at, end - overlap)
                stop = min(len(text), start + max(self.chunk, 2 * overlap))
                other, m = self.starts(text, start, stop)
                shift = len(text[at:start].encode())
                zone = text[start:end].encode()
                stable = [i for i in range(1, len(zone)) if zone[i] == 32 and zone[i - 1] != 32]
                common = np.intersect1d(np.intersect1d(np.array(stable, dtype=np.int64) + shift, begin), other + shift) if stable else np.array([], dtype=np.int64)
                if len(common):
                    cut = int(common[len(common) // 2])
                    total += int(np.searchsorted(begin, cut)) - done
                    done = int(np.searchsorted(other, cut - shift))
                    at, end, begin, n = start, stop, other, m
                    break
                if start == at:  # no boundary in the whole chunk: it grows
                    if stop == end:
                        stop = min(len(text), end + overlap)
                    begin, n = self.starts(text, at, stop)
                    end = stop
                    break
                overlap *= 2
        return total + n - done


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, **counter) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of each row; model_file is read by every worker from the same path."""
    kept = docs.select(id_col, text_col)
    kind = kept.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Counter(model_file, **counter)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = encoder.count_all(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return kept.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
