import hashlib
from collections import Counter, defaultdict

from scorelake.llm.common import LOWER, UPPER
from scorelake.llm.line_dedup import line_dedup


def brute(rows, min_docs=2):
    fold = str.maketrans(UPPER, LOWER)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held[key(line)].add(i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if i is None or len(held[key(x)]) < min_docs or min(held[key(x)]) == i]
        out[i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()] += 1
    return out


def test_against_brute_force(spark, odd, empty):
    assert line_dedup(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for n in (2, 3):
        got = line_dedup(odd, min_docs=n)
        assert set(odd.columns) <= set(got.columns)
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got.collect()) == brute(rows, n)
