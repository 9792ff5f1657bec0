import random
import re
from collections import Counter

import pytest

from scorelake.llm import ngram_join
from scorelake.llm.common import LOWER, UPPER, documents
from scorelake.llm.components import components


def brute(rows):
    fold = str.maketrans(UPPER, LOWER)
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i, _ in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, a in enumerate(sets):
        if ids[i] is None or not a:
            continue
        near = Counter(j for x in a for j in holders[x] if j < i and ids[j] is not None)
        for j, both in near.items():
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for j in range(i):
            if ids[j] == ids[i] and sets[j]:
                parent[root(i)] = root(j)
    low = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return Counter((ids[i], len(sets[i]), low.get(root(i)) if ids[i] is not None else None) for i in range(len(rows)))


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = [f"new{rng.randint(0, 10**6)}"] * rng.randint(0, 1)
    return w


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(400)]
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([3, 5, 6, 7, 8, 9, 10, 12, 16, 30, 80, 200]))
        for _ in range(rng.randint(1, 12)):
            rows.append((len(rows) + 5, " ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 20))))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("boundary", [None, 0, 9])
def test_against_brute_force(spark, near, boundary):
    docs = spark.createDataFrame(near, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs, boundary=boundary).collect())
    assert got == brute(near)


def test_odd_texts(spark, odd, empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(odd).collect()) == brute(rows)


def test_documents(spark, sf):
    docs = documents(spark, sf)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)] + [(100, 101), (102, 100)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 102: 100}
