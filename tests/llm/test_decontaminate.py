import random
import re

from scorelake.llm.common import LOWER, UPPER, documents
from scorelake.llm.decontaminate import contaminated, decontaminate
from scorelake.llm.license_scan import WORD


def words(text):
    return re.findall(WORD, (text or "").translate(str.maketrans(UPPER, LOWER)))


def parts(w):
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def weight(s):
    return sum(map(len, s))


def brute(docs, items):
    out = set()
    index = {}
    for item, text in items:
        for p in parts(words(text)):
            index.setdefault(p, set()).add(item)
    held = {item: (len(words(text)), parts(words(text))) for item, text in items}
    for doc, text in docs:
        w = words(text)
        for item in {i for p in parts(w) for i in index.get(p, ())}:
            n, own = held[item]
            for s in range(max(len(w) - n, 0) + 1):
                win = parts(w[s : s + n])
                both = weight(win & own)
                if 100 * both >= 80 * (weight(win) + weight(own) - both):
                    out.add((doc, item))
                    break
    return out


def test_against_brute_force(spark, odd, empty, sf):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(60)] + ["the", "of", "a", "Ünder", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, odd.collect()[15]["text"])]
    items.append((93, items[4][1]))
    docs = [(None, items[5][1]), (0, None), (1, "")]
    for k in range(2, 90):
        w = rng.choice(items[:25])[1].split(" ")
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
            w = w or ["x"]
        lead, tail = (rng.choices(vocabulary, k=rng.choice([0, 3, 80])) for _ in range(2))
        docs.append((k, rng.choice([" ", ", ", "\n"]).join([*lead, *w, *tail]).upper()))
    docs += docs[5:9]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in contaminated(frame, bench).collect()]
    want = brute(docs, items)
    assert set(got) == want and len(want) > 20
    bad = {d for d, _ in want}
    assert sorted(r["doc_id"] for r in decontaminate(frame, bench).where("doc_id IS NOT NULL").collect()) == sorted(d for d, _ in docs if d is not None and d not in bad)
    assert contaminated(empty, bench).count() == 0
    assert contaminated(frame, bench.limit(0)).count() == 0 and decontaminate(frame, bench.limit(0)).count() == len(docs)
    assert decontaminate(odd, bench).columns == odd.columns
    docs = documents(spark, sf)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()}
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
