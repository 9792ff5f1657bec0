import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from scorelake.llm import pii
from scorelake.llm.common import documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


HARD = [
    "a@b.c_d@e.f, x.y@z a@b..c A@B.C-D.e@f.g",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004 1.2.3 10.0.0.1.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 0000000000000 79927398713 4111  1111",
    "+1 (017) 555-7713 +49 30 1234567 +1 +12 (((( +123456789012345678",
    "é😀 4111111111111111 😀 me@ex.org",
    "9" * 30_000,
    "a" * 50_000 + "@x.yz " + "1 " * 20_000,
    "+" * 1000 + "1.1.1.1",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here',
]


def test_base_spans_against_plain_patterns(spark, odd, empty, sf):
    assert pii.find_pii(empty).count() == 0
    hard = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for docs in (hard, odd, documents(spark, sf)):
        for r in pii.find_pii(docs).select("text", "base_spans", "spans").collect():
            base = [tuple(s) for s in r["base_spans"]]
            assert base == brute(r["text"])
            assert set(base) <= {tuple(s) for s in r["spans"]}


def test_added_spans_and_redaction(spark):
    rows = [(0, HARD[8]), (1, "A sentence of many ordinary words in 2024-05-17, version 1.2.3, and thisisaverylongwordwithoutanyend."), (2, "mail a@b.co now")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["spans"], r["red"]) for r in found.select("doc_id", "spans", pii.redacted(F.col("text"), F.col("spans")).alias("red")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in got[0][0]] == [("secret", 9, 49)]
    assert got[0][1] == 'token = "[secret]" here'
    assert got[1][0] == [] and got[1][1] == rows[1][1]
    assert got[2][1] == "mail [email] now"


def test_places_beyond_two_steps_of_sums(spark):
    """More matches than a step of a step, among characters of several code units."""
    text = " ".join(f"😀 u{i}@ex.org 10.0.{i % 250}.{i % 7}" for i in range(4300))
    docs = spark.createDataFrame([(1, text, "s", 3)], "doc_id long, text string, spans string, base_spans int")
    model = pii.Model((), dict.fromkeys(pii.MORE, 1.0), {})
    got = pii.find_pii(docs, model=model).first()["base_spans"]
    assert [tuple(s) for s in got] == brute(text)


def test_spans_that_documents_label(spark):
    texts = [
        "+1 (098) 555-0174 and 142.226.109.250 then (098) 555-0174",
        "4111111111111111 or 4111111111111112",
        "DE89370400440532013000 or DE89370400440532013001",
        'token "04dbebab91ab85687d33eeaaf9ac699e1188f962" against thisisaverylongwordwithoutanyend',
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    got = {(r["kind"], r["m"], r["y"]) for r in pii.labelled_spans(docs).collect()}
    assert {("local_phone", "(098) 555-0174", 1), ("local_phone", "142.226.109", 0), ("id_number", "4111111111111111", 1), ("id_number", "4111111111111112", 0)} <= got
    assert {("iban", "DE89370400440532013000", 1), ("iban", "DE89370400440532013001", 0), ("secret", "thisisaverylongwordwithoutanyend", 0)} <= got
    assert ("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962", 1) in got
    assert pii.labelled_spans(docs, most_spans=1).groupBy("kind").count().where("count != 1").isEmpty()
    assert set(pii.fit(docs).report) == set(pii.MORE)
