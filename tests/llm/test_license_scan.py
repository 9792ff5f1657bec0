from collections import Counter

import duckdb

from scorelake.llm import license_scan as ls


def test_against_every_block_and_notice(spark, odd, empty):
    assert ls.license_scan(empty).count() == 0
    notice = ls.NOTICES[14][1]
    extra = [notice, "x " * 70 + notice + " y" * 100, notice.replace("granted", "given"), "the mit license, MIT-License. apache license cc by cc  by", " ".join(notice.split(" ")[:9])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    docs = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = Counter(tuple(r) for r in ls.license_scan(docs).select(*columns).collect())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({ls.oracle_sql()})").fetchall())
    assert got == want
    assert {r[6] for r in got if r[0] in (1000, 1001)} == {"mit"}


def test_notices_in_blocks_and_none(spark, odd, monkeypatch):
    rows = [(i, f"{text} tail", 1.0, "x", 2) for i, (_, text) in enumerate(ls.NOTICES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, labels string, n_words int")
    whole = ls.license_scan(docs).select("doc_id", "n_words", "labels", "score", "share").collect()
    monkeypatch.setattr(ls, "BLOCK_NOTICES", 5)
    parts = ls.license_scan(docs).select("doc_id", "n_words", "labels", "score", "share").collect()
    assert Counter(map(tuple, parts)) == Counter(map(tuple, whole))
    assert all(r["share"] == 1.0 for r in whole) and all("agpl" in r["labels"] for r in whole if r["doc_id"] == 0)
    none = ls.license_scan(odd, notices=[]).collect()
    assert all(r["share"] is None and r["labels"] == r["base_labels"] for r in none) and set(odd.columns) <= set(none[0].asDict())
