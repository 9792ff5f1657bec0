"""License scans: an exact set-similarity join of text blocks with licence notices, and phrase places.

DataFrame functions only.

* Words that occur in notices are ordered by their document frequency in the whole corpus, rarest first.
* A block is a run of 2L words that starts at a multiple of L, where L is the longest notice: any passage of up to L words
  lies whole in a block. A block's token set is its words of that vocabulary, in the global order.
* A notice of n distinct words is found where a block holds `need` = ceil(threshold * n) of them. Prefix filter: the first
  n - need + 1 words of the notice and the first |block| - need + 1 of the block share a word, so blocks emit their prefix
  words and are joined with an inverted index of the notices' prefixes. Length filter: the block has `need` words.
  Positional filter: behind the first shared word, both have enough left. Survivors are counted exactly.

Notices come in blocks of BLOCK_NOTICES (a stated query set against all rows), so the index that is broadcast is bounded
whatever their number. Texts are keyed by a 128-bit hash: copies of a text meet in the join's pre-aggregated result.

Result columns beside those of the contract: share (greatest containment of a notice, null without), first_block and
last_block (first word of the first and last block in which a notice was found). score is 1 where a base phrase stands,
else the share.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows get equal results; without notices
only base phrases are found.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import computed, hash128, join_spread, lower_ascii, merged

#: What words are, and the phrases whose places count, with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licence notices (label, text) as they commonly stand in public texts.
NOTICES = (
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Notices of one pass over the texts.
BLOCK_NOTICES = 500


def word_list(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def words_of(lowered: Column) -> Column:
    """What lies between gaps; splitting is several times cheaper than extracting words one by one."""
    return F.array_remove(F.split(lowered, GAP), "")


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def phrase_places(words: Column, parts: list[str], label: str) -> Column:
    def here(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == part)
        return test

    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def found_notices(texts: DataFrame, notices, threshold: float, length: int) -> DataFrame:
    """h1, h2, block, label, share for the texts (h1, h2, words) and one block of notices, all of at most `length` words."""
    spark = texts.sparkSession
    sets = [(label, set(word_list(text))) for label, text in notices]
    vocabulary = sorted(set().union(*(s for _, s in sets)))
    counted = texts.select(F.explode(F.array_intersect("words", strings(vocabulary))).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}  # at most the vocabulary of a block of notices
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, (label, tokens) in enumerate(sets):
        need = math.ceil(threshold * len(tokens) - 1e-9)
        ordered = sorted(tokens, key=rank.get)
        index += [(word, place, number, label, ordered, need) for place, word in enumerate(ordered[: len(tokens) - need + 1])]
    prefixes = sorted({row[0] for row in index})
    least = min(row[5] for row in index)

    words = F.col("words")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(words) / length).cast("int") - 2, F.lit(0)))
    held = texts.where(F.arrays_overlap(words, strings(prefixes)))
    blocks = held.select("h1", "h2", words, F.explode(starts).alias("b")).select("h1", "h2", (F.col("b") * length).cast("long").alias("block"), F.slice(words, F.col("b") * length + 1, F.lit(2 * length)).alias("run"))
    blocks = blocks.where(F.arrays_overlap("run", strings(prefixes)))
    sized = computed(blocks, tokens=F.array_intersect(strings(order), F.col("run"))).drop("run").where(F.size("tokens") >= least)
    emitted = F.array_intersect(F.slice("tokens", F.lit(1), F.size("tokens") - least + 1), strings(prefixes))
    emitted = sized.select("h1", "h2", "block", "tokens", F.explode(emitted).alias("word"))
    table = spark.createDataFrame(index, "word string, place int, notice int, label string, own array<string>, need int")
    size, at = F.size("tokens"), F.array_position("tokens", F.col("word")) - 1
    pairs = emitted.join(F.broadcast(table), "word").where((size >= F.col("need")) & (at <= size - F.col("need")))
    # the first shared word of each pair, and with it the positional filter; copies of a text end here
    first = pairs.groupBy("h1", "h2", "block", "notice").agg(F.min(at).alias("at"), F.min("place").alias("place"), F.first(F.struct("tokens", "own", "need", "label")).alias("p")).select("h1", "h2", "block", "at", "place", "p.*")
    left = F.least(F.size("own") - F.col("place"), F.size("tokens") - F.col("at"))
    close = computed(first.where(left >= F.col("need")), both=F.size(F.array_intersect("tokens", "own")))
    return close.where("both >= need").select("h1", "h2", "block", "label", (F.col("both") / F.size("own")).alias("share"))


def license_scan(docs: DataFrame, notices=NOTICES, threshold: float = 0.9, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, share, first_block, last_block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2 = hash128(text)
    texts = computed(docs.select(h1.alias("h1"), h2.alias("h2"), lower_ascii(text).alias("low")), words=words_of(F.col("low"))).drop("low")
    hits, length = None, max((len(word_list(text)) for _, text in notices), default=1)
    for at in range(0, len(notices), BLOCK_NOTICES):
        part = found_notices(texts, notices[at : at + BLOCK_NOTICES], threshold, length)
        hits = part if hits is None else hits.unionByName(part)

    found = computed(docs, __h1=h1, __h2=h2, __low=lower_ascii(text))
    found = computed(found, __words=words_of(F.col("__low")))
    words, low = F.col("__words"), F.col("__low")
    maybe = F.lit(False)
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        maybe = maybe | (F.contains(low, F.lit(max(parts, key=len))) & low.rlike(GAP.join(parts)))
        places.append(phrase_places(words, parts, label))
    nothing = F.array().cast("array<struct<start:bigint,label:string>>")
    base = F.when(maybe & (F.size(words) > 0), F.concat(*places)).otherwise(nothing)
    found = computed(found.withColumn("__n", F.size(words).cast("long")), __base=base).drop("__low", "__words")
    if hits is None:
        found = found.withColumns({"__labels": F.array().cast("array<string>"), "__share": F.lit(None).cast("double"), "__first": F.lit(None).cast("long"), "__last": F.lit(None).cast("long")})
    else:
        told = hits.groupBy(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).agg(
            F.collect_set("label").alias("__labels"), F.max("share").alias("__share"), F.min("block").alias("__first"), F.max("block").alias("__last")
        )
        found = join_spread(found, told, ["__h1", "__h2"], "left")
    base = F.col("__base")
    own = F.array_sort(F.array_distinct(base["label"]))
    result = {
        "n_words": F.col("__n"),
        "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(base["start"]),
        "last_word": F.array_max(base["start"]),
        "base_labels": F.array_join(own, ","),
        "labels": F.array_join(F.array_sort(F.array_union(own, F.coalesce("__labels", F.array().cast("array<string>")))), ","),
        "score": F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("__share", F.lit(0.0))),
        "share": F.col("__share"),
        "first_block": F.col("__first"),
        "last_block": F.col("__last"),
    }
    return merged(found, **result).drop("__h1", "__h2", "__n", "__base", "__labels", "__share", "__first", "__last")


def oracle_sql(notices=NOTICES, threshold: float = 0.9) -> str:
    """The same by brute force: every block against every notice."""
    length = max(len(word_list(text)) for _, text in notices)
    rows = []
    for label, text in notices:
        tokens = sorted(set(word_list(text)))
        listed = ", ".join(f"'{t}'" for t in tokens)
        rows.append(f"('{label}', [{listed}], {math.ceil(threshold * len(tokens) - 1e-9)})")
    phrases = []
    for phrase, label in PHRASES.items():
        parts = phrase.split(" ")
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts, 1))
        phrases.append(f"SELECT doc_id, unnest(list_filter(range(len(w)), lambda i: {test})) AS start, '{label}' AS label FROM d")
    return f"""
WITH t(label, tokens, need) AS (VALUES {", ".join(rows)}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
),
places AS ({" UNION ALL ".join(phrases)}),
base AS (
  SELECT doc_id, count(*) AS n, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels
  FROM places GROUP BY doc_id
),
blocks AS (
  SELECT doc_id, b * {length} AS block_start, list_distinct(w[b * {length} + 1 : (b + 2) * {length}]) AS block
  FROM (SELECT doc_id, w, unnest(range(greatest(CAST(ceil(len(w) / {length}.0) AS BIGINT) - 1, 1))) AS b FROM d)
),
held AS (
  SELECT doc_id, block_start, label, len(list_intersect(block, tokens)) AS n, len(tokens) AS size, need FROM blocks, t
),
found AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(CAST(n AS DOUBLE) / size) AS share, min(block_start) AS first_block, max(block_start) AS last_block FROM held WHERE n >= need GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score, share, first_block, last_block
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
