"""PII: high-recall candidate generators, boosted trees over format and context, calibrated thresholds.

DataFrame functions only; no shuffle but that of the spans that the trees are fitted on. Base kinds are found by their
formats and checks and always stay. Generators of further kinds propose spans, also overlapping ones; trees score each from its form and the characters before it, and a kind's threshold (the least score with a precision of 0.99 on
held-out spans, at least even odds) selects it. Selected spans that overlap no base span are added.

What the trees are fitted on: candidate spans of the documents themselves, labelled by a check (`LABELS`: checksums, the
country code that makes a local number part of a valid phone, mixed characters of a token), and, as documents need not hold
every kind, EXAMPLES rows written by a rule with a fixed seed. All distinct labelled spans count, in any number: they stay in
Spark, counted by their features, and each kind has trees of its own (`boosting`). A third of them, by the hash of the span,
is held out: thresholds come from all held-out spans of documents where a kind has MIN_HELD of them, else from the rule's.

Spans are [start, end) in code points. Places of matches are sums of the lengths before them, taken in steps of 64 and of
64 * 64, so a text costs about its number of matches. Patterns run in linear time: repetitions are possessive, and a
look-behind starts a match only where a run starts (or where the match before ended), which is where the leftmost match
starts anyway.

Defined cases: a null or empty text has no spans; repeated rows get equal results.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .common import cut_lineage, merged

#: Base kinds in their order, with patterns equal in matches to the plain forms of the contract, and what a
#: text must hold for a match to be possible.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]"),
}
#: Further kinds that generators propose.
MORE = {
    "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+", r"[A-Za-z0-9_+/=-]{20}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "local_phone": (r"(?<![0-9+.,-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", r"[0-9]\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"),
    "id_number": (r"(?<![A-Za-z0-9.,-])[0-9](?:[\x20-]?[0-9]){7,18}+(?![A-Za-z0-9])", r"[0-9](?:[\x20-]?[0-9]){7}"),
}
KINDS = [*BASE, *MORE]
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
#: Characters of context before a span; examples for fitting; the precision that thresholds are set for; trees a kind and their levels.
BEFORE, EXAMPLES, PRECISION, ROUNDS, DEPTH = 24, 3000, 0.99, 8, 3
#: How many held-out spans of documents set a kind's threshold; matches whose lengths are summed in one step.
MIN_HELD, STEP = 40, 64
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    return F.call_function("luhn_check", digits(m))


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.char_length(digits(m)).between(12, 19) & luhn(m)
    if kind == "phone":
        return F.char_length(digits(m)).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda m, before: valid(kind, m)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _steps(values: Column) -> Column:
    """Sums of each STEP values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda j: _sum(F.slice(values, j * STEP + 1, F.lit(STEP))))


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def spans_of(text: Column, kind: str, pattern: str, possible: str, accept) -> Column:
    """Spans of the kind; accept(match, context before it) says which matches stay."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def of(x: Column) -> Column:
        matches, pieces = x["found"], x["between"]
        every = F.sequence(F.lit(0), F.size(matches) - 1)
        lengths = F.transform(every, lambda k: F.char_length(F.get(pieces, k)) + F.char_length(F.get(matches, k)))

        def places(s: Column) -> Column:
            def place(k: Column) -> Column:
                step, far = F.floor(k / STEP).cast("int"), F.floor(k / (STEP * STEP)).cast("int")
                before = _sum(F.slice(s["far"], F.lit(1), far)) + _sum(F.slice(s["step"], far * STEP + 1, step - far * STEP)) + _sum(F.slice(s["one"], step * STEP + 1, k - step * STEP))
                start = before + F.char_length(F.get(pieces, k))
                return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.char_length(F.get(matches, k))).alias("end"), F.lit(kind).alias("kind"))

            kept = F.filter(every, lambda k: accept(F.get(matches, k), F.lower(F.right(F.get(pieces, k), F.lit(BEFORE)))))
            return F.transform(kept, place)

        ones = _let(lengths, lambda one: F.struct(one.alias("one"), _steps(one).alias("step")))
        sums = _let(ones, lambda s: F.struct(s["one"].alias("one"), s["step"].alias("step"), _steps(s["step"]).alias("far")))
        return F.when(F.size(matches) > 0, _let(sums, places))

    one = _let(F.struct(found.alias("found"), between.alias("between")), of)
    return F.when(text.rlike(possible), F.coalesce(one, F.array().cast(SPAN))).otherwise(F.array().cast(SPAN))


def mod97(m: Column) -> Column:
    """An account number, its first four characters moved to the end and letters read as 10 to 35, modulo 97."""
    plain = F.upper(F.regexp_replace(m, "[^0-9A-Za-z]", ""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, a * 10 + (code - 48)).otherwise(a * 100 + (code - 55)) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def labels(kind: str, m: Column, before: Column, after: Column) -> Column:
    """1 private, 0 not, null where no check says so."""
    if kind == "secret":
        distinct = F.size(F.array_distinct(F.split(m, "")))
        mixed = (F.char_length(digits(m)) >= 6) & m.rlike("[A-Za-z]") & (distinct >= 8)
        return F.when(mixed, 1).when(~m.rlike("[0-9]") | (distinct <= 4), 0)
    if kind == "iban":
        return (mod97(m) == 1).cast("int")
    if kind == "local_phone":
        return F.when(before.rlike(r"\+[0-9]{1,3}[\x20.-]?$"), 1).when(before.rlike(r"[0-9]\.?$") | after.rlike(r"^\.?[0-9]"), 0)
    return F.when(F.char_length(digits(m)) >= 12, luhn(m).cast("int"))


def _labelled(kind: str):
    """All matches of a text with what lies before them and their labels."""

    def of(x: Column) -> Column:
        def one(k: Column) -> Column:
            m, before = F.get(x["found"], k), F.lower(F.right(F.get(x["between"], k), F.lit(BEFORE)))
            return F.struct(F.lit(kind).alias("kind"), m.alias("m"), before.alias("before"), labels(kind, m, before, F.left(F.get(x["between"], k + 1), F.lit(2))).alias("y"))

        return F.when(F.size(x["found"]) > 0, F.transform(F.sequence(F.lit(0), F.size(x["found"]) - 1), one))

    return of


def labelled_spans(docs: DataFrame, text_col: str = "text", most_spans: int | None = None) -> DataFrame:
    """kind, m, before, y: all distinct candidates that a check labels; with most_spans the least hashes of each kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = []
    for kind, (pattern, possible) in MORE.items():
        made = _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")), _labelled(kind))
        nothing = F.array().cast("array<struct<kind:string,m:string,before:string,y:int>>")
        each.append(F.when(text.rlike(possible), F.coalesce(made, nothing)).otherwise(nothing))
    found = docs.select(F.explode(F.concat(*each)).alias("s")).select("s.*").where("y IS NOT NULL").distinct()
    if most_spans is not None:
        least = Window.partitionBy("kind").orderBy(F.xxhash64("m", "before"), "m", "before", "y")
        found = found.withColumn("__n", F.row_number().over(least)).where(F.col("__n") <= most_spans).drop("__n")
    return found


def features(m: Column, before: Column) -> list[Column]:
    count = lambda cls: F.char_length(F.regexp_replace(m, f"[^{cls}]", "")).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return [
        F.char_length(m).cast("double"),
        count("0-9"),
        count("a-z"),
        count("A-Z"),
        count(r"\x20().-"),
        flag(m.rlike("^[0-9a-fA-F]+$")),
        F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), "[A-Za-z]+", "a"), "[^0a]", "")).cast("double"),
        flag(luhn(m)),
        flag(before.rlike("token|secret|passw|key|auth|bearer|credential")),
        flag(before.rlike("tel|phone|call|fax|mobile|contact")),
        flag(before.rlike("iban|account|konto|card|passport|ssn|licen|social|tax")),
        flag(before.rlike(r"[=:#]\s*[\"']?$")),
    ]


def examples(n: int = EXAMPLES, seed: int = 20) -> list[tuple[str, str, str, int]]:
    """(kind, span, text before it, private or not): both sides of each generator, half and half, by a fixed rule."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    prose = ["in the end ", "was seen at ", "version ", "on page ", "chapter ", "between ", "see ", "the year ", "costs ", ""]
    syllables = ["tion", "ment", "ver", "en", "ing", "ou", "que", "lich", "ado", "the", "re", "Er", "an"]
    hexa, alnum, upper = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = []
    for i in range(n):
        kind, yes = list(MORE)[i % 4], i // 4 % 2
        if kind == "secret":
            before = rng.choice(["token = ", "secret: ", "api_key=", "password: ", "Bearer ", "auth token "]) + rng.choice(["", '"', "'"]) if yes and rng.random() < 0.8 else rng.choice(prose)
            good = rng.choice([pick(hexa, rng.choice([32, 40, 64])), pick(alnum, rng.randint(24, 60)), pick(alnum, rng.randint(20, 40)) + "=="])
            bad = rng.choice(["".join(rng.choices(syllables, k=rng.randint(8, 16))), "-" * rng.randint(20, 60), "=" * rng.randint(20, 40), "-".join(rng.choices(syllables, k=9)), pick("x", 30)])
        elif kind == "iban":
            before = rng.choice(["IBAN ", "account ", "pay to "]) if yes and rng.random() < 0.7 else rng.choice(prose)
            body = pick("0123456789", rng.choice([14, 18, 20]))
            good = pick(upper, 2) + body if rng.random() < 0.5 else " ".join((pick(upper, 2) + body)[k : k + 4] for k in range(0, len(body) + 2, 4))
            bad = pick(upper, 2) + pick("0123456789", 2) + pick(upper, rng.choice([8, 12, 16]))
        elif kind == "local_phone":
            before = rng.choice(["tel. ", "phone: ", "call me at ", "fax "]) if yes and rng.random() < 0.7 else rng.choice(prose)
            good = rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(pick("23456789", 3), pick("0123456789", 3), pick("0123456789", 4))
            bad = rng.choice(["{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(pick("12", 2), pick("0123", 3), pick("0", 3))
        else:
            before = rng.choice(["passport ", "card no. ", "ssn ", "account ", "tax id: "]) if yes else rng.choice(prose)
            good = pick("0123456789", rng.randint(8, 19))
            bad = rng.choice([f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", pick("0123456789", rng.randint(8, 19)), f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)}"])
        out.append((kind, good if yes else bad, before, yes))
    return out


def written(docs: DataFrame) -> DataFrame:
    """The rule's examples as labelled_spans has the documents' own, and which are held out."""
    kinds, spans, before, y = zip(*examples())
    held = [i // 8 % 3 == 0 for i in range(len(y))]
    rows = pa.table({"kind": kinds, "m": spans, "before": before, "y": pa.array(y, pa.int32()), "held": held})
    return docs.sparkSession.createDataFrame(rows).withColumn("before", F.lower(F.right("before", F.lit(BEFORE))))


def span_counts(docs: DataFrame, text_col: str = "text", most_spans: int | None = None) -> DataFrame:
    """g (place of the kind in MORE), documents (or the rule's), held, x (steps of features), n spans, hits of them private."""
    own = labelled_spans(docs, text_col, most_spans).withColumn("held", F.pmod(F.xxhash64("kind", "m", "before"), F.lit(3)) == 0)
    both = own.withColumn("documents", F.lit(True)).unionByName(written(docs).withColumn("documents", F.lit(False)))
    group = F.array_position(F.array(*map(F.lit, MORE)), F.col("kind")).cast("int") - 1
    steps = F.transform(F.array(*features(F.col("m"), F.col("before"))), boosting.step)
    counted = both.select(group.alias("g"), "documents", "held", steps.alias("x"), "y").groupBy("g", "documents", "held", "x")
    return counted.agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


@dataclass(frozen=True)
class Model:
    """trees: with their kinds. report: kind -> source of its threshold, held-out spans, share of them that is private, precision,
    recall."""

    trees: tuple[tuple[str, boosting.Node], ...]
    cuts: dict[str, float]
    report: dict[str, tuple[str, int, float, float, float]]


def fit(docs: DataFrame, text_col: str = "text", most_spans: int | None = None) -> Model:
    # read again for each level of trees: no more tasks than cores
    cells = cut_lineage(span_counts(docs, text_col, most_spans).coalesce(docs.sparkSession.sparkContext.defaultParallelism))
    trees = boosting.boost(cells.where("NOT held"), len(MORE), ROUNDS, DEPTH)
    held = cells.where("held").select("g", "documents", "n", "hits", boosting.margins(trees, DEPTH).alias("margin"))
    # bounded: margins are multiples of 1 / GRID within the trees' range
    counted = held.groupBy("g", "documents", "margin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    cuts, report = {}, {}
    for g, kind in enumerate(MORE):
        for documents in (True, False):
            margin, n, hits = (np.array([r[c] for r in counted if r["g"] == g and r["documents"] == documents], dtype=float) for c in ("margin", "n", "hits"))
            if not documents or n.sum() >= MIN_HELD and 0 < hits.sum() < n.sum():
                break
        cuts[kind] = boosting.threshold(margin, n, hits, PRECISION)
        chosen = margin >= cuts[kind]
        found, private = float(hits[chosen].sum()), float(hits.sum())
        report[kind] = ("documents" if documents else "rule", int(n.sum()), private / float(n.sum()), found / max(float(n[chosen].sum()), 1.0), found / max(private, 1.0))
    return Model(tuple((kind, boosting.linked(t)) for kind, own in zip(MORE, trees) for t in own), cuts, report)


def find_pii(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """docs with base_spans and spans: arrays of (start, rank, end, kind), by start, then kind as listed.

    Without a model, one is fitted on these documents."""
    model = model or fit(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumn("__text", text)
    base = F.concat(*(spans_of(F.col("__text"), k, pattern, possible, _checked(k)) for k, (pattern, possible) in BASE.items()))

    def chosen(kind: str):
        trees = [tree for k, tree in model.trees if k == kind]
        return lambda m, before: boosting.expression(trees, features(m, before)) >= model.cuts[kind]

    more = F.concat(*(spans_of(F.col("__text"), k, pattern, possible, chosen(k)) for k, (pattern, possible) in MORE.items()))
    named = named.withColumns({"__base": F.array_sort(base), "__more": more})
    free = F.filter("__more", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return merged(named, base_spans=F.col("__base"), spans=F.array_sort(F.concat(F.col("__base"), free))).drop("__text", "__base", "__more")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by [kind] of its first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
