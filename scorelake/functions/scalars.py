"""Scalar functions: scores, periods, tolerant comparisons, ciphers."""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def odds_score(p: Column) -> Column:
    """500 points at odds of 15, 20 points to double the odds; null outside (0, 1)."""
    inside = (p > 0) & (p < 1)
    return F.when(inside, 500 - 20 / math.log(2) * (math.log(15) + F.ln(F.when(inside, p / (1 - p)))))


def capped_score(x: Column, factor: float = 1.0) -> Column:
    return F.least(x * factor, F.lit(0.9999999))


def scaled_score(x: Column) -> Column:
    return capped_score(x, 1.112)


def percent_to_double(s: Column) -> Column:
    return F.regexp_replace(s, "%", "").try_cast("double") / 100


def vintage(s: Column) -> Column:
    """YYYYMM of the first dddd-dd in a string; null where there is none."""
    found = F.regexp_extract(s, r"(\d{4}-\d{2})", 1)
    return F.when(found != "", F.replace(found, F.lit("-"), F.lit("")))


def quarter_of_vintage(v: Column) -> Column:
    v = v.cast("string")
    return F.concat(F.left(v, F.lit(4)), F.lit("Q"), F.ceil(F.right(v, F.lit(2)).cast("int") / 3).cast("string"))


def quarter_if_closed(v: Column) -> Column:
    """YYYYQn of a vintage whose month ends a quarter, else null."""
    return F.when(F.right(v.cast("string"), F.lit(2)).cast("int") % 3 == 0, quarter_of_vintage(v))


def previous_vintage(d: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(d, "month"), -1), "yyyyMM")


def last_day_of_previous_month(d: Column) -> Column:
    return F.date_sub(F.trunc(d, "month"), 1)


def sunday_before_week(d: Column) -> Column:
    return F.date_sub(F.to_date(F.date_trunc("week", d)), 1)


def buffer_date(d: Column, weeks: int = 4, fmt: str = "yyyyMMdd") -> Column:
    return F.date_format(F.date_sub(d, 7 * weeks), fmt)


def month_period(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def quarter_period(t: Column) -> Column:
    return F.concat(F.year(t).cast("string"), F.lit("Q"), F.quarter(t).cast("string"))


def iso_week_period(t: Column) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), t)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def valid_vintages(first: int, last: int) -> list[int]:
    return [y * 100 + m for y in range(first // 100, last // 100 + 1) for m in range(1, 13) if first <= y * 100 + m <= last]


def title_case(name: str) -> str:
    return " ".join(p.capitalize() for p in name.split("_"))


def hex_to_rgb(color: str) -> tuple[int, int, int]:
    digits = color.lstrip("#")
    return tuple(int(digits[i : i + 2], 16) for i in (0, 2, 4))


def safe_difference(a: Column, b: Column) -> Column:
    return a.try_cast("double") - b.try_cast("double")


def safe_equal(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    return F.abs(safe_difference(a, b)) <= tolerance


def mismatch(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    """Over tolerance, or null on one side alone."""
    over = F.abs(safe_difference(a, b)) > tolerance
    return F.coalesce(over, F.lit(False)) | (a.isNull() != b.isNull())


def seconds_between(a: Column, b: Column) -> Column:
    return (a.try_cast("timestamp").cast("double")) - (b.try_cast("timestamp").cast("double"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum of value * weight over the sum of all weights, null where that is 0."""
    return F.try_divide(F.sum(value * weight), F.nullif(F.sum(weight.cast("double")), F.lit(0.0)))


def weighted_rate(mask: Column, weight: Column) -> Column:
    return weighted_mean(mask.cast("double"), weight)


def xor_encrypt(text: str, key: str) -> str:
    """Obfuscation, not security: XOR with a repeating key, a length of two bytes ahead, URL-safe base 64."""
    raw, secret = text.encode(), key.encode()
    body = bytes(b ^ secret[i % len(secret)] for i, b in enumerate(raw))
    return base64.urlsafe_b64encode(len(text).to_bytes(2, "big") + body).decode()


def xor_decrypt(cipher: str, key: str) -> str:
    """The inverse; ValueError where the text doesn't decode to the length that it states (in characters)."""
    try:
        raw, secret = base64.urlsafe_b64decode(cipher.encode()), key.encode()
        text = bytes(b ^ secret[i % len(secret)] for i, b in enumerate(raw[2:])).decode()
    except Exception as e:
        raise ValueError("not a text of this cipher") from e
    if len(raw) < 2 or len(text) != int.from_bytes(raw[:2], "big"):
        raise ValueError("the length does not fit")
    return text


def encrypt_column(c: Column, key: str, decrypt: bool = False) -> Column:
    step = xor_decrypt if decrypt else xor_encrypt

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else step(str(v), key))

    return run(c.cast("string"))
