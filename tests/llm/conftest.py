import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, key string"


def odd_texts() -> list[str | None]:
    """Nulls, empty and very long texts, repeated rows and lines, blanks of all kinds, characters of many planes."""
    rng = random.Random(5)
    words = ["the", "of", "Straße", "日本", "😀", "x" * 40, "1.2.3.4", "a@b.co", "\t", "<s>", "</s>", "<|endoftext|>", "İI", "MIT License"]
    line = "A line that several documents share, word for word"
    out: list[str | None] = [None, "", " ", "\n", "\n\n", "  two  spaces  ", line, line, f"{line}\n{line}\nown", f"  {line.upper()}\t\nother text here", "short"]
    out += [" ".join(rng.choices(words, k=n)) for n in (1, 3, 5, 6, 40, 400)]
    out += ["\n".join(" ".join(rng.choices(words, k=8)) for _ in range(300)) * 4, "y" * 70_000, "ab " * 20_000]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Extra columns have names that operators use inside."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), i, "k") for i, t in enumerate(odd_texts())]
    rows += [rows[6], rows[6], (None, "a row without an id, of ten characters", "en", "src0", 3, 1, "k"), (7, "the same id once more", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
