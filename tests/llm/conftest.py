from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "be", "co", "du", "el", "fi", "go", "hu", "in", "ka", "lo", "mé", "nu", "or", "pa", "qui", "ß"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    out = []
    for k, w in enumerate(words):
        out.append(w.capitalize() if k % 11 == 0 else w)
        if k % 11 == 10:
            out[-1] += "." + ("\n" if k % 44 == 43 else "")
    return " ".join(out).replace("\n ", "\n")


def odd_texts() -> list[str | None]:
    """Nulls, blanks, repeats, control strings, other scripts, one long word."""
    return [
        None,
        "",
        " \t\n\x0b\f\r ",
        "one",
        "Two words",
        "three little words",
        "ça ÇA été ÉTÉ naïve Straße İstanbul ΣΑΣ ﬁn",
        "日本語のテキスト 中文 12 ½ Ⅷ ²",
        "emoji 👍🏽 and combining é nbsp x  y",
        "don't we'll I'M they've o'clock ''' 's",
        "<|endoftext|> a <|startoftext|>b<|endoftext|>",
        "spam " * 400,
        "x" * 5000,
        "line\nline\n\nLine\n line\nline",
        "a\x00b\x1cc \x85d",
        r"back\slash \\ </s>[INST] <s> [/INST] \</s>",
    ]


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with exact and near copies, repeated rows, null ids and the odd texts."""
    rng = random.Random(7)
    rows = [(k, t, "en", "src0", 0) for k, t in enumerate(odd_texts())]
    for k in range(100, 160):
        rows.append((k, prose(rng, rng.randint(30, 300)), "en", f"src{k % 3}", 0))
    base = prose(rng, 200)
    for k in range(200, 220):
        words = base.split(" ")
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "en", "src0", 0))
    rows += [(300, base, "en", None, 0), (300, base, "en", None, 0), (None, base, None, "src1", None), (None, None, None, None, None)]
    rows.append((400, prose(rng, 20_000), "en", "src2", 0))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
