import random

import pytest

WORDS = ["".join(random.Random(i).choice(["an", "be", "to", "ri", "lo", "mu", "sé", "ke"]) for _ in range(1 + i % 4)) for i in range(120)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(10)) for _ in range((n + 9) // 10))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) with nulls, empty, very short and long texts, copies, near copies, shared passages, repeated lines and a repeated row."""
    passage = prose(900, 60)
    rows = []
    for i in range(40):
        rows.append((i, prose(i, 40 + 7 * i), "ab"[i % 2] + "x", f"s{i % 3}"))
    base = prose(3, 200).split(" ")
    for k in range(6):
        near = list(base)
        near[17 + 20 * k] = f"changed{k}"
        rows.append((100 + k, " ".join(near), "ax", "s0"))
    rows += [(110 + k, prose(5, 75), "bx", "s1") for k in range(4)]
    rows += [(120 + k, prose(50 + k, 50) + "\n" + passage + "\n" + prose(70 + k, 50), "ax", None) for k in range(5)]
    rows += [(130, None, "ax", "s0"), (131, "", "bx", "s1"), (132, "one two", None, "s2"), (133, "   \n\t ", "ax", "s2"), (134, "12 34 !! ??", "bx", "s0"), (135, prose(7, 6000), "ax", "s9"), (136, "日本語 " * 30 + "<|endoftext|> x  y", None, "s9")]
    rows += [(137, prose(11, 120), "ax", "s1")] * 2 + [(None, prose(12, 80), "bx", "s1"), (138, "\n".join(["same line of words here"] * 9), "ax", "s0")]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, 1, "x") for r in corpus], SCHEMA + ", size int, words string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
