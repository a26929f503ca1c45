"""The weighted similarity against definitions written out, and its search against all pairs."""

import random

from evigraph.operators import weighted as W


def common_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio_by_table(a, b):
    return 200 * common_by_table(a, b) / (len(a) + len(b))


def test_ratios_against_a_table():
    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(1, 12))) for _ in range(2))
        assert abs(W.ratio(a, b) - ratio_by_table(a, b)) < 1e-9
        short, long = sorted((a, b), key=len)
        pieces = {long[i:j] for i in range(len(long)) for j in range(i + 1, len(long) + 1) if j - i == len(short) or (j - i < len(short) and (i == 0 or j == len(long)))}
        want = max(ratio_by_table(short, p) for p in pieces)
        if len(a) == len(b):
            pieces = {short[i:j] for i in range(len(short)) for j in range(i + 1, len(short) + 1) if i == 0 or j == len(short)}
            want = max(want, *(ratio_by_table(long, p) for p in pieces))
        assert abs(W.partial(a, b) - want) < 1e-9, (a, b)


def test_known_scores():
    assert W.weighted("vitamin c", "vitamin c") == 100
    assert W.weighted("c vitamin", "vitamin c") == 95
    assert W.weighted("folic acid", "folic acid folic") == 0.95 * 0.9 * 100 or W.weighted("folic acid", "folic acid folic") == 90
    assert W.weighted("zinc", "zinc sulfate heptahydrate") == 90
    assert W.weighted("iron oxide", "oxide of lanthanum, red") == 85.5
    assert W.weighted("", "x") == 0 and W.weighted("a", "b") == 0


def test_search_against_all_pairs(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcde") for _ in range(r.randint(1, 7))) for _ in range(40)]

    def text():
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 4)))
        if r.random() < 0.6:
            i = r.randrange(len(t))
            t = t[:i] + r.choice(["", "x", "ab"]) + t[i + r.choice([0, 1]) :]
        return t.strip() or "z"

    left, right = ([text() for _ in range(n)] for n in (150, 120))
    left += ["a", "zz", "", None, "  ", left[0]]
    right += ["a", "b", None, right[0], "  "]
    for threshold in (82.0, 85.0, 92.0):
        got = W.best_weighted(spark.createDataFrame([(x, 1) for x in left], "name string, n int"), spark.createDataFrame([(x, 1) for x in right], "key string, grams int"), "name", "key", threshold)
        want = {}
        for a in {x for x in left if x and x.strip()}:
            score, key = min((-W.weighted(a, b), b) for b in {x for x in right if x and x.strip()})
            if -score >= threshold:
                want[a] = (key, round(-score, 6))
        assert {x.name: (x.key, round(x.score, 6)) for x in got.collect()} == want
        assert len(want) > (50 if threshold < 90 else 5)
