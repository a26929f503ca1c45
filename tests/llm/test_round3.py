"""Manifests, personal data, hard negatives and repeats among rows alike, against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import jaccard, merkle, negatives, packing, pii, suffix, votes
from tests.llm.conftest import SCHEMA

LETTERS = "abcdefghijklm nopqrst"


def letters(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(LETTERS) for _ in range(n))


# repeats among rows alike


def removed_by_hand(rows, length=100):
    """Distinct (id, text) in order of id; for each the marks of its bytes that a string covers which started earlier."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        mark = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                mark[s : s + length] = [True] * length
            seen.add(raw[s : s + length])
        out[i, text] = (len(raw), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), bytes(b for b, m in zip(raw, mark) if not m))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_a_repeated_row_loses_nothing(spark, parts):
    rows = [(1, letters(1, 601))] * 2 + [(None, letters(2, 345))] * 3 + [(2, letters(3, 99))] * 2
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(99, 0, 0)] * 2 + [(345, 0, 0)] * 3 + [(601, 0, 0)] * 2
    assert {bytes(r.kept) for r in got} == {t.encode() for _, t in rows}


def test_repeats_among_repeated_rows_against_brute_force(spark, monkeypatch):
    """Twenty small corpora in one table, each of an alphabet of its own so that they share nothing; ids repeat with the same text."""
    monkeypatch.setattr(suffix, "GROUP", 3)
    rows = []
    for seed in range(20):
        r = random.Random(seed)
        base = letters(seed, 500).translate(str.maketrans(LETTERS, "".join(chr(0x4E00 + 32 * seed + k) for k in range(len(LETTERS)))))
        for k in range(6):
            a, b = sorted(r.sample(range(500), 2))
            text = base[a:b] + r.choice(["", base[:60]]) + base[a : a + 45] * r.choice([0, 1, 2])
            rows += [(100 * seed + k, text)] * r.choice([1, 1, 2, 3])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = suffix.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    want = removed_by_hand(rows)
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got) == sorted((i, want[i, t]) for i, t in rows)
    assert any(r.n_removed for r in got)


# manifests


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(leaves, arity):
    """(root, for each leaf its siblings level by level with the leaf's place)."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // arity * arity : p // arity * arity + arity]
            paths[i].append((p % arity, [x for k, x in enumerate(run) if k != p % arity]))
        level, at = [h(*level[k : k + arity]) for k in range(0, len(level), arity)], [p // arity for p in at]
    return level[0], paths


def encode(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("arity,height", [(8, 4), (2, 1), (3, 2)])
def test_manifest_against_brute_force(spark, corpus, arity, height):
    rows = [(*r, i % 7 or None) for i, r in enumerate(corpus)] + [(k, f"t{k}", f"l{k % 12}", None, k) for k in range(500, 530)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", n_chars int, tree string, index int").repartition(3)
    hit = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    claimed = F.when(hit, merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.upper("text")))
    m = merkle.build_manifest(df, claimed=claimed, arity=arity, height=height)
    got = merkle.check_rows(m).collect()
    groups = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf = h(*map(encode, (i, source, lang, n, text)))
        other = h(*map(encode, (i, source, lang, n, text and text.upper()))) if i is not None and i % 3 == 0 else leaf
        groups[lang].append((i is not None, i or 0, leaf, other, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree_by_hand([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], arity) for g in order]
    root, above = tree_by_hand([t[0] for t in trees], arity)
    want = []
    for g, (subroot, paths), up in zip(order, trees, above):
        for (_, _, leaf, other, i), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            node = other
            for place, rest in path + up:
                node = h(*rest[:place], node, *rest[place:])
            want.append((str(i), leaf, subroot, root, h(*(x for _, rest in path + up for x in rest)), node, node == root))
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted(want)
    assert 0 < sum(r.verified for r in got) < len(got)
    p = merkle.proofs(m).collect()
    assert len(p) == len(rows) and {merkle.fold(r.leaf, merkle.unpacked(bytes(r.path))) for r in p} == {root}


@pytest.mark.parametrize("arity,height,n", [(2, 3, 8), (3, 2, 100), (8, 4, 5), (4, 2, 17), (2, 2, 1)])
def test_positions_are_those_of_the_log(arity, height, n):
    leaves = [h(str(i)) for i in range(n)]
    log = []
    for block in range(-(-n // arity**height)):
        first = block * arity**height
        log += merkle.append_log(leaves[first : first + arity**height], first, n, arity, height)
    level, nodes = 0, leaves
    while True:
        at = merkle.position(level, np.arange(len(nodes)), n, arity, height)
        assert [log[k] for k in at] == nodes
        if level == merkle.top_level(n, arity, height):
            break
        level, nodes = level + 1, [h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]


def test_manifest_of_nothing_and_of_one(spark, empty):
    rows = empty.withColumn("n_chars", F.lit(1))
    assert merkle.check_rows(merkle.build_manifest(rows)).collect() == []
    one = spark.createDataFrame([(None, None, None, None, None)], SCHEMA + ", n_chars int")
    (r,) = merkle.check_rows(merkle.build_manifest(one)).collect()
    leaf = h("-----")
    assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (leaf, leaf, leaf, h(), leaf, True)


# personal data

EMAIL, NUMBERS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"


def personal_by_hand(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def checked(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(NUMBERS, text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and checked(digits(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    r = random.Random(4)
    for alphabet in ("a.b@@-1 2+3(4)5.6.7é@x.y", "0123456789 -", "12 .. 3", "+1234567890 ()-+"):
        for _ in range(10_000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(text) == personal_by_hand(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "@" * 100_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "(at)" * 50_000, ":" * 200_000, "x@é." * 50_000):
        pii.spans_of(text)


def test_personal_data(spark, corpus):
    planted = {
        1: ("jan (at) mail.org, please", [("email", "jan (at) mail.org")]),
        2: ("call (415) 555-2671 or +1 (743) 555-3824 4539578763621486", [("phone", "(415) 555-2671"), ("phone", "+1 (743) 555-3824"), ("card", "4539578763621486")]),
        3: ("4539578763621486 4539578763621486", [("card", "4539578763621486")] * 2),
        4: ("from 2a00:1450:4001:81b::200e and 9.9.9.9", [("ip", "2a00:1450:4001:81b::200e"), ("ip", "9.9.9.9")]),
        5: ("look (at) this.That, a::b, 12:30:45, 4539578763621487 and 1234567890123456", []),
        6: ("É" * 3 + " x.y@z.org 👍 a@b.de", [("email", "x.y@z.org"), ("email", "a@b.de")]),
        7: (None, []), 8: ("", []),
    }
    rows = [(i, t) for i, (t, _) in planted.items()] + [(6, planted[6][0]), (None, "a@b.org")]
    rows += [(100 + i, f"w{i}.{i}@mail{i}.example.com and +1 ({200 + i}) 555-{1000 + i} on 8.8.{i}.1, card 4539578763621486.") for i in range(60)] + [(1000 + i, t) for i, t, *_ in map(list, corpus) if i]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, found int, spans string").repartition(3)
    got = pii.find_personal(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base] == personal_by_hand(text)
        if r.doc_id in planted:
            assert [(s.kind, text[s.start : s.end]) for s in r.spans] == planted[r.doc_id][1]
        elif (r.doc_id or 0) >= 1000:
            assert not r.spans
    assert pii.find_personal(df.limit(0)).collect() == []
    found = pii.find_personal(df).join(df.select("doc_id", "text").distinct(), "doc_id").filter("doc_id in (2, 6, 7)").distinct()
    out = {r.doc_id: (r.t, r.s) for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t"), pii.spelt(F.col("spans")).alias("s")).collect()}
    assert out == {2: ("call [phone] or [phone] [card]", "phone:5:19,phone:23:40,card:41:57"), 6: ("ÉÉÉ [email] 👍 [email]", "email:4:13,email:16:22"), 7: (None, "")}


def test_patterns_and_their_numbers():
    for kind in range(4):
        for form in range(3):
            for v in ([1, 0, -1, 1], [-1] * 4, [0, 0, 0, 1]):
                for length in (3, 17, 25, 400):
                    code = pii.code_of(kind, form, v, length, True)
                    assert pii.parts_of(code) == (kind, form, v, min(3, length // 10), 1)


def test_reliabilities_of_made_votes():
    """Good cases are voted for by 95, 90 and 70 in 100 of the time, bad ones by 10, 30 and 50."""
    r, good, bad = random.Random(1), (0.95, 0.9, 0.7), (0.1, 0.3, 0.5)
    counts = collections.Counter()
    for _ in range(40_000):
        p = good if r.random() < 0.6 else bad
        counts[tuple(-1 if r.random() < 0.1 else int(r.random() < x) for x in p)] += 1
    prior, g, b = votes.fit_patterns(np.array(list(counts)), list(counts.values()), rounds=300)
    assert abs(prior - 0.6) < 0.08 and np.abs(g - good).max() < 0.05 and np.abs(b - bad).max() < 0.1


# hard negatives


def mined_by_hand(rows, k=3, positives=5):
    usable = sorted({(i, str(label), tuple(map(float, v))) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in usable]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for i, label, q in whole:
        if i % 50:
            continue
        scored = sorted((-clip(sum(a * b for a, b in zip(q, v))), j, other == label) for j, other, v in whole if j != i and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            hard = [(-n, j) for n, j, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s][:k]
            out += [(i, p, rank, j, -s, n) for rank, (n, j) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(1024, 1 << 21, 1 << 18), (4, 64, 8)])
def test_negatives_against_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("BUCKET", "CELL", "GROUP"), sizes):
        monkeypatch.setattr(negatives, name, size)
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6) * 2.0 ** r.integers(-3, 3)], int(r.integers(0, 3))) for i in range(260)]
    rows += [(300 + i, [1.0, 2.0, 0.5], i % 2) for i in range(60)] + [(400 + i, [0.0] * 6, i % 3) for i in range(60)] + [(450, [-1.0, 0.001], 1), (451, [-1.0, 0.0], 1), (452, [-0.7, 0.0], 0)]
    rows += [(500, None, 1), (550, [], 1), (600, [1.0, None], 1), (650, [float("nan"), 1.0], 1), (700, [float("inf"), 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (750, [1.0, 1.0, 1.0], None)]
    rows += [rows[50], rows[50], (100, [0.5] * 6, 2), (101, [0.5] * 6, 1)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id bigint, embedding array<double>, label int, cell int").repartition(3)
    got = negatives.mine_negatives(df).collect()
    assert sorted(tuple(x) for x in got) == mined_by_hand(rows)
    assert len(got) > 30 and negatives.mine_negatives(df.limit(0)).collect() == []


def test_negatives_of_large_numbers(spark):
    rows = [(0, [1e9, 1.0], "a"), (1, [1e9, 2.0], "a"), (2, [7e8, 0.0], "b"), (3, [1e300, 1.0], "b"), (4, [3e15, 1.0], "a"), (5, [1e3, 1.0], "b"), (50, [1.5, 2.0], "b"), (51, [3.0, 1.0], "b"), (52, [2.5, 1.0], "a"), (53, [9e5, 0.0], "b")]
    got = negatives.mine_negatives(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()
    assert sorted(tuple(x) for x in got) == mined_by_hand(rows)


def test_coordinate_ranges_lose_no_vector():
    r = np.random.default_rng(5)
    v = np.floor(256 * r.normal(size=(500, 8)))
    length = np.sqrt((v**2).sum(1))
    bucket, dropped = negatives.Bucket(v, length), 0
    for q in np.floor(256 * r.normal(size=(40, 8))):
        norm = np.sqrt((q**2).sum())
        for cosine in (0.05, 0.3, 0.6, 0.9, 0.999):
            found = bucket.candidates(q / norm, np.argsort(-np.abs(q))[: negatives.FOCUS], cosine)
            need = np.flatnonzero(v @ q >= cosine * norm * length)
            assert set(need) <= set(found.tolist())
            dropped += len(v) - len(found)
    assert dropped > 0.5 * 40 * 5 * len(v)


# recall of the chosen-path join, and neighbours in packing


def test_recall_in_deep_trees(spark, monkeypatch):
    """Pairs of similarity 0.8 among texts that share near half of their shingles, so that nodes split again and again."""
    monkeypatch.setattr(jaccard, "LEAF", 2)
    shared, rows = [f"common{k}" for k in range(24)], []
    for i in range(400):
        own = [f"t{i}w{k}" for k in range(25)]
        other = own[:12] + [f"changed{i}"] + own[13:]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + other))]
    got = jaccard.join_near(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    found = sum(r.n_links == 1 for r in got) / len(got)
    # 400 draws of at least 0.99
    assert found >= 0.975 and all(r.n_links <= 1 for r in got)


def test_recall_is_that_of_simulated_draws():
    r = np.random.default_rng(2)
    runs, depth, lost, n = 4, 3, 0, 4000
    for _ in range(n):
        agree = r.random(jaccard.PLACES) < 0.8

        def missed(k):
            if k == 0:
                return False
            places = r.integers(0, jaccard.PLACES, 2 if r.random() < 1 / jaccard.SECOND else 1)
            return all(not agree[p] or missed(k - 1) for p in places)

        lost += all(missed(depth) for _ in range(runs))
    assert abs(1 - lost / n - jaccard.recall_of(0.8, runs, depth)) < 0.01
    assert jaccard.recall_of(0.8, jaccard.runs_needed(0.8, 0.99, 6), 6) >= 0.99
    with pytest.raises(ValueError):
        jaccard.runs_needed(0.8, 0.9999999, 6)


def test_a_shard_of_short_documents_takes_linear_time(monkeypatch):
    """As many calls of the scorer as sequences, whatever the number of documents."""
    calls, scores = [], packing.Index.scores
    monkeypatch.setattr(packing.Index, "scores", lambda self, d: calls.append(d) or scores(self, d))
    packer, texts = packing.Packer(1024, 0), [f"w{i % 500}" for i in range(20_000)]
    packing.pack_shard(packer, list(range(len(texts))), texts, lambda t: b"\1\0\0\0", np.full(packing.BUCKETS, 3.0, np.float32), 1.0, 0)
    packer.close()
    assert len(calls) <= 2 * len(texts) // 1024 + 2
    assert sorted(r[0] for r in packer.rows if r[1] == 0) == list(range(len(texts)))
