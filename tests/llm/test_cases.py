"""Odd rows that the corpus of the other tests lacks: clashing names, repeated ids, texts above block sizes, large numbers, independent solutions."""

import collections
import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evigraph.llm import jaccard, langid, line_dedup, mixing, packing, quality, suffix, topk, words
from evigraph.llm.queries import tokenizer_path
from tests.llm.conftest import prose
from tests.llm.test_operators import dedup_by_hand, ids_of, shingles, word_list

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# ---- names of columns ----

CLASHES = ["_hash", "_first", "_gone", "__hash", "__first", "__gone", "__copy", "_copy", "_K1", "_number", "_position", "__Position"]


def test_columns_of_any_name_are_kept(spark):
    rows = [(i, prose(i % 4, 60), f"s{i % 2}", *[100 * i + k for k in range(len(CLASHES))]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES))
    want = {r[0]: r[3:] for r in rows}
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines", "n_removed"]
    hand = dedup_by_hand([(r[0], r[1]) for r in rows])
    for r in lines.collect():
        assert tuple(r)[3:-2] == want[r.doc_id] and r.text == hand[r.doc_id, rows[r.doc_id][1]][0]
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert got and all(tuple(r)[3:] == want[r.doc_id] for r in got)
    kept = corpus_pipeline.jaccard_join(spark, docs, "unused")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]


# ---- repeated ids ----


def test_repeats_among_rows_without_an_id(spark, monkeypatch):
    r = random.Random(3)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(22))
    shared = [line() for _ in range(6)]
    texts = [f"{line()} {r.choice(shared)} {line()[: r.randrange(140)]}" for _ in range(1000)]
    ids = [None if i % 3 else 7 for i in range(1000)]
    # with no bits of their own, only the long hash tells texts apart
    want_removed = 0
    got = suffix.remove_repeats(spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")).collect()
    assert len(got) == 1000
    # whichever order rows of one id have, each repeated string stays once
    kept = collections.Counter()
    for x in got:
        want_removed += x.n_removed
        assert x.n_removed + len(x.kept) == x.n_bytes
    for t in shared:
        kept[t] = sum(t[:100].encode() in x.kept for x in got)
    assert want_removed > 900 * 100 and set(kept.values()) <= {1}


def test_repeats_in_long_texts(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij \n") for _ in range(1_500_000))
    long = base + base[40_000:1_300_000] + "".join(r.choice("xyz") for _ in range(300_000))
    docs = spark.createDataFrame([(1, base[:5000]), (2, long), (3, long[-5000:]), (4, "ä" * 300)], "doc_id bigint, text string")
    seen, want = set(), {}
    for d, t in docs.collect():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            x = b[p : p + 100]
            if x in seen:
                gone[p : p + 100] = True
            else:
                seen.add(x)
        want[d] = (int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    assert len(long.encode()) > 3_000_000 > words.BLOCK
    got = {x.doc_id: (x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in suffix.remove_repeats(docs).collect()}
    assert got == want and want[2][0] > 1_200_000


def test_links_of_rows_that_share_an_id(spark):
    a, b = prose(21, 90).split(" "), prose(22, 90)
    near = [" ".join(a), " ".join(a[:-1] + ["other"]), " ".join(["first"] + a[1:])]
    rows = [(1, near[0], 0), (1, b, 1), (2, near[1], 2), (3, near[2], 3), (5, b, 4), (5, prose(30, 50), 5), (5, prose(30, 50), 6), (None, b, 7), (6, None, 8), (6, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, first int")
    got = collections.Counter((r.doc_id, r.class_id, r.n_links, r.copies) for r in jaccard.join_near(docs).collect())
    assert got == collections.Counter([(1, 1, 2, 1), (1, 1, 1, 2), (2, 1, 2, 1), (3, 1, 2, 1), (5, 1, 1, 2), (5, 5, 1, 2), (5, 5, 1, 2), (None, None, 0, 1), (6, 6, 0, 1), (6, 6, 0, 1)])
    kept = corpus_pipeline.jaccard_join(spark, docs, "unused").collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept])) == sorted(map(str, [(1, near[0]), (1, b), (5, prose(30, 50)), (None, b), (6, None), (6, "")]))


def test_rows_alike_share_the_mix(spark):
    rows = [(1, "a b c d", "x")] * 5 + [(2, "e f g h", "x"), (None, "i j", "y"), (None, "i j", "y"), (None, "k l m", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.plan_mix(docs).collect()
    out = mixing.mix_documents(docs).collect()
    for s in "xy":
        taken = sum(r.taken for r in plan if r.source == s)
        assert sum(len(word_list(r.text)) for r in out if r.source == s) == taken
        target = next(r.target for r in plan if r.source == s)
        assert target - 1 <= taken <= target


def test_stages_of_nothing(spark, empty):
    docs = empty.withColumn("n_chars", F.lit(0).cast("bigint"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


# ---- packing ----


def test_packing_of_texts_without_blanks(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    r = random.Random(2)
    rows = [(i, "".join(r.choice("日本語中文字符測試") for _ in range(3000))) for i in range(30)] + [(None, "\n".join(prose(k, 30).split())) for k in range(40)] + [(99, "x" * 200_000), (100, "ab <|endoftext|> c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = packing.pack_documents(docs, tokenizer_path(), shard_words=4000, partition_words=20_000)
    assert out.rdd.getNumPartitions() > 1
    got = out.toPandas()
    assert got.length.sum() == sum(len(ids_of(t, x)) for _, x in rows)
    assert got.groupby("sequence_id").length.sum().max() == 1024


def test_neighbours_are_the_best(spark):
    texts = [f"{' '.join(random.Random(i).choice('abcdefghijklmnop') * 2 for _ in range(12))} w{i % 5}" for i in range(60)]
    idf = np.linspace(0.5, 3.0, packing.BUCKETS).astype(np.float32)
    packer = packing.Packer(32, 0)
    ids = {t: b"\1\0\0\0" * 9 for t in texts}
    packing.pack_shard(packer, list(range(60)), texts, ids.__getitem__, idf, 13.0, 0)
    packer.close()
    order = list(dict.fromkeys(r[0] for r in packer.rows))
    # by hand: whoever opens a sequence asks, and the best that is free comes next
    index = packing.Index([np.array(x) for x in packing.terms_of(__import__("pyarrow").array(texts))], idf, 13.0)
    free, used, want, asks = set(range(60)), 0, [], None
    while free:
        score = {d: index.scores(asks)[d] for d in free} if asks is not None and used else {}
        best = max(score, key=lambda d: (score[d], -d)) if score and max(score.values()) > 0 else min(free)
        free.remove(best)
        want.append(best)
        opened = used == 0 or used + 10 > 32
        used = (used + 10) % 32
        if opened and used:
            asks = best
    assert order == want


# ---- top k ----


def test_top_k_of_large_numbers(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=4).tolist()) for i in range(120)]
    rows += [(200, [1e300, -1e300, 0.0, 1.0]), (201, [1e300, 1e300, 1.0, 0.0]), (250, [5e7, -3e7, 1e6, 2.5]), (251, [4e7, 1.0, -1e9, 0.25]), (252, [2.0**40, 2.0**40, 1.0, 1.0]), (300, [1e308] * 4)]
    q = {i: [math.floor(256 * x) if abs(x) < 1e18 else 256 * int(x) for x in v] for i, v in rows}
    got = collections.defaultdict(list)
    for x in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert set(got) == {0, 50, 100, 200, 250, 300}
    for i, found in got.items():
        clip = lambda s: max(topk.LEAST, min(topk.MOST, s))
        best = sorted((-clip(sum(a * b for a, b in zip(q[i], q[j]))), j) for j in q if j != i)[:5]
        assert sorted(found) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)], i


def test_vectors_that_cannot_qualify_are_dropped():
    r = np.random.default_rng(6)
    vectors = np.floor(r.normal(size=(2000, 3)) * 256)
    queries = np.floor(r.normal(size=(6, 3)) * 256)
    reader = topk.Reader(queries, vectors)
    for depth in (100, 300, 900):
        lower, upper = reader.step(depth)
        exact = queries @ vectors.T
        assert (lower <= exact).all() and (exact <= upper).all()
    sizes, keep = [], topk.Reader.keep

    class Watched(topk.Reader):
        def keep(self, q, v):
            sizes.append((len(q), len(v)))
            keep(self, q, v)

    topk.Reader, plain = Watched, topk.Reader
    try:
        found = list(topk.best_of_block(queries, -np.arange(1, 7), vectors, np.arange(2000), 5, np.full(6, -np.inf)))
    finally:
        topk.Reader = plain
    at, vec, score = topk.first_k(*(np.concatenate(x) for x in zip(*found)), 5)
    for i in range(6):
        assert score[at == i].tolist() == sorted((queries[i] @ vectors.T).astype(int))[::-1][:5]
    assert sizes[0][1] < 1500 or sizes[0][0] < 6


# ---- quality ----


def em_by_hand(votes, rounds=25, prior=0.8, floor=0.02):
    """votes: rows by rules, 1, 0 or nan."""
    seen, one = ~np.isnan(votes), np.nan_to_num(votes) == 1
    good, bad = np.full(votes.shape[1], 0.9), np.full(votes.shape[1], 0.4)
    clip = lambda p: np.clip(p, floor, 1 - floor)

    def posterior():
        with np.errstate(divide="ignore"):
            like = lambda p: np.where(seen, np.where(one, np.log(p), np.log(1 - p)), 0).sum(1)
        return 1 / (1 + np.exp(like(bad) - like(good)) * (1 - prior) / prior)

    for _ in range(rounds):
        g = posterior()[:, None]
        new = clip(g.mean()), clip(((g * one).sum(0) + 0.9) / ((g * seen).sum(0) + 1)), clip((((1 - g) * one).sum(0) + 0.4) / (((1 - g) * seen).sum(0) + 1))
        new = new[0], new[1], np.minimum(new[1], new[2])
        moved = max(abs(new[0] - prior), abs(new[1] - good).max(), abs(new[2] - bad).max())
        prior, good, bad = new
        if moved < 1e-4:
            break
    return posterior(), prior, good, bad


@needs_tables
def test_quality_against_a_model_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rules = quality.default_rules()
    rows = quality.text_measures(docs).withColumns({f"vote_{n}": v.cast("double") for n, v in rules.items()}).toPandas()
    base = (rows.n_words < 10) | (100 * rows.n_repeat_words > 20 * rows.n_words)
    votes = rows[[f"vote_{n}" for n in rules]].to_numpy(float)
    _, prior, good, bad = em_by_hand(votes[~base])
    with np.errstate(divide="ignore"):
        odds = np.where(np.isnan(votes), 0, np.where(votes == 1, np.log(good / bad), np.log((1 - good) / (1 - bad)))).sum(1) + math.log(prior / (1 - prior))
    want = dict(zip(rows.doc_id, 1 / (1 + np.exp(-odds))))
    got = quality.judge_quality(docs).toPandas()
    for r in got.itertuples():
        assert r.p_good == pytest.approx(want[r.doc_id], abs=1e-3)
    failed = dict(zip(rows.doc_id, base))
    assert all(r.kept == (not failed[r.doc_id] and r.p_good >= 0.5) for r in got.itertuples())
    # rules differ in what they are worth, and more than one tells good from bad
    assert len(set(np.round(good - bad, 2))) >= 3 and ((good - bad) > 0.1).sum() >= 2
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id").quality
    seen = got[got.doc_id.isin(labels.index)]
    assert (seen.kept == (labels[seen.doc_id].to_numpy() == 1)).mean() > 0.95


def test_rules_look_at_signals_of_their_own():
    import re

    measures = {"n_words", "word_chars", "n_lines"}
    used = [set(re.findall(r"n_\w+|word_chars", str(v))) - measures for v in quality.default_rules().values()]
    assert sum(map(len, used)) == len(set().union(*used))


# ---- recall on a driver table ----


@needs_tables
def test_recall_of_links(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    by = collections.defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    want = collections.Counter()
    for d, s in sets.items():
        for e in set().union(*(by[x] for x in s)) - {d} if s else ():
            if len(s & sets[e]) >= 0.8 * len(s | sets[e]) - 1e-9:
                want[d] += 1
    got = {r.doc_id: r.n_links for r in jaccard.join_near(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert all(got[d] <= want[d] for d in got)
    assert sum(got.values()) >= 0.98 * sum(want.values()) and sum(want.values()) > 50


# ---- language ----


def test_ridge_against_an_independent_solution():
    r = random.Random(8)
    texts = [" ".join("".join(r.choice(p) for _ in range(3)) for _ in range(25)) for p in (["ba", "do"], ["zu", "pe"], ["ço", "na"]) for _ in range(20)]
    langs = ["a"] * 20 + ["b"] * 20 + ["c"] * 20
    model = langid.Classifier(texts, langs, 60, 1e-4)

    def grams(t):
        t = f" {t.lower()} "
        return {t[i : i + n] for n in langid.NGRAMS for i in range(len(t) - n + 1)}

    sets = [grams(t) for t in texts]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    # with every text a landmark the map holds the whole kernel: ridge in the dual, with a free bias
    goal = np.where(np.array(langs)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    n, penalty = len(texts), 1e-4 * len(texts)
    system = np.block([[kernel + penalty * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    solved = np.linalg.solve(system, np.vstack([goal, np.zeros((1, 3))]))
    want = kernel @ solved[:n] + solved[n]
    assert np.abs(model.score(texts) - want).max() < 0.05
