"""Each operator against a brute-force version on a small corpus with all kinds of odd rows."""

import binascii
import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import components, jaccard, langid, licenses, line_dedup, mixing, packing, quality, suffix, topk, url_filter, words
from evigraph.llm.queries import URL_RULES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text):
    return WORD.findall(text or "")


# ---- packing ----


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("options", [{}, {"shard_words": 500, "partition_words": 1500}])
def test_packing_holds_every_id_once(docs, corpus, tokenizer, options):
    rows = packing.pack_documents(docs, tokenizer_path(), **options).toPandas()
    assert rows.doc_tokens.groupby([rows.doc_id.fillna(-1), rows.doc_tokens]).first().size > 0
    got = collections.Counter()
    for (doc, n), g in rows.sort_values("start").groupby([rows.doc_id.fillna(-1), "doc_tokens"]):
        got[int(doc)] += g.length.sum()
    want = collections.Counter()
    for doc, text, *_ in corpus:
        want[-1 if doc is None else doc] += len(ids_of(tokenizer, text))
    assert got == want
    texts = {d: t for d, t, *_ in corpus if d != 137 and d is not None}
    for r in rows[rows.doc_id.isin(list(texts))].itertuples():
        ids = ids_of(tokenizer, texts[int(r.doc_id)])
        assert r.doc_tokens == len(ids)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start : r.start + r.length]
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.length.cumsum() - s.length).tolist() == s.offset.tolist()
        size = s.length.sum()
        assert size <= 1024 and size & (size - 1) == 0


def test_packing_puts_related_documents_together(spark):
    groups = [[" ".join(f"topic{g}word{(7 * i + k) % 40}" for k in range(30)) for i in range(6)] for g in range(6)]
    rows = [(10 * i + g, groups[g][i]) for i in range(6) for g in range(6)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), tokenizer_path()).toPandas()
    same = pairs = 0
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        topics = (s.doc_id % 10).tolist()
        same += sum(a == b for a, b in zip(topics, topics[1:]))
        pairs += len(topics) - 1
    assert same / pairs > 0.6


def test_bm25_scores(spark):
    texts = ["a b c c", "c d", "x y", "a a a c"]
    terms = list(packing.terms_of(pa.array(texts)))
    idf = np.ones(packing.BUCKETS, np.float32)
    index, mean = packing.Index(terms, idf, 3.0), 3.0
    for q in range(4):
        for d in range(4):
            want = 0.0
            for t in set(texts[q].split()):
                tf, n = texts[d].split().count(t), len(texts[d].split())
                want += tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * n / mean)) if tf else 0
            assert index.scores(q)[d] == pytest.approx(want, rel=1e-5)


def test_fast_encoder_equals_the_tokenizer(tokenizer):
    encode = packing.Encoder(tokenizer_path())
    assert encode.fast is not None
    for t in ["", " ", "a  b", "x \ny", "x\n\n y", "it's 'll DON'T", "\t a", "日本語 é…“x”", "1234 %%", "<|endoftext|> a", "a\r\n b", "\u00a0x", "👍🏽 ok"]:
        assert encode(t) == np.asarray(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


# ---- mixing ----


def shares(sizes, weights, most):
    left, open_ = float(sum(sizes.values())), dict(weights)
    target = {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= most * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mix_meets_its_targets(docs, corpus):
    rows = mixing.plan_mix(docs).toPandas()
    assert len(rows) == len(corpus)
    sizes = collections.Counter()
    for _, text, _, source in corpus:
        sizes[source] += len(word_list(text))
    names = sorted([s for s in sizes if s is not None]) + [None]
    target = shares(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, 3)
    for source, g in rows.groupby(rows.source.map(lambda s: s or "none")):
        s = None if source == "none" else source
        assert g.source_size.iloc[0] == sizes[s]
        assert g.target.iloc[0] == pytest.approx(target[s])
        assert target[s] - 1 <= g.taken.sum() <= target[s]
    assert (rows.taken <= 3 * rows["size"]).all()
    again = mixing.plan_mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(str, rows[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_demand_is_inverted(spark):
    for knots in mixing.SCHEDULES:
        rows = spark.range(0, 101).select((F.col("id") / 100).alias("x")).withColumn("t", mixing.invert_demand(F.col("x"), knots)).collect()
        fine = np.linspace(0, 1, 20001)
        w = np.interp(fine, *zip(*knots))
        demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        demand /= demand[-1]
        for r in rows:
            assert r.t == pytest.approx(np.interp(r.x, demand, fine), abs=2e-4)


def test_mix_is_in_order_and_cuts_once(docs):
    plan = {(r.doc_id, r.text_hash): r for r in mixing.plan_mix(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    rows = out.withColumn("h", F.spark_partition_id()).collect()
    taken = sum(r.taken for r in plan.values())
    assert sum(len(word_list(r.text)) for r in rows) == pytest.approx(taken, abs=400)
    fading = [i for i, r in enumerate(rows) if r.source == "s0"]
    growing = [i for i, r in enumerate(rows) if r.source == "s2"]
    assert np.mean(fading) < np.mean(growing)


def test_sources_without_words(spark):
    rows = [(1, None, "x", None), (2, "", "x", "a"), (3, "one two", "x", "b"), (4, None, "x", "b")]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert {(r.doc_id, r.target, r.taken) for r in got} == {(1, 0.0, 0), (2, 0.0, 0), (3, 2.0, 2), (4, 2.0, 0)}
    blank = spark.createDataFrame(rows[:2], "doc_id bigint, text string, lang string, source string")
    assert {(r.target, r.taken) for r in mixing.plan_mix(blank).collect()} == {(0.0, 0)}


def test_mix_of_nothing(empty):
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# ---- URLs ----

URLS = [
    None, "", "no scheme.net/", "http://net/", "http://a.net", "https://a.net/x?y#z", "http://EXAMPLE.net/en/a", "http://www.example.net/en/", "http://example.net/EN/", "http://myexample.net/en/x",
    "http://example.com/de/x/y", "http://sub.example.com/de", "https://a.org/fr/x", "http://org/fr/", "http://a.net:80/x", "x://y://example.net/en/", "http://ÀB.net/", "http:///net/", "http://a.net/\nq", "http://a.net//",
]


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, default)))


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_RULES, 0])
def test_urls_against_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rows = [(i % 7 if i else None, u, "html") for i, u in enumerate([*URLS, *URLS])]
    rules = [*URL_RULES, ("a.net", "/x", "allow"), ("net", "", "block")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = url_filter.judge_urls(pages, spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")).collect()
    want = collections.Counter((i, u, *judge(u, rules)) for i, u, _ in rows)
    assert collections.Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got) == want


def test_no_urls(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), rules).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert url_filter.judge_urls(pages, rules.limit(0)).first().verdict == "allow"


# ---- licences ----


def test_licenses_whatever_their_layout(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [
        (1, "MIT License\nCopyright (c) 2020 Someone\n" + mit), (2, "Copyright 1999 X. All rights reserved.\n\n" + mit.upper().replace(" ", "\n  ")), (3, mit + "\nand more"), (4, None), (5, ""),
        (6, "Some words.\nReleased under the MIT Licence.\nOther words\nLicensed under CC BY-NC 4.0."), (7, licenses.TEXTS["ISC"].replace(",", " ,")), (8, "Copyright 2001 me"), (6, "x"), (None, mit), (None, mit),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, unit string")
    got = licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.license, tuple(r.notices)) for r in got}
    assert (2, "MIT", ()) in by and (7, "ISC", ()) in by and (3, None, ()) in by and (4, None, ()) in by and (5, None, ()) in by and (8, None, ()) in by
    assert (6, None, ("CC-BY-NC-4.0", "MIT")) in by and (6, None, ()) in by
    assert sum(r.doc_id is None and r.license == "MIT" for r in got) == 2
    assert [r.digest for r in got if r.doc_id == 4] == [None]


def test_license_titles_are_wording(spark):
    docs = spark.createDataFrame([(1, "MIT License\n" + licenses.TEXTS["MIT"])], "doc_id bigint, text string")
    known = spark.createDataFrame([("MIT", "document", "mit  LICENSE " + licenses.TEXTS["MIT"]), (None, "line", "x")], "license string, unit string, text string")
    assert licenses.scan_licenses(docs, known).first().license == "MIT"
    assert licenses.scan_licenses(docs.limit(0), known).count() == 0 and licenses.scan_licenses(docs, known.limit(0)).first().license is None


def test_license_files_and_headers(spark):
    known = licenses.known_licenses(spark)
    bsd = licenses.bsd_wordings(3)[0]
    rows = [(1, "MIT License\nCopyright (c) 2020 Someone\n" + licenses.TEXTS["MIT"], "MIT"), (2, "BSD 3-Clause License\n\nCopyright (c) 2021, A\nAll rights reserved.\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause"), (3, licenses.bsd_wordings(2)[0].upper(), "BSD-2-Clause"), (4, bsd + "\nand more", None)]
    for k in licenses.TITLE_LINES:
        text = (licenses.FOLDER / f"{k}.txt").read_text()
        rows += [(10 * len(rows), text, k), (10 * len(rows) + 1, "\n".join(text.split("\n")).replace("\n", "\r\n  ").upper(), k), (10 * len(rows) + 2, text.strip().split("\n", 1)[1], k), (10 * len(rows) + 3, text + "\nmore", None)]
    apache = (licenses.FOLDER / "Apache-2.0.txt").read_text()
    rows += [(1001, apache[: apache.index("   APPENDIX")], "Apache-2.0"), (1002, apache.replace("[yyyy] [name of copyright owner]", "2020 Some One"), "Apache-2.0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, want string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(docs, known).collect()}
    assert got == {i: want for i, _, want in rows}
    assert set(licenses.NAMES) - {k for k, _ in licenses.wordings()} == {"CC-BY-4.0", "CC-BY-NC-4.0"}
    heads = [("# SPDX-License-Identifier: GPL-3.0-or-later\nx = 1", "GPL-3.0"), ("// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ('# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use', "Apache-2.0"), ("/* This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. */", "GPL-2.0"), (" * License, v. 2.0. If a copy of the MPL was not distributed with this\n", "MPL-2.0")]
    found = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(heads)], "doc_id bigint, text string"), known).collect()
    assert {r.doc_id: r.notices for r in found} == {i: [k] for i, (_, k) in enumerate(heads)}


# ---- lines ----


def dedup_by_hand(rows, width=3):
    seen, out = set(), {}
    order = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    for d, t in order:
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            if not word_list("".join(w)):
                continue
            if w in seen:
                gone |= set(range(i, i + width))
            seen.add(w)
        out[d, t] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_lines_against_brute_force(docs, corpus):
    want = dedup_by_hand([(r[0], r[1]) for r in corpus])
    before = {r[0]: r[1] for r in corpus}
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if before[r.doc_id] is None:
            assert (r.text, r.n_lines, r.n_removed) == (None, 0, 0)
        else:
            assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id, before[r.doc_id]]
    assert any(r.n_removed for r in rows) and {"size", "words", "source"} <= set(rows[0].asDict())


def test_lines_of_nothing(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


# ---- top k ----


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 150)
    monkeypatch.setattr(topk, "GROUP", 5)
    monkeypatch.setattr(topk, "BLOCK", 64)
    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=8).tolist()) for i in range(500)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(120)]
    bad = [(None, [1.0] * 8), (2000, None), (2050, [float("nan")] * 8), (2100, [None] + [1.0] * 7), (2150, [float("inf")] * 8), (2200, []), (2250, [1.0, 2.0])]
    rows = spark.createDataFrame([(*x, 1) for x in [*vectors, *bad, vectors[7]]], "vec_id bigint, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for x in topk.top_k(rows).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    q = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in vectors}
    assert set(got) == {i for i in q if i % 50 == 0}
    for i, found in got.items():
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        assert sorted(found) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_top_k_of_few(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id bigint, embedding array<double>")
    assert [(x.rank, x.vec_id, x.score) for x in topk.top_k(rows).orderBy("rank").collect()] == [(1, 1, 131072), (2, 2, -65536)]
    assert topk.top_k(rows.limit(0)).count() == 0


# ---- Jaccard ----


def shingles(text):
    w = word_list(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("sizes", [(128, 1024), (2, 3)])
def test_near_duplicates_against_brute_force(docs, corpus, monkeypatch, sizes):
    monkeypatch.setattr(jaccard, "LEAF", sizes[0])
    monkeypatch.setattr(jaccard, "BLOCK", sizes[1])
    sets = [(r[0], shingles(r[1])) for r in corpus]
    label = {d: d for d, _ in sets if d is not None}
    links = collections.Counter()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is None or b is None or not x or not y:
                continue
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[i] += 0
                links[a, x] += 1
                links[b, y] += 1
                low, high = sorted((label[a], label[b]))
                label = {d: low if c == high else c for d, c in label.items()}
    rows = jaccard.join_near(docs).collect()
    assert len(rows) == len(corpus)
    got = {r.doc_id: r for r in rows}
    for d, x in sets:
        if d is None:
            assert (got[d].class_id, got[d].n_links) == (None, 0)
        else:
            assert got[d].class_id == label[d], d
            assert got[d].n_links == links[d, x] // (2 if d == 137 else 1), d


def test_nothing_is_near_nothing(empty):
    assert jaccard.join_near(empty).count() == 0


def test_components(spark):
    import random

    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    label = {}
    for a, b in pairs:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in label and b in label and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {x.node: x.component for x in got} == label and len(got) == len(label)


# ---- language ----


def test_languages_of_held_out_texts(spark):
    import random

    syllables = {"aa": ["ba", "do", "ki"], "bb": ["zu", "pe", "ri"], "cc": ["ço", "lé", "na"]}
    rows = []
    for i in range(240):
        r = random.Random(i)
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(30)), lang, "s", 3))
    rows += [(500, None, "aa", "s", 3), (501, "", "aa", "s", 3), (502, "12 !!", "bb", "s", 3), (None, "badoki do", None, "s", 3), (503, "badoki " * 30000, None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score int")
    model = langid.fit(docs)
    out = langid.identify(docs, model).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held == (r.doc_id is not None and binascii.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.doc_id in (500, 501, 502):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred == (r.lang or "aa")
    assert {c for c in docs.columns} | {"lang_pred"} == set(out[0].asDict()) - {"held"}
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_kernel_counts_shared_grams():
    a, b = "abc ab", "xbc"
    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in langid.NGRAMS for i in range(len(t) - n + 1)}

    p = langid.presence([a, b]).astype(int)
    assert p.sum(1).tolist() == [len(grams(a)), len(grams(b))] and p[0] @ p[1] == len(grams(a) & grams(b))


# ---- quality ----


def measures(text):
    ws = word_list(text)
    lines = [x for x in (text or "").split("\n") if word_list(x)]
    where = collections.defaultdict(list)
    for i in range(len(ws) - 4):
        where[tuple(ws[i : i + 5])].append(i)
    inside = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_measures_against_brute_force(spark, corpus):
    more = [(900, "a b c d e a b c d e", "x", "s"), (901, "a " * 50, "x", "s"), (902, "# * x|y <b>\n\n# * x|y <b>\n", "x", "s"), (903, "a b c d e f g a b c d e x a b c d", "x", "s"), (904, "é\u2003ü \u00a0 x", "x", "s")]
    rows = [*corpus, *more]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, lang string, source string, n_words int")
    got = quality.judge_quality(docs).collect()
    want = collections.Counter()
    for r in rows:
        m = measures(r[1])
        want[(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    for r in got:
        assert not (r.base_failed and r.kept)
    assert {r.kept for r in got if r.doc_id in range(40)} == {True}


def test_em_finds_accuracies(spark):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(4000):
        good = r.random() < 0.7
        p = (0.95, 0.85, 0.9) if good else (0.1, 0.3, 0.2)
        rows.append(tuple(None if r.random() < 0.2 else int(r.random() < x) for x in p))
    model = quality.fit_votes(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"], rounds=60)
    assert model["prior"] == pytest.approx(0.7, abs=0.07)
    for n, g, b in zip("abc", (0.95, 0.85, 0.9), (0.1, 0.3, 0.2)):
        assert model["good"][n] == pytest.approx(g, abs=0.06) and model["bad"][n] == pytest.approx(b, abs=0.1)


def test_quality_of_nothing(empty):
    assert quality.judge_quality(empty).count() == 0


# ---- repeated strings ----


@pytest.mark.parametrize("group", [1 << 16, 2])
def test_repeats_against_brute_force(docs, corpus, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    texts = {r[0]: r[1] or "" for r in corpus}
    seen, want = set(), {}
    for d in sorted(texts, key=lambda x: (x is not None, x or 0)):
        b = texts[d].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    rows = suffix.remove_repeats(docs).collect()
    assert len(rows) == len(corpus)
    assert sum(w[1] > 0 for w in want.values()) > 10
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id], r.doc_id


def test_family_levels_grow_geometrically():
    r = np.random.default_rng(2)
    family, known, later = suffix.Family(), {}, []
    for _ in range(40):
        c = r.integers(0, 3000, 200).astype(np.uint64)
        rows = [c, c * np.uint64(3), r.integers(0, 50, 200), r.integers(0, 1 << 30, 200)]
        for x in zip(*(x.tolist() for x in rows)):
            known.setdefault(x[0], []).append((x[2], x[3]))
        later += zip(*(x.tolist() for x in family.add([x.copy() for x in rows])))
    kept = {c: (d, t) for level in family.levels for c, _, d, t in zip(*(x.tolist() for x in level))}
    assert kept == {c: min(v) for c, v in known.items()}
    assert sorted((c, d, t) for c, _, d, t in later) == sorted((c, *x) for c, v in known.items() for x in sorted(v)[1:])
    sizes = [len(x[0]) for x in family.levels]
    assert len(sizes) <= 8 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_runs_are_joined():
    doc = np.array([1, 1, 1, 2, 2])
    start, count = np.array([0, 10, 30, 40, 41]), np.array([10, 5, 7, 1, 3])
    d, t = suffix.joined_runs(doc, suffix.tag(np.zeros(5, np.int64), start, count))
    s, c = suffix.starts_of(t)
    assert (d.tolist(), s.tolist(), c.tolist()) == ([1, 1, 2], [0, 30, 40], [15, 7, 4])


def test_repeats_in_nothing(empty):
    assert suffix.remove_repeats(empty).count() == 0


# ---- words ----


def test_word_hashes_follow_words():
    texts = ["a b", None, "", "  a\tb\n", "b", "ab", "é ü", "x" * 3000, "a b"]
    seen = {}
    for first, h, ends in words.word_hashes(pa.array(texts)):
        for i in range(len(ends) - 1):
            got = h[ends[i] : ends[i + 1]].tolist()
            want = word_list(texts[first + i])
            assert len(got) == len(want)
            for w, x in zip(want, got):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
