"""The corpus operators as queries over the shared tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import jaccard, langid, licenses, line_dedup, merkle, mixing, negatives, packing, pii, quality, suffix, topk, url_filter

# The rules of the URL query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer of the packing query, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, and when it takes each copy, in order of first use."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    positions = [F.round(F.get("copies", F.lit(k))["position"], 6).alias(f"position_{k + 1}") for k in range(3)]
    rows = plan.select("doc_id", "size", "source_size", "target", "taken", *positions)
    return mixing.range_sorted(rows, F.col("position_1").asc_nulls_last(), "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages the URL rules block."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and licence notices of every document."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated three-line windows."""
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return jaccard.join_near(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    rows = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return rows.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    rows = quality.judge_quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    rows = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the manifest, and whether a copy, of which a third is tampered with, still leads to its root."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = F.when(hit, merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], lowered))
    return merkle.check_rows(merkle.build_manifest(docs, claimed=claimed))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    rows = pii.find_personal(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["base"]))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.spelt(F.col("base")), 256).alias("base_sha256"), pii.spelt(F.col("spans")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh has the next label."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(vectors.withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mix_sources": op2_mix_sources,
    "op3_url_filter": op3_url_filter,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_top_k": op6_top_k,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pii": op12_pii,
    "op13_hard_negatives": op13_hard_negatives,
}


def license_sql() -> str:
    """SQL of the licence query; its texts and spellings are those of the operator."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    spellings = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in licenses.SPELLINGS.items())
    known = ", ".join(f"({quote(k)}, {quote(u)}, {quote(t)})" for k, u, t in licenses.known_rows())
    begin = r"^[^\p{L}\p{N}©(]*"
    dropped = rf"(regexp_matches(x, '{begin}(copyright\s+\S|\(c\)\s*(copyright\b|\d{{4}})|©|all rights reserved\b|portions copyright\s)') AND NOT regexp_matches(x, '{begin}copyright\s+(notice|holder|owner)'))"
    words = r"list_filter(string_split(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    lines = rf"[CASE WHEN {dropped} THEN '' ELSE array_to_string([coalesce(m[w], w) FOR w IN {words}], ' ') END FOR x IN string_split(regexp_replace(lower(text), '\r\n|\r', chr(10), 'g'), chr(10))]"
    whole = "sha256(coalesce(array_to_string(list_filter(ls, lambda x: x <> ''), ' '), ''))"
    return rf"""
        WITH sp AS (SELECT MAP {{{spellings}}} AS m), k0(license, unit, text) AS (VALUES {known}),
        k AS (SELECT unit, digest, min(license) AS license FROM (SELECT license, unit, {whole} AS digest FROM (SELECT license, unit, {lines} AS ls FROM k0, sp)) GROUP BY unit, digest),
        d AS (SELECT doc_id, text, {lines} AS ls FROM documents, sp),
        w AS (SELECT doc_id, CASE WHEN text IS NOT NULL THEN {whole} END AS digest, ls FROM d),
        n AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM (SELECT doc_id, sha256(unnest(list_filter(ls, lambda x: x <> ''))) AS line_digest FROM w) JOIN k ON k.digest = line_digest AND unit = 'line' GROUP BY doc_id)
        SELECT w.doc_id, w.digest, k.license, coalesce(notices, '') AS notices FROM w LEFT JOIN k ON k.unit = 'document' AND k.digest = w.digest LEFT JOIN n ON n.doc_id = w.doc_id"""


def positions_sql() -> str:
    """When each copy is taken: the schedules of the sources, integrated and inverted by hand."""
    out = []
    for k in range(3):
        words = f"greatest(0, least(size, want - start - {k} * source_size))"
        s = f"((start + {k} * source_size + {words} / 2) / target)"
        fading = f"2 * {s} / (1.5 + sqrt(greatest(2.25 - 2 * {s}, 0)))"
        growing = f"CASE WHEN {s} < 0.45 THEN 2 * {s} / (0.5 + sqrt(0.25 + {s} / 0.6)) ELSE 0.6 + least(0.4, 2 * ({s} - 0.45) / (1 + sqrt(greatest(1 + 3.75 * ({s} - 0.45), 0)))) END"
        out.append(f"CASE WHEN {words} > 0 THEN round(CASE turn % 3 WHEN 0 THEN {fading} WHEN 1 THEN {s} ELSE {growing} END, 6) END AS position_{k + 1}")
    return ", ".join(out)


def merkle_sql(levels: int = 7, group_levels: int = 3) -> str:
    """SQL of the manifest, a step a level: groups of up to 8 to the number of levels rows."""
    values = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars"))
    leaf = lambda text: f"sha256(concat({values}, CASE WHEN {text} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)"
    steps = []
    # a lone node stays; rows of a level carry the run that they are in
    for k in range(levels + group_levels):
        steps.append(
            f"r{k} AS (SELECT g, i // 8 AS run, string_agg(d, '' ORDER BY i) AS ds, count(*) = 1 AND count(*) OVER (PARTITION BY g) = 1 AS lone FROM n{k} GROUP BY g, i // 8), "
            f"n{k + 1}a AS (SELECT g, run, CASE WHEN lone THEN ds ELSE sha256(ds) END AS d, lone, ds FROM r{k})"
        )
        if k == levels - 1:
            steps.append(f"n{levels} AS (SELECT 'root' AS g, g AS lang, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, d FROM n{levels}a)")
        else:
            steps.append(f"n{k + 1} AS (SELECT g, run AS i, d FROM n{k + 1}a)")
    walk = [f"w0 AS (SELECT p0.*, t.i AS place, leaf AS f0 FROM p0 JOIN n{levels} t ON t.lang IS NOT DISTINCT FROM p0.lang)"]
    others = []
    for k in range(levels + group_levels):
        at = f"(i // {8**k})" if k < levels else f"(place // {8 ** (k - levels)})"
        key = "w.lang IS NOT DISTINCT FROM a.g" if k < levels else "true"
        cut = f"({at} % 8) * 64"
        fold = f"CASE WHEN lone THEN f{k} ELSE sha256(substr(ds, 1, ({cut})::BIGINT) || f{k} || substr(ds, ({cut} + 65)::BIGINT)) END"
        first = "CASE WHEN hit THEN tampered ELSE leaf END" if k == 0 else f"f{k}"
        fold = fold.replace(f"f{k}", first) if k == 0 else fold
        walk.append(f"w{k + 1} AS (SELECT w.*, {fold} AS f{k + 1}, CASE WHEN lone THEN '' ELSE substr(ds, 1, ({cut})::BIGINT) || substr(ds, ({cut} + 65)::BIGINT) END AS o{k} FROM w{k} w JOIN n{k + 1}a a ON {key} AND a.run = {at} // 8)")
        others.append(f"o{k}")
    last = levels + group_levels
    return f"""
        WITH t AS (SELECT [list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) for i in range(256)] AS tab),
        p0 AS (SELECT doc_id, lang, {leaf("text")} AS leaf, {leaf(lowered)} AS tampered, coalesce({crc} % 3 = 0, false) AS hit,
                      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i FROM documents, t),
        n0 AS (SELECT lang AS g, i, leaf AS d FROM p0), {", ".join(steps)}, {", ".join(walk)}
        SELECT doc_id, leaf, s.d AS subroot, r.d AS root, sha256({" || ".join(others)}) AS proof_sha256, f{last} AS folded_root, f{last} = r.d AS verified
        FROM w{last} w JOIN n{levels} s ON s.lang IS NOT DISTINCT FROM w.lang, n{last} r"""


SQL: dict[str, str] = {
    "op2_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
        s1 AS (SELECT *, CASE turn % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 3 AS cap FROM s0),
        s2 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, turn) AS r FROM s1),
        s3 AS (SELECT *, (SELECT sum(source_size) FROM s2) - coalesce((SELECT sum(cap) FROM s2 b WHERE b.r < a.r), 0) AS rest,
                      (SELECT sum(weight) FROM s2) - coalesce((SELECT sum(weight) FROM s2 b WHERE b.r < a.r), 0) AS weight_rest FROM s2 a),
        s4 AS (SELECT *, rest::DOUBLE * weight / weight_rest < cap AS open FROM s3),
        s5 AS (SELECT source, turn, source_size, CASE WHEN open THEN (SELECT rest::DOUBLE FROM s4 WHERE open ORDER BY r LIMIT 1) * weight / (SELECT weight_rest FROM s4 WHERE open ORDER BY r LIMIT 1) ELSE cap::DOUBLE END AS target FROM s4),
        p AS (SELECT d.doc_id, size, turn, source_size, target, floor(target)::BIGINT AS want, (sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
              FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
        SELECT doc_id, size, source_size, target,
               (greatest(0, least(size, want - start)) + greatest(0, least(size, want - start - source_size)) + greatest(0, least(size, want - start - 2 * source_size)))::BIGINT AS taken, @POSITIONS@ FROM p""".replace("@POSITIONS@", positions_sql()),
    "op3_url_filter": r"""
        WITH rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        p AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
        j AS (SELECT q.*, r_host || r_path AS rule, r_verdict FROM q LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM j QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST) = 1""",
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        w AS (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l)),
        x AS (SELECT doc_id, i FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]') QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
        c AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM x) GROUP BY doc_id)
        SELECT l.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i)], chr(10)), '') END) AS kept_sha256
        FROM l LEFT JOIN c ON l.doc_id = c.doc_id""",
    "op6_top_k": r"""
        WITH v AS (SELECT vec_id AS id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS query_id, b.id AS vec_id, list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op4_license_scan": license_sql(),
    "op11_merkle_manifest": merkle_sql(),
    "op13_hard_negatives": r"""
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
}
