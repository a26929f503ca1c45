"""Personal data by weak supervision: e-mail addresses, internet addresses, card and phone numbers.

Base spans follow fixed patterns and always stand. Wider patterns propose more spans: addresses spelt
with "(at)" or with letters beyond ASCII, addresses of version 6, and cards and phones that the base
patterns lose since a longer run of digits swallows them, or that are written another way. A proposal
has to pass its kind's arithmetic. Labelers vote on every span, base or proposed, or abstain: its form
(regular expressions), gazetteers of endings, issuers and calling codes, words before it, and what it
touches. Expectation-maximisation estimates, kind by kind, how reliable each labeler is; the posteriors
that follow train a logistic classifier on the span's shape and votes, which decides on the proposals.

Each document is read once, in its own row. What is fitted is a table of patterns (kind, form, votes,
shape), whose number is bounded by design; it is counted over all documents.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm.common import checkpointed, ship
from evigraph.llm.votes import fit_patterns, log_odds

ship(__name__)

# Kinds in their order, and the base patterns. The e-mail pattern is in two parts, since an @ is found first and its left side read backwards; no run of characters is tried twice.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# The gazetteers. Endings of mail domains, calling codes, and words near personal and other numbers.
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me eu uk us ca au de fr es it nl be ch at pl se no dk fi pt ie jp cn in br mx ar ru".split())
CALLING_CODES = re.compile(r"(?:1|7|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|2[1234568]\d|3[578]\d|42\d|5[09]\d|6[789]\d|8[058]\d|9[679]\d)")
ISSUERS = re.compile(r"(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[68])|35|6(?:011|4[4-9]|5))")
NEAR = {
    "email": re.compile(r"\b(?:e-?mail|mail|courriel|correo|contact|kontakt|contacto|write|address|adresse|cc|from|to)\b"),
    "ip": re.compile(r"\b(?:ip|ipv[46]|host|server|serveur|servidor|address|adresse|client|login|connected|from)\b"),
    "card": re.compile(r"\b(?:card|carte|karte|tarjeta|visa|mastercard|amex|credit|debit|payment|pan)\b"),
    "phone": re.compile(r"\b(?:phone|tel|telephone|téléphone|telefon|teléfono|call|mobile|cell|handy|fax|whatsapp|sms|contact)\b"),
}
OTHER = re.compile(r"\b(?:version|release|isbn|issn|doi|section|chapter|page|order|invoice|sku|serial|model|part|bug|ticket|commit|example|sample)\b|v\.?$|#$")

# The wider patterns.
SPELT_AT = re.compile(r"[ \t]?[(\[{][ \t]?(?:at|AT|@)[ \t]?[)\]}][ \t]?")
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ \t]?[(\[{][ \t]?(?:dot|DOT|\.)[ \t]?[)\]}][ \t]?)[A-Za-z0-9-]+)+")
ANY_DOMAIN = re.compile(r"@[\w-]++(?:\.[\w-]++)+")
LOCAL_BACK = re.compile(r"[\w.%+-]*\Z")
IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
CARDS = re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{5})(?![0-9])")
PHONES = re.compile(r"(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w.+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
DIGITS = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
#: Characters before a span that are read for context, and the labelers in order.
BEFORE = 40
LABELERS = ("form", "gazetteer", "context", "edges")
#: Forms (base, proposed by another spelling, proposed by another grouping), buckets of length, and groupings.
FORMS, LENGTHS, SEPARATED = 3, 4, 2

Span = tuple[int, int, int]


def digits_of(s: str) -> str:
    return NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d if (d := 2 * int(x)) < 10 else d - 9 for x in even)) % 10 == 0


def small_parts(address: str) -> bool:
    """Whether no part of an address of version 4 is over 255."""
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in address.split("."))


def version_6(address: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(address))
    except ValueError:
        return False


def base_spans(text: str) -> list[Span]:
    """(start, place of the kind in KINDS, end), in order."""
    out: list[Span] = []
    done = 0
    if "@" in text:
        seen = 0
        for m in DOMAIN.finditer(text):
            # the left side holds no @, so it is read from the last one at most
            left = text[max(done, text.rfind("@", seen, m.start()) + 1, seen) : m.start()]
            size = len(left) - len(left.rstrip(LOCAL))
            if size:
                out.append((m.start() - size, 0, m.end()))
                done = m.end()
            seen = m.start() + 1
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m.group())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


def proposals(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, kind, end, form) of the wider patterns that pass their kind's arithmetic."""
    if "@" in text:
        last = 0
        for m in ANY_DOMAIN.finditer(text):
            size = len(LOCAL_BACK.search(text[max(last, m.start() - 64) : m.start()]).group())
            if size and not text[m.start() - size : m.end()].isascii():
                yield m.start() - size, 0, m.end(), 1
            last = m.end()
    if "(" in text or "[" in text or "{" in text:
        for m in SPELT_AT.finditer(text):
            left = text[max(0, m.start() - 64) : m.start()]
            size, right = len(left) - len(left.rstrip(LOCAL)), SPELT_DOMAIN.match(text, m.end())
            if size and right:
                yield m.start() - size, 0, right.end(), 1
    if not DIGITS.search(text):
        return
    if ":" in text:
        for m in IP6.finditer(text):
            if m.group().count(":") >= 3 and version_6(m.group()):
                yield m.start(), 1, m.end(), 1
    for m in CARDS.finditer(text):
        if luhn(digits_of(m.group())):
            yield m.start(), 2, m.end(), 2
    for m in PHONES.finditer(text):
        if 10 <= len(digits_of(m.group())) <= 15:
            yield m.start(), 3, m.end(), 2 if m.group()[0] == "+" else 1


def form_vote(kind: int, span: str, form: int) -> int:
    d = digits_of(span)
    if kind >= 2 and (len(set(d[1:])) == 1 or d in "01234567890123456789"):
        return 0
    return 1 if form == 0 or (kind == 2 and len(d) in (15, 16)) or (kind == 3 and form == 2) else -1


def gazetteer_vote(kind: int, span: str) -> int:
    if kind == 0:
        end = re.split(r"[^0-9A-Za-z]+", span)[-1].lower()
        return int(end in ENDINGS)
    if kind == 1:
        try:
            return int(ipaddress.ip_address(".".join(str(int(p)) for p in span.split(".")) if ":" not in span else span).is_global)
        except ValueError:
            return 0
    d = digits_of(span)
    if kind == 2:
        return int(ISSUERS.match(d) is not None)
    if span[0] != "+" and not span.startswith("00"):
        # three digits of an area and of an exchange begin with 2 to 9
        return int(d[0] > "1" and d[3] > "1")
    return int(CALLING_CODES.match(d.lstrip("0")) is not None)


def context_vote(kind: int, before: str) -> int:
    return 1 if NEAR[KINDS[kind]].search(before) else 0 if OTHER.search(before) else -1


def edge_vote(text: str, start: int, end: int) -> int:
    """Whether a span stands by itself: not in a word, a path or a longer number."""
    a, b, c = text[start - 1 : start], text[end : end + 1], text[end + 1 : end + 2]
    glued = a.isalnum() or b.isalnum() or a in tuple("/_=-.#$") or b in tuple("/_=@") or (b in tuple(".-,") and c.isdigit())
    return 0 if glued else 1


def code_of(kind: int, form: int, votes: Sequence[int], length: int, separated: bool) -> int:
    """A span's pattern as a number."""
    code = kind * FORMS + form
    for v in votes:
        code = code * 3 + v % 3
    return (code * LENGTHS + min(LENGTHS - 1, length // 10)) * SEPARATED + separated


def parts_of(code: int) -> tuple[int, int, list[int], int, int]:
    code, separated = divmod(code, SEPARATED)
    code, length = divmod(code, LENGTHS)
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(-1 if v == 2 else v)
    return code // FORMS, code % FORMS, votes[::-1], length, separated


def judged(text: str, start: int, kind: int, end: int, form: int) -> int:
    span = text[start:end]
    votes = form_vote(kind, span, form), gazetteer_vote(kind, span), context_vote(kind, text[max(0, start - BEFORE) : start].lower()), edge_vote(text, start, end)
    return code_of(kind, form, votes, end - start, any(c in span for c in " -()"))


def spans_of(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, code) of all base spans and of the proposals that overlap none and no earlier proposal; kinds first in KINDS come first."""
    base = base_spans(text)
    out = [(s, k, e, judged(text, s, k, e, 0)) for s, k, e in base]
    taken: list[tuple[int, int]] = sorted((s, e) for s, _, e in base)
    proposed = sorted(proposals(text), key=lambda p: (p[1], p[0], -p[2]))
    if proposed:
        edges = np.zeros(len(text) + 1, bool)
        for s, e in taken:
            edges[s:e] = True
        for s, k, e, form in proposed:
            if not edges[s:e].any():
                edges[s:e] = True
                out.append((s, k, e, judged(text, s, k, e, form)))
    return sorted(out)


def finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: doc_id, text to doc_id, found."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.int32())]))
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            found = [[dict(zip(("start", "kind", "end", "code"), s)) for s in spans_of(t or "")] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])


def features(codes: Sequence[int]) -> np.ndarray:
    """One row a pattern: kind, kind and form, votes for and against by labeler, length, grouping."""
    rows = np.zeros((len(codes), 1 + 4 + 4 * FORMS + 2 * len(LABELERS) + LENGTHS + 1))
    for row, code in zip(rows, codes):
        kind, form, votes, length, separated = parts_of(code)
        row[0] = row[1 + kind] = row[5 + kind * FORMS + form] = 1
        at = 5 + 4 * FORMS
        for i, v in enumerate(votes):
            row[at + 2 * i], row[at + 2 * i + 1] = v == 1, v == 0
        at += 2 * len(LABELERS)
        row[at + length], row[at + LENGTHS] = 1, separated
    return rows


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic classifier on soft targets, by Newton's method with a ridge penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(counts: dict[int, int]) -> dict[int, float]:
    """Probability of being personal of each pattern (its number), from how often each occurs.

    Labelers' reliabilities are estimated for each kind. Posteriors take both classes as equally likely
    beforehand, since base spans say nothing of how many proposals are right. In training, a pattern
    weighs the logarithm of its count, so that the many plain cases do not drown the rare ones.
    """
    codes = sorted(counts)
    if not codes:
        return {}
    n = np.array([counts[c] for c in codes], np.float64)
    parts = [parts_of(c) for c in codes]
    kinds, votes = np.array([p[0] for p in parts]), np.array([p[2] for p in parts])
    posterior = np.zeros(len(codes))
    for k in np.unique(kinds):
        at = kinds == k
        _, good, bad = fit_patterns(votes[at], n[at], prior=0.5, floor=0.05, imagined=max(1.0, n[at].sum() / 5))
        posterior[at] = 1 / (1 + np.exp(-log_odds(votes[at], 0.5, good, bad)))
    x = features(codes)
    w = fit_logistic(x, posterior, np.log1p(n))
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, spans, an array of (start, kind, end, base, score) in order of start, then of KINDS.

    Places are code points, the end exclusive. Base spans (base true) always stand; proposals do where
    the classifier gives them at least `threshold`. score is the classifier's probability, for both.
    The model is fitted on the pattern counts of all documents; there are at most 4 x 3 x 81 x 8
    patterns, which are collected.

    Null and empty text: no spans. Null and repeated ids: each row counts for itself. Documents may
    have any length. Empty table: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = checkpointed(rows.mapInArrow(finder, f"doc_id {id_type}, found array<struct<start:bigint,kind:int,end:bigint,code:int>>"))
    counts = found.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    scores = fit({r["code"]: r["n"] for r in counts.collect()})
    form = lambda s: F.floor(s["code"] / (SEPARATED * LENGTHS * 3 ** len(LABELERS))) % FORMS
    names = F.array(*[F.lit(k) for k in KINDS])
    known = F.map_from_arrays(F.lit(list(scores)), F.lit(list(scores.values()))) if scores else F.create_map().cast("map<int,double>")

    def span(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.get(names, s["kind"]).alias("kind"), s["end"].alias("end"), (form(s) == 0).alias("base"), F.try_element_at(known, s["code"]).alias("score"))

    return found.select("doc_id", F.filter(F.transform("found", span), lambda s: s["base"] | (s["score"] >= threshold)).alias("spans"))


def spelt(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind in square brackets; of spans that overlap, the first to start."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(done: Column, s: Column) -> Column:
        kept = F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(done["out"], kept, F.lit("["), s["kind"], F.lit("]")).alias("out"))
        return F.when(s["start"] >= done["at"], fresh).otherwise(done)

    return F.aggregate(spans, start, add, lambda done: F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int"))))
