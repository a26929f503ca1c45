"""Scores on columns: units, logistic scales, confidences, qualities, labels."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evigraph import lexicons as L


def choose(value: Column, table: Mapping, default) -> Column:
    """The table's entry for a value, else default."""
    return reduce(lambda acc, kv: F.when(value == kv[0], F.lit(kv[1])).otherwise(acc), reversed(list(table.items())), F.lit(default))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def to_mg(amount: Column, unit: Column) -> Column:
    """Amount in milligrams; null for a null amount or unit, or a unit of another kind."""
    return amount * choose(F.upper(F.trim(unit)), L.UNIT_TO_MG, None).cast("double")


def logistic(x: Column, median: Column, scale: Column) -> Column:
    """1 / (1 + exp(-(x - median) / scale)); 0 where x or the statistics are null or not numbers."""
    y = 1 / (1 + F.exp(-(x - median) / scale))
    return F.when(F.isnan(y), 0.0).otherwise(F.coalesce(y, F.lit(0.0)))


def log_amount(x: Column) -> Column:
    """ln(1 + x), negative x as 0."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def dose_ratio(amount: Column, daily: Column) -> Column:
    """1 - exp(-amount / daily value) within 0 and 1; 0 without a daily value or a positive amount."""
    return F.when((amount > 0) & (daily > 0), clip01(1 - F.exp(-amount / daily))).otherwise(0.0)


def dose_selected(amount: Column, ratio: Column, least: float = 0.5, least_ratio: float = 0.01, micro: float = 0.001) -> Column:
    """Whether an amount counts: large itself, or a fair share of the daily value and not minute."""
    by_ratio = F.coalesce(ratio, F.lit(0.0)) >= least_ratio
    return amount.isNotNull() & ((amount >= least) | (by_ratio & (amount >= micro)))


def mapping_confidence(method: Column, fuzzy: Column, known: Column, weights: Mapping[str, float] = L.METHOD_WEIGHTS) -> Column:
    """Logistic of 0.55 method weight + 0.25 fuzzy score / 100 + 0.20 known, around 0.6 with width 0.15."""
    raw = 0.55 * choose(method, weights, L.UNLISTED_METHOD) + 0.25 * clip01(F.coalesce(fuzzy, F.lit(0.0)) / 100) + 0.2 * F.when(known, 1.0).otherwise(0.0)
    return 1 / (1 + F.exp(-(raw - 0.6) / 0.15))


def alignment(role: Column, direction: Column) -> Column:
    """How a change agrees with protection: a risk gene going down or a protective one going up 1, the reverse 0, else one half."""
    good = ((role == "pro") & (direction == "down")) | ((role == "anti") & (direction == "up"))
    bad = ((role == "pro") & (direction == "up")) | ((role == "anti") & (direction == "down"))
    return F.when(good, 1.0).when(bad, 0.0).otherwise(0.5)


def support(direct: Column, codes: Column, evidence: Column, pubmed: Column) -> Column:
    """Support of an edge from its evidence codes (array), rows and articles."""
    rows = F.when(F.coalesce(evidence, F.lit(0)) == 0, 1).otherwise(evidence)
    repeated = clip01((rows - 1) / 3 + 0.5 * clip01(F.coalesce(pubmed, F.lit(0)) / 5))
    prior = F.array_max(F.transform(codes, lambda c: choose(c, L.EVIDENCE_PRIORS, L.UNLISTED_CODE)))
    with_codes = F.least(F.lit(1.0), prior + 0.3 * repeated)
    return F.when(direct & (F.size(codes) > 0), with_codes).when(direct, F.least(F.lit(1.0), 0.65 + 0.35 * repeated)).otherwise(F.least(F.lit(0.6), 0.1 + 0.45 * repeated))


#: Weights of the components of a path's quality.
QUALITY_WEIGHTS = {"dose": 0.2, "mapping": 0.15, "literature": 0.15, "inference": 0.2, "support": 0.2, "direction": 0.1}


def weighted(parts: Mapping[str, Column], weights: Mapping[str, float] = QUALITY_WEIGHTS) -> Column:
    """Weighted sum of components, within 0 and 1."""
    return clip01(reduce(lambda a, b: a + b, [F.lit(float(w)) * parts[k] for k, w in weights.items()]))


def evidence_level(direct: Column, codes: Column, pubmed: Column, evidence: Column, score: Column, inference: Column) -> Column:
    """Strong, Moderate, Preliminary or Weak Evidence."""
    therapeutic = F.exists(codes, lambda c: F.contains(c, F.lit("therapeutic")))
    marker = F.exists(codes, lambda c: F.contains(c, F.lit("marker/mechanism")))
    with_direct = F.when(therapeutic & ((pubmed >= 2) | (evidence >= 3)) & (score >= 0.65), "Strong Evidence").when((therapeutic | marker) & (score >= 0.55), "Moderate Evidence").otherwise("Preliminary Evidence")
    without = (
        F.when((evidence >= 3) & (pubmed >= 3) & (score >= 0.6) & (inference >= 0.65), "Moderate Evidence")
        .when((evidence >= 2) & (score >= 0.4), "Preliminary Evidence")
        .when(score >= 0.3, "Preliminary Evidence")
        .otherwise("Weak Evidence")
    )
    return F.when(direct, with_direct).otherwise(without)


def tier(score: Column, high: float = 0.75, least: float = 0.6) -> Column:
    """high, moderate or low."""
    return F.when(score >= high, "high").when(score >= least, "moderate").otherwise("low")


def vote_strength(kind: Column, score: Column, direct_hits: Column) -> Column:
    """strong, moderate or weak; kind is the winning kind of vote."""
    strong = (direct_hits >= 2) | (kind.isin("upregulation", "downregulation") & (score >= 2.8))
    return F.when(strong, "strong").when(score >= 1.6, "moderate").otherwise("weak")


def vote_confidence(strength: Column, score: Column) -> Column:
    """Score over 4 or over 3, at most 1, by strength; 0.4 for weak."""
    return F.round(F.when(strength == "strong", F.least(F.lit(1.0), score / 4)).when(strength == "moderate", F.least(F.lit(1.0), score / 3)).otherwise(0.4), 3)


def path_confidence(confidence: Column, evidence: Column, effect: Column) -> Column:
    """Mean of the best confidence and evidence over 5, cut by a fifth for effects that hold only in part."""
    base = F.round((confidence + F.least(F.lit(1.0), evidence / 5)) / 2, 3)
    return F.when(effect.isin("context_specific", "association_only"), F.round(base * 0.8, 3)).otherwise(base)


def compose_effect(main: Column, relationship: Column, polarity: Column, species: Column, conflicting: Column) -> Column:
    """Effect of compound on disease from compound on gene and gene on disease; the first rule that fits."""
    harmful, beneficial = F.lit("potentially_harmful"), F.lit("potentially_beneficial")
    return (
        F.when(polarity == "neutral", "uncertain")
        .when((main == "genetic_association") | (relationship == "associated"), "association_only")
        .when((F.coalesce(species, F.lit("")) != "") & ~species.isin("Human", "unspecified"), "context_specific")
        .when(conflicting, "context_specific")
        .when((main == "upregulation") & (relationship == "risk_factor"), harmful)
        .when((main == "upregulation") & (relationship == "protective"), beneficial)
        .when((main == "downregulation") & (relationship == "risk_factor"), beneficial)
        .when((main == "downregulation") & (relationship == "protective"), harmful)
        .otherwise("uncertain")
    )
