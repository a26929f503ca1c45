"""Language identification by string kernels.

Two texts are compared by the character n-grams they share: the blended-spectrum presence kernel
counts the distinct n-grams, of all lengths in NGRAMS, that both have, over the root of the product
of their own counts. N-grams are hashed to FEATURES places. Landmarks from the training sample turn
the kernel into a Nystrom map, on which kernel ridge regression is solved for one language against
the rest. A batch of texts is scored by two matrix products: presence by landmarks, kernel by weights.

The classifier learns from a bounded sample, a stated number of texts of each language; scoring
reads every whole text.

A best language is always found, so a text in a language that was never taught, or junk, is told by
its lead: the best margin less the second. Texts unlike all landmarks get the same few margins and
nearly no lead. What lead to ask for is learned from the sample: each half of it is scored by the
other, whole and cut to the lengths in CUTS, as short texts lead by less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm.common import checkpointed, ship, small

ship(__name__)

NGRAMS = (1, 2, 3)
FEATURES = 1 << 15
#: Texts scored by one matrix product.
ROWS = 64
UNKNOWN = "und"
#: Characters to which texts of the sample are cut to learn what lead texts of a size have.
CUTS = (8, 16, 32, 64, 128, 256, 1024, None)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """0/1 matrix, texts by hashed n-grams, of lower-cased whole texts with a blank at either end."""
    out = np.zeros((len(texts), FEATURES), np.uint8)
    for row, text in zip(out, texts):
        chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(chars), np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            h = h[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in NGRAMS:
                row[(h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 15)] = 1
    return out


def scaled(texts: list[str]) -> np.ndarray:
    """presence() with each row over the root of its sum."""
    x = presence(texts).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Classifier:
    """Languages, landmark features (features x landmarks, scaled) and weights (landmarks x languages)."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int, ridge: float):
        self.names = sorted(set(langs))
        self.features = self.weights = self.limits = None
        if not self.names:
            return
        number = {x: k for k, x in enumerate(self.names)}
        y = np.array([number[x] for x in langs])
        # the same number of landmarks of each language
        each = max(1, landmarks // len(self.names))
        chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(self.names))])
        self.features = np.ascontiguousarray(np.concatenate([scaled(texts[i : i + 1]) for i in chosen]).T)
        values, vectors = np.linalg.eigh((self.features.T @ self.features).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        to_map = vectors[:, keep] / np.sqrt(values[keep])
        # some texts at a time: of the whole sample only the landmarks' features are held
        phi = np.concatenate([(scaled(texts[k : k + ROWS]) @ self.features).astype(np.float64) for k in range(0, len(texts), ROWS)]) @ to_map
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        goal = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        # each language weighs the same, however many texts it has
        weight = (1 / np.bincount(y))[y] * len(y) / len(self.names)
        penalty = ridge * len(y) * np.eye(phi.shape[1])
        penalty[-1, -1] = 1e-9
        w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + penalty, phi.T @ (goal * weight[:, None]))
        self.weights, self.bias = (to_map @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margins of each text, and the number of its n-grams."""
        x = presence(texts)
        size = x.sum(1, dtype=np.float32)
        return (x.astype(np.float32) @ self.features / np.sqrt(np.maximum(size, 1))[:, None]) @ self.weights + self.bias, size

    def score(self, texts: list[str]) -> np.ndarray:
        return self.measure(texts)[0]

    def learn_limits(self, texts: list[str], langs: list[str], landmarks: int, ridge: float, loss: float) -> None:
        """From now on texts are "und" whose lead is less than that of all but the share `loss` of the sample's of their size.

        The lead of a text of the sample is that of its own language over the best other one, scored
        by a classifier of the other half. A limit is never below 0, so where the sample's languages
        cannot be told apart nothing is rejected; nor is it with one language, or one too small to halve.
        """
        if len(self.names) < 2:
            return
        number = {x: k for k, x in enumerate(self.names)}
        y = np.array([number[x] for x in langs])
        sizes, leads = [[] for _ in CUTS], [[] for _ in CUTS]
        for half in (0, 1):
            known, asked = np.arange(1 - half, len(y), 2), np.arange(half, len(y), 2)
            other = Classifier([texts[i] for i in known], [langs[i] for i in known], landmarks, ridge)
            if other.names != self.names:
                return
            for k, cut in enumerate(CUTS):
                for at in range(0, len(asked), ROWS):
                    some = asked[at : at + ROWS]
                    margins, size = other.measure([texts[i][:cut] for i in some])
                    own = margins[np.arange(len(some)), y[some]]
                    margins[np.arange(len(some)), y[some]] = -np.inf
                    sizes[k] += size.tolist()
                    leads[k] += (own - margins.max(1)).tolist()
        size = np.maximum.accumulate([np.median(x) for x in sizes])
        lead = np.maximum.accumulate([max(0.0, np.quantile(x, loss)) for x in leads])
        self.limits = size, lead

    def unsure(self, margins: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a text leads by less than texts of its size do."""
        if self.limits is None:
            return np.zeros(len(size), bool)
        second, best = np.sort(margins, 1)[:, -2:].T
        return best - second < np.interp(np.log(np.maximum(size, 1)), np.log(self.limits[0]), self.limits[1])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: 1 and 0 stand for clear yes and no of the regression."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.names else []
        for k in range(0, len(at), ROWS):
            some = at[k : k + ROWS]
            margins, size = self.measure([texts[i] for i in some])
            best = margins.argmax(1)
            for i, b, m, no in zip(some, best, margins[np.arange(len(some)), best], self.unsure(margins, size)):
                if no:
                    continue
                langs[i], scores[i] = self.names[b], min(1.0, max(0.0, (float(m) + 1) / 2))
        return langs, scores


def held_out(doc_id):
    """Documents set aside for measuring: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = 300, longest: int = 1 << 17, languages: int = 256, characters: int = 1 << 27, landmarks: int = 64, ridge: float = 1e-4, loss: float | None = None) -> Classifier:
    """A classifier from at most per_language texts of each language, of at most `longest` characters, those with the least hash of the id.

    The `languages` with most texts are learned, ties by name, and a language's texts end once they
    have its even share of `characters`, so that at most that many, and `longest` for each language,
    are gathered on the driver, for any size of docs and any number of values of lang_col. Rows with
    a null language, or a null text or one without a letter, and held-out rows teach nothing. A
    language's rows are thinned by hash to about four times the number wanted before they are
    ranked, so that a large language is not one task's work. With loss, texts that are not sure to
    be in a language of the sample become "und", at the cost of about that share of those that are.
    """
    named = docs.filter(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & (F.length(text_col) <= longest))
    counts = named.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    rows = named.filter(F.col(text_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(8), F.col(id_col), F.col(text_col)).alias("h"))
    counts = checkpointed(counts.orderBy(F.desc("n"), "lang").limit(languages))
    share = max(1, characters // max(1, counts.count()))
    counts = F.broadcast(counts)
    near = F.shiftrightunsigned("h", 32).cast("double") * F.col("n") <= 4.0 * (1 << 32) * per_language
    picked = rows.select("lang", "h", F.length("text").alias("chars")).join(counts, "lang").filter(near).select("lang", "h", "chars").distinct()
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 32), "h")
    before = F.coalesce(F.sum("chars").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = picked.withColumn("r", F.row_number().over(first)).withColumn("before", before).filter((F.col("r") <= per_language) & (F.col("before") < share))
    picked = small(checkpointed(picked.select("lang", "h")))
    got: pd.DataFrame = rows.join(picked, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).toPandas().sort_values(["lang", "h"])
    sample = got["text"].tolist(), got["lang"].tolist()
    model = Classifier(*sample, landmarks, ridge)
    if loss is not None:
        model.learn_limits(*sample, landmarks, ridge, loss)
    return model


def identify(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); other columns are kept, these two replaced.

    Null text or one without a letter, text below the model's limits if it learned any, and every
    text if nothing was learned: "und" and 0. Repeated rows get the same. Ties go to the first language by name. Empty table: no rows.
    """
    # plain arrays, so that workers need no copy of this package; of a size that the landmarks bound
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.drop("lang_pred", "score")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier.__new__(Classifier)
        vars(own).update(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                langs, scores = own.predict(part.column(part.schema.get_field_index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(label, schema)
