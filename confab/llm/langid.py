"""Language identification in two levels: the family first, then pairwise linear support vector machines inside it.

Features are hashed letter bigrams and trigrams of the whole lower-cased text (square roots of the counts, unit length). A
multinomial logistic model tells the families apart; inside a family every pair of languages has a linear SVM, and the language
with most pairwise wins is predicted. Both levels are Spark ML models fitted on a bounded sample of labelled rows
(``per_language`` rows for each language, chosen by a hash of id and text); prediction is one Arrow function without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0; null or empty language labels teach nothing; a null
id is neither held out nor learned from; without labelled rows every text is ``und``; other columns pass through untouched.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from confab.llm.texts import flat, fresh, give_back, id_in_slot, slices
from confab.session import cut

WIDTH = 2048
PER_LANGUAGE = 400
UNKNOWN = "und"

# Language families by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"), "baltic": ("lt", "lv"), "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"), "indic": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes), lang)


def _letters() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def features(arr, width: int = WIDTH) -> np.ndarray:
    """One unit row of hashed letter n-gram weights per text."""
    off, data = flat(pc.utf8_lower(arr))
    n = len(off) - 1
    x = _letters()[data]
    keep = x != 32
    keep[1:] |= x[:-1] != 32  # one space after a word, none at the beginning
    doc = np.repeat(np.arange(n), np.diff(off))[keep]
    x = x[keep].astype(np.uint32)
    out = np.zeros(n * width)
    same = doc[1:] == doc[:-1]
    two = x[:-1] * np.uint32(256) + x[1:]
    rows = doc[:-1] * width
    slot = ((two * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(width)
    out += np.bincount((rows + slot)[same], minlength=n * width)
    if len(x) > 2:
        three = two[:-1] * np.uint32(256) + x[2:]
        slot = ((three * np.uint32(2246822519)) >> np.uint32(15)) % np.uint32(width)
        out += np.bincount((rows[:-1] + slot)[doc[2:] == doc[:-2]], minlength=n * width)
    out = np.sqrt(out.reshape(n, width))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _stacks(arr):
    """Slices small in bytes and in rows, so that a dense feature block stays at a few MB."""
    for part in slices(arr):
        for i in range(0, len(part), 256):
            yield part.slice(i, 256)


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, chosen by a hash of id and text.

    A first pass over the labels alone counts each language; only rows below the hash value that lets about four times the
    wanted number through reach the ranking, so what is shuffled does not grow with the input.
    """
    counts = docs.where(F.col("lang") != "").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.where(F.col("lang") != "").select("lang", "text", F.xxhash64("doc_id", "text").alias("pick"))
    chance = F.pmod("pick", F.lit(1 << 20)) * F.col("n") < 4 * per_language * (1 << 20)
    rows = rows.join(F.broadcast(counts), "lang").where(chance & F.col("text").rlike(r"\p{L}"))  # one row per language
    pick = Window.partitionBy("lang").orderBy("pick", "text")
    return rows.withColumn("nth", F.row_number().over(pick)).where(F.col("nth") <= per_language).select("lang", "text")


class Model:
    """Weights of the family model and of the pairwise machines, a few matrices of ``width`` columns."""

    def __init__(self, families, family_weights, family_bias, members, pairs):
        self.families, self.family_weights, self.family_bias = families, family_weights, family_bias
        self.members, self.pairs = members, pairs  # family -> languages; family -> (weights, bias)

    def predict(self, arr) -> tuple[list[str], np.ndarray]:
        """Language and score of every text of a string array."""
        n = len(arr)
        if not n or not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        seen = pc.fill_null(pc.match_substring_regex(arr, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        f = features(arr)
        z = f @ self.family_weights.T + self.family_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(n), best]
        lang = np.empty(n, object)
        for k, family in enumerate(self.families):
            at = np.flatnonzero(best == k)
            names = self.members[family]
            if len(names) == 1 or not len(at):
                lang[at] = names[0]
                continue
            weights, bias = self.pairs[family]
            margin = f[at] @ weights.T + bias
            wins, sure = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
            for m, (a, b) in enumerate(combinations(range(len(names)), 2)):
                chance = 1 / (1 + np.exp(-4 * np.clip(margin[:, m], -50, 50)))  # of b
                wins[:, b] += margin[:, m] > 0
                wins[:, a] += margin[:, m] <= 0
                sure[:, b] += chance
                sure[:, a] += 1 - chance
            top = (wins + sure / (2 * len(names))).argmax(axis=1)
            lang[at] = np.array(names, object)[top]
            score[at] *= sure[np.arange(len(at)), top] / (len(names) - 1)
        lang[~seen], score[~seen] = UNKNOWN, 0.0
        return lang.tolist(), np.clip(score, 0.0, 1.0)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on columns doc_id, text and lang of ``docs`` (the caller leaves out what must not be learned)."""

    @F.arrow_udf("array<float>")
    def vector(text: pa.Array) -> pa.Array:
        parts = [features(p).astype(np.float32) for p in _stacks(text)]
        flat_values = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * WIDTH, pa.int32()), pa.array(flat_values))

    rows = cut(sample(docs, per_language).select("lang", array_to_vector(vector("text")).alias("features")), "langid")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in langs})
    members = {f: [x for x in langs if family_of(x) == f] for f in families}
    number = lambda names: F.element_at(F.create_map(*[F.lit(v) for n, i in names.items() for v in (n, float(i))]), F.col("lang"))
    if len(families) < 2:
        weights, bias = np.zeros((len(families), WIDTH)), np.zeros(len(families))
    else:
        of = {x: families.index(family_of(x)) for x in langs}
        m = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=20, standardization=False).fit(rows.withColumn("label", number(of)))
        weights, bias = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    pairs = {}
    for f, names in members.items():
        if len(names) > 1:
            w, b = [], []
            for x, y in combinations(names, 2):
                m = LinearSVC(regParam=1e-4, maxIter=20, standardization=False).fit(
                    rows.where(F.col("lang").isin(x, y)).withColumn("label", number({x: 0, y: 1})))
                w.append(m.coefficients.toArray())
                b.append(m.intercept)
            pairs[f] = np.array(w), np.array(b)
    return Model(families, weights, bias, members, pairs)


def predicted(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) of a text column."""

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in _stacks(texts):
            a, b = model.predict(part)
            langs += a
            scores.append(b)
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
            ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learned from the rows outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang", id_in_slot("doc_id", folds, held).alias("held_out"))
    model = fit(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()), per_language)
    return rows.select("doc_id", "held_out", predicted(model, F.col("text")).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.3, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows whose language is recognised with a score of at least ``least``, columns unchanged."""
    learn = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    model, name = fit(learn, per_language), fresh(docs.columns, "langid")
    found = F.col(name)
    return docs.withColumn(name, predicted(model, F.col("text"))).where(
        (found["lang_pred"] != UNKNOWN) & (found["score"] >= least)).drop(name)
