"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier per bit weighs hashed 1- and
3-grams of characters by how much likelier they are in the languages whose bit is
one. A text's margins, each scaled by the margins its languages are expected to
have, are decoded to the codeword of the least loss, exponential and weighted by
how far apart a bit holds its two sides. What two codewords explain almost
equally well is flagged as ambiguous.

Only text and language of the training rows are learned from, on a sample of at
most about SAMPLE documents a language, chosen by a hash of doc_id. Predictions
read whole texts. Nulls: a null text, or one without a letter, is `und`, score 0;
a null language teaches nothing. Without training rows all is `und`. Repeated
rows: each is predicted. Ties: of equal losses the language first in order of code points. Empty table: no
rows. A very long text is read whole. Other columns are left out.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of a language, about, that its n-grams are counted on.
SAMPLE = 3000
#: Languages that are learned at most: a sum per language and bucket goes to the driver.
LANGUAGES = 500
BUCKETS = 1 << 14
UNKNOWN = "und"


def folded(text: str) -> np.ndarray:
    """Code points of the lower-case text; ASCII other than letters counts as a space."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    return np.where((x < 128) & ((x < 97) | (x > 122)), np.uint32(32), x)


def grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-grams (upper half) and of the 3-grams (lower half)."""
    with np.errstate(over="ignore"):
        one = ((x * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64) + BUCKETS
        if len(x) < 3:
            return one, np.zeros(0, np.int64)
        h = (x[:-2] * np.uint32(0x85EBCA6B)) ^ (x[1:-1] * np.uint32(0xC2B2AE35)) ^ (x[2:] * np.uint32(0x27D4EB2F))
        h ^= h >> np.uint32(15)
        return one, ((h * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """+1/-1 codes of n languages: all splits for up to six, else the random code whose codewords are farthest apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        rows = [(1, *bits) for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits]
        return np.array(rows, float).T
    rng, bits = np.random.default_rng(15), math.ceil(15 * math.log2(n))
    tries = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(40)]
    return max(tries, key=lambda c: ((bits - c @ c.T) / 2 + bits * np.eye(n)).min())


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        if not self.langs:
            return
        self.codes = codewords(len(self.langs))
        p = np.array([counts[x] + 0.5 for x in self.langs], float).reshape(len(self.langs), 2, BUCKETS)
        p /= p.sum(axis=2, keepdims=True)
        weights, middle, half = [], [], []
        for bit in self.codes.T:
            up, down = p[bit > 0].mean(axis=0), (p[bit < 0] if (bit < 0).any() else p).mean(axis=0)
            w = np.log(up) - np.log(down)
            expected = (p * w).sum(axis=(1, 2))
            a, b = expected[bit > 0].min(), expected[bit < 0].max() if (bit < 0).any() else 0.0
            weights.append(w.ravel())
            middle.append((a + b) / 2)
            half.append(max((a - b) / 2, 1e-3))
        # rows are buckets: 3-grams first, 1-grams after them, as grams() numbers them
        self.weights = np.array(weights).T.astype(np.float32)
        self.middle, self.half = np.array(middle), np.array(half)
        self.trust = self.half / self.half.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        one, three = grams(folded(text))
        margin = self.weights[one].mean(axis=0, dtype=np.float64)
        if len(three):
            margin = margin + self.weights[three].mean(axis=0, dtype=np.float64)
        f = np.clip((margin - self.middle) / self.half, -6, 6)
        loss = (self.trust * np.exp(-self.codes * f)).sum(axis=1)
        order = np.argsort(loss, kind="stable")
        likely = np.exp(loss[order[0]] - loss)
        score = float(1 / likely.sum())
        return self.langs[order[0]], score, len(order) > 1 and bool(likely[order[1]] > 0.8)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> Model:
    """docs: doc_id, text, lang of the rows to learn from. Of more languages than `most` those with the most rows are learned."""
    known = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(most).collect()}
    if not sizes:
        return Model({})
    share = docs.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "of string, share double")
    chosen = known.join(share, known.lang == share.of).where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                total = sums.setdefault(lang, np.zeros(2 * BUCKETS, np.int64))
                for found in grams(folded(text.as_py())):
                    total += np.bincount(found, minlength=2 * BUCKETS)
        for lang, total in sums.items():
            some = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "bucket", "n"])

    # a task returns its sums, so that no task holds a language's texts
    rows = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    sums = {x: np.zeros(2 * BUCKETS) for x in set(rows["lang"])}
    for lang, bucket, n in zip(rows["lang"], rows["bucket"], rows["n"], strict=True):
        sums[lang][bucket] = n
    return Model(sums)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every document; held-out documents teach nothing."""
    given = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(train(given.where(~held_out(F.col("doc_id"))), sample))

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            found = [model.value.predict(x.as_py()) for x in batch.column("text")]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return given.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
