"""Language identification by nearest centroid over TF-IDF character n-grams.

Character 1- to 3-grams are hashed to ``DIMS`` features; document frequencies come from every training text, several centroids
a language from spherical k-means over a bounded sample. A text gets the language of the centroid with the largest cosine; it
is rejected where that cosine is far below what the language's own texts reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, numbered, renamed, tidy, written

DIMS = 8192
PIECE = 1 << 20
FULL = 600  # grams, of some 200 characters, from which on the floor holds in full
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Per code point: 1 for letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000))
    return _letters[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a text's character 1- to 3-grams; other characters than letters count as one kind of space.

    Long texts are taken piece by piece, with the last two characters carried over, which gives the same counts.
    """
    total = np.zeros(DIMS, np.int64)
    low = text.lower()
    table = _letter_table()
    carry = np.zeros(0, np.uint32)
    for at in range(0, len(low), PIECE):
        codes = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([carry, codes * table[codes]])
        k = len(carry)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        keep[:k] = True
        codes = codes[keep]
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for gram in (one[k:], two[max(0, k - 1) :], three[max(0, k - 2) :]):
            if len(gram):
                total += np.bincount(gram >> np.uint32(32 - 13), minlength=DIMS)
        carry = codes[-2:]
    idx = np.flatnonzero(total)
    return idx, total[idx]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def weighted(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(count)) * idf[idx]
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm else v).astype(np.float32)


@dataclass
class LanguageModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x DIMS, unit rows
    idf: np.ndarray
    floor: np.ndarray  # of each centroid: a smaller cosine of a text of FULL grams is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); ``und``, 0, rejected without letters or without any learned language."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        idx, count = features(text)
        cos = self.centroids[:, idx] @ weighted(idx, count, self.idf)
        k = int(cos.argmax())
        short = min(1.0, float(count.sum()) / FULL) ** 0.5  # a text of few grams meets few of a centroid's
        return self.langs[k], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] < self.floor[k] * short)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Texts that hold each feature, and texts of each language, over all training texts: few sums, added up by Spark."""

    def run(batches):
        df, n = np.zeros(DIMS, np.int64), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                df[features(text)[0]] += 1
                n[lang] = n.get(lang, 0) + 1
        if n:
            cols = [pa.array([None] * DIMS + list(n), pa.string()), pa.array([*range(DIMS), *[-1] * len(n)], pa.int32()), pa.array([*df.tolist(), *n.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "f", "n"])

    sums = train.select("lang", "text").mapInArrow(tidy(run), "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS, np.int64)
    for r in sums:
        if r.f >= 0:
            out[r.f] = r.n
    return out, {r.lang: r.n for r in sums if r.f < 0}


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts far apart, each next the row least similar to those chosen."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                norm = np.linalg.norm(m)
                c[j] = m / norm if norm else m
    return c


def fit(train: DataFrame, per_language: int = 1500, clusters: int = 4, slack: float = 0.5) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows; those without language or letters teach nothing.

    Document frequencies cover all rows. Centroids come from ``per_language`` rows of each language at most, the first by
    a hash of doc_id: this bounds the fit, and languages x ``clusters`` x ``DIMS`` bounds the model. Of rows that
    repeat a doc_id and a language one is in the sample. A language's floor is ``slack`` times the smallest cosine of its sample with its nearest
    centroid, but for the lowest half per cent; it is less for texts of under ``FULL`` grams.
    """
    train = train.where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}"))
    df, texts = document_frequencies(train)
    idf = (np.log((1 + sum(texts.values())) / (1 + df)) + 1).astype(np.float32)
    # a cut through the hashes that leaves a few more than are wanted, so that no task ranks a whole language
    share = {lang: min(1.0, (per_language + 6 * per_language**0.5 + 20) / n) for lang, n in texts.items()}
    cuts = train.sparkSession.createDataFrame([(k, int((v - 0.5) * 2**64) if v < 1 else (1 << 63) - 1) for k, v in share.items()], "l string, cut long")
    rows = train.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().join(F.broadcast(cuts), F.col("lang") == F.col("l")).where("h <= cut")  # a row a language
    ranked = rows.selectExpr("doc_id", "lang", "row_number() over (partition by lang order by h, doc_id) as r")
    chosen = written(ranked.where(F.col("r") <= per_language).select("doc_id", "lang"), "sample")
    sample = train.join(chosen, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def vectors(batch: pa.RecordBatch):
        idx, val = [], []
        for text in batch.column("text").to_pylist():
            i, c = features(text)
            idx.append(i.astype(np.int32))
            val.append(weighted(i, c, idf))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["lang", "idx", "val"])

    def cluster(group: pa.Table) -> pa.Table:
        x = np.zeros((group.num_rows, DIMS), np.float32)
        for row, (i, v) in enumerate(zip(group.column("idx").to_pylist(), group.column("val").to_pylist(), strict=True)):
            x[row, i] = v
        c = spherical_kmeans(x[sorted(range(len(x)), key=lambda i: x[i].tobytes())], clusters)  # in an order of the rows' own
        cos = x @ c.T
        floor = slack * float(np.quantile(cos.max(axis=1), 0.005))
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(c), "c": pa.array(list(c), pa.list_(pa.float32())), "floor": [floor] * len(c)})

    schema = "lang string, idx array<int>, val array<float>"
    rows = arrow_map(sample, lambda: vectors, schema).groupBy("lang").applyInArrow(cluster, "lang string, c array<float>, floor double").collect()
    rows.sort(key=lambda r: (r.lang, r.c))
    return LanguageModel([r.lang for r in rows], np.array([r.c for r in rows], np.float32).reshape(len(rows), DIMS), idf, np.array([r.floor for r in rows]))


def _tagged(docs: DataFrame, text: str, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and rejected at its end, from the column ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def f(batch: pa.RecordBatch):
        found = [shared.value.predict(x) for x in batch.column(text).to_pylist()]
        more = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return arrow_map(docs, lambda: f, ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema), "lang_pred string, score double, rejected boolean"]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected in place of columns so named; only ``text`` is looked at.

    Null texts and texts without letters are ``und`` with score 0 and rejected. Texts of any length are looked at as a whole.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")]
    return _tagged(docs.select(*[F.col("text").cast("string") if c == "text" else F.col(f"`{c}`") for c in kept]), "text", model)


def is_training(doc_id) -> F.Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) != 0


def predict_documents(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every document.

    Learns from the documents whose crc32(doc_id) mod 5 is not 0 and lang is known. A row without doc_id is not held out and
    teaches nothing. An empty table gives an empty result. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = fit(docs.where(is_training(F.col("doc_id"))), **how)
    held = F.coalesce(~is_training(F.col("doc_id")), F.lit(False))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; columns, whatever their names, unchanged.

    Null texts and texts without letters go; rows that repeat and rows without doc_id are judged like others.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = fit(known.where(is_training(F.col("doc_id"))), **how)
    tagged = _tagged(numbered(docs), f"c{docs.columns.index('text')}", model)
    return renamed(tagged.where("not rejected"), docs.columns)
