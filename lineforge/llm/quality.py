"""Quality by the perplexity of a modified Kneser-Ney model over characters.

The model counts the n-grams of all trusted text, language by language. The distinct n-grams of all documents then get their
interpolated log probability by joins with the count tables, order by order; every join is sharded by its n-gram. A document's
log likelihood is the sum over its characters, so the probabilities can be handed out in slices of bounded size: each slice
adds its part, and a document's parts are added up.

The model learns from four fifths of the trusted documents; thresholds are quantiles of the perplexity of the other fifth in
each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, tidy, written
from .langid import is_training

ORDER = 4
START = "\x02"
SLICE = 1_000_000  # n-grams of one broadcast slice: 4 million slots of 12 bytes


def _joined(texts: list[str], order: int) -> np.ndarray:
    """Code points of texts, each after ``order`` - 1 start marks."""
    pad = START * (order - 1)
    return np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)


def _normal(text: str | None) -> str:
    return " ".join(text.replace(START, " ").split()) if text else ""


def _groups(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[str, list[str], list[int]]]:
    """(lang, texts, rows) of about ``limit`` characters."""
    held: dict[str, tuple[list[str], list[int]]] = {}
    size: dict[str, int] = {}
    for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)):
        texts, rows = held.setdefault(lang, ([], []))
        texts.append(_normal(text))
        rows.append(i)
        size[lang] = size.get(lang, 0) + len(texts[-1])
        if size[lang] >= limit:
            yield lang, *held.pop(lang)
            size[lang] = 0
    for lang, (texts, rows) in held.items():
        yield lang, texts, rows


def _distinct_grams(texts: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """Distinct n-grams that end in a text's character, with counts. Characters are numbered, so that as many as can be fit 63 bits."""
    cps = _joined(texts, order)
    present = np.flatnonzero(np.bincount(cps))
    number = np.zeros(int(present[-1]) + 1, np.int64)
    number[present] = np.arange(len(present))
    ids = number[cps]
    bits = max(1, int(len(present) - 1).bit_length())  # 21 at most, so that three characters fit 63 bits
    n = len(cps) - order + 1
    if n <= 0:
        return [], np.zeros(0, np.int64)
    per = 63 // bits
    words = []
    for at in range(0, order, per):
        packed = np.zeros(n, np.int64)
        for k in range(at, min(at + per, order)):
            packed = (packed << bits) | ids[k : k + n]
        words.append(packed[cps[order - 1 :] != ord(START)])
    if len(words) == 1:
        _, first, counts = np.unique(words[0], return_index=True, return_counts=True)
    else:
        _, first, counts = np.unique(np.stack(words, axis=1), axis=0, return_index=True, return_counts=True)
    at = np.flatnonzero(cps[order - 1 :] != ord(START))[first]
    flat = cps[at[:, None] + np.arange(order)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [flat[i : i + order] for i in range(0, len(flat), order)], counts


def gram_counts(docs: DataFrame, order: int = ORDER, limit: int = 2_000_000) -> DataFrame:
    """(lang, gram, n) over (lang, text) rows, each n-gram once a task and language as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def emit(lang):
            found = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, texts, _ in _groups(batch, limit):
                own = held.setdefault(lang, {})
                for g, n in zip(*(lambda x, y: (x, y.tolist()))(*_distinct_grams(texts, order)), strict=True):
                    own[g] = own.get(g, 0) + n
                if sum(map(len, held.values())) > SLICE:
                    yield from [emit(k) for k in list(held)]
        yield from [emit(k) for k in list(held)]

    return docs.mapInArrow(tidy(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of one order, a row a language, from its counts of counts; 1/2, 1 and 3/2 where these don't give any.

    None is under 0.1, so that every context leaves something to unseen n-grams.
    """
    c = [F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)]
    y = F.col("c1") / (F.col("c1") + 2 * F.col("c2"))
    fair = (F.col("c1") > 0) & (F.col("c2") > 0) & (F.col("c3") > 0)
    d = lambda k, other: F.when(fair, F.greatest(F.lit(0.1), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"c{k + 1}") / F.col(f"c{k}")))).otherwise(other).alias(f"d{k}")
    return counts.groupBy("lang").agg(*c).select("lang", d(1, 0.5), d(2, 1.0), d(3, 1.5))


def train(trusted: DataFrame, order: int = ORDER) -> list[dict[str, DataFrame]]:
    """For each order from 1: ``grams`` (lang, gram, num) with the discounted share, ``contexts`` (lang, ctx, gamma).

    The highest order has occurrences, lower ones continuation counts.
    """
    counts = written(gram_counts(trusted, order), "grams")
    model = []
    for k in range(order, 0, -1):
        disc = _discounts(counts)
        ctx = F.substring("gram", 1, k - 1) if k > 1 else F.lit("")
        n = F.col("n")
        sums = counts.groupBy("lang", ctx.alias("ctx")).agg(
            F.sum("n").alias("total"), *[F.count(F.when(n == i, 1)).alias(f"n{i}") for i in (1, 2)], F.count(F.when(n > 2, 1)).alias("n3")
        )
        gamma = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")
        contexts = written(sums.join(F.broadcast(disc), "lang").select("lang", "ctx", "total", gamma.alias("gamma"), "d1", "d2", "d3"), f"contexts{k}")
        off = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = counts.withColumn("ctx", ctx).join(contexts, ["lang", "ctx"]).select("lang", "gram", ((n - off) / F.col("total")).alias("num"))
        model.append({"grams": written(grams, f"shares{k}"), "contexts": contexts.select("lang", "ctx", "gamma")})
        if k > 1:
            counts = written(counts.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count("*").alias("n")), f"grams{k - 1}")
    return model[::-1]


def probabilities(wanted: DataFrame, model: list[dict[str, DataFrame]]) -> DataFrame:
    """(lang, gram, logp) of every wanted n-gram in a language that has a model, interpolated from the lowest order up."""
    order = len(model)
    vocabulary = model[0]["grams"].groupBy("lang").agg(F.count("*").alias("v"))
    need = [wanted]
    for k in range(order - 1, 0, -1):
        need.append(need[-1].select("lang", F.substring("gram", 2, k).alias("gram")).distinct())
    lower = None
    for k, asked in enumerate(need[::-1], 1):
        tables = model[k - 1]
        if k == 1:
            base = asked.join(F.broadcast(vocabulary), "lang").withColumn("rest", 1 / (F.col("v") + 1)).withColumn("ctx", F.lit(""))
        else:
            suffix = asked.select("lang", "gram", F.substring("gram", 2, k - 1).alias("low"), F.substring("gram", 1, k - 1).alias("ctx"))
            base = suffix.join(lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("rest")), ["lang", "low"])
        both = base.join(tables["contexts"], ["lang", "ctx"], "left").join(tables["grams"], ["lang", "gram"], "left")
        p = F.coalesce("num", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("rest")
        lower = written(both.select("lang", "gram", p.alias("p")), f"p{k}")
    return lower.select("lang", "gram", F.log("p").alias("logp"))


def _codes(cps: np.ndarray, order: int, lang: str) -> np.ndarray:
    """64-bit hash of the n-gram at every position."""
    n = len(cps) - order + 1
    h = np.full(max(n, 0), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    wide = cps.astype(np.uint64)
    for k in range(order):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Slots:
    """code -> logp: slots by the code's top bits, and a sorted list of those that found theirs taken."""

    def __init__(self, codes: np.ndarray, logp: np.ndarray):
        bits = max(4, int(4 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = (codes >> self.shift).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        self.keys[slot[first]], self.vals[slot[first]] = codes[first], logp[first]
        rest = np.setdiff1d(np.arange(len(codes)), first)
        order = np.argsort(codes[rest])
        self.more, self.more_vals = codes[rest][order], logp[rest][order].astype(np.float32)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logp, found) of each code."""
        slot = (codes >> self.shift).astype(np.int64)
        found = self.keys[slot] == codes
        out = np.where(found, self.vals[slot], np.float32(0))
        miss = np.flatnonzero(~found)
        if len(miss) and len(self.more):
            at = np.minimum(np.searchsorted(self.more, codes[miss]), len(self.more) - 1)
            ok = self.more[at] == codes[miss]
            out[miss[ok]] = self.more_vals[at[ok]]
            found[miss[ok]] = True
        return out, found


def partial_scores(docs: DataFrame, slots, order: int, limit: int = 2_000_000) -> DataFrame:
    """(doc_id, lang, row, n, found, logp): for every row the characters, those whose n-gram is in the slice, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Slots = slots.value
        for batch in batches:
            n, found, total = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.float64))
            for lang, texts, rows in _groups(batch, limit):
                cps = _joined(texts, order)
                logp, hit = table.find(_codes(cps, order, lang))
                real = cps[order - 1 :] != ord(START)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                ends = np.cumsum(sizes)
                hits, sums = np.concatenate([[0], np.cumsum(hit[real])]), np.concatenate([[0.0], np.cumsum(logp[real], dtype=np.float64)])
                n[rows], found[rows], total[rows] = sizes, hits[ends] - hits[ends - sizes], sums[ends] - sums[ends - sizes]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("row"), pa.array(n), pa.array(found), pa.array(total)], ["doc_id", "lang", "row", "n", "found", "logp"])

    return docs.mapInArrow(tidy(run), "doc_id long, lang string, row long, n long, found long, logp double")


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity) for every row of (doc_id, lang, row, text); perplexity null without a model or text."""
    spark = docs.sparkSession
    model = train(trusted.select("lang", "text"), order)
    wanted = written(gram_counts(docs.select("lang", "text"), order).select("lang", "gram"), "wanted")
    probs = probabilities(wanted, model)

    def code(batch: pa.RecordBatch):
        langs, grams = batch.column("lang").to_pylist(), batch.column("gram").to_pylist()
        out = np.zeros(len(langs), np.uint64)
        for lang in set(langs):
            rows = [i for i, x in enumerate(langs) if x == lang]
            cps = np.frombuffer("".join(grams[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
            out[rows] = _codes(cps, order, lang)[::order]
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column("logp")], ["code", "logp"])

    coded = written(arrow_map(probs, lambda: code, "code long, logp double"), "coded")
    n_slices = max(1, -(-coded.count() // SLICE))
    parts = None
    for k in range(n_slices):
        own = coded.where(F.pmod("code", F.lit(n_slices)) == k).toArrow()
        table = Slots(own.column("code").to_numpy().view(np.uint64), own.column("logp").to_numpy())
        part = partial_scores(docs, spark.sparkContext.broadcast(table), order)
        parts = part if parts is None else parts.union(part)
    sums = parts.groupBy("doc_id", "lang", "row").agg(F.max("n").alias("n"), F.sum("found").alias("found"), F.sum("logp").alias("logp"), F.count("*").alias("rows"))
    copies = F.col("rows") / F.lit(n_slices)
    full = (F.col("n") > 0) & (F.col("found") == F.col("n") * copies)
    scored = sums.select("doc_id", "lang", "n", F.when(full, F.exp(-F.col("logp") / copies / F.col("n"))).alias("perplexity"), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))
    return scored.select("doc_id", "lang", F.col("n").alias("n_chars"), "perplexity")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.1, spread: float = 3.0, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, threshold, kept), one row for every row of ``docs``.

    Trusted are documents labelled quality 1 and not toxic. Those whose crc32(doc_id) mod 5 is not 0 train the model, the others
    give the thresholds (where a language has none of these, its training documents do). A document is kept unless its
    perplexity exceeds its threshold: ``margin`` times the ``quantile`` of its language, where every perplexity counts relative
    to exp(``spread`` / sqrt(n_chars)), the error of a mean over few characters. Null languages form one language, ``und``.
    Without any text a document isn't kept; where its language has no trusted text there is no threshold and it is. Rows that
    repeat are scored each; long texts as a whole; an empty table gives an empty result; other columns, whatever their names,
    are ignored.
    """
    row = F.xxhash64("text")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string")).withColumn("row", row)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    good = written(good, "trusted")
    training = docs.join(good.where(is_training(F.col("doc_id"))), "doc_id", "left_semi")
    scored = written(perplexities(docs, training, order), "perplexity")
    allowance = F.exp(F.lit(spread) / F.sqrt(F.greatest(F.col("n_chars"), F.lit(1))))
    trusted = scored.join(good, "doc_id", "left_semi").where("perplexity is not null").select("lang", is_training(F.col("doc_id")).alias("seen"), (F.col("perplexity") / allowance).alias("p"))
    at = lambda x: F.percentile_approx(x, quantile, 10000)
    limits = trusted.groupBy("lang").agg((F.coalesce(at(F.when(~F.col("seen"), F.col("p"))), at(F.col("p"))) * margin).alias("threshold"))
    out = scored.join(F.broadcast(limits), "lang", "left").withColumn("threshold", F.col("threshold") * allowance)  # a row a language
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), (F.col("n_chars") > 0) & F.col("threshold").isNull())
    return out.select("doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(kept, F.lit(False)).alias("kept"))
