"""Seeded generators: distributions, the 48-bit generator, mutations, and a shotgun read simulator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.rand(seed) * (hi - lo) + lo


def normal(seed: int, mean: float = 0.0, spread: float = 1.0) -> Column:
    return F.randn(seed) * spread + mean


def exponential(seed: int, rate: float = 1.0) -> Column:
    return -F.log(1 - F.rand(seed)) / rate


def geometric(seed: int, p: float) -> Column:
    return F.floor(F.log(1 - F.rand(seed)) / float(np.log1p(-p))).cast("int")


def coin(seed: int, p: float = 0.5) -> Column:
    return F.rand(seed) < p


def poisson(seed: int, mean: float) -> Column:
    """By counting exponential waits, bounded at mean + 12 sqrt(mean) + 24 draws."""
    draws = int(mean + 12 * mean**0.5 + 24)
    waits = F.array(*[exponential(seed + k) for k in range(draws)])
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("n"))
    return F.aggregate(waits, start, lambda a, w: F.struct((a["t"] + w).alias("t"), F.when(a["t"] + w <= mean, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])


def binomial(seed: int, n: int, p: float) -> Column:
    """Heads in ``n`` throws of a coin."""
    return F.aggregate(F.array(*[coin(seed + k, p).cast("int") for k in range(n)]), F.lit(0), lambda a, x: a + x)


def weighted(seed: int, weights: list[float]) -> Column:
    """A place in ``weights``, as often as its weight asks for."""
    ends = np.cumsum(weights) / sum(weights)
    reached = lambda u: F.aggregate(F.array(*[F.lit(float(e)) for e in ends[:-1]]).cast("array<double>"), F.lit(0), lambda a, e: a + (u >= e).cast("int"))
    return F.transform(F.array(F.rand(seed)), reached)[0]


# fixed values: multiplier and increment of the 48-bit linear congruential generator, and the low bits of a seed
MULTIPLIER, INCREMENT, SEED_LOW = 0x5DEECE66D, 0xB, 0x330E
_M48 = (1 << 48) - 1


class Random48:
    """The 48-bit generator: ``linked`` ones share their state, and ``jump`` goes ahead any number of draws at once."""

    def __init__(self, seed: int):
        self._state = [(seed & 0xFFFFFFFF) << 16 | SEED_LOW]

    def next(self) -> float:
        self._state[0] = (self._state[0] * MULTIPLIER + INCREMENT) & _M48
        return self._state[0] / (1 << 48)

    def linked(self) -> Random48:
        """Another handle of the same stream."""
        out = Random48(0)
        out._state = self._state
        return out

    def unlinked(self) -> Random48:
        """A stream of its own from the present state on."""
        out = Random48(0)
        out._state = list(self._state)
        return out

    def jump(self, n: int) -> None:
        a, c, mul, add = 1, 0, MULTIPLIER, INCREMENT
        while n:
            if n & 1:
                a, c = a * mul & _M48, (c * mul + add) & _M48
            mul, add, n = mul * mul & _M48, (add * mul + add) & _M48, n >> 1
        self._state[0] = (self._state[0] * a + c) & _M48


def with_random48(df: DataFrame, ordinal: str, seed: int, name: str = "u") -> DataFrame:
    """Add the draw of each row's ordinal (from 1): tasks jump to their place, so rows get the same numbers in any partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, at = Random48(seed), 0
        for b in batches:
            out = []
            for k in b.column(ordinal).to_pylist():
                if k <= at:
                    g, at = Random48(seed), 0
                g.jump(k - at - 1)
                out.append(g.next())
                at = k
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` double"]))


def _each(df: DataFrame, key: str, seq: str, seed: int, change) -> DataFrame:
    """Replace every sequence by ``change(rng, bytes)``, with draws that depend on the seed and the key alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            out = []
            for name, text in zip(b.column(key).to_pylist(), b.column(seq).to_pylist(), strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
                out.append(None if text is None else change(rng, text.encode("latin-1")).decode("latin-1"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == seq else b.column(c) for c in b.schema.names], b.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes))


_BASES = np.frombuffer(b"acgt", np.uint8)


def mutate(df: DataFrame, key: str, seq: str, rate: float, seed: int = 1) -> DataFrame:
    """Substitute bases at ``rate``, each by one of the three others."""

    def change(rng, data: bytes) -> bytes:
        x = np.frombuffer(data.lower(), np.uint8).copy()
        hit = np.flatnonzero(rng.random(len(x)) < rate)
        code = np.searchsorted(_BASES, x[hit])
        known = (code < 4) & (_BASES[np.minimum(code, 3)] == x[hit])
        x[hit[known]] = _BASES[(code[known] + rng.integers(1, 4, int(known.sum()))) % 4]
        return x.tobytes()

    return _each(df, key, seq, seed, change)


def fill_gaps(df: DataFrame, key: str, seq: str, seed: int = 1) -> DataFrame:
    """Replace everything other than a, c, g, t by random bases, as for the scaffolds that reads are drawn from."""

    def change(rng, data: bytes) -> bytes:
        x = np.frombuffer(data.lower(), np.uint8).copy()
        gap = ~np.isin(x, _BASES)
        x[gap] = _BASES[rng.integers(0, 4, int(gap.sum()))]
        return x.tobytes()

    return _each(df, key, seq, seed, change)


READS = "src string, read bigint, beg bigint, end bigint, rc boolean, seq string"


def shotgun(scaffolds: DataFrame, coverage: float, mean: float = 1000.0, spread: float = 0.2, shortest: int = 50, error: float = 0.0, seed: int = 1) -> DataFrame:
    """Reads of (id, seq): log-normal lengths, uniform starts, random strands, substitutions, insertions and deletions.

    A scaffold's number of reads follows its length, so that all tasks together reach ``coverage``; the draws depend on the
    seed and the scaffold's id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        comp = bytes.maketrans(b"acgtACGT", b"tgcaTGCA")
        for b in batches:
            for name, seq in zip(b.column("id").to_pylist(), b.column("seq").to_pylist(), strict=True):
                rng = np.random.default_rng([seed, zlib.crc32(str(name).encode())])
                data, rows, total = (seq or "").encode(), [], 0
                while len(data) >= shortest and total < coverage * len(data):
                    n = int(min(len(data), max(shortest, rng.lognormal(np.log(mean), spread))))
                    beg = int(rng.integers(0, len(data) - n + 1))
                    rc = bool(rng.random() < 0.5)
                    read = data[beg : beg + n]
                    read = read.translate(comp)[::-1] if rc else read
                    if error:
                        out, kinds = bytearray(), rng.random(n)
                        for c, k, x in zip(read, kinds, rng.integers(0, 4, n), strict=True):
                            if k < error / 3:
                                continue  # deletion
                            out.append(b"acgt"[x] if k < 2 * error / 3 else c)
                            if 2 * error / 3 <= k < error:
                                out.append(b"acgt"[x])  # insertion
                        read = bytes(out)
                    rows.append((str(name), len(rows), beg, beg + n, rc, read.decode()))
                    total += n
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["src", "read", "beg", "end", "rc", "seq"])

    return scaffolds.select(F.col("id").cast("string"), "seq").mapInArrow(run, READS)
