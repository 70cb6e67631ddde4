"""SimHash near-duplicate detection by a binary-trie self-join.

A text's fingerprint sums the bits of its word shingles' hashes. Distinct fingerprints are the leaves of a binary trie whose
node pairs are traversed together; a pair's differing bits accumulate on the way down and the pair is dropped once they exceed
the error budget. With up to 3 differing bits at least one half of a fingerprint has no more than 1, so the trie is walked in
two bit orders, each with a budget of 1 for the first 32 levels and 3 below: no link is lost and few pairs live.

The upper levels are walked by Spark: a node pair is a group of rows, split further while it holds more than ``node_rows``
points. The lower levels are walked inside a task, on sorted arrays.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, one_row_each, raw_texts, without, written
from .components import connected_components

BITS, HALF = 64, 32
BUDGET, HALF_BUDGET = 3, 1
_digest = partial(xxhash.xxh64_digest, seed=42)


def fingerprint(text: bytes, words_in: int = 3, block: int = 1 << 16) -> int:
    """64-bit SimHash of a text's word shingles, A-Z lower-cased; without words it is zero."""
    words = text.lower().split()
    n = len(words) - words_in + 1
    if not words:
        return 0
    if n < 1:
        words, n = [b" ".join(words)], 1
        pieces = iter(words)
    else:
        pieces = map(b" ".join, zip(*(words[k:] for k in range(words_in)), strict=False))
    ones = np.zeros(BITS, np.int64)
    digests = map(_digest, pieces)
    for at in range(0, n, block):
        part = b"".join(x for _, x in zip(range(min(block, n - at)), digests, strict=False))
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The bits that over half of the unsigned 64-bit hashes have set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at : at + block].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_in: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number. Null text counts as empty."""

    def make():
        def f(batch: pa.RecordBatch):
            fps = np.array([fingerprint(x, words_in) for x in raw_texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

        return f

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, fp long")


def _allowed(depth: int) -> int:
    return HALF_BUDGET if depth <= HALF else BUDGET


def close_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, dist: int, leaf: int = 256, chunk: int = 1 << 16):
    """Yield index arrays (i, j) of keys a[i], b[j] within the budget; a and b are sorted unsigned keys.

    All of a share their first ``depth`` bits, as do all of b, and these prefixes differ in ``dist`` bits. b None: pairs
    within a, each once.
    """
    same = b is None
    b = a if same else b
    zeros: dict[tuple[int, int], np.ndarray] = {}

    def split(side: int, keys: np.ndarray, d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if (side, d) not in zeros:
            zeros[side, d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1) == 0)]).astype(np.int64)
        z = zeros[side, d]
        return lo + z[hi] - z[lo]

    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(dist))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        done = ((ahi - alo) * (bhi - blo) <= leaf) | (d == BITS)
        if done.any():
            yield from _verify(a, b, alo[done], ahi[done], blo[done], bhi[done], same)
            keep = ~done
            alo, ahi, blo, bhi, err = alo[keep], ahi[keep], blo[keep], bhi[keep], err[keep]
        if not len(alo):
            continue
        am, bm = split(0, a, d, alo, ahi), split(1, b, d, blo, bhi)
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), (am, ahi, blo, bm, err + 1)]
        if same:  # of a node with itself the two mixed pairs are one
            own = (alo == blo) & (ahi == bhi)
            parts[3] = tuple(x[~own] for x in parts[3])
        alo, ahi, blo, bhi, err = (np.concatenate([p[k] for p in parts]) for k in range(5))
        live = (ahi > alo) & (bhi > blo) & (err <= _allowed(d + 1))
        alo, ahi, blo, bhi, err = alo[live], ahi[live], blo[live], bhi[live], err[live]
        for at in range(0, len(alo), chunk):
            s = slice(at, at + chunk)
            stack.append((d + 1, alo[s], ahi[s], blo[s], bhi[s], err[s]))


def _verify(a, b, alo, ahi, blo, bhi, same, most: int = 1 << 21):
    na, nb = ahi - alo, bhi - blo
    sizes = na * nb
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        s = slice(start, stop)
        rep = sizes[s]
        pair = np.repeat(np.arange(start, stop), rep)
        k = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
        i, j = alo[pair] + k // nb[pair], blo[pair] + k % nb[pair]
        ok = np.bitwise_count(a[i] ^ b[j]) <= BUDGET
        if same:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]
        start = stop


class Forest:
    """Labels of connected points, the smallest index in each."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[i], label[j]
            open_ = x != y
            if not open_.any():
                return
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def node_pair_links(group: pa.Table) -> pa.Table:
    """Links (a, b) of representatives that connect the points of one node pair: a forest, not all pairs."""
    key = group.column("key").to_numpy().view(np.uint64)
    rep = group.column("rep").to_numpy()
    side = group.column("side").to_numpy()
    order = np.lexsort((key, side))
    key, rep, side = key[order], rep[order], side[order]
    n = int(np.searchsorted(side, 1))
    depth, dist = group.column("depth")[0].as_py(), group.column("dist")[0].as_py()
    same = group.column("p")[0].as_py() == group.column("q")[0].as_py()
    forest = Forest(len(key))
    if same:
        pairs = close_pairs(key, None, depth, dist)
    elif 0 < n < len(key):
        pairs = close_pairs(key[:n], key[n:], depth, dist)
    else:
        pairs = ()
    for i, j in pairs:
        forest.join(i, j if same else j + n)
    linked = np.flatnonzero(forest.label != np.arange(len(key)))
    return pa.table({"a": pa.array(rep[forest.label[linked]], pa.int64()), "b": pa.array(rep[linked], pa.int64())})


def _top(key, bits):
    return F.shiftrightunsigned(key, BITS - bits) if bits else F.lit(0).cast("long")


NODES = ["trie", "depth", "p", "q", "dist"]


def _descend(rows: DataFrame, depth: int, bits: int) -> DataFrame:
    """Deal the points of node pairs at ``depth`` to the live child pairs ``bits`` levels further down.

    A point goes to a pair for every neighbour prefix that keeps the accumulated differing bits within the budget.
    """
    to = depth + bits
    masks = [m for m in range(1 << bits) if bin(m).count("1") <= _allowed(to)]
    spread = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(bin(m).count("1")).alias("e")) for m in masks])
    own = F.expr(f"(p = q)")
    child = _top(F.col("key"), to)
    live = rows.select("*", child.alias("c"), F.explode(spread).alias("x")).where(F.col("dist") + F.col("x.e") <= _allowed(to))
    other_top = F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p"))
    low = F.col("c").bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.col("x.m"))
    mate = F.shiftleft(other_top, bits).bitwiseOR(low)
    first = F.when(own, F.col("c") <= mate).otherwise(F.col("side") == 0)
    return live.select(
        "trie",
        F.lit(to).alias("depth"),
        F.when(first, F.col("c")).otherwise(mate).alias("p"),
        F.when(first, mate).otherwise(F.col("c")).alias("q"),
        (F.col("dist") + F.col("x.e")).cast("int").alias("dist"),
        F.when(first, 0).otherwise(1).alias("side"),
        "key",
        "rep",
    )


def near_links(points: DataFrame, node_rows: int = 2048, step: int = 4) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints, enough to connect all within the budget.

    ``points``: (fp, rep), each fp once. A node pair of more than 8 ``node_rows`` rows is split further, down to the leaves,
    so that no task gets an unbounded group.
    """
    total = points.count()
    depth = min(HALF, max(0, math.ceil(math.log2(max(1, total) / node_rows))))
    rotated = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    tries = points.select("rep", F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("trie"), rotated.alias("key")))).alias("t"))
    rows = tries.select("t.trie", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("dist"), F.lit(0).alias("side"), "t.key", "rep")
    at = 0
    while at < depth:
        bits = min(step, depth - at)
        rows, at = _descend(rows, at, bits), at + bits
    found = []
    while True:
        rows = written(rows, "node-pairs", "lz4")
        big = rows.groupBy(NODES).agg(F.count("*").alias("n"), F.count(F.when(F.col("side") == 0, 1)).alias("n0")).where(f"n > {8 * node_rows} and (p = q or n0 between 1 and n - 1)")
        big = written(big.select(NODES), "large-pairs")
        split = at < BITS and big.head(1) != []
        small = rows.join(big, NODES, "left_anti") if split else rows
        links = small.groupBy(NODES).applyInArrow(node_pair_links, "a long, b long")
        found.append(written(links.distinct(), "links"))
        if not split:
            break
        bits = min(step, BITS - at)
        rows, at = _descend(rows.join(big, NODES, "left_semi"), at, bits), at + bits
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, words_in: int = 3, node_rows: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document with a doc_id.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id reachable over links. Texts without
    words (null, empty) have fingerprint zero, linked like any other. Rows that repeat a doc_id give a row each. An empty
    table gives an empty result; rows without doc_id cannot be in a component and have a null component_id. Other columns,
    whatever their names, are ignored. Long texts are read once and never moved.
    """
    fps = written(fingerprints(docs, words_in), "fingerprints")
    ties = fps.where("doc_id is not null")
    points = written(ties.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    own = ties.join(points, "fp").where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    repeated = ties.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("doc_id")
    links = near_links(points, node_rows).union(own.join(repeated, F.col("b") == F.col("doc_id"), "left_semi"))
    component = connected_components(links)
    named = written(points.join(component, points["rep"] == component["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    out = fps.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; columns, whatever their names, unchanged.

    Rows that repeat a doc_id are one document: the least of its rows by all columns stays. Rows without doc_id stay.
    """
    gone = near_duplicates(docs, **how).where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    return one_row_each(without(docs, gone), "doc_id")
