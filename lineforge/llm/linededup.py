"""Line deduplication over range-partitioned line hashes.

Line hashes are range-partitioned and sorted by hash, then document (largest first), then position. One pass over each
partition streams every key's rows and marks what to drop. A key that reaches a partition's edge may go on in the next one:
its rows pass through marked as open, with one summary a partition, and are settled from the joined summaries (at most two
rows a partition). A document's result is a compressed bitmap of the lines to keep, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, raw_texts, written

SPACE = b" \t\n\x0b\x0c\r"
EVENTS = "h1 long, h2 long, doc_id long, pos int, open boolean, docs long, first long, last long"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def line_hashes(docs: DataFrame, least: int = 20) -> DataFrame:
    """(h1, h2, doc_id, pos): a 128-bit hash of every line key of at least ``least`` code points."""

    def make():
        def f(batch: pa.RecordBatch):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            digests, owner, pos = [], [], []
            for i, x in enumerate(raw_texts(batch.column("text"))):
                for k, line in enumerate(x.split(b"\n")):
                    if len(line) >= least and len(key := line_key(line)) >= least and code_points(key) >= least:
                        digests.append(xxhash.xxh3_128_digest(key))
                        owner.append(i)
                        pos.append(k)
            h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids[owner] if owner else np.zeros(0, np.int64)), pa.array(pos, pa.int32())], ["h1", "h2", "doc_id", "pos"])

        return f

    return arrow_map(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "h1 long, h2 long, doc_id long, pos int")


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])) if len(h1) else np.zeros(0, np.int64)


def stream_drops(least_docs: int):
    """Batch iterator over sorted rows -> events: rows to drop, and for keys at the partition's edges their rows and summaries."""

    def events(h1, h2, doc, pos, open_, docs=None, first=None, last=None):
        n = len(h1)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(h1), pa.array(h2), none if doc is None else pa.array(doc), pa.nulls(n, pa.int32()) if pos is None else pa.array(pos, pa.int32()), pa.array(np.full(n, open_))]
            + [none if x is None else pa.array(x) for x in (docs, first, last)],
            ["h1", "h2", "doc_id", "pos", "open", "docs", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # of the key in progress: (h1, h2, at_edge, first doc, last doc, docs, rows of the first fewer than least_docs documents)

        def close(s, edge):
            """Rows that were held back; a key at an edge leaves its summary."""
            h1, h2, at_edge, first, last, docs, held = s
            if at_edge or edge:
                if held:
                    d, p = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield events(np.full(len(d), h1), np.full(len(d), h2), d, p, True)
                yield events(*(np.array([x]) for x in (h1, h2)), None, None, True, np.array([docs]), np.array([first]), np.array([last]))

        start = True
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "doc_id", "pos"))
            cut = _runs(h1, h2)
            ends = np.append(cut[1:], len(h1))
            new_doc = np.concatenate([[True], (doc[1:] != doc[:-1])])
            new_doc[cut] = True
            docs_in = np.add.reduceat(new_doc.astype(np.int64), cut)
            # runs wholly inside this batch, neither its first nor its last one
            inner = np.zeros(len(cut), bool)
            inner[1:-1] = True
            many = inner & (docs_in >= least_docs)
            of = np.repeat(np.arange(len(cut)), ends - cut)
            gone = many[of] & (doc != doc[cut][of])
            if gone.any():
                yield events(h1[gone], h2[gone], doc[gone], pos[gone], False)
            for k in sorted({0, len(cut) - 1}):
                a, b = cut[k], ends[k]
                if state is not None and (state[0], state[1]) == (h1[a], h2[a]):
                    docs = state[5] + int(docs_in[k]) - int(state[4] == doc[a])
                    state = (*state[:4], int(doc[b - 1]), docs, state[6])
                else:
                    if state is not None:
                        yield from close(state, False)
                    state = (int(h1[a]), int(h2[a]), start, int(doc[a]), int(doc[b - 1]), int(docs_in[k]), [])
                start = False
                state[6].append((doc[a:b], pos[a:b]))
                if state[5] >= least_docs or state[2]:  # nothing more need be held: an edge key's rows go out open, others are settled
                    d, p = (np.concatenate(x) for x in zip(*state[6], strict=True))
                    state[6].clear()
                    if state[2]:
                        yield events(np.full(len(d), state[0]), np.full(len(d), state[1]), d, p, True)
                    else:
                        yield from flush_settled(state, d, p)
        if state is not None:
            yield from close(state, True)

    def flush_settled(state, d, p):
        # whether the key goes on in the next partition doesn't matter for these rows: enough documents hold it and the first is the largest
        keep = d != state[3]
        if keep.any():
            yield events(np.full(int(keep.sum()), state[0]), np.full(int(keep.sum()), state[1]), d[keep], p[keep], False)

    return run


def dropped_lines(docs: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, pos): lines to drop."""
    spark = docs.sparkSession
    hashes = written(line_hashes(docs, least), "line-hashes")
    order = ["h1", "h2", F.col("doc_id").desc(), "pos"]
    ranged = hashes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ev = written(ranged.mapInArrow(stream_drops(least_docs), EVENTS), "line-events")
    # at most two summaries a partition: of its first and its last key
    parts = F.expr("transform(array_sort(collect_list(struct(-first as k, -last as l, docs))), x -> struct(-x.k as first, -x.l as last, x.docs as docs))")
    step = "named_struct('n', s.n + x.docs - if(s.last <=> x.first, 1L, 0L), 'last', x.last)"
    total = F.expr(f"aggregate(parts, named_struct('n', 0L, 'last', cast(null as bigint)), (s, x) -> {step}, s -> s.n)")
    keys = (
        ev.where("docs is not null")
        .groupBy("h1", "h2")
        .agg(parts.alias("parts"))
        .select("h1", "h2", F.expr("parts[0].first").alias("largest"), total.alias("n"))
        .where(F.col("n") >= least_docs)
    )
    open_rows = ev.where("open and docs is null").join(F.broadcast(keys), ["h1", "h2"]).where("doc_id != largest")
    return ev.where("not open").select("doc_id", "pos").union(open_rows.select("doc_id", "pos"))


def keep_bitmap(dropped: np.ndarray, n_lines: int) -> bytes:
    bits = np.ones(n_lines, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def read_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def line_keep_bitmaps(docs: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, n_dropped, last_dropped, keep_bitmap) for the documents that lose lines.

    Keys (stripped, A-Z lower-cased) of at least ``least`` code points found in at least ``least_docs`` documents lose all
    their lines except in the largest doc_id that holds them. The bitmap has a bit for every line up to the last dropped one,
    zlib-compressed; later lines stay.
    """
    lists = dropped_lines(docs, least, least_docs).groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))

    def make():
        def f(batch: pa.RecordBatch):
            maps, last, n = [], [], []
            for gone in batch.column("gone"):
                g = gone.values.to_numpy(zero_copy_only=False)
                n.append(len(g))
                last.append(int(g.max()))
                maps.append(keep_bitmap(g, last[-1] + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(last, pa.int32()), pa.array(maps, pa.binary())], ["doc_id", "n_dropped", "last_dropped", "keep_bitmap"])

        return f

    return arrow_map(lists, make, "doc_id long, n_dropped long, last_dropped int, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text_out: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, text]): each text without its dropped lines, the others joined by newlines."""
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * text_out

    def make():
        def f(batch: pa.RecordBatch):
            ids, n_lines, n_dropped, sha, out = batch.column("doc_id"), [], [], [], []
            maps, last = batch.column("keep_bitmap").to_pylist(), batch.column("last_dropped").to_pylist()
            for x, bitmap, end in zip(raw_texts(batch.column("text")), maps, last, strict=True):
                n = x.count(b"\n") + 1
                gone = 0
                if bitmap is not None:
                    keep = read_bitmap(bitmap, end + 1)
                    lines = x.split(b"\n")
                    left = [line for line, k in zip(lines, keep.tolist(), strict=False) if k] + lines[end + 1 :]
                    gone = n - len(left)
                    x = b"\n".join(left)
                n_lines.append(n)
                n_dropped.append(gone)
                sha.append(hashlib.sha256(x).hexdigest())
                if text_out:
                    out.append(x)
            cols = [ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha)]
            if text_out:
                cols.append(pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["text"] * text_out)

        return f

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the same join at every size: bitmaps grow with the texts
    joined = texts.join(bitmaps.select("doc_id", "last_dropped", "keep_bitmap").hint("merge"), "doc_id", "left")
    return arrow_map(joined, make, schema)


def dedup_lines(docs: DataFrame, least: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row for every row of ``docs``.

    Null or empty text is one empty line. Rows without doc_id keep all lines and do not count as documents; rows that repeat
    a doc_id are one document, whose dropped positions apply to each. An empty table gives an empty result; other columns
    are ignored.
    """
    bitmaps = written(line_keep_bitmaps(docs, least, least_docs), "bitmaps")
    return apply_bitmaps(docs, bitmaps)
