"""Removal of repeated passages found by fixed-block anchors.

Reference blocks are the runs of ``block`` words at every ``block``-th word of a text; any ``window`` of at least twice that
length holds one of them whole. Every rolling run of ``block`` words probes the block index. A hit anchors a possible repeat;
the windows around anchors are then looked up by a 96-bit hash, and consecutive repeated windows extend to the maximal repeat.

Both look-ups are packed joins: a task hashes a batch of texts and sends each shard of the hash space one compact row; a shard
answers with positions. A batch sends each distinct hash once, so a passage that many documents hold is one entry a batch, and
the number of shards follows the bytes of text, so that a shard's size doesn't. A shard is a task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, shard_names, slices, tidy, written

MULT = 0x9E3779B97F4A7C15
MULT2 = 0xD6E8FEB86659FD93
_digest = partial(xxhash.xxh64_digest, seed=7)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(_digest, words)), "<u8")


def rolling(h: np.ndarray, n: int, mult: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` numbers, by doubling."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    part, length, power = h, 1, np.array([mult], np.uint64)
    while True:
        if n & length:
            out = part[:size] if out is None else out * power + part[have : have + size]
            have += length
        if length * 2 > n:
            return _mix(out)
        part = part[: len(part) - length] * power + part[length:]
        length, power = length * 2, power * power


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


class Batch:
    """Texts hashed together: word hashes of all, with each text's place."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        words = [x.split() for x in texts]
        self.ids = ids
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.hashes = word_hashes([w for x in words for w in x])

    def runs(self, n: int, mult: int = MULT) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the runs of ``n`` words that lie in one text; places count words over the batch."""
        h = rolling(self.hashes, n, mult)
        last = np.repeat(self.starts[1:], self.sizes)[: len(h)]
        at = np.flatnonzero(np.arange(len(h)) + n <= last)
        return at, h[at]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


def _batches(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in stream:
        texts = raw_texts(batch.column("text"))
        for a, b in slices(texts, limit):
            yield batch.slice(a, b - a), texts[a:b]


def _positions(ids: np.ndarray, owner: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """One row a document: packed positions."""
    order = np.lexsort((pos, owner))
    owner, pos = owner[order], pos[order].astype("<u4")
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)])
    ends = np.append(cut[1:], len(owner))[: len(cut)]
    blobs = [pos[a:b].tobytes() for a, b in zip(cut, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids[owner[cut]], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "at"])


# ---- step 1: anchors. Entries name their place in the batch; the batch's header maps places to documents.

SENT = "shard int, batch long, kind int, a binary, b binary, c binary"
HEADER, ENTRIES, SETTLED = 0, 1, 2
_SENT = ["shard", "batch", "kind", "a", "b", "c"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], _SENT)


def _gaps(place: np.ndarray) -> bytes:
    """Ascending places as two-byte gaps, or as they are where one is larger."""
    gap = np.diff(place, prepend=0)
    return gap.astype("<u2").tobytes() if gap.max(initial=0) < 65536 else place.astype("<u4").tobytes()


def _places(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64) if len(raw) == 4 * n else np.cumsum(np.frombuffer(raw, "<u2").astype(np.int64))


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    first, counts = _runs_of(shard[order])
    for s, a, n in zip(shard[order][first].tolist(), first.tolist(), counts.tolist(), strict=True):
        yield s, order[a : a + n]


def anchors(docs: DataFrame, block: int, batch_bytes: int, names: list[int]) -> DataFrame:
    """(doc_id, at): packed places of runs that equal a reference block elsewhere, or are one that a run elsewhere equals."""

    shards = len(names)

    def probe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(stream, batch_bytes):
            b = Batch(batch.column("doc_id").to_numpy(zero_copy_only=False), texts)
            at, h = b.runs(block)
            if not len(at):
                continue
            reference = (at - b.starts[b.owner(at)]) % block == 0
            _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            marks = np.zeros(len(count), bool)
            marks[inverse[reference]] = True
            name = xxhash.xxh64_intdigest(b.ids.tobytes() + b.starts.tobytes()) - (1 << 63)
            rows = [(names[name % shards], name, HEADER, b.ids.astype("<i8").tobytes(), b.starts.astype("<i8").tobytes(), None)]
            again = at[(count > 1)[inverse]]  # repeated in the batch: an anchor whatever the others say
            if len(again):
                rows.append((names[name % shards], name, SETTLED, again.astype("<u4").tobytes(), None, None))
            first.sort()
            h, at, flag = h[first], at[first], marks[inverse[first]]
            for s, o in _by_shard(h, shards):
                rows.append((names[s], name, ENTRIES, h[o].astype("<u4").tobytes(), _gaps(at[o]), np.packbits(flag[o]).tobytes()))
            yield _rows(rows)

    def match(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        out = [group.slice(i, 1) for i in np.flatnonzero(kinds != ENTRIES)]
        got = group.filter(pa.array(kinds == ENTRIES))
        if got.num_rows:
            names, hs, places, flags = got.column("batch").to_pylist(), [], [], []
            for h, place, flag in zip(*(got.column(k).to_pylist() for k in ("a", "b", "c")), strict=True):
                hs.append(np.frombuffer(h, "<u4"))
                n = len(hs[-1])
                places.append(_places(place, n))
                flags.append(np.unpackbits(np.frombuffer(flag, np.uint8), count=n).astype(bool))
            row = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
            h, place, flag = np.concatenate(hs), np.concatenate(places), np.concatenate(flags)
            order = np.argsort(h, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            size = np.diff(np.append(cut, len(h)))
            # a batch sends a hash once, so two entries are of two batches
            hit = np.zeros(len(h), bool)
            hit[order] = np.repeat((size > 1) & np.logical_or.reduceat(flag[order], cut), size)
            for k in np.unique(row[hit]).tolist():
                own = slice(*np.searchsorted(row, [k, k + 1]))
                own = place[own][hit[own]]
                out.append(pa.Table.from_batches([_rows([(0, names[k], SETTLED, own.astype("<u4").tobytes(), None, None)])]))
        schema = _rows([]).schema
        return pa.concat_tables([x.cast(schema) for x in out]) if out else schema.empty_table()

    def resolve(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        head = np.flatnonzero(kinds == HEADER)
        if not len(head):
            raise RuntimeError("a batch's header is missing: its input was not read alike twice")
        ids = np.frombuffer(group.column("a")[int(head[0])].as_py(), "<i8")
        starts = np.frombuffer(group.column("b")[int(head[0])].as_py(), "<i8")
        parts = [np.frombuffer(group.column("a")[int(i)].as_py(), "<u4") for i in np.flatnonzero(kinds == SETTLED)]
        place = np.unique(np.concatenate([*parts, np.zeros(0, np.uint32)])).astype(np.int64)
        owner = np.searchsorted(starts, place, "right") - 1
        return pa.Table.from_batches([_positions(ids, owner, place - starts[owner])])

    sent = docs.mapInArrow(tidy(probe), SENT)
    answers = sent.repartition(shards, "shard").groupBy("shard").applyInArrow(match, SENT)
    return answers.groupBy("batch").applyInArrow(resolve, "doc_id long, at binary")


# ---- step 2: windows around anchors. Entries carry their document, as the earliest one is wanted.

WINDOWS = "shard int, bucket int, ids binary, counts binary, pos binary, h binary, low binary"
_WINDOWS = [x.split()[0] for x in WINDOWS.split(", ")]


def _windows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], _WINDOWS)


def _runs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, counts) of the runs of equal ids."""
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return cut, np.diff(np.append(cut, len(ids)))


def _settled(ids: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple]:
    """Repeated windows, a row for each bucket of documents, whatever the number of documents."""
    bucket = (((ids.astype(np.uint64) * np.uint64(MULT)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pos, ids, bucket))
    bucket, ids, pos = bucket[order], ids[order], pos[order]
    rows = []
    for k, at, n in zip(*(lambda x: (bucket[x[0]].tolist(), x[0].tolist(), x[1].tolist()))(_runs_of(bucket)), strict=True):
        s = slice(at, at + n)
        first, counts = _runs_of(ids[s])
        rows.append((None, k, ids[s][first].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), pos[s].astype("<u4").tobytes(), None, None))
    return rows


def repeated_windows(docs: DataFrame, hits: DataFrame, block: int, window: int, batch_bytes: int, names: list[int]) -> DataFrame:
    """(doc_id, at): packed starts of the windows around anchors whose words also start earlier."""
    lists = hits.groupBy("doc_id").agg(F.collect_list("at").alias("hits"))
    shards = len(names)

    def probe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _batches(stream, batch_bytes):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            by_id = np.argsort(ids, kind="stable")
            b = Batch(ids[by_id], [texts[i] for i in by_id.tolist()])
            near = np.zeros(len(b.hashes) + 1, np.int64)
            blobs = batch.column("hits").to_pylist()
            for k, i in enumerate(by_id.tolist()):
                p = np.frombuffer(b"".join(blobs[i]), "<u4").astype(np.int64)
                p = np.unique(p[p < b.sizes[k]])
                np.add.at(near, b.starts[k] + np.maximum(p - (window - block), 0), 1)
                np.add.at(near, b.starts[k] + p + 1, -1)
            at, h = b.runs(window)
            _, low = b.runs(window, MULT2)
            some = np.cumsum(near)[at] > 0
            at, h, low = at[some], h[some], (low[some] >> np.uint64(32)).astype(np.uint32)
            if not len(at):
                continue
            owner = b.owner(at)
            pos = at - b.starts[owner]
            order = np.lexsort((at, low, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1])])
            lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the earliest equal window of each, in sorted order
            later = order[(order != lead) & ((b.ids[owner[order]] != b.ids[owner[lead]]) | (pos[order] != pos[lead]))]
            rows = []
            if len(later):
                s = names[xxhash.xxh64_intdigest(b.ids.tobytes()) % shards]
                rows += [(s, *r[1:]) for r in _settled(b.ids[owner[later]], pos[later], shards)]
            first = np.sort(order[new])
            h, low, owner, pos = h[first], low[first], owner[first], pos[first]
            for s, o in _by_shard(h, shards):
                cut, counts = _runs_of(owner[o])
                rows.append((names[s], None, b.ids[owner[o][cut]].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), pos[o].astype("<u4").tobytes(), h[o].astype("<u8").tobytes(), low[o].astype("<u4").tobytes()))
            yield _windows(rows)

    def match(group: pa.Table) -> pa.Table:
        sent = group.filter(group.column("bucket").is_null())
        out = [group.filter(group.column("bucket").is_valid())]
        if sent.num_rows:
            read = lambda k, t: np.concatenate([np.frombuffer(x, t) for x in sent.column(k).to_pylist()])
            h, low, pos = read("h", "<u8"), read("low", "<u4"), read("pos", "<u4")
            ids = np.repeat(read("ids", "<i8"), read("counts", "<u4"))
            order = np.lexsort((pos, ids, low, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (low[order][1:] != low[order][:-1])])
            lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later = order[(order != lead) & ((ids[order] != ids[lead]) | (pos[order] != pos[lead]))]
            if len(later):
                out.append(pa.Table.from_batches([_windows(_settled(ids[later], pos[later], shards))]))
        schema = _windows([]).schema
        return pa.concat_tables([x.cast(schema) for x in out])

    def gather(group: pa.Table) -> pa.Table:
        read = lambda k, t: np.concatenate([np.frombuffer(x, t) for x in group.column(k).to_pylist()])
        docs_, local = np.unique(np.repeat(read("ids", "<i8"), read("counts", "<u4")), return_inverse=True)
        return pa.Table.from_batches([_positions(docs_, local, read("pos", "<u4"))])

    near = docs.join(lists, "doc_id")
    answers = near.mapInArrow(tidy(probe), WINDOWS).repartition(shards, "shard").groupBy("shard").applyInArrow(match, WINDOWS)
    return answers.groupBy("bucket").applyInArrow(gather, "doc_id long, at binary")


# ---- step 3


def remove_repeats(docs: DataFrame, starts: DataFrame, window: int, text_out: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]): words under a window of ``starts`` go; others are joined by blanks."""
    lists = starts.groupBy("doc_id").agg(F.collect_list("at").alias("starts"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text_out

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            n_words, n_removed, sha, out = [], [], [], []
            for x, blobs in zip(raw_texts(batch.column("text")), batch.column("starts").to_pylist(), strict=True):
                words = x.split()
                n = len(words)
                if blobs:
                    p = np.unique(np.frombuffer(b"".join(blobs), "<u4").astype(np.int64))
                    p = p[p + window <= n]
                    cover = np.zeros(n + 1, np.int64)
                    cover[p] += 1
                    np.subtract.at(cover, p + window, 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:n] == 0).tolist()]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                sha.append(hashlib.sha256(kept).hexdigest())
                if text_out:
                    out.append(kept)
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            if text_out:
                cols.append(pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * text_out)

    return docs.join(lists, "doc_id", "left").mapInArrow(tidy(cut), schema)


def dedup_passages(docs: DataFrame, window: int = 20, block: int = 10, batch_bytes: int = 4 << 20, shard_bytes: int = 16 << 20, text_out: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]), one row for every row of ``docs``.

    A word goes where a window of ``window`` words that covers it has the same words as one that starts earlier: in a smaller
    doc_id, or before it in the same document. Windows are judged on the input. Null texts have no words. Rows without doc_id
    keep all words and are no reference. Rows that repeat a doc_id are taken for one document: a window is not earlier than
    the one at its own doc_id and start. Equal windows are those with equal 96-bit hashes of their words. An empty table gives
    an empty result; other columns, whatever their names, are ignored; texts of any length are taken as a whole.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole reference block")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = docs.where("doc_id is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = shard_names(docs.sparkSession, max(1, -(-size // shard_bytes)))
    hits = written(anchors(named, block, batch_bytes, names), "anchors")
    starts = written(repeated_windows(named, hits, block, window, batch_bytes, names), "repeats")
    return remove_repeats(docs, starts, window, text_out)
