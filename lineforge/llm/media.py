"""Media columns stored as content-defined chunks.

A payload is wrapped as an 8-bit grey image (binary PGM, 576 samples a line), and the image's bytes are cut by a rolling gear
hash. Joins on chunk digests give every distinct chunk one owner, the first document and place that holds it. The store has a
row for each document with the compressed chunks it owns; the manifest has every document's ordered chunk list. Reading puts
a document's own chunks and those fetched from other owners together in order and verifies every digest.

Bytes move once, compressed, on the way into the store; only chunks that several documents share move again when they are read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import boundaries
from .common import arrow_map, raw_texts, written

WIDTH = 576
PAD = b"\xff"
NO_DOC = -(1 << 63)
PARTS = "array<struct<seq: int, n: int, own: boolean, shared: boolean>>"


def name_of(digest) -> bytes:
    """A medium's name: 128 bits of its SHA-256."""
    return digest.digest()[:16]


def payload_of(text: bytes) -> bytes:
    """UTF-8 bytes padded with 255 to a positive multiple of 576."""
    return text + PAD * (max(1, -(-len(text) // WIDTH)) * WIDTH - len(text))


def to_image(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_image(image: bytes) -> bytes:
    """The samples of a binary PGM with one byte a sample; raises on anything else."""
    kind, size, depth, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return samples


def feature(samples: bytes) -> str:
    """Samples' mean and spread, histogram over eight ranges, and mean absolute step along a line."""
    x = np.frombuffer(samples, np.uint8)
    hist = np.bincount(x >> 5, minlength=8)
    total, n = int(x.sum(dtype=np.int64)), len(x)
    square = int(np.bincount(x, minlength=256) @ (np.arange(256, dtype=np.int64) ** 2))
    lines = x.reshape(-1, WIDTH)
    step = int(np.abs(np.maximum(lines[:, 1:], lines[:, :-1]) - np.minimum(lines[:, 1:], lines[:, :-1])).sum(dtype=np.int64))
    return f"mean={total / n:.4f};var={square / n - (total / n) ** 2:.4f};step={step / (len(lines) * (WIDTH - 1)):.4f};hist=" + "/".join(map(str, hist.tolist()))


@dataclass
class MediaStore:
    """``manifest``: (doc_id, row, n_bytes, media_sha256, chunks) of every document; ``chunks``: (row, parts, pack) of every
    medium, with the chunks that it owns; ``foreign``: (row, seq, d), the chunks that it has from others; ``dictionary``: that
    of the compressed packs."""

    manifest: DataFrame
    chunks: DataFrame
    foreign: DataFrame
    dictionary: bytes


def manifest(docs: DataFrame, bits: int, least: int, most: int) -> DataFrame:
    def make():
        def f(batch: pa.RecordBatch):
            cols = {k: [] for k in ("row", "n_bytes", "media_sha256")}
            digests, sizes, offsets = [], [], [0]
            for x in raw_texts(batch.column("text")):
                image = to_image(payload_of(x))
                whole = hashlib.sha256(image)
                cols["row"].append(name_of(whole))
                cols["n_bytes"].append(len(x))
                cols["media_sha256"].append(whole.digest())
                start = 0
                for end in boundaries(image, bits, least, most):
                    digests.append(hashlib.sha256(image[start:end]).digest()[:16])
                    sizes.append(end - start)
                    start = end
                offsets.append(len(digests))
            chunk = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["d", "n"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols["row"], pa.binary()), pa.array(cols["n_bytes"], pa.int64()), pa.array(cols["media_sha256"], pa.binary()), lists],
                ["doc_id", "row", "n_bytes", "media_sha256", "chunks"],
            )

        return f

    return arrow_map(docs, make, "doc_id long, row binary, n_bytes long, media_sha256 binary, chunks array<struct<d: binary, n: int>>")


def _pack(dictionary: bytes, level: int):
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress


def _unpack(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress


def train_dictionary(docs: DataFrame, texts: int = 2000, size: int = 112_640) -> bytes:
    """A compression dictionary from the first ``texts`` documents by a hash of doc_id; empty where there is too little text.

    It only makes stored bytes smaller. Sample, sizes and result are bounded; it belongs to the store.
    """
    chosen = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.substring("text", 1, 16384).alias("t")).where("t is not null").limit(2 * texts)
    parts = sorted(x.t.encode() for x in sample.collect() if x.t)
    try:
        return zstandard.train_dictionary(size, parts).as_bytes() if len(parts) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def packed(docs: DataFrame, shared, level: int) -> DataFrame:
    """(row, doc, z): images, compressed, as they travel to the store. A task sends a medium for its smallest doc_id alone."""

    def make():
        pack, sent = _pack(shared.value, level), {}

        def f(batch: pa.RecordBatch):
            found: dict[bytes, tuple[int, bytes]] = {}
            for i, x in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                image = to_image(payload_of(x))
                row, doc = name_of(hashlib.sha256(image)), NO_DOC if i is None else i
                if (row not in sent or doc < sent[row]) and (row not in found or doc < found[row][0]):
                    found[row] = (doc, image)
            sent.update({row: doc for row, (doc, _) in found.items()})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array([d for d, _ in found.values()], pa.int64()), pa.array([pack(x) for _, x in found.values()], pa.binary())], ["row", "doc", "z"]
            )

        return f

    return arrow_map(docs, make, "row binary, doc long, z binary")


def build_store(docs: DataFrame, bits: int = 12, least: int = 2048, most: int = 32768, level: int = 12) -> MediaStore:
    """Store the media of (doc_id, text) rows. Equal texts are one medium, named by its digest (``row``)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(docs)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    table = written(manifest(docs, bits, least, most), "manifest")
    media = table.groupBy("row").agg(F.min(F.coalesce("doc_id", F.lit(NO_DOC))).alias("doc"), F.first("chunks").alias("chunks"))
    places = media.select("row", "doc", F.posexplode("chunks").alias("seq", "c")).select("row", "doc", "seq", "c.d", "c.n")
    owners = places.groupBy("d").agg(F.min(F.struct("row", "seq")).alias("o"), F.count("*").alias("copies"))
    owners = written(owners.select("d", "o", "copies"), "owners")
    dealt = places.join(owners, "d")
    mine = (F.col("row") == F.col("o.row")) & (F.col("seq") == F.col("o.seq"))
    plan = dealt.groupBy("row", "doc").agg(
        F.array_sort(F.collect_list(F.struct("seq", "n", mine.alias("own"), (F.col("copies") > 1).alias("shared")))).alias("parts"),
        F.array_sort(F.collect_list(F.when(~mine, F.struct("seq", "d")))).alias("foreign"),
    )
    plan = written(plan, "plan")
    foreign = plan.select("row", F.explode("foreign").alias("f")).select("row", "f.seq", "f.d")
    once = packed(docs, shared, level).join(plan.select("row", "doc", "parts"), ["row", "doc"])

    def make():
        unpack, pack = _unpack(shared.value), _pack(shared.value, level)

        def f(batch: pa.RecordBatch):
            packs = []
            for z, parts in zip(batch.column("z").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if all(p["own"] for p in parts):
                    packs.append(z)
                    continue
                image, at, own = unpack(z), 0, []
                for p in parts:
                    if p["own"]:
                        own.append(image[at : at + p["n"]])
                    at += p["n"]
                packs.append(pack(b"".join(own)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("parts"), pa.array(packs, pa.binary())], ["row", "parts", "pack"])

        return f

    stored = arrow_map(once, make, f"row binary, parts {PARTS}, pack binary")
    return MediaStore(table, written(stored, "chunks", "uncompressed"), foreign, dictionary)


def read_media(store: MediaStore) -> DataFrame:
    """(row, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every medium, read from the store."""
    own, dictionary = store.chunks, store.chunks.sparkSession.sparkContext.broadcast(store.dictionary)
    out = "row binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def shared_chunks():
        unpack, pack = _unpack(dictionary.value), _pack(dictionary.value, 6)

        def f(batch: pa.RecordBatch):
            d, z = [], []
            for parts, blob in zip(batch.column("parts").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                data, at = unpack(blob), 0
                for p in parts:
                    if p["own"]:
                        piece = data[at : at + p["n"]]
                        at += p["n"]
                        if p["shared"]:
                            d.append(hashlib.sha256(piece).digest()[:16])
                            z.append(pack(piece))
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(z, pa.binary())], ["d", "z"])

        return f

    def rebuild():
        unpack = _unpack(dictionary.value)

        def f(batch: pa.RecordBatch):
            cols = [[] for _ in range(6)]
            got = batch.column("fetched").to_pylist() if "fetched" in batch.schema.names else [None] * batch.num_rows
            for parts, blob, fetched in zip(batch.column("parts").to_pylist(), batch.column("pack").to_pylist(), got, strict=True):
                pieces, data, at = [b""] * len(parts), unpack(blob), 0
                for k, p in enumerate(parts):
                    if p["own"]:
                        pieces[k] = data[at : at + p["n"]]
                        at += p["n"]
                for x in fetched or ():
                    pieces[x["seq"]] = unpack(x["z"])
                    if hashlib.sha256(pieces[x["seq"]]).digest()[:16] != x["d"]:
                        raise RuntimeError("a chunk read back differs from its digest")
                if [len(x) for x in pieces] != [p["n"] for p in parts]:
                    raise RuntimeError("a chunk is missing or has another length")
                image = b"".join(pieces)
                samples = from_image(image)
                for c, v in zip(cols, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.strip().split()[0] for x in out.split(",")])

        return f

    fields = ["row", "parts", "pack"]
    whole = F.forall("parts", lambda p: p["own"])
    alone = arrow_map(own.where(whole).select(fields), rebuild, out)
    shared = own.where(F.exists("parts", lambda p: p["own"] & p["shared"])).select("parts", "pack")
    shared = written(arrow_map(shared, shared_chunks, "d binary, z binary"), "shared", "uncompressed")
    fetched = store.foreign.join(shared, "d").groupBy("row").agg(F.collect_list(F.struct("seq", "d", "z")).alias("fetched"))
    joint = arrow_map(own.where(~whole).select(fields).join(fetched, "row"), rebuild, out)
    return alone.union(joint)


def media_columns(docs: DataFrame, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), one row for every row.

    The payload's digests and the feature come from the bytes read back from the store. Null text counts as empty, which is
    one line of padding. Rows without or with a repeated doc_id are stored like others; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    store = build_store(docs, **sizes)
    read = written(read_media(store).dropDuplicates(["row"]), "read-back")
    base = store.manifest.select("doc_id", "row", "n_bytes", F.lower(F.hex("media_sha256")).alias("_stored"))
    joined = base.join(read, "row")
    same = F.assert_true(F.col("_stored") == F.col("media_sha256"), F.lit("a medium read back differs from what was stored"))
    return joined.where(same.isNull()).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
