"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A word (match of the split pattern) is cut where two bytes meet that no piece of the vocabulary has side by side: no merge can
cross such a place. A task packs consecutive texts into a block: its distinct parts of words as arrays of byte ranks, and for
each text the numbers of its parts. Parts of a small sample of the table are merged before and known to every task, so that it only
packs those that are new to it; which texts are sampled affects the work, not the result. The JVM then folds ranked merges over every distinct part with ``aggregate``, a lowest pair
at a time, or in long parts all places of the lowest pair at a time. The rank map is a literal array (a scalar subquery, which
every task gets once) looked up by arithmetic alone. Decoding concatenates the pieces' bytes the same way. Block rows never
leave their task: nothing is shuffled, and a block's size is bounded whatever the table's.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import re
import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, tidy

BITS, PLACE = 17, 7  # of an id or rank, and of a place in a part
NONE = (1 << BITS) - 1  # the rank of a pair that is no piece
EMPTY = (1 << 2 * BITS) - 1  # what a slot without a pair holds
HELD_PARTS = 300_000  # after which a task numbers its parts anew
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16 << 10  # texts whose parts are merged once for all tasks, and their most bytes
SAMPLE_LEAST = 8 * SAMPLE_ROWS  # rows of a table that is worth it
KNOWN_PARTS = 120_000  # of them, at most
STEPWISE = 100  # bytes of a part up to which one pair is merged a step


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file, one ``base64 rank`` a line."""
    try:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    except OSError:
        lines = [r.value.encode() for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


@dataclass
class RankMap:
    """The rank of a pair of pieces: ``slots[base[left] + right]`` holds ``left << BITS | rank`` if there is one."""

    pieces: list[bytes]
    bytes_: np.ndarray  # rank of each byte value
    pairs: np.ndarray  # rank of each pair of byte values, or NONE
    apart: np.ndarray  # pairs of byte values that no piece has side by side
    sentinel: int
    slots: np.ndarray
    base: np.ndarray
    whole: dict[bytes, int]  # pieces that merges alone would not make


def merge_pairs(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    return [(ranks[p[:i]], ranks[p[i:]], r) for p, r in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]


def rank_map(ranks: dict[bytes, int]) -> RankMap:
    top = max(ranks.values()) + 1
    if top >= NONE:
        raise ValueError("the vocabulary has too many pieces")
    pieces = [b""] * (top + 1)
    for p, r in ranks.items():
        pieces[r] = p
    triples = np.array(merge_pairs(ranks), np.int64).reshape(-1, 3)
    triples = triples[np.argsort(triples[:, 0], kind="stable")]
    cut = np.flatnonzero(np.concatenate([[True], triples[1:, 0] != triples[:-1, 0]])) if len(triples) else np.zeros(0, np.int64)
    rows = sorted(np.split(triples, cut[1:]), key=len, reverse=True) if len(triples) else []
    size = max(4 * len(triples), 16)
    base, slots, place = np.zeros(top + 1, np.int32), np.full(size + top + 1, EMPTY, np.int64), 0
    for row in rows:  # sparse rows laid over each other where they don't clash
        right = row[:, 1]
        while (slots[right + place] != EMPTY).any():
            place = (place * 5 + 7919) % size
        base[row[0, 0]] = place
        slots[right + place] = row[:, 0] << BITS | row[:, 2]
        place = (place + 7919) % size
    byte_ranks = np.array([ranks.get(bytes([b]), top) for b in range(256)], np.int64)
    pairs = np.array([ranks.get(bytes([a, b]), NONE) for a in range(256) for b in range(256)], np.int64)
    flat, ends = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64), np.cumsum([len(p) for p in pieces])
    inside = np.ones(len(flat) - 1, bool)
    inside[ends[(ends > 0) & (ends < len(flat))] - 1] = False
    apart = np.ones(1 << 16, bool)
    apart[(flat[:-1] << 8 | flat[1:])[inside]] = False
    whole = {p: r for p, r in ranks.items() if merge(p, ranks) != [r]}
    return RankMap(pieces, byte_ranks, pairs, apart, top, slots, base, whole)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranked merges of one word, lowest rank first, leftmost of equals; heap and linked list."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts at i
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# ---- the fold, in the JVM
#
# A part is an array of numbers, one for each token: the rank of its pair with the next token, its place, and its id, from the
# high bits down. The least number is then the leftmost pair of the lowest rank. A token that is in no pair goes before it.


def part_state(ranks: RankMap, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of parts given as bytes in a row and where each ends."""
    n, parts = len(flat), len(ends)
    starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
    pair = np.full(n, NONE, np.int64)
    pair[:-1] = ranks.pairs[flat[:-1].astype(np.int64) * 256 + flat[1:]] if n > 1 else pair[:-1]
    pair[ends - 1] = NONE
    place = np.arange(n) - np.repeat(starts, ends - starts) + 1
    state = pair << (BITS + PLACE) | np.minimum(place, (1 << PLACE) - 1) << BITS | ranks.bytes_[flat]
    out = np.insert(state, starts, NONE << (BITS + PLACE) | ranks.sentinel)
    return out, np.concatenate([[0], ends + np.arange(1, parts + 1)])


BIG = 1 << 30
END = NONE << (BITS + PLACE)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _id(x: Column) -> Column:
    return x.bitwiseAND(F.lit(NONE).cast("bigint")).cast("int")


def _rank(left: Column, right: Column, slots: Column, base: Column) -> Column:
    """Rank of a pair, or a number from ``NONE`` on; null where there is no token to the right.

    A slot holds its left piece above the rank: what other pieces' slots hold leaves high bits set.
    """
    return F.get(slots, F.get(base, left) + right).bitwiseXOR(F.shiftleft(left.cast("bigint"), BITS))


def fold_merges(part: Column, slots: Column, base: Column) -> Column:
    """array<bigint> of ``part_state`` -> array<int> of token ids: merges one pair after the other until none is left."""
    low, places = F.lit((1 << (BITS + PLACE)) - 1).cast("bigint"), F.lit(((1 << PLACE) - 1) << BITS).cast("bigint")
    # numbers from ``END`` on are no pairs, whatever their high bits
    rank = lambda left, right: F.shiftleft(_rank(left.cast("int"), right.cast("int"), slots, base), BITS + PLACE)

    def merge_least(e, least):
        made = F.shiftright(least, BITS + PLACE)

        def at(i):
            before = F.get(e, i - 2)
            left = rank(before.bitwiseAND(NONE), made).bitwiseOR(before.bitwiseAND(low))
            after = F.coalesce(rank(made, F.get(e, i + 1).bitwiseAND(NONE)), F.lit(END))
            new = after.bitwiseOR(least.bitwiseAND(places)).bitwiseOR(made)
            return F.concat(F.slice(e, 1, i - 2), F.array(left, new), F.slice(e, i + 2, BIG))

        return _let(F.array_position(e, least).cast("int"), at)

    def step(e, _):
        return _let(F.array_min(e), lambda least: F.when(least >= END, e).otherwise(merge_least(e, least)))

    return F.aggregate(F.slice(part, 3, BIG), part, step, lambda e: F.transform(F.slice(e, 2, BIG), _id))


def fold_passes(part: Column, slots: Column, base: Column) -> Column:
    """The same ids, merging all places of the lowest pair in a step: time goes with the length times the different pairs.

    Merging from left to right, one pair at a time, gives the same unless a merge makes a pair of lower rank on the way; such a
    step merges the leftmost place alone.
    """
    none = F.lit(NONE).cast("bigint")
    rank = lambda left, right: F.least(F.coalesce(_rank(left, right, slots, base), none), none)
    ranked = lambda ids: F.transform(ids, lambda x, i: F.shiftleft(rank(x, F.get(ids, i + 1)), BITS).bitwiseOR(x.cast("bigint")))
    state = lambda e: F.struct(e.alias("e"), F.shiftright(F.coalesce(F.array_min(e), F.lit(NONE << BITS).cast("bigint")), BITS).alias("least"))

    def joined(e, least, marks):
        """Tokens after merging with the next one where ``marks`` has a 1; the 1s aren't side by side."""
        made = lambda x, i: F.when(F.get(marks, i) == "1", least.cast("int")).when(F.get(marks, i - 1) == "1", F.lit(-1)).otherwise(_id(x))
        return F.filter(F.transform(e, lambda x, i: F.when(i == 0, F.when(F.get(marks, i) == "1", least.cast("int")).otherwise(_id(x))).otherwise(made(x, i))), lambda x: x >= 0)

    def lower(e, least, marks):
        """Whether any merge makes a pair of lower rank: its left neighbour is merged already, its right one isn't yet."""
        new = least.cast("int")

        def at(m, i):
            left = F.when(i < 1, F.lit(None).cast("int")).when((i > 1) & (F.get(marks, F.greatest(i - 2, F.lit(0))) == "1"), new).otherwise(_id(F.get(e, F.greatest(i - 1, F.lit(0)))))
            return (m == "1") & ((rank(new, _id(F.get(e, i + 2))) < least) | (rank(left, new) < least))

        return F.exists(F.transform(marks, at), lambda x: x)

    def marked(e, least, places):
        """A 1 for each token that is merged with the next one: of places side by side the first, the third and so on."""
        first = _let(F.instr(places, "1"), lambda at: F.transform(e, lambda x, i: F.when(i == at - 1, "1").otherwise("0")))
        return _let(F.split(F.regexp_replace(places, "11", "10"), ""), lambda m: F.when(lower(e, least, m), first).otherwise(m))

    def step(s, _):
        e, least = s["e"], s["least"]
        places = F.array_join(F.transform(e, lambda x: F.when(F.shiftright(x, BITS) == least, "1").otherwise("0")), "")
        merged = _let(_let(places, lambda p: marked(e, least, p)), lambda m: joined(e, least, m))
        return F.when(least == NONE, s).otherwise(_let(_let(merged, ranked), state))

    ids = F.transform(F.slice(part, 2, BIG), _id)
    start = _let(_let(ids, ranked), state)
    return F.aggregate(F.slice(part, 3, BIG), start, step, lambda s: F.transform(s["e"], _id))


# ---- words of a text


def _one_byte_pattern(pattern: str) -> str:
    """The pattern for texts of code points under 256, with its classes written out, which the plain engine runs faster."""
    inside = lambda test: "".join(re.escape(chr(i)) for i in range(256) if test(chr(i)))
    letters, numbers = inside(lambda c: unicodedata.category(c)[0] == "L"), inside(lambda c: unicodedata.category(c)[0] == "N")
    blanks = r"\t\n\x0b\x0c\r \x85\xa0"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return out.replace(r"\s", f"[{blanks}]").replace(r"\S", f"[^{blanks}]")


def _all_neighbours() -> str:
    """A text in which each code point under 256 comes after each other one, alone and in runs."""
    return "".join(f"{chr(a)}{chr(b)}{chr(a)}{chr(a)}{chr(b)}{chr(b)}" for a in range(256) for b in range(256))


def splitter(pattern: str):
    """text -> words. The plain engine takes texts of code points under 256, if it splits all neighbours like the full one."""
    whole = regex.compile(pattern).findall
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # on what may mean something else
            small = re.compile(_one_byte_pattern(pattern)).findall
        if small(probe := _all_neighbours()) != whole(probe):
            return whole
    except (re.error, FutureWarning):  # classes that the plain engine doesn't know
        return whole

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return small(text)

    return split


class _Numbers(dict):
    """Words in order of appearance; asking for a new one numbers it."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


class Known:
    """Parts that are merged already, numbered from 0: their ids one after the other, how many each has, and their bytes."""

    def __init__(self, flat: np.ndarray, lens: np.ndarray, parts: pa.Array):
        self.flat, self.lens, self._parts = flat, lens, parts

    def __len__(self) -> int:
        return len(self.lens)

    @functools.cached_property  # of the worker, which keeps what is broadcast between tasks
    def parts(self) -> list[bytes]:
        return self._parts.to_pylist()

    @functools.cached_property
    def numbers(self) -> dict[bytes, int]:
        return {part: n for n, part in enumerate(self.parts)}


NOTHING_KNOWN = Known(np.zeros(0, np.uint32), np.zeros(0, np.int64), pa.array([], pa.binary()))


class Parts:
    """A task's distinct parts of words, those known before first, and the distinct words of its present block, both numbered from 0."""

    def __init__(self, ranks: RankMap, known: Known = NOTHING_KNOWN):
        self.ranks, self.known = ranks, known
        self.clear()

    def clear(self) -> None:
        # a part is its bytes, or a piece's id where that stands for a whole word
        self.parts, self.sent = _Numbers(self.known.numbers), len(self.known)
        self.new_block()

    def new_block(self) -> None:
        self.words = _Numbers()
        self.of, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add_words(self) -> None:
        """Number the parts of the block's words."""
        new = [w.encode("utf-8", "surrogatepass") for w in self.words]
        if not new:
            return
        joined, ends = b"".join(new), np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        flat = np.frombuffer(joined, np.uint8).astype(np.int64)
        cut = np.ones(len(flat), bool)
        cut[1:] = self.ranks.apart[flat[:-1] << 8 | flat[1:]]
        starts = ends - np.fromiter(map(len, new), np.int64, len(new))
        cut[starts] = True
        for k, w in enumerate(new) if self.ranks.whole else ():
            if w in self.ranks.whole:
                cut[starts[k] + 1 : ends[k]] = False
        edges = np.append(np.flatnonzero(cut), len(flat))
        found = [joined[a:b] for a, b in itertools.pairwise(edges.tolist())]
        counts = np.diff(np.append(np.searchsorted(edges, starts), len(found)))
        if self.ranks.whole:
            for k in np.flatnonzero(counts == 1).tolist():
                at = int(np.searchsorted(edges, starts[k]))
                found[at] = self.ranks.whole.get(found[at], found[at])
        self.of = np.fromiter(map(self.parts.__getitem__, found), np.int32, len(found))
        self.ends = np.concatenate([[0], np.cumsum(counts)])

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the parts of words given by number."""
        size = self.ends[words + 1] - self.ends[words]
        return self.of[np.repeat(self.ends[words] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def state(self) -> pa.ListArray:
        """``part_state`` of the parts that came since the last call."""
        new = list(itertools.islice(self.parts, self.sent, None))
        self.sent = len(self.parts)
        ready = [k for k, p in enumerate(new) if isinstance(p, int)] if self.ranks.whole else []
        data = [self.ranks.pieces[p][:1] if isinstance(p, int) else p for p in new] if ready else new
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        state, offsets = part_state(self.ranks, np.frombuffer(b"".join(data), np.uint8), ends)
        for k in ready:
            state[offsets[k] + 1] = NONE << (BITS + PLACE) | new[k]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(state, pa.int64()))


BLOCK = "first long, doc_id array<long>, n_parts array<int>, codes array<int>, parts array<array<long>>"


def _one(values, kind=None) -> pa.ListArray:
    """A list array of one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def part_blocks(docs: DataFrame, shared, pattern: str, block_bytes: int, known=None) -> DataFrame:
    """A row for each run of texts of about ``block_bytes``: new distinct parts, and part numbers of every text.

    Parts are numbered over a task's blocks, after the ``known`` ones, and anew where ``first`` is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(pattern), Parts(shared.value, known.value if known else NOTHING_KNOWN)
        ids, words, size = [], [], 0

        def block():
            first = seen.sent - len(seen.known)
            seen.add_words()
            codes = [seen.codes(w) for w in words]
            n_parts = np.fromiter(map(len, codes), np.int32, len(codes))
            cols = [pa.array([first], pa.int64()), _one(ids, pa.int64()), _one(n_parts, pa.int32()), _one(np.concatenate([*codes, np.zeros(0, np.int32)]), pa.int32()), _one(seen.state())]
            return pa.RecordBatch.from_arrays(cols, ["first", "doc_id", "n_parts", "codes", "parts"])

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = split(text) if text else []
                ids.append(i)
                words.append(np.fromiter(map(seen.words.__getitem__, found), np.int64, len(found)))
                size += len(text or "")
                if size >= block_bytes:
                    yield block()
                    ids, words, size = [], [], 0
                    seen.new_block() if len(seen.parts) <= HELD_PARTS else seen.clear()
        if ids:
            yield block()

    return docs.mapInArrow(tidy(run), BLOCK)


def known_parts(rows: DataFrame, shared, pattern: str, block_bytes: int, coded) -> Known:
    """Parts of the first ``SAMPLE_ROWS`` shorter texts of the first partition; none of a small table.

    ``coded`` merges blocks of ``part_blocks``. Parts that don't decode to themselves, for lack of a byte's rank, are left out, as
    are all of a vocabulary with pieces that only stand for whole words.
    """
    if shared.value.whole or rows.select("doc_id").limit(SAMPLE_LEAST).count() < SAMPLE_LEAST:
        return NOTHING_KNOWN
    sample = rows.where(F.spark_partition_id() == 0).where(F.octet_length("text") <= SAMPLE_BYTES).limit(SAMPLE_ROWS)
    found = coded(part_blocks(sample, shared, pattern, block_bytes)).select(F.explode(F.arrays_zip("ids", "spelled")).alias("part")).select("part.*").toArrow()
    ids, spelled = found.column("ids").combine_chunks(), found.column("spelled").combine_chunks()
    flat, lens = ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(lens)), lens)
    whole = np.ones(len(lens), bool)
    whole[of[flat == shared.value.sentinel]] = False
    first = np.zeros(len(lens), bool)
    first[np.unique(spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False), return_index=True)[1]] = True
    keep = whole & first
    keep[np.flatnonzero(keep)[KNOWN_PARTS:]] = False
    return Known(flat[keep[of]].astype(np.uint32), lens[keep], spelled.filter(pa.array(keep)).cast(pa.binary()))


def encode(docs: DataFrame, vocabulary: str, pattern: str, block_bytes: int = 2 << 20, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row's whole text; null text counts as empty.

    ``ids_sha256`` digests the ids as little-endian unsigned 32-bit numbers, ``decoded_sha256`` the bytes they decode to. Rows
    without or with a repeated doc_id are encoded like others; an empty table gives an empty result; other columns, whatever
    their names, are ignored. A text longer than a block is a block of its own; words of any length take the same way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    m = rank_map(read_ranks(spark, vocabulary))
    literal = spark.createDataFrame(pa.table({"slots": _one(m.slots, pa.int64()), "base": _one(m.base, pa.int32()), "pieces": _one(m.pieces, pa.binary())}))
    slots, base, pieces = (literal.select(c).scalar() for c in ("slots", "base", "pieces"))
    shared = spark.sparkContext.broadcast(m)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def merged(blocks: DataFrame) -> DataFrame:
        blocks = blocks.select("*", slots.alias("slots"), base.alias("base"), pieces.alias("pieces"))
        how = (F.col("slots"), F.col("base"))
        coded = blocks.withColumn("ids", F.transform("parts", lambda w: F.when(F.size(w) <= STEPWISE, fold_merges(w, *how)).otherwise(fold_passes(w, *how))))
        spell = lambda ids: F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.get(F.col("pieces"), i)))
        return coded.select("first", "doc_id", "n_parts", "codes", "ids", F.transform("ids", spell).alias("spelled"))

    known = spark.sparkContext.broadcast(known_parts(rows, shared, pattern, block_bytes, merged))
    give_back()
    coded = merged(part_blocks(rows, shared, pattern, block_bytes, known))
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = known.value
        lens, flat, parts = before.lens, before.flat, list(before.parts)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_parts, codes, lists, spelled = (batch.column(c)[row].values for c in ("doc_id", "n_parts", "codes", "ids", "spelled"))
                if batch.column("first")[row].as_py() == 0:
                    lens, flat, parts = before.lens, before.flat, list(before.parts)
                ends = lists.offsets.to_numpy()
                lens = np.concatenate([lens, np.diff(ends).astype(np.int64)])
                flat = np.concatenate([flat, lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.uint32)])
                parts += spelled.to_pylist()
                offsets = np.concatenate([[0], np.cumsum(lens)])
                codes = codes.to_numpy(zero_copy_only=False)
                at, sizes, a, b, lists_out = 0, [], [], [], []
                for n in n_parts.to_numpy(zero_copy_only=False).tolist():
                    own = codes[at : at + n]
                    at += n
                    size = lens[own]
                    total = int(size.sum())
                    tokens = flat[np.repeat(offsets[own] - (np.cumsum(size) - size), size) + np.arange(total)].astype("<u4")
                    sizes.append(total)
                    a.append(hashlib.sha256(tokens.tobytes()).hexdigest())
                    b.append(hashlib.sha256(b"".join(map(parts.__getitem__, own.tolist()))).hexdigest())
                    if with_ids:
                        lists_out.append(tokens.astype(np.int32))
                cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(a), pa.array(b)]
                if with_ids:
                    cols.append(pa.array(lists_out, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return coded.mapInArrow(tidy(digest), out)
