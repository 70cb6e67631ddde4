"""Near duplicates by exact Jaccard similarity of word shingles, with a prefix-filtered self-join.

A text's shingles are put in one order that holds for all texts: hashes ascending, very common ones last. Texts of similarity t
share a shingle among their first n - ceil(t n) + 1, so only texts that meet there are compared; sizes and positions rule out
most others without looking at the texts, and parity bitmaps of the sets, whose differing bits are no more than the differing
shingles, most of what is left. Every link is verified on the whole sets and none is lost. The order itself may be
any: which shingles count as common affects the work, not the result.

Components need few links. First the SimHash trie join links texts whose fingerprints over the same shingles differ in 3 bits
or fewer, as far as the exact similarity bears it out. Similar texts may differ in more bits, so the shingles find the rest:
every text is compared with one pivot of each shingle it shares, then, of texts that still are in different components, those
pairs that share a shingle and whose signatures (small parity bitmaps that travel with the shingles) may belong to similar sets:
first a forest of them, the nearest in each bucket, and then, at shingles that have more, all whose ends the forest's links leave
in different components. In a large group most pairs need no look after the forest, and of copies that are nearly but not quite
similar enough, signatures leave few; those that they leave still grow with the square of such a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, one_row_each, raw_texts, tidy, without, written
from .components import connected_components
from .simhash import majority, near_links

SIGNATURES = (512, 1024, 2048)  # bits that travel with a text's shingles: the first that are as many as these, or the last
_EPS = 1e-9
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: bytes, words_in: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased; fewer words are one shingle, none are a zero."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - words_in + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 43)], np.uint64).view(np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(words_in):
        out = (out ^ (out >> np.uint64(29))) * _PRIME + h[k : k + n]
    out = (out ^ (out >> np.uint64(33))) * _MIX
    return np.unique((out ^ (out >> np.uint64(33))).view(np.int64))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted array ``known``; time goes with the values, hardly with what is known."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def common_shingles(docs: DataFrame, words_in: int, least: int = 64, most: int = 200_000, piece: int = 1 << 21) -> np.ndarray:
    """Sorted hashes of shingles that very many texts have, as far as single pieces of the table show it."""

    def count(batches):
        def frequent(found):
            token, n = np.unique(np.concatenate(found), return_counts=True)
            keep = n >= 4
            return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(n[keep].astype(np.int64))], ["token", "n"])

        found, size = [], 0
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                found.append(shingles(text, words_in))
                size += len(found[-1])
                if size >= piece:
                    yield frequent(found)
                    found, size = [], 0
        if found:
            yield frequent(found)

    counts = _texts(docs).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(f"n >= {least}")
    return np.sort(np.array([r.token for r in counts.orderBy(F.desc("n"), "token").limit(most).collect()], np.int64))


def prefixes(docs: DataFrame, words_in: int, similarity: float, common: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, token, doc_id, n, pos, last, last2): the first shingles of every text, enough that similar texts share one, each with
    the two before it."""

    def make():
        def f(batch: pa.RecordBatch):
            ids, tokens, sizes, lens = batch.column("doc_id").to_numpy(), [], [], []
            for text in raw_texts(batch.column("text")):
                s = shingles(text, words_in)
                last = among(s, common)
                k = len(s) - int(np.ceil(similarity * len(s) - _EPS)) + 1
                tokens.append(np.concatenate([s[~last], s[last]])[:k])
                sizes.append(len(s))
                lens.append(k)
            if not tokens:
                return
            token, rep = np.concatenate(tokens), np.array(lens)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(rep) - rep, rep)
            before = [np.where(pos >= k, np.concatenate([np.zeros(k, np.int64), token])[: len(token)], 0) for k in (1, 2)]
            columns = [(token.view(np.uint64) % np.uint64(buckets)).astype(np.int32), token, np.repeat(ids, rep), np.repeat(np.array(sizes, np.int32), rep), pos.astype(np.int32), *before]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "token", "doc_id", "n", "pos", "last", "last2"])

        return f

    return arrow_map(_texts(docs), make, "bucket int, token long, doc_id long, n int, pos int, last long, last2 long")


def _groups(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(token)]]))


def shared_only(group: pa.Table) -> pa.Table:
    """The rows of a bucket whose token several texts have, each with the token's pivot: its smallest doc_id."""
    token, doc = group.column("token").to_numpy(), group.column("doc_id").to_numpy()
    order = np.lexsort((doc, token))
    starts, size = _groups(token[order])
    rows, first = order[np.repeat(size > 1, size)], order[np.repeat(starts, size)[np.repeat(size > 1, size)]]
    out = group.select(["bucket", "token", "doc_id", "n", "pos", "last", "last2"]).take(pa.array(rows))
    for name in ("doc_id", "n", "pos"):
        out = out.append_column(f"pivot_{name}", group.column(name).take(pa.array(first)))
    return out


def _may_link(na, nb, i, j, similarity, least=np.minimum):
    """Whether texts of na and nb shingles that share the one at i and j can be similar; for arrays and columns alike."""
    most = least(na, nb)
    return (most >= similarity * (na + nb - most) - _EPS) & (1 + least(i, j) + least(na - 1 - i, nb - 1 - j) >= similarity / (1 + similarity) * (na + nb) - _EPS)


def signature_bits(n: int) -> int:
    return next((bits for bits in SIGNATURES if bits >= n), SIGNATURES[-1])


def _signatures(sigs: list[bytes]) -> tuple[list[int], dict[int, np.ndarray]]:
    """Bits of every signature, and for each number of bits an array of those that have as many, folded to it; others' rows are zero."""
    width = [8 * len(x) for x in sigs]
    folded = {bits: np.zeros((len(sigs), bits // 64), np.uint64) for bits in SIGNATURES}
    for own in SIGNATURES:
        rows = np.flatnonzero(np.array(width) == own)
        found = np.frombuffer(b"".join(sigs[k] for k in rows), np.uint64)
        for bits in SIGNATURES if len(rows) else ():
            if bits <= own:
                folded[bits][rows] = np.bitwise_xor.reduce(found.reshape(len(rows), own // bits, bits // 64), axis=1)
    return width, folded


def _candidates(group: pa.Table, similarity: float, most: int = 1 << 20):
    """(token, a, b, labels of a and b, distance) of pairs of texts that share a token of the bucket, may be similar and are not in
    one component yet, as arrays of a token's pairs, ``most`` or few more at a time. The distance is 1 at most.

    A pair that also shares one of the two tokens before has been found there. It is left out here, so that pairs aren't found once
    for each of many shared tokens; at the first token that a pair shares it never is.
    """
    share = (1 - similarity) / (1 + similarity)
    token, doc, n, pos, label, last, last2 = (group.column(c).to_numpy() for c in ("token", "doc_id", "n", "pos", "label", "last", "last2"))
    order = np.lexsort((n, token))
    token, doc, n, pos, label, last, last2 = (x[order].astype(np.int64) for x in (token, doc, n, pos, label, last, last2))
    before = ((last, pos >= 1), (last2, pos >= 2))
    width, folded = _signatures(group.column("sig").take(pa.array(order)).to_pylist())
    for lo, size in zip(*_groups(token), strict=True):
        hi = lo + size
        if (label[lo:hi] == label[lo]).all():
            continue
        xs, ys, far, held = [], [], [], 0
        for x in range(lo, hi - 1):
            stop = lo + int(np.searchsorted(n[lo:hi], n[x] / similarity + _EPS, "right"))
            y = np.arange(x + 1, stop)
            y = y[(label[y] != label[x]) & _may_link(n[x], n[y], pos[x], pos[y], similarity)]
            sig = folded[width[x]]  # no row of the token after x has less
            differ, allowed = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1), share * (n[x] + n[y]) + _EPS
            near = differ <= allowed
            y, distance = y[near], differ[near] / allowed[near]
            for own, there in before if len(y) else ():
                for other, too in before if there[x] else ():
                    new = (other[y] != own[x]) | ~too[y]
                    y, distance = y[new], distance[new]
            if len(y):
                xs.append(np.full(len(y), x))
                ys.append(y)
                far.append(distance)
                held += len(y)
            if xs and (held >= most or x == hi - 2):
                i, j = np.concatenate(xs), np.concatenate(ys)
                yield token[lo], np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), label[i], label[j], np.concatenate(far)
                xs, ys, far, held = [], [], [], 0


def open_pairs(similarity: float):
    """Pairs (a, b) of texts that share a token of the bucket, may be similar and are not in one component yet: all of them."""

    def f(group: pa.Table) -> pa.Table:
        found, held = [np.zeros((0, 2), np.int64)], 0
        for _, a, b, *_ in _candidates(group, similarity):
            found.append(np.stack([a, b], 1))
            held += len(a)
            if held > 1 << 20:
                found, held = [np.unique(np.concatenate(found), axis=0)], 0
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return f


def forest_pairs(similarity: float):
    """Of ``open_pairs`` a forest that connects what they all connect, the nearest pairs first; and the tokens (token, a and b null)
    that have other pairs. Those need a look only if the forest's pairs turn out not to be similar."""

    def f(group: pa.Table) -> pa.Table:
        above, pairs, left = {}, set(), set()

        def root(x):
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for token, a, b, of_a, of_b, distance in _candidates(group, similarity):
            order = np.argsort(distance, kind="stable")
            for p, q, x, y in zip(*(v[order].tolist() for v in (a, b, of_a, of_b)), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    pairs.add((p, q))
                elif (p, q) not in pairs:
                    left.add(int(token))
        pairs, left = sorted(pairs), sorted(left)
        nothing = [None] * len(left)
        columns = [group.column("bucket").to_pylist()[:1] * (len(pairs) + len(left)), [None] * len(pairs) + left, [p[0] for p in pairs] + nothing, [p[1] for p in pairs] + nothing]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["bucket", "token", "a", "b"])

    return f


def bitmaps(docs: DataFrame, words_in: int) -> DataFrame:
    """(doc_id, size, bits, sig, fp): number of shingles, bitmaps of the next power of two bits and of ``signature_bits``, set where
    an odd number of hashes fall, and the SimHash fingerprint of the shingles."""
    parity = lambda s, width: np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()

    def make():
        def f(batch: pa.RecordBatch):
            sizes, bits, sigs, fps = [], [], [], []
            for text in raw_texts(batch.column("text")):
                s = shingles(text, words_in).view(np.uint64)
                sizes.append(len(s))
                bits.append(parity(s, max(64, 1 << (len(s) - 1).bit_length())))
                sigs.append(parity(s, signature_bits(len(s))))
                fps.append(majority(s))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(sigs, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "bits", "sig", "fp"])

        return f

    return arrow_map(_texts(docs), make, "doc_id long, size int, bits binary, sig binary, fp long")


def trie_pairs(maps: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect documents whose fingerprints the trie join links: equal ones, and representatives of close ones."""
    points = written(maps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    own = maps.join(points, "fp").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    both = own.union(near_links(points)).where("a != b")
    return written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "trie-pairs")


def apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ends are in different components yet."""
    one = lambda end: component.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    both = pairs.join(one("a"), "a", "left").join(one("b"), "b", "left")
    return both.where("coalesce(of_a, a) != coalesce(of_b, b)").select("a", "b")


def _fold(bits: np.ndarray, to: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, to), axis=0)


def plausible(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` without those whose bitmaps differ in more bits than similar sets can differ in shingles."""

    def make():
        def f(batch: pa.RecordBatch):
            m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
            most, keep = (m + n) * ((1 - similarity) / (1 + similarity)) + _EPS, np.zeros(len(m), bool)
            for k, (x, y) in enumerate(zip(raw_texts(batch.column("x")), raw_texts(batch.column("y")), strict=True)):
                to = min(len(x), len(y)) // 8
                x, y = _fold(np.frombuffer(x, np.uint64), to), _fold(np.frombuffer(y, np.uint64), to)
                keep[k] = np.bitwise_count(x ^ y).sum() <= most[k]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

        return f

    one = lambda node, n, bits: maps.select(F.col("doc_id").alias(node), F.col("size").alias(n), F.col("bits").alias(bits))
    both = pairs.join(one("b", "n", "y"), "b").join(one("a", "m", "x"), "a")
    return written(arrow_map(both.select("a", "b", "m", "n", "x", "y"), make, "a long, b long").distinct(), "plausible")


def verified(pairs: DataFrame, docs: DataFrame, words_in: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets have the similarity."""

    def make():
        def f(batch: pa.RecordBatch):
            sets = pa.array([shingles(x, words_in) for x in raw_texts(batch.column("text"))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["doc_id", "s"])

        return f

    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(arrow_map(_texts(docs).join(nodes, "doc_id", "left_semi"), make, "doc_id long, s array<long>").distinct(), "shingle-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), "b").join(sets.select(F.col("doc_id").alias("a"), "s"), "a")
    n: Column = F.size(F.array_intersect("s", "t"))
    return written(both.where(n >= similarity * (F.size("s") + F.size("t") - n) - _EPS).select("a", "b").distinct(), "links")


def similar_links(docs: DataFrame, words_in: int = 5, similarity: float = 0.8, bucket_bytes: int = 1 << 20) -> DataFrame:
    """Links (a, b) of similar texts, enough to connect all that are; rows of one doc_id are one document of several texts."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(16, -(-size // bucket_bytes))  # as many as the texts ask for, so that a bucket stays small
    rows = prefixes(docs, words_in, similarity, common_shingles(docs, words_in), buckets)
    shared = written(rows.groupBy("bucket").applyInArrow(shared_only, "bucket int, token long, doc_id long, n int, pos int, last long, last2 long, pivot_doc_id long, pivot_n int, pivot_pos int"), "shared-shingles")
    fits = _may_link(F.col("n"), F.col("pivot_n"), F.col("pos"), F.col("pivot_pos"), similarity, F.least)
    maps = written(bitmaps(docs, words_in).distinct(), "bitmaps")
    close = trie_pairs(maps)
    links = verified(plausible(close, maps, similarity), docs, words_in, similarity)
    stars = shared.where((F.col("doc_id") != F.col("pivot_doc_id")) & fits).select(F.col("pivot_doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = written(apart(stars.join(close, ["a", "b"], "left_anti"), connected_components(links)), "pairs")
    links = links.union(verified(plausible(stars, maps, similarity), docs, words_in, similarity))
    tried, rows = close.union(stars), shared.select("bucket", "token", "doc_id", F.col("n").alias("size"), "pos", "last", "last2")

    def labelled() -> DataFrame:
        component = connected_components(links)
        known = maps.select("doc_id", "size", "sig").join(component, F.col("doc_id") == F.col("node"), "left").select("doc_id", "size", "sig", F.coalesce("component", "doc_id").alias("label"))
        return rows.join(known, ["doc_id", "size"]).withColumnRenamed("size", "n").groupBy("bucket")

    found = written(labelled().applyInArrow(forest_pairs(similarity), "bucket int, token long, a long, b long"), "forest")
    forest = written(found.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    links, tried = links.union(verified(plausible(forest, maps, similarity), docs, words_in, similarity)), tried.union(forest)
    left = found.where("a is null").select("bucket", "token")
    if left.isEmpty():
        return links
    rows = written(rows.join(left, ["bucket", "token"], "left_semi"), "open-shingles")
    rest = labelled().applyInArrow(open_pairs(similarity), "a long, b long").distinct()
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "pairs")
    return links.union(verified(plausible(rest, maps, similarity), docs, words_in, similarity))


def drop_similar(docs: DataFrame, words_in: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each component of similar texts the one with the smallest doc_id stays; columns, whatever their names, unchanged.

    Texts are similar if the Jaccard similarity of their word shingles is ``similarity`` at least. Null text counts as empty;
    texts without words are alike. Rows that repeat a doc_id are one document, similar to what any of its texts is similar to;
    the least of its rows by all columns stays. Rows without doc_id stay. Of long texts bitmaps and fingerprints travel, and shingle
    sets where a link is verified.
    """
    gone = connected_components(similar_links(docs, words_in, similarity)).where("node != component").select(F.col("node").alias("gone"))
    return one_row_each(without(docs, gone), "doc_id")
