"""Near duplicates by shingle similarity against brute force, alone and as the pipeline's stage."""

import random
import time

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from lineforge.llm import similar

from .test_operators import corpus, plain_components, words_of


def plain_shingles(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return set(plain_components(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]).values())


def edited():
    """Texts with chains of edits about the threshold, and a passage that many otherwise different texts hold."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, passage = {}, [word() for _ in range(30)]
    for base in range(12):
        words = [word() for _ in range(rng.choice([4, 12, 40, 150, 400]))]
        for _ in range(8):
            words = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 25)):
                words[rng.randrange(len(words))] = word()
            texts[len(texts)] = " ".join(words)
    for k in range(90):
        texts[len(texts)] = " ".join(passage + [word() for _ in range(k % 30)])
    return texts


@pytest.mark.parametrize("texts", [edited(), {i: t for i, t, *_ in corpus()}], ids=["edited", "corpus"])
def test_near_stage_takes_five_words_and_similarity(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == plain_kept(texts)


def test_common_shingles_do_not_change_the_result(spark, monkeypatch):
    texts = edited()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert len(similar.common_shingles(docs, 5)) > 0
    monkeypatch.setattr(similar, "common_shingles", lambda docs, words_in: similar.np.zeros(0, "int64"))
    assert {r.doc_id for r in similar.drop_similar(docs).collect()} == plain_kept(texts)


def test_many_common_shingles_cost_little(spark):
    """The more texts, the more shingles are common; looking one text's up must not take time for all of them."""
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(500)], "doc_id long, text string").repartition(4)
    common = np.sort(np.append(rng.integers(-(2**63), 2**63 - 1, 200_000), similar.shingles(b"a b c d e", 5)))
    start = time.perf_counter()
    rows = similar.prefixes(docs, 5, 0.8, common, 16).collect()
    assert time.perf_counter() - start < 5
    assert len(rows) == 500  # of two shingles the first, and the common one comes last
    assert {r.token for r in rows} == {int(x) for i in range(500) for x in similar.shingles(f"b c d e f{i}".encode(), 5)}
    assert not similar.among(common[:5], common[:0]).any() and similar.among(common[-5:], common).all()


@pytest.mark.parametrize("n", [300, 900, 1500, 2500])
def test_long_texts_that_share_a_shingle_are_told_apart(n):
    """Pairs of a rare shingle's texts grow with the square of their number, so unlike ones must go before any set is looked at."""
    rng = np.random.default_rng(n)
    sets = [np.unique(np.append(rng.integers(0, 2**62, n + 20 * k), 7)) for k in range(12)]
    sets.append(np.unique(np.append(sets[0], 5)))  # similar to the first

    def sig(s):
        bits = similar.signature_bits(len(s))
        return np.packbits((np.bincount((s & (bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()

    ids = list(range(len(sets)))
    group = pa.table({"token": [7] * len(sets), "doc_id": ids, "n": [len(s) for s in sets], "pos": [0] * len(sets), "label": ids, "last": [0] * len(sets), "last2": [0] * len(sets), "sig": [sig(s) for s in sets]})
    assert similar.open_pairs(0.8)(group).to_pylist() == [{"a": 0, "b": len(sets) - 1}]


def test_near_stage_links_by_the_trie_first(spark, monkeypatch):
    """The trie join of five-word fingerprints is a step of the stage; what it links isn't compared again by shingles."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = {}
    for _ in range(6):
        words = [word() for _ in range(3000)]
        for k in range(4):
            texts[len(texts)] = " ".join([*words, *(word() for _ in range(k))])
    docs = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    plain = {i: sum((2 * sum(int(h) >> b & 1 for h in s) > len(s)) << b for b in range(64)) for i, t in texts.items() for s in [similar.shingles(t.encode(), 5).view("uint64")]}
    maps = similar.bitmaps(docs, 5)
    assert {r.doc_id: r.fp % (1 << 64) for r in maps.collect()} == plain
    close = [(a, b) for a in plain for b in plain if a < b and (plain[a] ^ plain[b]).bit_count() <= 3]
    pairs = [(r.a, r.b) for r in similar.trie_pairs(maps).collect()]
    assert close and plain_components(sorted(plain), pairs) == plain_components(sorted(plain), close)
    asked, apart = [], similar.apart

    def seen(pairs, component):
        asked.append([(r.a, r.b) for r in apart(pairs, component).collect()])
        return apart(pairs, component)

    monkeypatch.setattr(similar, "apart", seen)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == plain_kept(texts)
    of = plain_components(sorted(plain), close)
    assert len(asked) == 1 and all(of[a] != of[b] for a, b in asked[0])


def test_pairs_are_found_at_few_of_the_shingles_they_share(spark):
    """Else a family of nearly similar texts gives each of its pairs once for every shingle of their prefixes."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    words, texts = [word() for _ in range(600)], []
    for _ in range(20):
        own = list(words)
        for k in rng.sample(range(600), rng.randrange(4, 10)):
            own[k] = word()
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = similar.prefixes(docs, 5, 0.8, np.zeros(0, np.int64), 64).toArrow().to_pylist()
    sigs = {r.doc_id: r.sig for r in similar.bitmaps(docs, 5).collect()}
    found = []
    for bucket in range(64):
        own = [r | {"label": r["doc_id"], "sig": sigs[r["doc_id"]]} for r in rows if r["bucket"] == bucket]
        found += [(r["a"], r["b"]) for r in similar.open_pairs(0.8)(pa.Table.from_pylist(own)).to_pylist()] if own else []
    sets = [plain_shingles(t) for t in texts]
    alike = {(a, b) for a in range(20) for b in range(a + 1, 20) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert alike and alike <= set(found)
    assert len(found) <= 5 * len(set(found))


def test_a_large_group_needs_few_of_its_pairs(spark, monkeypatch):
    """Pairs of a group of similar texts grow with its square; links that its components don't need must not all be verified."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    words, texts = [word() for _ in range(300)], {}
    for i in range(160):
        own = list(words)
        for k in rng.sample(range(300), rng.randrange(1, 9)):
            own[k] = word()
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked, plausible = [], similar.plausible

    def seen(pairs, *rest):
        asked.append(pairs.count())
        return plausible(pairs, *rest)

    monkeypatch.setattr(similar, "plausible", seen)
    monkeypatch.setattr(similar, "trie_pairs", lambda maps: maps.selectExpr("doc_id a", "doc_id b").where("false"))
    monkeypatch.setattr(similar, "apart", lambda pairs, component: pairs.where("false"))  # the forest has the group to itself
    assert {r.doc_id for r in similar.drop_similar(docs).collect()} == plain_kept(texts)
    assert sum(asked) < 8 * len(texts)


def test_forest_connects_what_all_open_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 300)
    sets = [np.unique(np.append(np.concatenate([base[: 300 - k % 40], rng.integers(0, 2**62, k % 40)]), 7)) for k in range(120)]
    sets += [np.unique(np.append(rng.integers(0, 2**62, 300), 7)) for _ in range(5)]

    def sig(s):
        bits = similar.signature_bits(len(s))
        return np.packbits((np.bincount((s & (bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()

    ids = list(range(len(sets)))
    zeros = [0] * len(ids)
    group = pa.table({"bucket": pa.array(zeros, pa.int32()), "token": [7] * len(ids), "doc_id": ids, "n": [len(s) for s in sets], "pos": zeros, "label": [min(i, 2) if i < 4 else i for i in ids], "last": zeros, "last2": zeros, "sig": [sig(s) for s in sets]})
    every = [(r["a"], r["b"]) for r in similar.open_pairs(0.8)(group).to_pylist()]
    found = similar.forest_pairs(0.8)(group).to_pylist()
    forest = [(r["a"], r["b"]) for r in found if r["a"] is not None]
    assert set(forest) <= set(every) and len(forest) < len(ids) < len(every)
    one = [(2, 3)]  # these have one label
    assert plain_components(ids, forest + one) == plain_components(ids, every + one)
    assert [(r["bucket"], r["token"]) for r in found if r["a"] is None] == [(0, 7)]
