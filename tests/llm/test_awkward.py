"""Awkward tables: nulls in any column, repeated rows and ids, clashing names, empty and long texts; models against brute force."""

import collections
import hashlib
import math
import random

import corpus_pipeline
import numpy as np
import pytest
from lineforge.llm import bpe, exact, langid, mixing, quality, simhash, similar

from .test_operators import VOCAB, P, tokens  # noqa: F401

CLASH = ["_block", "_epoch", "_order", "_source", "score", "rejected", "lang_pred", "k", "n", "h", "own", "gone", "text_sha256", "ids", "row", "c0", "source_"]


def sentence(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) + rng.choice(["", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def table():
    """(doc_id, text, lang, source) with nulls, repeats, copies and a long text."""
    rng = random.Random(11)
    rows = [(i, sentence(rng, "en" if i % 2 else "de", 40), "en" if i % 2 else "de", "web" if i % 3 else None) for i in range(60)]
    rows += [(1, rows[1][1], "en", "web")] * 3 + [(1, sentence(rng, "en", 30), "en", "web"), (70, rows[1][1], "en", "web")]
    rows += [(None, sentence(rng, "en", 30), None, None)] * 2 + [(None, None, None, None), (71, None, "en", "web"), (72, "", None, "books"), (73, "  \n", "en", "web")]
    rows += [(74, sentence(rng, "de", 60_000), "de", "web"), (75, "q" * 5000, "en", "web")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, len(r[1] or ""), *[f"{c}!" for c in CLASH]) for r in table], schema).repartition(3)


def untouched(df, docs):
    rows = df.collect()
    assert df.columns[: len(docs.columns)] == docs.columns
    assert all(tuple(r)[5 : 5 + len(CLASH)] == tuple(f"{c}!" for c in CLASH) for r in rows)
    return rows


@pytest.mark.parametrize("name", ["language", "exact_copies", "near_copies", "mixture"])
def test_stages_leave_columns_alone(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns and untouched(out, docs)


def test_language_stage_on_awkward_rows(docs, table):
    kept = collections.Counter((r.doc_id, r.text) for r in langid.keep_identified(docs).collect())
    want = collections.Counter((i, t) for i, t, *_ in table if t and any(map(str.isalpha, t)) and i != 75)
    assert {k: n for k, n in kept.items() if k[0] != 75} == want


def test_exact_stage_on_awkward_rows(docs, table):
    got = collections.Counter((r.doc_id, r.text or "") for r in exact.drop_duplicates(docs).collect())
    groups = collections.defaultdict(list)
    for i, t, *_ in table:
        groups[t or ""].append(i)
    want = {(max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()}
    assert got == dict.fromkeys(want, 1)


def test_exact_stage_takes_one_of_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, "aa"), (1, "aa"), (1, "bb"), (2, "bb")], "doc_id long, text string")
    assert sorted(map(tuple, exact.drop_duplicates(docs).collect())) == [(1, "aa"), (2, "bb")]


@pytest.mark.parametrize("drop", [simhash.drop_near_duplicates, similar.drop_similar])
def test_near_stages_on_repeated_ids(docs, spark, drop, table):
    small = spark.createDataFrame([(1, "aa"), (1, "aa"), (1, "bb"), (2, "bb"), (3, "other words that stand alone here"), (None, "aa"), (None, "aa")], "doc_id long, text string")
    assert sorted(map(tuple, drop(small).collect()), key=repr) == [(1, "aa"), (3, "other words that stand alone here"), (None, "aa"), (None, "aa")]
    ids = [r.doc_id for r in drop(docs).collect()]
    assert {i for i in ids if i is not None} <= {r[0] for r in table} and all(n == 1 for i, n in collections.Counter(ids).items() if i is not None)


def test_mix_stream_is_in_order(spark, docs, table, tmp_path):
    mix = mixing.Mix(repeats=1.5, whole=True)
    rows = mixing.mix_rows(docs, mix)
    assert rows.columns[-3:] == ["__epoch", "__block", "__order"] == mixing.stream_columns(docs.columns)
    place = {(r.doc_id, r.text): (r["__order"], r["__block"]) for r in rows.collect() if r["__epoch"] == 0}
    assert collections.Counter((r.doc_id, r.text) for r in rows.collect() if r["__epoch"] == 0) == collections.Counter((i, t) for i, t, *_ in table)
    mixing.mix_stream(docs, mix).write.parquet(str(tmp_path / "stream"))
    got = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "stream")).coalesce(1).collect()]
    first = [place[x] for x in got[: len(table)]]
    assert len(got) == rows.count() and sum(a <= b for a, b in zip(first, first[1:], strict=False)) >= len(first) - 4  # files may be packed in another order


def test_blocks_grow_with_tokens(spark):
    number = lambda n: mixing.block_number(spark.createDataFrame([("a", n), ("b", 3)], "source string, n_tokens long"), mixing.Mix())
    assert [number(x) for x in (0, 1 << 26, (1 << 26) + 1, 1 << 28, 1 << 40)] == [64, 64, 128, 128, 64 << 7]


def test_tokens_stage_on_awkward_rows(spark, docs, table, tokens):  # noqa: F811
    _, enc = tokens
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in stage(spark, docs, "").collect())
    coded = [(i, enc.encode_ordinary(t or "")) for i, t, *_ in table]
    assert got == collections.Counter((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, ids in coded)
    assert stage(spark, docs.limit(0), "").count() == 0


def test_long_words_take_the_same_way(spark, tokens):  # noqa: F811
    _, enc = tokens
    rng = random.Random(3)
    texts = ["a" * 3000, "=" * 5000, "ab" * 2000 + "x", "日本語テキスト" * 200, "".join(rng.choice("theinaor") for _ in range(3000)), "no" * 700, "é" * 2000, "ththee" * 400 + "the in ing " * 5, "the" * 3000]
    texts += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(80, 130))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect():
        assert r.ids == enc.encode_ordinary(texts[r.doc_id])


def test_words_that_merges_would_not_make(spark, tmp_path):
    """A vocabulary with a piece that no merges lead to: alone it is one token, inside a word its parts are."""
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"ab": 257}
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for p, r in ranks.items()))
    df = spark.createDataFrame([(0, "xyz"), (1, "xyz ab xyzab xyz")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, str(path), r"\p{L}+|\s+", with_ids=True).collect()}
    assert got == {0: [256], 1: [256, 32, 257, 32, 120, 121, 122, 257, 32, 256]}


def test_splitter_falls_back_where_the_plain_engine_differs():
    import regex

    odd = r"[\p{L}']+|\p{N}|\s+|[^\s\p{L}\p{N}]"
    text = "it's 12 naïve\xa0words — 日本"
    assert bpe.splitter(odd)(text) == regex.findall(odd, text) and bpe.splitter(odd)("it's 12") == regex.findall(odd, "it's 12")


def plain_features(text):
    codes = []
    for c in text.lower():
        codes.append(ord(c) if c.isalpha() else 0)
    codes = [c for k, c in enumerate(codes) if c or k == 0 or codes[k - 1]]
    m, out = 0xFFFFFFFF, collections.Counter()
    one = [c * 0x9E3779B1 & m for c in codes]
    two = [(one[i] ^ (codes[i + 1] * 0x85EBCA6B & m)) * 0xC2B2AE35 & m for i in range(len(codes) - 1)]
    three = [(two[i] ^ (codes[i + 2] * 0x27D4EB2F & m)) * 0x165667B1 & m for i in range(len(codes) - 2)]
    for g in one + two + three:
        out[g >> 19] += 1
    return dict(out)


@pytest.mark.parametrize("piece", [1 << 20, 64, 1])
def test_language_features_equal_brute_force_in_any_pieces(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    for text in ("Größe und Maß — 1234 words, in pieces. " * 50, "", "a", "  ", "a  b", " é" * 100):
        idx, n = langid.features(text)
        assert dict(zip(idx.tolist(), n.tolist(), strict=True)) == plain_features(text)


def test_language_predictions_equal_brute_force(docs, table):
    known = docs.select("doc_id", "text", "lang").where(langid.is_training(docs["doc_id"]))
    model = langid.fit(known, per_language=20, clusters=2)
    again = langid.fit(known.repartition(7), per_language=20, clusters=2)
    assert model.langs == again.langs and (model.centroids == again.centroids).all()
    got = {(r.doc_id, r.text): r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    for i, t, *_ in table:
        r = got[i, t]
        if not t or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = {f: (1 + math.log(n)) * float(model.idf[f]) for f, n in plain_features(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[f]) for f, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert abs(r.score - min(1.0, max(0.0, cos[best]))) < 1e-4 and (r.lang_pred == model.langs[best] or sorted(cos)[-1] - sorted(cos)[-2] < 1e-4)


def plain_perplexity(text, trusted, order):
    """Interpolated modified Kneser-Ney over characters, straight from its definition."""
    clean = lambda t: " ".join(t.replace("\x02", " ").split())
    pad = "\x02" * (order - 1)
    grams = lambda t: [(pad + t)[i : i + order] for i in range(len(t))]
    counts = {order: collections.Counter(g for t in trusted for g in grams(clean(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        n = collections.Counter(c.values())
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [max(0.1, min(float(j), j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3)]
        else:
            d = [0.5, 1.0, 1.5]
        contexts = collections.defaultdict(list)
        for g, x in c.items():
            contexts[g[:-1]].append(x)
        tables[k] = (c, d, contexts)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        c, d, contexts = tables[k]
        rest = p(g[1:])
        xs = contexts.get(g[:-1])
        if not xs:
            return rest
        own = max(0.0, c[g] - d[min(c[g], 3) - 1]) / sum(xs) if c[g] else 0.0
        return own + sum(d[min(x, 3) - 1] for x in xs) / sum(xs) * rest

    t = clean(text or "")
    return math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(t)) if t else None


def test_quality_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, "en" if i % 2 else "de", rng.choice([3, 12, 40])), "en" if i % 2 else "de") for i in range(80)]
    rows += [(80, None, "en"), (81, " \n", "en"), (82, "zq zq zq zq", "en"), (83, "naïve 日本 😀", None), (84, rows[0][1], "de"), (84, rows[0][1], "de"), (None, rows[1][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(70)] + [(3, 1, 0), (75, 1, 1), (76, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    train = {k: [t for i, t, l in rows if i is not None and i < 70 and l == k and not held(i)] for k in ("en", "de")}
    want = [(i, plain_perplexity(t, train[l], 4) if l else None, l, len(" ".join((t or "").split()))) for i, t, l in rows]
    got = quality.classify(docs, labels).collect()
    key = lambda i, p: (i is None, i, p or 0)
    both = list(zip(sorted(((r.doc_id, r.perplexity, r.lang, r.n_chars, r.kept, r.threshold) for r in got), key=lambda r: key(*r[:2])), sorted(want, key=lambda r: key(*r[:2])), strict=True))
    room = lambda n: math.exp(3 / math.sqrt(max(n, 1)))
    limit = {}
    for k in ("en", "de"):
        ps = sorted(p / room(n) for i, p, l, n in want if l == k and i is not None and i < 70 and held(i))
        limit[k] = 1.1 * ps[max(0, math.ceil(0.99 * len(ps)) - 1)]
    for (i, p, _, n, kept, t), (j, q, lang, m) in both:
        assert i == j and n == m and (p is None) == (q is None) and (p is None or abs(p - q) < 1e-3 * q), (i, p, q)
        if lang and n:
            assert abs(t - limit[lang] * room(n)) < 1e-3 * t and (kept == (p <= t))


def test_text_of_very_many_characters(spark):
    text = "".join(chr(c) for c in range(0x20, 0xD800)) + "".join(chr(c) for c in range(0xE000, 0x12000))
    grams, n = quality._distinct_grams([text, "ab"], 4)
    assert len(grams) == len(set(grams)) and int(n.sum()) == len(text) + 2
