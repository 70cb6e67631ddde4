"""The pipeline's stages, one after the other, against plain versions of each on its own input."""

import collections
import hashlib

import corpus_pipeline
import numpy as np
import pytest
from lineforge.llm.common import small_batches

from .test_operators import corpus, tokens  # noqa: F401
from .test_similar import plain_kept


def test_pipeline(spark, tmp_path, tokens):  # noqa: F811
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path / "sf"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at.collect()
    text = {i: t for i, t, *_ in rows}
    language = {r.doc_id for r in seen["language"]}
    assert language <= set(text) and not language & {400, 401, 402} and len(language) >= 0.9 * sum(1 for t in text.values() if t and any(map(str.isalpha, t)))
    groups = collections.defaultdict(list)
    for i in language:
        groups[text[i] or ""].append(i)
    exact = {r.doc_id for r in seen["exact_copies"]}
    assert exact == {max(g) for g in groups.values()}
    near = {r.doc_id for r in seen["near_copies"]}
    assert near == plain_kept({i: text[i] for i in exact})  # five-word shingles of similarity 0.8 or more
    mixed = collections.Counter(r.doc_id for r in seen["mixture"])
    assert set(mixed) == near and max(mixed.values()) <= 2
    _, enc = tokens
    assert collections.Counter(r.doc_id for r in seen["tokens"]) == mixed
    for r in seen["tokens"]:
        ids = enc.encode_ordinary(text[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(ids)


@pytest.mark.parametrize("name", ["language", "exact_copies", "near_copies", "mixture"])
def test_stages_take_empty_tables(spark, name):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, "")
    assert out.columns == empty.columns and out.count() == 0


def test_texts_are_read_and_sent_in_small_batches(spark):
    """Else the reader's arrays drive an executor's heap to its limit, and the token stage's workers find no room beside it."""
    rows, sent = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {key: spark.conf.get(key, None) for key in (rows, sent)}
    try:
        for given, wanted in (("4096", "512"), ("100", "100")):
            spark.conf.set(rows, given)
            docs = spark.createDataFrame([(1, "ein Wort", None, None, 8)], "doc_id long, text string, lang string, source string, n_chars long")
            corpus_pipeline.language(spark, docs, "")
            assert spark.conf.get(rows) == wanted and int(spark.conf.get(sent)) <= 4 << 20
        spark.conf.set(sent, "1000")
        small_batches(spark)
        assert spark.conf.get(sent) == "1000"
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
