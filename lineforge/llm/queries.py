"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from lineforge.session import table

from . import bpe, exact, langid, linededup, media, mixing, privacy, quality, simhash, substring

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_simhash_trie(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_exact_recipes(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_exact_recipes"] = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_centroid_language(spark, sf_dir):
    return langid.predict_documents(table(spark, sf_dir, "documents"))


@query
def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op9_line_bitmaps(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op9_line_bitmaps"] = f"""
    WITH lines AS (
        SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    keyed AS (
        SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    common AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT keyed.*, last IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN common USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
"""


@query
def op1_temperature_mix(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


ORACLES["op1_temperature_mix"] = """
    WITH RECURSIVE d0 AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
               CAST('0x' || substr(md5('42/' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
        FROM documents),
    z AS (
        SELECT CAST(64 * 2 ** greatest(0, ceil(log2(max(n) / 67108864.0) / 2)) AS BIGINT) AS n_blocks
        FROM (SELECT sum(n_tokens) AS n FROM d0 GROUP BY source)),
    d AS (SELECT doc_id, source, n_tokens, CAST(h % n_blocks AS INTEGER) AS block FROM d0, z),
    b AS (SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY ALL),
    s AS (SELECT source, sum(n) AS tokens, sum(n) / (SELECT CAST(sum(n) AS DOUBLE) FROM b) AS p FROM b GROUP BY source),
    l AS (SELECT list(p) AS ps, CAST(count(*) AS DOUBLE) AS k FROM s),
    halving AS (
        SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
        UNION ALL
        SELECT i + 1, CASE WHEN low THEN lo ELSE (lo + hi) / 2 END, CASE WHEN low THEN (lo + hi) / 2 ELSE hi END,
               CASE WHEN few THEN lo2 ELSE (lo2 + hi2) / 2 END, CASE WHEN few THEN (lo2 + hi2) / 2 ELSE hi2 END
        FROM (
            SELECT halving.*,
                   ln(list_sum([p ** ((lo + hi) / 2) FOR p IN ps]))
                     - (lo + hi) / 2 * list_sum([p ** ((lo + hi) / 2) * ln(p) FOR p IN ps]) / list_sum([p ** ((lo + hi) / 2) FOR p IN ps])
                     < 0.95 * ln(k) AS low,
                   list_max([p ** ((lo2 + hi2) / 2 - 1) FOR p IN ps]) / list_sum([p ** ((lo2 + hi2) / 2) FOR p IN ps]) <= 4 AS few
            FROM halving, l)
        WHERE i < 40),
    e AS (SELECT round(least(1.0, greatest((lo + hi) / 2, (lo2 + hi2) / 2)), 9) AS a FROM halving WHERE i = 40),
    w AS (
        SELECT source, tokens, CAST(floor(p ** a / sum(p ** a) OVER () * sum(tokens) OVER () + 0.5) AS BIGINT) AS budget FROM s, e),
    q AS (SELECT b.*, tokens, budget, budget // tokens AS whole FROM b JOIN w USING (source)),
    r AS (
        SELECT *, CAST('0x' || substr(md5('42/' || source || '/' || CAST(whole AS VARCHAR) || '/' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT) AS r FROM q),
    plan AS (
        SELECT source, block, whole + CASE WHEN coalesce(sum(n) OVER (PARTITION BY source ORDER BY r, block
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < budget - whole * tokens THEN 1 ELSE 0 END AS epochs FROM r),
    x AS (SELECT d.*, unnest(range(CAST(epochs AS BIGINT))) AS epoch FROM d JOIN plan USING (source, block))
    SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, epoch, block,
           CAST('0x' || substr(md5('42/' || source || '/' || CAST(epoch AS VARCHAR) || '/' || CAST(block AS VARCHAR)), 1, 15) AS BIGINT) AS block_order
    FROM x
"""


@query
def op8_block_anchors(spark, sf_dir):
    return substring.dedup_passages(table(spark, sf_dir, "documents"))


ORACLES["op8_block_anchors"] = """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    g AS (SELECT doc_id, w, unnest(range(CAST(len(w) - 19 AS BIGINT))) AS s FROM d WHERE len(w) >= 20),
    m AS (
        SELECT doc_id, s FROM (
            SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s + 1 : s + 20], ' ') ORDER BY doc_id, s) AS r FROM g)
        WHERE r > 1),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
    c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM m),
    k AS (SELECT x.*, c.i IS NOT NULL AS gone FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i),
    a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN a USING (doc_id)
"""


@query
def op7_term_disclosure(spark, sf_dir):
    return privacy.personal_data(table(spark, sf_dir, "documents"))


@query
def op3_media_chunks(spark, sf_dir):
    return media.media_columns(table(spark, sf_dir, "documents"))


@query
def op10_kneser_ney_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
