"""The engine's queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineforge.functions import sequence as S
from lineforge.operators import barcode, filterexpr, joins, ordinals, scaffold, simulate, stats
from lineforge.session import scratch, table
from lineforge.sources import records, sequences, text_format
from lineforge.sources.schema import RecordSchema

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_DNA = "regexp_replace(lower(text), '[^acgtn]', '', 'g')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _dna(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.dna_projection(F.col("text")).alias("s"))


# ---- statistics and validation


@query("""
    SELECT lang AS line_type, count(*) AS n, max(octet_length(encode(text))) AS max_len, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_len
    FROM documents GROUP BY lang""")
def line_stats(spark, sf_dir):
    return stats.line_stats(table(spark, sf_dir, "documents"), F.col("lang"), F.octet_length("text").cast("bigint"))


@query("""
    SELECT l_returnflag AS child_type, max(c) AS max_count, CAST(max(t) AS BIGINT) AS max_total
    FROM (SELECT l_orderkey, l_returnflag, count(*) AS c, sum(length(l_linestatus) + length(l_returnflag)) AS t FROM lineitem GROUP BY ALL) GROUP BY 1""")
def container_maxima(spark, sf_dir):
    return stats.container_maxima(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag"), F.length("l_linestatus") + F.length("l_returnflag"))


@query("""
    WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT e.user_id, count(*) FILTER (first IS NULL OR event_id < first) AS n_before
    FROM events e LEFT JOIN f ON e.user_id = f.user_id GROUP BY e.user_id""")
def prefix_before_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("first"))
    return e.join(first, "user_id").groupBy("user_id").agg(F.count(F.when(F.col("first").isNull() | (F.col("event_id") < F.col("first")), 1)).alias("n_before"))


@query("""
    WITH given AS (SELECT o_orderstatus AS k, count(*) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n, max(o_custkey) AS m FROM orders GROUP BY 1 HAVING k <> 'F'),
    actual AS (SELECT o_orderstatus AS k, count(*) AS n, max(o_custkey) AS m FROM orders GROUP BY 1),
    g AS (SELECT k, 'n' AS measure, n AS given FROM given UNION ALL SELECT k, 'm', m FROM given),
    a AS (SELECT k, 'n' AS measure, n AS actual FROM actual UNION ALL SELECT k, 'm', m FROM actual)
    SELECT coalesce(g.k, a.k) AS k, coalesce(g.measure, a.measure) AS measure, CAST(given AS BIGINT) AS given, CAST(actual AS BIGINT) AS actual,
           CASE WHEN given IS NULL AND coalesce(actual, 0) > 0 THEN 'missing' WHEN coalesce(given, 0) = coalesce(actual, 0) THEN 'ok' ELSE 'bad' END AS status
    FROM g FULL JOIN a ON g.k = a.k AND g.measure = a.measure""")
def header_validate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("m"))
    given = o.where("k <> 'F'").withColumn("n", F.col("n") + F.when(F.col("k") == "P", 1).otherwise(0))
    return stats.validate(given, o, ["k"], ["n", "m"])


@query("SELECT event_type AS line_type, CAST(sum(octet_length(encode(props)) + 1) AS BIGINT) AS n_bytes FROM events GROUP BY 1")
def byte_usage(spark, sf_dir):
    return stats.byte_usage(table(spark, sf_dir, "events"), F.col("event_type"), F.col("props"))


@query(f"SELECT count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS total, round(avg(length(s)), 2) AS mean, min(length(s)) AS min_len, max(length(s)) AS max_len FROM (SELECT {_DNA} AS s FROM documents)")
def seq_summary(spark, sf_dir):
    return stats.sequence_summary(_dna(spark, sf_dir), F.col("s"))


@query(f"""
    WITH d AS (SELECT {_DNA} AS s FROM documents),
    t AS (SELECT sum(length(s)) AS total FROM d),
    c AS (SELECT b AS base, sum(length(s) - length(replace(s, b, ''))) AS n FROM d, (SELECT unnest(['a', 'c', 'g', 't', 'n']) AS b) GROUP BY b)
    SELECT base, CAST(n AS BIGINT) AS n, round(n * 100.0::DOUBLE / total, 4) AS percent FROM c, t WHERE n > 0""")
def base_counts(spark, sf_dir):
    return stats.base_counts(_dna(spark, sf_dir), F.col("s"))


@query("""
    SELECT p_size AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent,
           round(sum(count(*)) OVER (ORDER BY p_size) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS cum_percent FROM part GROUP BY p_size""")
def qual_hist_cum(spark, sf_dir):
    return stats.histogram_cumulative(table(spark, sf_dir, "part"), F.col("p_size"))


_HIST = f"SELECT CAST(floor(10 * sqrt(length(s))) AS INTEGER) AS bin, count(*) AS n, sum(length(s)) AS total FROM (SELECT {_DNA} AS s FROM documents) GROUP BY 1"


@query(f"""
    WITH h AS ({_HIST}), r AS (SELECT bin, sum(total) OVER (ORDER BY bin) * 2 >= sum(total) OVER () AS ok FROM h)
    SELECT (CAST(min(bin) AS BIGINT) + 1) * (CAST(min(bin) AS BIGINT) + 2) // 100 AS n50_approx FROM r WHERE ok""")
def n50_approx(spark, sf_dir):
    return stats.approximate_n50(_dna(spark, sf_dir), F.length("s"))


@query(f"""
    WITH h AS ({_HIST}), t AS (SELECT max(bin) AS top, greatest(1, (max(bin) + 1) // 20) AS d FROM h),
    m AS (SELECT top - ((top - bin) // d) * d AS b, n FROM h, t)
    SELECT CAST(b AS BIGINT) * b // 100 AS length, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY b""")
def length_bins(spark, sf_dir):
    return stats.length_bins(_dna(spark, sf_dir), F.length("s"))


@query("SELECT doc_id, source AS description, length(text) AS len FROM documents")
def entry_listing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("description"), F.length("text").cast("bigint").alias("len"))


@query("SELECT event_type AS key, row_number() OVER (ORDER BY min(event_id)) - 1 AS id FROM events GROUP BY event_type")
def dict_ids(spark, sf_dir):
    return stats.dictionary(table(spark, sf_dir, "events"), F.col("event_type"), "event_id")


@query("SELECT count(DISTINCT user_id) AS n_keys, count(DISTINCT event_type) AS n_types FROM events")
def key_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n_keys"), F.count_distinct("event_type").alias("n_types"))


# ---- navigation


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS ordinal FROM events")
def object_ordinals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ordinals.with_running(e, "event_id", {"ordinal": F.lit(1)}, by=["event_type"])


_TYPES = "'purchase'"
_EVENT_LINES = """
    SELECT event_id AS line_no, event_type AS line_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS obj,
           max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS last,
           max(CASE WHEN event_type NOT IN ('purchase', 'click', 'view') THEN event_id END) OVER w AS block
    FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""


def _event_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), F.col("event_type").alias("line_type"))
    return ordinals.containment_positions(e, ["purchase"], {"purchase": {"click", "view"}})


@query(f"""
    WITH l AS ({_EVENT_LINES}), r(req_no, lo, hi) AS (VALUES (0, 3, 4), (1, 5, 6), (2, 9, 12), (3, 4, 5))
    SELECT r.req_no, line_no, line_type FROM l JOIN r ON obj >= lo AND obj < hi WHERE last > coalesce(block, -1)""")
def index_ranges(spark, sf_dir):
    return ordinals.select_ranges(_event_lines(spark, sf_dir), "purchase", "3,5,9-12,4").select("req_no", "line_no", "line_type")


@query(f"WITH l AS ({_EVENT_LINES}) SELECT line_no, line_type FROM l WHERE obj = 0")
def preamble(spark, sf_dir):
    return ordinals.select_ranges(_event_lines(spark, sf_dir), "purchase", "0").select("line_no", "line_type")


@query(f"WITH l AS ({_EVENT_LINES}) SELECT line_type, obj >= 1 AND last > coalesce(block, -1) AS contained, count(*) AS n FROM l GROUP BY ALL")
def containment_filter(spark, sf_dir):
    return _event_lines(spark, sf_dir).groupBy("line_type", F.col("in_purchase").alias("contained")).agg(F.count("*").alias("n"))


@query("""
    SELECT CAST(obj AS BIGINT) AS obj, count(*) FILTER (event_type = 'click') AS n
    FROM (SELECT event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS obj FROM events) GROUP BY obj""")
def count_until_next(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return ordinals.count_until_next(e, "event_id", F.col("event_type") == "error", F.col("event_type") == "click")


@query("""
    SELECT o_orderkey, count(l_orderkey) AS n_lines, coalesce(string_agg(x, ';' ORDER BY x), '') AS lines
    FROM orders LEFT JOIN (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR) AS x FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def objects_nested(spark, sf_dir):
    line = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    inner = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.array_join(F.array_sort(F.collect_list(line)), ";").alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(inner, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce("lines", F.lit("")).alias("lines"))


@query("""
    SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS types
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY user_id""")
def compact_sorted(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(w).alias("before"))
    kept = e.where("before is null or before <> event_type")
    return kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


# ---- sequence functions


@query(f"SELECT doc_id, reverse(translate({_DNA}, 'acgtn', 'tgcan')) AS rc FROM documents")
def revcomp(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", S.reverse_complement(F.col("s")).alias("rc"))


_HOCO = "regexp_replace(" * 5 + "{s}, 'a+', 'a', 'g'), 'c+', 'c', 'g'), 'g+', 'g', 'g'), 't+', 't', 'g'), 'n+', 'n', 'g')"


@query(f"SELECT doc_id, h AS hoco, length(h) AS len FROM (SELECT doc_id, {_HOCO.format(s=_DNA)} AS h FROM documents)")
def hoco(spark, sf_dir):
    h = _dna(spark, sf_dir).select("doc_id", S.homopolymer_compress(F.col("s")).alias("hoco"))
    return h.select("doc_id", "hoco", F.length("hoco").cast("bigint").alias("len"))


@query(f"""
    WITH d AS (SELECT doc_id, {_DNA} AS s FROM documents), r AS (SELECT doc_id, regexp_extract_all(s, '(a+|c+|g+|t+|n+)') AS runs FROM d),
    e AS (SELECT doc_id, unnest(runs) AS run, unnest(range(1, len(runs) + 1)) AS i FROM r),
    p AS (SELECT doc_id, i, length(run) AS n, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM e),
    x AS (SELECT doc_id, count(*) AS n_runs, max(n) AS longest, string_agg(CAST(stop AS VARCHAR), ',' ORDER BY i) AS ends FROM p GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, coalesce(longest, 0) AS longest, coalesce(ends, '') AS ends FROM d LEFT JOIN x USING (doc_id)""")
def hoco_runs(spark, sf_dir):
    d = _dna(spark, sf_dir).select("doc_id", S.run_lengths(F.col("s")).alias("n"))
    ends = F.array_join(S.running_sum(F.col("n")).cast("array<string>"), ",")
    return d.select("doc_id", F.size("n").cast("bigint").alias("n_runs"), F.coalesce(F.array_max("n"), F.lit(0)).cast("bigint").alias("longest"), ends.alias("ends"))


@query(f"SELECT doc_id, {_DNA} AS expanded FROM documents")
def hoco_roundtrip(spark, sf_dir):
    d = _dna(spark, sf_dir).select("doc_id", S.homopolymer_compress(F.col("s")).alias("c"), S.run_ends(F.col("s")).alias("ends"))
    return d.select("doc_id", S.homopolymer_expand(F.col("c"), F.col("ends")).alias("expanded"))


@query(f"""
    WITH d AS (SELECT doc_id, {_DNA} AS s FROM documents), g AS (SELECT doc_id, regexp_extract_all(s, '([acgt]+|n+)') AS seg FROM d),
    e AS (SELECT doc_id, unnest(seg) AS part, unnest(range(1, len(seg) + 1)) AS i FROM g),
    p AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS pos FROM e)
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, 'n' AS base, length(part) AS n FROM p WHERE part LIKE 'n%'""")
def n_runs(spark, sf_dir):
    r = _dna(spark, sf_dir).select("doc_id", F.explode(S.non_acgt_runs(F.col("s"))).alias("r"))
    return r.select("doc_id", F.col("r.pos").cast("bigint").alias("pos"), "r.base", F.col("r.n").cast("bigint").alias("n"))


@query(f"""
    WITH d AS (SELECT doc_id, trim({_DNA}, 'n') AS s FROM documents),
    c AS (SELECT doc_id, unnest(regexp_split_to_array(s, 'nn+')) AS seq, unnest(range(1, len(regexp_split_to_array(s, 'nn+')) + 1)) AS contig FROM d WHERE s <> '')
    SELECT doc_id, contig, CAST(doc_id AS VARCHAR) || '.' || CAST(contig AS VARCHAR) AS id, length(seq) AS len, seq FROM c""")
def scaffold_break(spark, sf_dir):
    out = scaffold.scaffold_break(_dna(spark, sf_dir), "doc_id", F.col("s"), 2)
    return out.select("doc_id", F.col("contig").cast("bigint").alias("contig"), "id", F.length("seq").cast("bigint").alias("len"), "seq")


@query(f"SELECT doc_id, {_DNA} AS seq FROM documents")
def scaffold_join(spark, sf_dir):
    d = _dna(spark, sf_dir)
    contigs = scaffold.scaffold_break(d, "doc_id", F.col("s"), 2).select("doc_id", "pos", "seq")
    return scaffold.scaffold_join(contigs, "doc_id", d.select("doc_id", F.length("s").alias("length")))


_FRAGMENTS = [("3", 10, 20, False), ("6", 0, 0, False), ("6", 4, 30, True), ("8", 0, 0, True), ("3", 10, 20, False), ("50", 2, 1000000, False)]


@query(f"""
    WITH f(key, a, b, rc) AS (VALUES {", ".join(f"({k}, {a}, {b}, {str(r).lower()})" for k, a, b, r in _FRAGMENTS)}),
    j AS (SELECT doc_id, {_DNA} AS s, a, b, rc, length({_DNA}) AS n FROM documents JOIN f ON doc_id = key),
    e AS (SELECT *, CASE WHEN b = 0 OR b > n THEN n ELSE b END AS z FROM j),
    x AS (SELECT *, CASE WHEN rc THEN n - z ELSE a END AS lo, CASE WHEN rc THEN n - a ELSE z END AS hi FROM e)
    SELECT doc_id, CAST(doc_id AS VARCHAR) || ':' || CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) || CASE WHEN rc THEN 'R' ELSE '' END AS label,
           substr(CASE WHEN rc THEN reverse(translate(s, 'acgtn', 'tgcan')) ELSE s END, lo + 1, greatest(hi - lo, 0)) AS seq FROM x""")
def extract_fragments(spark, sf_dir):
    fragments = spark.createDataFrame(_FRAGMENTS, "key string, start bigint, end bigint, rc boolean")
    return scaffold.extract(_dna(spark, sf_dir), fragments, "doc_id", F.col("doc_id"), F.col("s"))


@query(f"""
    WITH d AS (SELECT doc_id, {_DNA} AS s FROM documents),
    c AS (SELECT doc_id, rpad(translate(s, 'acgtn', '01230'), CAST(ceil(length(s) / 4.0) * 4 AS INTEGER), '0') AS q FROM d),
    b AS (SELECT doc_id, CASE WHEN q = '' THEN [] ELSE list_transform(range(0, length(q) // 4), lambda i: CAST(substr(q, i * 4 + 1, 1) AS INTEGER)
        + 4 * CAST(substr(q, i * 4 + 2, 1) AS INTEGER) + 16 * CAST(substr(q, i * 4 + 3, 1) AS INTEGER) + 64 * CAST(substr(q, i * 4 + 4, 1) AS INTEGER)) END AS v FROM c)
    SELECT doc_id, coalesce(array_to_string(list_transform(v, lambda x: lpad(upper(to_hex(x)), 2, '0')), ''), '') AS packed FROM b""")
def pack2bit(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", S.pack2bit(F.col("s")).alias("packed"))


@query("""
    WITH a AS (SELECT user_id, list(event_id ORDER BY event_id) AS v FROM events GROUP BY user_id),
    d AS (SELECT user_id, v, list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]) AS d FROM a)
    SELECT user_id, array_to_string(list_prepend(v[1], d), ',') AS deltas,
           CASE WHEN coalesce(list_max(d), 0) < 128 THEN 1 WHEN list_max(d) < 32768 THEN 2 WHEN list_max(d) < 8388608 THEN 3 ELSE 4 END AS width FROM d""")
def delta_lists(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("v"))
    return a.select("user_id", F.array_join(S.deltas(F.col("v")).cast("array<string>"), ",").alias("deltas"), S.delta_width(F.col("v")).alias("width"))


@query("""
    SELECT o_orderkey, CASE WHEN v BETWEEN -64 AND 63 THEN 1 WHEN v BETWEEN 0 AND 8191 THEN 2 WHEN v >= -65536 AND v < 65536 THEN 3 WHEN v >= -16777216 AND v < 16777216 THEN 4 ELSE 5 END AS n_bytes
    FROM (SELECT o_orderkey, (o_orderkey % 7 - 3) * o_custkey * 40 AS v FROM orders)""")
def varint_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", S.varint_size((F.col("o_orderkey") % 7 - 3) * F.col("o_custkey") * 40).alias("n_bytes"))


@query("SELECT p_partkey, CASE WHEN p_size >= 20 THEN '1' ELSE '0' END || CASE WHEN p_size // 2 >= 20 THEN '1' ELSE '0' END AS bits FROM part")
def quality_threshold(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.quality_bits(F.array(F.col("p_size"), F.expr("p_size div 2")), 20).alias("bits"))


@query("""
    WITH u AS (SELECT DISTINCT p_size AS code FROM part WHERE p_size % 5 = 1), c AS (SELECT CAST(unnest(range(0, 60)) AS INTEGER) AS code)
    SELECT c.code, arg_min(u.code, abs(u.code - c.code) * 1000 + u.code) AS nearest FROM c, u GROUP BY c.code""")
def nearest_code(spark, sf_dir):
    used = table(spark, sf_dir, "part").select(F.col("p_size").alias("code")).where("code % 5 = 1")
    return joins.nearest_code(spark.range(60).select(F.col("id").cast("int").alias("code")), used)


@query(f"""
    WITH d AS (SELECT doc_id, {_DNA} AS s FROM documents),
    p AS (SELECT x.doc_id, x.s AS a, y.s AS b FROM d x JOIN d y ON y.doc_id = x.doc_id + 1),
    c AS (SELECT doc_id, unnest(range(1, greatest(length(a), length(b)) + 1)) AS i, unnest(string_split(rpad(a, CAST(greatest(length(a), length(b)) AS INTEGER), '-'), '')) AS x,
                 unnest(string_split(rpad(b, CAST(greatest(length(a), length(b)) AS INTEGER), '-'), '')) AS y FROM p WHERE length(a) + length(b) > 0)
    SELECT p.doc_id, coalesce(m, 0) AS mismatch FROM p LEFT JOIN (SELECT doc_id, min(i) AS m FROM c WHERE x <> y GROUP BY doc_id) USING (doc_id)""")
def packed_match(spark, sf_dir):
    d = _dna(spark, sf_dir)
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return d.join(other, "doc_id").select("doc_id", S.match_position(F.col("s"), F.col("t")).cast("bigint").alias("mismatch"))


@query(f"SELECT doc_id, reverse(translate({_DNA}, 'acgtn', 'tgcat')) AS rc, substr(replace({_DNA}, 'n', 'a'), 6, 30) AS part FROM documents")
def packed_revcomp(spark, sf_dir):
    d = _dna(spark, sf_dir).select("doc_id", F.length("s").alias("n"), S.pack2bit(F.col("s")).alias("p"))
    rc = S.unpack2bit(S.packed_reverse_complement(F.col("p"), F.col("n")), F.col("n"))
    part = S.unpack_at(F.col("p"), F.lit(5), F.greatest(F.lit(0), F.least(F.lit(30), F.col("n") - 5)))
    return d.select("doc_id", rc.alias("rc"), part.alias("part"))


# ---- joins, pairing, grouping


@query("""
    WITH f AS (SELECT row_number() OVER (ORDER BY p_partkey) AS ord, p_partkey, p_size FROM part),
    r AS (SELECT row_number() OVER (ORDER BY p_partkey DESC) AS ord, p_partkey AS mate, p_brand FROM part)
    SELECT ord, p_partkey, p_size, mate, p_brand FROM f JOIN r USING (ord)""")
def pair_zip(spark, sf_dir):
    """Two whole files of as many records by place, one read forwards and one backwards; different counts are an error."""
    p = table(spark, sf_dir, "part")
    forward = ordinals.with_running(p.select("p_partkey", "p_size"), "p_partkey", {"ord": F.lit(1)})
    backward = p.select(F.col("p_partkey").alias("mate"), "p_brand", (-F.col("p_partkey")).alias("from_end"))
    return joins.zip_join(forward, ordinals.with_running(backward, "from_end", {"ord": F.lit(1)}).drop("from_end"))


@query("""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_size, s_nationkey, least(l_quantity, p_size) AS overlap
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def lookup_lengths(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    p, s = table(spark, sf_dir, "part").select("p_partkey", "p_size"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    both = joins.lookup(joins.lookup(l, p, F.col("l_partkey") == F.col("p_partkey"), ["p_size"]), s, F.col("l_suppkey") == F.col("s_suppkey"), ["s_nationkey"])
    return both.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "p_size", "s_nationkey", F.least("l_quantity", F.col("p_size").cast("double")).alias("overlap"))


@query("""
    WITH k AS (SELECT event_id, user_id, split_part(event_type, 'c', 1) AS group_key FROM events),
    c AS (SELECT *, CASE WHEN lag(group_key) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM group_key THEN 0 ELSE 1 END AS new FROM k)
    SELECT event_id, user_id, group_key, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS group_no FROM c""")
def group_by_prefix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return joins.prefix_groups(e, S.group_prefix(F.col("event_type"), "c", 1), "event_id", ["user_id"]).select("event_id", "user_id", "group_key", "group_no")


@query("""
    WITH p AS (SELECT DISTINCT conv_id, turn, turn // 2 AS name FROM conversations), c AS (SELECT conv_id, name FROM p GROUP BY ALL HAVING count(*) = 2)
    SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY name) AS BIGINT) AS pair_no,
           row_number() OVER (PARTITION BY conv_id, name ORDER BY turn) AS mate FROM p JOIN c USING (conv_id, name)""")
def pair_adjacent(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("turn div 2").alias("name")).distinct()
    whole = t.groupBy("conv_id", "name").agg(F.count("*").alias("n")).where("n = 2").select("conv_id", "name")
    return joins.adjacent_pairs(t.join(whole, ["conv_id", "name"]), "name", "turn", ["conv_id"]).select("conv_id", "turn", "pair_no", F.col("mate").cast("bigint").alias("mate"))


@query("""
    WITH b AS (SELECT event_id, 'cell' || CAST(event_id AS VARCHAR) AS cell FROM events WHERE event_type = 'error')
    SELECT e.event_id, cell FROM (SELECT event_id FROM events WHERE event_type <> 'error') e ASOF LEFT JOIN b ON e.event_id >= b.event_id""")
def group_interval_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    bounds = e.where("event_type = 'error'").select("event_id", F.concat(F.lit("cell"), F.col("event_id").cast("string")).alias("cell"))
    return joins.interval_lookup(e.where("event_type <> 'error'").select("event_id"), bounds, "event_id", "event_id", "cell")


@query("SELECT 0 AS part, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 1, o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'O'")
def concat_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    one = lambda k, c: o.where(c).select(F.lit(k).alias("part"), "o_orderkey", "o_custkey")
    return one(0, "o_orderstatus = 'O'").unionByName(one(1, "o_orderstatus <> 'O'"))


@query("""
    WITH best AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part)
    SELECT row_number() OVER (ORDER BY p_partkey) AS ord, p_partkey, p_size FROM best WHERE r = 1 AND p_size >= 10""")
def trim_renumber(spark, sf_dir):
    """The largest part of each brand, those of too small a size dropped, numbered anew."""
    best = F.min(F.struct((-F.col("p_size")).alias("s"), "p_partkey")).alias("b")
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(best).select("b.p_partkey", (-F.col("b.s")).alias("p_size")).where("p_size >= 10")
    return ordinals.with_running(p, "p_partkey", {"ord": F.lit(1)}).select("ord", "p_partkey", "p_size")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE (l_quantity >= 30 AND l_suppkey < 50) OR (l_linenumber = 1 AND (l_quantity <= 5 OR l_suppkey != 7))""")
def filter_expr(spark, sf_dir):
    names = {"zm": F.col("l_suppkey"), "ln": F.col("l_quantity"), "np": F.col("l_linenumber")}
    predicate = filterexpr.compile_filter("ln >= 30 && zm<50 || np == 1&&(ln<=5||zm!=7)", names)
    return table(spark, sf_dir, "lineitem").where(predicate).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


# ---- barcodes

_CODE = f"SELECT doc_id, substr({_DNA}, 1, 6) AS code, {_DNA} AS s FROM documents WHERE length({_DNA}) >= 6 AND substr({_DNA}, 1, 6) NOT LIKE '%n%'"
_VERDICT = f"""
    r AS ({_CODE}), counts AS (SELECT code, count(*) AS n FROM r GROUP BY code), valid AS (SELECT code FROM counts WHERE n >= 3),
    v AS (SELECT valid.code AS fixed, substr(valid.code, 1, i) || c || substr(valid.code, i + 2) AS code
          FROM valid, (SELECT unnest(range(0, 6)) AS i), (SELECT unnest(['a', 'c', 'g', 't']) AS c) WHERE substr(valid.code, i + 1, 1) <> c),
    u AS (SELECT code, min(fixed) AS fixed FROM v GROUP BY code HAVING count(*) = 1 AND code NOT IN (SELECT code FROM valid)),
    t AS (SELECT r.*, CASE WHEN valid.code IS NOT NULL THEN 'valid' WHEN u.fixed IS NOT NULL THEN 'repaired' ELSE 'dropped' END AS status,
                 coalesce(valid.code, u.fixed) AS corrected FROM r LEFT JOIN valid ON r.code = valid.code LEFT JOIN u ON r.code = u.code)"""


def _codes(spark, sf_dir):
    d = _dna(spark, sf_dir).where("length(s) >= 6").withColumn("code", F.substring("s", 1, 6))
    return d.where("code not like '%n%'")


@query(f"""
    WITH c AS (SELECT code, count(*) AS n FROM ({_CODE}) GROUP BY code)
    SELECT CASE WHEN n < 50 THEN n WHEN n < 1000 THEN n // 10 * 10 ELSE 1000 END AS bin, count(*) AS codes, CAST(sum(n) AS BIGINT) AS reads FROM c GROUP BY 1""")
def barcode_counts(spark, sf_dir):
    return barcode.count_histogram(barcode.code_counts(_codes(spark, sf_dir)))


@query(f"WITH {_VERDICT} SELECT doc_id, code, status, corrected FROM t")
def barcode_correct(spark, sf_dir):
    return barcode.correct(_codes(spark, sf_dir), 3, 6).select("doc_id", "code", "status", "corrected")


@query(f"WITH {_VERDICT} SELECT status, count(*) AS reads, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS percent FROM t GROUP BY status")
def barcode_totals(spark, sf_dir):
    return barcode.totals(barcode.correct(_codes(spark, sf_dir), 3, 6))


@query(f"WITH {_VERDICT} SELECT corrected AS cloud, count(*) AS n_reads, CAST(sum(length(substr(s, 24))) AS BIGINT) AS bases, min(doc_id) AS first FROM t WHERE status <> 'dropped' GROUP BY corrected")
def barcode_clouds(spark, sf_dir):
    c = barcode.clouds(barcode.correct(_codes(spark, sf_dir), 3, 6), F.col("s"))
    return c.groupBy("cloud").agg(F.count("*").alias("n_reads"), F.sum(F.length("trimmed")).cast("bigint").alias("bases"), F.min("doc_id").alias("first"))


# ---- files: written, read back, and compared with the table

_SCHEMA = "P 3 doc\nO D 2 3 INT 6 STRING\nD L 1 8 INT_LIST\nD S 2 4 CHAR 4 REAL\n"


def _record_lines(spark, sf_dir):
    """Documents as lines: D with number and text, L with the lengths of its words, S with a letter and a number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    sizes = F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint"))
    none = {"ints": "array<bigint>", "reals": "array<double>", "chars": "array<string>", "list_len": "bigint", "str": "string", "int_list": "array<bigint>", "real_list": "array<double>", "str_list": "array<string>", "comment": "string"}
    line = lambda kind, **f: F.struct(F.lit(kind).alias("line_type"), *[(f[k].cast(t) if k in f else F.array().cast(t) if k in ("ints", "reals", "chars") else F.lit(None).cast(t)).alias(k) for k, t in none.items()])
    kinds = F.array(
        line("D", ints=F.array("doc_id"), str=F.col("text"), list_len=F.octet_length("text"), comment=F.col("lang")),
        line("L", int_list=sizes, list_len=F.size(sizes)),
        line("S", chars=F.array(F.substring("lang", 1, 1)), reals=F.array(F.length("text") / 4)),
    )
    return d.select(F.lit("").alias("file"), "doc_id", F.posexplode(kinds).alias("k", "x")).select("file", (F.col("doc_id") * 3 + F.col("k")).alias("line_no"), "x.*")


_SOURCE_SQL = """
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, lang AS comment, len(string_split(coalesce(text, ''), ' ')) AS n_words,
           CAST(list_sum(list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w))) AS BIGINT) AS n_letters, lang[1] AS first, length(coalesce(text, '')) / 4.0::DOUBLE AS quarter
    FROM documents"""


def _read_back(f):
    """One row a document from its three lines."""
    of = lambda kind: F.get(F.filter("lines", lambda x: x["line_type"] == kind), 0)
    o = f.objects("D").select(of("D").alias("d"), of("L").alias("l"), of("S").alias("s"))
    total = F.aggregate("l.int_list", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return o.select(F.get("d.ints", 0).alias("doc_id"), F.col("d.list_len").alias("n_bytes"), F.sha2(F.col("d.str").cast("binary"), 256).alias("text_sha256"), "d.comment", F.size("l.int_list").cast("bigint").alias("n_words"), total.alias("n_letters"), F.get("s.chars", 0).alias("first"), F.get("s.reals", 0).alias("quarter"))


def _documents_header():
    return text_format.Header("doc", schema=RecordSchema.for_type(_SCHEMA, "doc")).add_provenance("lineforge", "1", "catalogue", "2024-01-01_00:00:00")


@query(_SOURCE_SQL)
def binary_roundtrip(spark, sf_dir):
    """Documents written as binary record files by four tasks, found by their indexes, and read back."""
    path = scratch(spark, "binary")
    records.write_binary(_record_lines(spark, sf_dir), _documents_header(), path, parts=4)
    return _read_back(records.read_records(spark, path))


@query("""
    SELECT line_type, count(*) AS n, CAST(max(l) AS BIGINT) AS max_len, CAST(sum(l) AS BIGINT) AS total_len FROM (
        SELECT 'D' AS line_type, octet_length(encode(coalesce(text, ''))) AS l FROM documents UNION ALL SELECT 'L', len(string_split(coalesce(text, ''), ' ')) FROM documents UNION ALL SELECT 'S', 0 FROM documents)
    GROUP BY line_type""")
def footer_counts(spark, sf_dir):
    """Counts of every line type from the footers of binary files alone, without reading their data."""
    path = scratch(spark, "binary")
    records.write_binary(_record_lines(spark, sf_dir), _documents_header(), path, parts=3)
    counts = records.read_records(spark, path).header.counts
    return spark.createDataFrame([(k, c.get("count", 0), c.get("max", 0), c.get("total", 0)) for k, c in counts.items()], "line_type string, n bigint, max_len bigint, total_len bigint")


@query(f"SELECT row_number() OVER (ORDER BY doc_id) AS ord, CAST(doc_id AS VARCHAR) AS id, lang AS desc, {_DNA} AS seq FROM documents")
def fasta_roundtrip(spark, sf_dir):
    """Sequences written as FASTA in order, in parts, read back by splits, with the place of every record over all parts."""
    path = scratch(spark, "fasta")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("desc"), S.dna_projection(F.col("text")).alias("seq"))
    sequences.write_fasta(d.orderBy("doc_id"), path)
    return sequences.read_fasta(spark, path, continued=True).select("ord", "id", "desc", "seq")


@query(f"SELECT doc_id, length({_HOCO.format(s=_DNA)}) AS stored, {_DNA} AS seq FROM documents")
def hoco_record_file(spark, sf_dir):
    """Sequences stored homopolymer-compressed with their run ends in a record file, and expanded when they are read."""
    path = scratch(spark, "hoco")
    d = _dna(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("s").alias("seq"))
    schema = RecordSchema.for_type("P 3 seq\nO S 1 3 DNA\nD I 1 6 STRING\nD N 3 3 INT 4 CHAR 3 INT\nD H 1 8 INT_LIST\n", "seq")
    records.write_binary(sequences.sequence_lines(d, order="doc_id", homopolymers=True), text_format.Header("seq", schema=schema), path, parts=2)
    f = records.read_records(spark, path)
    return sequences.sequences_of(f, stored="stored").select(F.col("id").cast("bigint").alias("doc_id"), "stored", "seq")


@query("SELECT * FROM (VALUES (0, 'make', 'make a'), (1, 'join', 'join a b')) AS t(step, program, command)")
def header_inherit(spark, sf_dir):
    """Provenance of a file made from another one, written and read back."""
    schema = RecordSchema.for_type(_SCHEMA, "doc")
    first = text_format.Header("doc", schema=schema).add_provenance("make", "1", "make a", "2024-01-01_00:00:00")
    second = text_format.Header("doc", schema=schema).add_provenance("join", "1", "join a b", "2024-01-02_00:00:00").inherit(first)
    path = scratch(spark, "inherit")
    records.write_binary(_record_lines(spark, sf_dir), second, path)
    found = records.read_records(spark, path).header.provenance
    return spark.createDataFrame([(k, p[0], p[2]) for k, p in enumerate(found)], "step int, program string, command string")


@query()
def simulate_reads(spark, sf_dir):
    """Reads drawn from the documents' sequences, gaps filled; each is checked against the place it was drawn from."""
    d = _dna(spark, sf_dir).where("length(s) >= 50").select(F.col("doc_id").cast("string").alias("id"), F.col("s").alias("seq"))
    whole = simulate.fill_gaps(d, "id", "seq", seed=7)
    reads = simulate.shotgun(whole, coverage=2.0, mean=60.0, seed=7)
    source = F.expr("substring(seq, int(beg + 1), int(end - beg))")
    drawn = F.when(F.col("rc"), S.reverse_complement(source)).otherwise(source)
    both = reads.withColumnRenamed("seq", "read_seq").join(whole, F.col("src") == F.col("id"))
    return both.groupBy("src").agg(F.count("*").alias("reads"), F.sum(F.length("read_seq")).alias("bases"), F.min((drawn == F.col("read_seq")).cast("int")).alias("exact"))
