"""Personal data and the terms that reveal it, with DataFrame functions alone.

Base spans are regular expressions with checks: e-mail, IP, card and phone numbers. Every value found is a protected entity. A
term in the same document discloses the entity as far as its presence tells it: the pointwise mutual information of term and
entity over the corpus, as a fraction of the entity's information content. Terms above the upper threshold are removed, those
above the lower one generalised, in every document that has them.

The patterns use possessive quantifiers where greedy ones would give the same match, as these need no stack in the regular
expression engine, and start runs only where a run begins, so that long runs take linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# fixed values: the four kinds in the order in which they are listed, and their patterns
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?+[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
BASE = ("email", "ip", "card", "phone")
TERM_KINDS = ("removed", "generalised")
WORD = r"\p{L}{3,}"

_SPAN = "struct<start: int, kind: int, end: int, value: string>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _matches(text: Column, pattern: str | Column, kind: int, valid) -> Column:
    """array<span> of the valid matches of one kind."""
    both = F.struct(F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("g"))
    empty = F.array().cast(f"array<{_SPAN}>")

    def place(b):
        def step(acc, i):
            value = F.get(b["v"], i)
            start = acc["at"] + F.length(F.get(b["g"], i))
            end = start + F.length(value)
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        n = F.size(b["v"])
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.when(n == 0, empty).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), start, step, lambda acc: acc["out"]))

    return F.filter(F.transform(F.array(both), place)[0], lambda s: valid(s["value"]))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> by start, then kind; ``text`` isn't null."""
    empty = F.array().cast(f"array<{_SPAN}>")
    digits = lambda v: F.length(_digits(v))
    card = _matches(text, CARD, 2, lambda v: digits(v).between(14, 19) & F.call_function("luhn_check", _digits(v)))
    parts = [
        F.when(F.contains(text, F.lit("@")), _matches(text, EMAIL, 0, lambda v: F.lit(True))).otherwise(empty),
        F.when(text.rlike(r"[0-9]\.[0-9]"), _matches(text, IP, 1, lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))).otherwise(empty),
        F.when(text.rlike(r"(?:[0-9][ -]?+){14}"), card).otherwise(empty),
        F.when(F.contains(text, F.lit("+")), _matches(text, PHONE, 3, lambda v: digits(v).between(10, 15))).otherwise(empty),
    ]
    return F.array_sort(F.concat(*parts))


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of its spans; positions stay."""

    def blank(acc, s):
        return F.concat(F.substring(acc, F.lit(1), s["start"]), F.repeat(F.lit(" "), s["end"] - s["start"]), F.substring(acc, s["end"] + 1, F.length(acc)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, text, blank))


def _entity(s: Column) -> Column:
    return F.concat(s["kind"].cast("string"), F.lit(":"), F.when(s["kind"] < 2, F.lower(s["value"])).otherwise(_digits(s["value"])))


def disclosures(found: DataFrame, least_docs: int, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    """(risky, in_docs): (term, kind) of the terms that are above a threshold for any entity; (term, n_t) of all.

    ``found``: (spans, words) of every document, its base spans and the distinct words outside them.
    """
    terms = F.array_distinct(F.transform("words", F.lower))
    in_docs = written(found.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "document-counts")
    some = found.where(F.size("spans") > 0).select(F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"), terms.alias("terms"))
    n_docs = found.count()
    held = some.groupBy("entity").agg(F.count("*").alias("n_e"))
    # the entity's count goes along with the terms, as pairs are many and each join would move them again
    joint = some.join(held, "entity").select("entity", "n_e", F.explode("terms").alias("term"))
    joint = joint.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= least_docs)
    told = joint.select("n_e", "n_te", "term").join(in_docs, "term")
    bits = lambda x: F.log2(x.cast("double"))
    content = F.lit(float(n_docs)).cast("double")
    ic = bits(content) - bits(F.col("n_e"))
    pmi = bits(F.col("n_te")) + bits(content) - bits(F.col("n_e")) - bits(F.col("n_t"))
    share = F.when(ic > 0, pmi / ic).otherwise(0.0)
    # a term that one entity wants removed and another generalised is removed
    risky = told.where(share >= generalise).groupBy("term").agg(F.min(F.when(share >= remove, 4).otherwise(5)).alias("kind"))
    return written(risky, "risky"), in_docs


def sanitise_spans(docs: DataFrame, least_docs: int = 1, generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """(doc_id, row, spans): base spans and those of disclosing terms, one row for every row of ``docs``.

    ``spans``: array of (start, kind, end, value) by start, then kind; kinds 0 to 3 are the base, 4 terms to remove, 5 terms to
    generalise. A pair of entity and term counts if ``least_docs`` documents at least have both. A term that discloses any
    entity is listed wherever a document has it outside base spans. Null text counts as empty. Rows without doc_id and rows that
    repeat one are documents of their own text; other columns are ignored, and an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    spanned = rows.select("*", base_spans(F.col("text")).alias("spans"))
    clear = spanned.select("doc_id", "row", "spans", masked(F.col("text"), F.col("spans")).alias("clear"))
    found = written(clear.select("doc_id", "row", "spans", F.array_distinct(F.regexp_extract_all("clear", F.lit(WORD), F.lit(0))).alias("words")), "words")
    risky, in_docs = disclosures(found.select("spans", "words"), least_docs, generalise, remove)
    # harmless words of a 200th of the documents, no more than 200 times a document's words, need not be looked up
    harmless = in_docs.where(F.col("n_t") * 200 >= found.count()).join(risky, "term", "left_anti").select("term")
    words = found.select("doc_id", "row", F.explode("words").alias("word"))
    term = F.lower("word") == F.col("term")  # not a column of its own, as this is the largest shuffle
    hits = words.join(F.broadcast(harmless), term, "left_anti").join(risky, term).groupBy("doc_id", "row").agg(F.collect_set(F.struct("word", "kind")).alias("hits"))
    hits = written(hits, "hits")
    joined = rows.alias("a").join(hits.alias("h"), F.col("a.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("a.row") == F.col("h.row")), "left")
    spanned = joined.select("a.doc_id", "a.row", "text", "hits", base_spans(F.col("text")).alias("spans"))
    clear = spanned.select("doc_id", "row", "spans", "hits", masked(F.col("text"), F.col("spans")).alias("clear"))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform("hits", lambda h: h["word"]), "|"), F.lit(r")(?!\p{L})"))
    kinds = F.map_from_entries("hits")
    place = lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["value"]).alias("kind"), s["end"].alias("end"), F.lower(s["value"]).alias("value"))
    more = F.transform(_matches(F.col("clear"), pattern, 4, lambda v: F.lit(True)), place)
    return clear.select("doc_id", "row", F.when(F.col("hits").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", more))).alias("spans"))


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*BASE, *TERM_KINDS)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; see ``sanitise_spans``."""
    found = sanitise_spans(docs, **how)
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text): texts with base spans and removed terms as ``[KIND]`` and generalised terms as their first letter.

    Of overlapping spans the one that starts first, of equal starts the longest, is replaced.
    """
    found = sanitise_spans(docs, **how)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    joined = rows.alias("a").join(found.dropDuplicates(["doc_id", "row"]).alias("f"), F.col("a.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("a.row") == F.col("f.row")))
    text = F.col("text")
    names = F.array(*[F.lit(f"[{x.upper()}]") for x in (*BASE, "term")])

    def step(acc, s):
        put = F.when(s["kind"] == 5, F.concat(F.substring(s["value"], 1, 1), F.lit("*"))).otherwise(F.get(names, s["kind"]))
        done = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(done)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    by_place = F.transform(F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], (-s["end"]).alias("e"), s["kind"].alias("k"), s.alias("s")))), lambda x: x["s"])
    clean = F.aggregate(by_place, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select("a.doc_id", clean.alias("text"))
