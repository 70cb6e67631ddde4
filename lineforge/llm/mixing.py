"""Mixing sources to target weights by temperature.

Source token shares p are raised to an exponent and normalised; the exponent is bisected to meet a target entropy and a limit
on repetition. Each source's weight becomes a token budget, realised epoch by epoch as permutations of the source's blocks:
whole epochs first, then blocks of the next permutation until the budget is reached. The number of blocks grows with the root
of the largest source's tokens, so that a budget is overshot by ever less and the permutations stay small.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, renamed, written

LEVELS = 5  # of the bisection in one pass over the source totals


@dataclass(frozen=True)
class Mix:
    """Wanted mix: the least flat exponent that reaches ``entropy`` (as a fraction of that of equal weights), made less flat
    until no source is repeated more than ``repeats`` times. The budget is ``tokens`` if given; else ``epochs`` of the whole
    corpus; else, with ``whole``, as many tokens as give every source at least one epoch."""

    entropy: float = 0.95
    repeats: float = 4.0
    tokens: int | None = None
    epochs: float = 1.0
    whole: bool = False
    blocks: int = 64  # of a source, while the largest has up to 2**26 tokens
    seed: int = 42


def token_count(text: Column) -> Column:
    """Words between blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _hash(*cols: Column) -> Column:
    """A non-negative 60-bit number that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]).cast("binary")), 1, 15), 16, 10).cast("long")


def _measures(sources: DataFrame, mix: Mix, alphas: list[float]) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy, most repetitions), one aggregation over the source totals for all exponents."""
    total, n = sources.select(F.sum("tokens").cast("double"), F.count("*")).first()
    p = F.col("tokens") / F.lit(total)
    a = F.col("a")
    rows = (
        sources.select(p.alias("p"), F.explode(F.array(*[F.lit(float(x)) for x in alphas])).alias("a"))
        .groupBy("a")
        .agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.log("p")).alias("l"), F.max(F.pow("p", a - 1)).alias("up"), F.max(F.pow("p", 1 - a)).alias("down"))
        .collect()
    )
    out = {}
    for r in rows:
        weight_up, weight_down = r.up / r.z, r.down * r.z  # largest w / p, largest p / w
        scale = mix.tokens / total if mix.tokens else (max(weight_down, mix.epochs) if mix.whole else mix.epochs)
        out[r.a] = (math.log(r.z) - r.a * r.l / r.z, weight_up * scale)
    return out


def solve_exponent(sources: DataFrame, mix: Mix, passes: int = 8) -> float:
    """Bisect the exponent in [0, 1]: the largest that reaches the entropy, raised where repetition forbids it.

    ``sources``: (source, tokens > 0). Entropy falls and repetition falls with a growing exponent. Five halvings are settled in
    a pass, from the measures of their 31 possible midpoints; the driver sees these alone, whatever the number of sources.
    """
    n = sources.count()
    if n < 2:
        return 1.0
    target = mix.entropy * math.log(n)

    def bisect(good) -> float:
        """The exponent from which on ``good`` holds."""
        lo, hi = 0.0, 1.0
        for _ in range(passes):
            parts = 1 << LEVELS
            grid = [lo + (hi - lo) * k / parts for k in range(1, parts)]
            seen = _measures(sources, mix, grid)
            for _ in range(LEVELS):
                mid = (lo + hi) / 2
                near = min(seen, key=lambda x: abs(x - mid))
                lo, hi = (lo, mid) if good(seen[near]) else (mid, hi)
        return (lo + hi) / 2

    for_entropy = bisect(lambda m: m[0] < target)
    for_repeats = bisect(lambda m: m[1] <= mix.repeats)
    return min(1.0, max(for_entropy, for_repeats))


def source_budgets(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, tokens, weight, budget): normalised weights and their whole number of tokens."""
    positive = sources.where("tokens > 0")
    alpha = round(solve_exponent(positive, mix), 9)
    total = positive.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    w = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(alpha))
    norm = positive.agg(F.sum(w)).first()[0]
    most = positive.agg(F.max(F.col("tokens") / F.lit(float(total)) / (w / F.lit(norm)))).first()[0]
    amount = mix.tokens if mix.tokens else total * (max(most, mix.epochs) if mix.whole else mix.epochs)
    weight = F.when(F.col("tokens") > 0, w / F.lit(norm)).otherwise(0.0)
    exact = weight * F.lit(float(amount))
    budget = F.floor(exact + F.lit(0.5)).cast("long")
    if mix.whole and not mix.tokens:  # not short of a token by rounding
        budget = F.greatest(budget, F.col("tokens"))
    return sources.select("source", "tokens", weight.alias("weight"), budget.alias("budget"))


def block_number(sizes: DataFrame, mix: Mix) -> int:
    """Blocks of every source: ``mix.blocks``, doubled whenever the largest source's tokens are four times as many."""
    most = sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] or 1
    return mix.blocks << max(0, math.ceil(math.log2(most / (1 << 26)) / 2))


def block_plan(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, int]:
    """(source, block, epochs): in how many epochs every block is, and the number of blocks.

    ``sizes``: (source, h, n_tokens) of every row; a row's block is ``h`` modulo the number of blocks.
    """
    n_blocks = block_number(sizes, mix)
    blocks = written(sizes.groupBy("source", (F.col("h") % n_blocks).alias("block")).agg(F.sum("n_tokens").alias("n")), "blocks")
    budgets = written(source_budgets(blocks.groupBy("source").agg(F.sum("n").alias("tokens")), mix), "budgets")
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    joined = blocks.join(budgets, blocks["source"].eqNullSafe(budgets["source"])).select(blocks["source"], "block", "n", "tokens", "budget", whole.alias("whole"))
    ordered = joined.withColumn("r", _hash(F.lit(mix.seed), F.col("source"), F.col("whole"), F.col("block")))
    before = "coalesce(sum(n) over (partition by source order by r, block rows between unbounded preceding and 1 preceding), 0)"
    plan = ordered.selectExpr("source", "block", f"whole + if({before} < budget - whole * tokens, 1, 0) as epochs")
    return written(plan, "block-plan"), n_blocks


def stream_columns(columns: list[str]) -> list[str]:
    """Names for epoch, block and order that none of ``columns`` has: with as many leading underscores as it takes."""
    taken, out = {c.lower() for c in columns}, []
    for name in ("_epoch", "_block", "_order"):
        while name in taken:
            name = "_" + name
        out.append(name)
    return out


def _dealt(docs: DataFrame, mix: Mix) -> DataFrame:
    """``numbered`` columns with source, n_tokens, epoch, block and order: a row for every epoch its block is in."""
    at = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    rows = numbered(docs).select("*", at["source"].cast("string").alias("own"), _hash(F.lit(mix.seed), at["doc_id"].cast("long")).alias("h"))
    sizes = written(rows.select(F.col("own").alias("source"), "h", token_count(at["text"].cast("string")).alias("n_tokens")), "sizes")
    plan, n_blocks = block_plan(sizes, mix)
    tagged = rows.withColumn("place", F.col("h") % n_blocks)
    dealt = tagged.join(plan, F.col("own").eqNullSafe(F.col("source")) & (F.col("place") == F.col("block")))
    out = dealt.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    return out.withColumn("order", _hash(F.lit(mix.seed), F.col("own"), F.col("epoch"), F.col("block"))).withColumn("block", F.col("block").cast("int"))


def mix_rows(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with _epoch (0, 1, ...), _block and _order: each row once for every epoch its block is in.

    Rows in the order (_epoch, _order, _block) within a source are that source's training stream. Null sources form one source
    of their own; sources without any word are kept for one epoch. A source's last block may exceed its budget by less than a
    block. Rows that repeat count as so many rows; rows without doc_id share a block of their source. An empty table gives an
    empty result. Where ``docs`` has such a column itself, see ``stream_columns`` for the name. Long texts aren't moved.
    """
    out = _dealt(docs, mix)
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*own, *[F.col(c).alias(name) for c, name in zip(("epoch", "block", "order"), stream_columns(docs.columns), strict=True)])


def mix_stream(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``mix_rows`` in the order of the stream, with the columns of ``docs`` alone.

    Epochs follow one another, and within one the permuted blocks of all sources are interleaved; written out, the order is
    that of the files. Rows of a block are ordered by a hash of their place, so that a large block spans several partitions.
    """
    order = [F.col("epoch"), F.col("order"), F.col("block"), F.xxhash64("h", "own", f"c{docs.columns.index('text')}")]
    return renamed(_dealt(docs, mix).repartitionByRange(*order).sortWithinPartitions(*order), docs.columns)


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, block_order): the stream that realises the mix, without texts."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return _dealt(docs, mix).select(F.col("c0").alias("doc_id"), F.col("c1").alias("source"), token_count(F.col("c2")).alias("n_tokens"), "epoch", "block", F.col("order").alias("block_order"))
