"""The record filter language: comparisons joined by ``&&`` and ``||``, with parentheses; ``&&`` binds tighter."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the variables of the language
VARIABLES = ("zm", "ln", "rq", "bc1", "bc2", "bq", "np", "qs", "qe")
DEFAULT = "ln>=500 && rq>=750"
_TOKEN = re.compile(r"\s*(?:(&&|\|\||[()]|<=|>=|==|!=|<|>)|(\d+)|([A-Za-z][A-Za-z0-9_]*))")
_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}


class FilterError(ValueError):
    pass


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected text at {at}: {text[at:]!r}")
        out.append(m.group().strip())
        at = m.end()
    return out


def parse(text: str, variables: tuple[str, ...] = VARIABLES):
    """Nested tuples: ('or' | 'and', left, right) or (op, variable, number). All of the text must be an expression."""
    tokens = _tokens(text)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else None

    def either():
        left = both()
        while peek() == "||":
            take()
            left = ("or", left, both())
        return left

    def both():
        left = one()
        while peek() == "&&":
            take()
            left = ("and", left, one())
        return left

    def one():
        token = take()
        if token == "(":
            inner = either()
            if take() != ")":
                raise FilterError("a parenthesis is not closed")
            return inner
        if token not in variables:
            raise FilterError(f"unknown variable {token!r}")
        op, number = take(), take()
        if op not in _OPS or number is None or not number.isdigit():
            raise FilterError(f"no comparison with a number after {token!r}")
        return (op, token, int(number))

    tree = either()
    if at != len(tokens):
        raise FilterError(f"text after the expression: {' '.join(tokens[at:])!r}")
    return tree


def variables_of(tree) -> set[str]:
    return variables_of(tree[1]) | variables_of(tree[2]) if tree[0] in ("or", "and") else {tree[1]}


def compile_filter(text: str, columns: dict[str, Column], variables: tuple[str, ...] = VARIABLES) -> Column:
    """A predicate that Catalyst can push down. Every variable used must be in ``columns``."""
    tree = parse(text, variables)
    if missing := variables_of(tree) - set(columns):
        raise FilterError(f"the records do not define {', '.join(sorted(missing))}")

    def build(node):
        if node[0] == "or":
            return build(node[1]) | build(node[2])
        if node[0] == "and":
            return build(node[1]) & build(node[2])
        return _OPS[node[0]](columns[node[1]], F.lit(node[2]))

    return build(tree)


def filter_records(records: DataFrame, text: str = DEFAULT) -> DataFrame:
    """Subread records that pass; ``rq`` is compared as int(1000 rq), ``bc1``/``bc2`` are the two barcodes."""
    columns = {v: F.col(v) for v in VARIABLES if v in records.columns}
    if "rq" in columns:
        columns["rq"] = F.floor(F.col("rq") * 1000).cast("int")
    if "bc" in records.columns:
        columns |= {"bc1": F.col("bc")[0], "bc2": F.col("bc")[1]}
    return records.where(compile_filter(text, columns))


def primary_alignments(records: DataFrame) -> DataFrame:
    """Without secondary and supplementary records (flag bits 0x900)."""
    return records.where(F.col("flag").bitwiseAND(0x900) == 0)
