"""Reduction operations: builtin ones map to Spark aggregates, custom ones are folds in rank order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce as _fold

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
_FLOATING = (T.FloatType, T.DoubleType)
_LOGICAL = (T.BooleanType,)
_LIMITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


@dataclass(frozen=True)
class Op:
    """agg: the aggregate of a column; fold: the operation on two values; commutative: whether rank order is free."""

    name: str
    agg: Callable[[Column, T.DataType], Column] | None
    fold: Callable[[Column, Column], Column]
    types: tuple[type, ...] = ()
    identity: Callable[[T.DataType], object] | None = None
    commutative: bool = True
    post: Callable[[Column, T.DataType], Column] = lambda c, kind: c.cast(kind)  # from the aggregate's type to the elements'

    def check(self, kind: T.DataType) -> None:
        if self.types and not isinstance(kind, self.types):
            raise TypeError(f"{self.name} is not defined for {kind.simpleString()}")

    def identity_of(self, kind: T.DataType) -> Column:
        """The value that changes nothing; null where the operation has none."""
        if self.identity is None:
            return F.lit(None).cast(kind)
        return F.lit(self.identity(kind)).cast(kind)


def _bound(sign: int) -> Callable[[T.DataType], object]:
    def of(kind: T.DataType) -> object:
        if isinstance(kind, _FLOATING):
            return sign * float("inf")
        if isinstance(kind, T.DecimalType):
            return sign * (10**kind.precision - 1)
        half = 1 << (_LIMITS[kind.simpleString()] - 1)
        return half - 1 if sign > 0 else -half

    return of


def _true(c: Column, kind: T.DataType) -> Column:
    return c if isinstance(kind, T.BooleanType) else c != 0


def _exact_product(c: Column, kind: T.DataType) -> Column:
    """Spark's product is a double; whole numbers are multiplied one by one, so an overflow is an error."""
    if isinstance(kind, _FLOATING):
        return F.product(c)
    return F.aggregate(F.collect_list(c), F.lit(1).cast(kind), lambda a, x: (a * x).cast(kind))


_int = lambda c: c.cast("int")
MAX = Op("max", lambda c, k: F.max(c), F.greatest, _INTEGER + _FLOATING, _bound(-1))
MIN = Op("min", lambda c, k: F.min(c), F.least, _INTEGER + _FLOATING, _bound(1))
PLUS = Op("plus", lambda c, k: F.sum(c), lambda a, b: a + b, _INTEGER + _FLOATING, lambda k: 0)
MULTIPLIES = Op("multiplies", _exact_product, lambda a, b: a * b, _INTEGER + _FLOATING, lambda k: 1)
LOGICAL_AND = Op("logical_and", lambda c, k: F.bool_and(_true(c, k)), lambda a, b: a & b, _INTEGER + _LOGICAL, lambda k: True)
LOGICAL_OR = Op("logical_or", lambda c, k: F.bool_or(_true(c, k)), lambda a, b: a | b, _INTEGER + _LOGICAL, lambda k: False)
LOGICAL_XOR = Op("logical_xor", lambda c, k: F.bit_xor(_int(_true(c, k))), lambda a, b: a != b, _INTEGER + _LOGICAL, lambda k: False, post=lambda c, k: (c == 1).cast(k))
BIT_AND = Op("bit_and", lambda c, k: F.bit_and(c), lambda a, b: a.bitwiseAND(b), _INTEGER[:4], lambda k: -1)
BIT_OR = Op("bit_or", lambda c, k: F.bit_or(c), lambda a, b: a.bitwiseOR(b), _INTEGER[:4], lambda k: 0)
BIT_XOR = Op("bit_xor", lambda c, k: F.bit_xor(c), lambda a, b: a.bitwiseXOR(b), _INTEGER[:4], lambda k: 0)
BUILTIN = {op.name: op for op in (MAX, MIN, PLUS, MULTIPLIES, LOGICAL_AND, LOGICAL_OR, LOGICAL_XOR, BIT_AND, BIT_OR, BIT_XOR)}
ALIASES = {"sum": "plus", "product": "multiplies", "land": "logical_and", "lor": "logical_or", "lxor": "logical_xor", "band": "bit_and", "bor": "bit_or", "bxor": "bit_xor"}
#: Complex numbers are struct<re, im>.
COMPLEX_PLUS = Op("complex_plus", lambda c, k: F.struct(F.sum(c["re"]).alias("re"), F.sum(c["im"]).alias("im")), lambda a, b: F.struct((a["re"] + b["re"]).alias("re"), (a["im"] + b["im"]).alias("im")), (T.StructType,))
COMPLEX_MULTIPLIES = Op("complex_multiplies", None, lambda a, b: F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im")), (T.StructType,))


def op(what: str | Op | Callable, commutative: bool | None = None) -> Op:
    """An operation from a builtin's name, or from a function of two Columns, which must be tagged as commutative or not."""
    if isinstance(what, Op):
        return what
    if isinstance(what, str):
        if commutative is not None:
            raise TypeError("a builtin operation takes no commutativity tag")
        name = ALIASES.get(what, what)
        if name not in BUILTIN:
            raise TypeError(f"unknown operation {what!r}")
        return BUILTIN[name]
    if commutative is None:
        raise TypeError("a custom operation must be tagged commutative=True or False")
    return Op(getattr(what, "__name__", "custom"), None, what, commutative=commutative)


def reduced(of: Op, kind: T.DataType, value: str = "value", order: str = "rank") -> Column:
    """The aggregate of a group: native if there is one, else a fold from the smallest rank up."""
    of.check(kind)
    if of.agg:
        return of.post(of.agg(F.col(value), kind), kind)
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda x: x[value])
    return F.aggregate(F.slice(rows, 2, F.size(rows)), F.element_at(rows, 1), lambda a, x: of.fold(a, x).cast(kind))


def python_reduce(fn: Callable, kind: str):
    """A grouped aggregate for a Python function of two values; its input must be sorted by rank within a list."""

    def fold(rows: list) -> object:
        return _fold(fn, rows) if len(rows) else None

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fold)

    return run
