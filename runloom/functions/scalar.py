"""Elementwise operators as Column expressions, for the dtypes i (32-bit), f (binary32), b and c (8-bit).

Integers are worked out in 64 bits and wrapped to 32; floats follow IEEE where Spark's ANSI mode would raise or compare NaN
as equal. Integer division and remainder by zero raise. Zero is "missing" for ``coalesce``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.errors import UnimplementedOperation

SQL_TYPES = {"i": "int", "f": "float", "b": "boolean", "c": "tinyint"}
NAN, INF = float("nan"), float("inf")


def wrap32(x: Column) -> Column:
    """The low 32 bits of a 64-bit integer, as a signed one."""
    return (x.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.lit(0x80000000)) - F.lit(0x80000000)).cast("int")


def _long(x: Column) -> Column:
    return x.cast("bigint")


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN instead of an error; the sign of a zero divisor counts."""
    a, b = a.cast("double"), b.cast("double")
    negative = (a < 0) != (b.cast("string") == "-0.0")
    by_zero = F.when((a == 0) | F.isnan(a), NAN).when(negative, -INF).otherwise(INF)
    return F.when(b == 0, by_zero).otherwise(a / b).cast("float")


def _number(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column, str], Column]:
    return lambda a, b, t: wrap32(op(_long(a), _long(b))) if t in "ic" else op(a, b).cast("float")


def _truncated(x: Column, t: str) -> Column:
    return x.cast("float") if t == "f" else wrap32(x.cast("bigint"))


def _floordiv(a: Column, b: Column, t: str) -> Column:
    return ieee_divide(a, b) if t == "f" else wrap32(F.call_function("div", _long(a), _long(b)))


def _mod(a: Column, b: Column, t: str) -> Column:
    if t == "f":
        return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), NAN).otherwise(a % F.when(b == 0, 1.0).otherwise(b)).cast("float")
    return wrap32(_long(a) % _long(b))


def _logic(bits: Callable[[Column, Column], Column], bools: Callable[[Column, Column], Column] | None) -> Callable[[Column, Column, str], Column]:
    def run(a: Column, b: Column, t: str) -> Column:
        if t == "b" and bools:
            return bools(a, b)
        if t in "ic":
            return bits(a, b)
        raise UnimplementedOperation(f"no bitwise operator on {t}")

    return run


def _equal(a: Column, b: Column, t: str) -> Column:
    return (a == b) & ~F.isnan(a) if t == "f" else a == b


def _ordered(op: Callable[[Column, Column], Column]) -> Callable[[Column, Column, str], Column]:
    return lambda a, b, t: op(a, b) & ~F.isnan(a) & ~F.isnan(b) if t == "f" else op(a, b)


def nonzero(a: Column, t: str) -> Column:
    return a if t == "b" else a != 0


#: name: (expression of two operands of dtype t, dtype of the result or None for t)
BINARY: dict[str, tuple[Callable[[Column, Column, str], Column], str | None]] = {
    "add": (_number(lambda a, b: a + b), None),
    "sub": (_number(lambda a, b: a - b), None),
    "mul": (_number(lambda a, b: a * b), None),
    "floordiv": (_floordiv, None),
    "truediv": (lambda a, b, t: ieee_divide(a, b), "f"),
    "mod": (_mod, None),
    "pow": (lambda a, b, t: _truncated(F.pow(a.cast("double"), b.cast("double")), t), None),
    "and": (_logic(lambda a, b: a.bitwiseAND(b), lambda a, b: a & b), None),
    "or": (_logic(lambda a, b: a.bitwiseOR(b), lambda a, b: a | b), None),
    "xor": (_logic(lambda a, b: a.bitwiseXOR(b), None), None),
    "shl": (_logic(lambda a, b: F.call_function("shiftleft", a, b), None), None),
    "shr": (_logic(lambda a, b: F.call_function("shiftright", a, b), None), None),
    "eq": (_equal, "b"),
    "ne": (lambda a, b, t: ~_equal(a, b, t), "b"),
    "lt": (_ordered(lambda a, b: a < b), "b"),
    "le": (_ordered(lambda a, b: a <= b), "b"),
    "gt": (_ordered(lambda a, b: a > b), "b"),
    "ge": (_ordered(lambda a, b: a >= b), "b"),
    "min": (lambda a, b, t: F.least(a, b), None),
    "max": (lambda a, b, t: F.greatest(a, b), None),
    "coalesce": (lambda a, b, t: F.when(nonzero(a, t), a).otherwise(b), None),
}

UNARY: dict[str, tuple[Callable[[Column, str], Column], str | None]] = {
    "pos": (lambda a, t: a, None),
    "neg": (lambda a, t: wrap32(-_long(a)) if t in "ic" else (-a).cast("float"), None),
    "invert": (lambda a, t: ~a if t == "b" else F.bitwise_not(a), None),
    "abs": (lambda a, t: wrap32(F.abs(_long(a))) if t in "ic" else F.abs(a), None),
    "sqrt": (lambda a, t: _truncated(F.sqrt(a.cast("double")), t), None),
    "exp": (lambda a, t: _truncated(F.exp(a.cast("double")), t), None),
    "not": (lambda a, t: ~nonzero(a, t), "b"),
}


def cast(a: Column, t: str, to: str) -> Column:
    """Truncating casts; a boolean is whether the value isn't zero."""
    if t == to:
        return a
    if to == "b":
        return nonzero(a, t)
    if to == "c":
        return (wrap32(a.cast("bigint")).bitwiseAND(F.lit(0xFF)).bitwiseXOR(F.lit(0x80)) - F.lit(0x80)).cast("tinyint")
    return a.cast(SQL_TYPES[to])


def pack_rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Four bytes in one 32-bit number, r lowest."""
    return _long(r).bitwiseOR(F.shiftleft(_long(g), 8)).bitwiseOR(F.shiftleft(_long(b), 16)).bitwiseOR(F.shiftleft(_long(a), 24))


def unpack_rgba(x: Column) -> list[Column]:
    return [F.shiftright(x, k).bitwiseAND(F.lit(0xFF)).cast("int") for k in (0, 8, 16, 24)]
