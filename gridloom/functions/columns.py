"""Column expressions and Arrow functions over addresses, patterns and formulas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import formula

_TEXT, _INT, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


REF = _struct(kind=_TEXT, sheet=_TEXT, r0=_INT, c0=_INT, r1=_INT, c1=_INT, name=_TEXT)
COMPILED = _struct(r1c1=_TEXT, refs=T.ArrayType(REF), error_kind=_TEXT, error_msg=_TEXT)
_COMPILED = to_arrow_type(COMPILED)
_REF_NAMES = REF.names


def _once(columns: list[pa.Array], make, kind: pa.DataType) -> pa.Array:
    """``make`` of each row's values, called and turned to Arrow once per distinct row; null where the first value is null."""
    if columns[0].null_count == len(columns[0]):
        return pa.nulls(len(columns[0]), kind)
    codes, kinds = np.zeros(len(columns[0]), np.int64), 1
    for column in columns:
        found = column.dictionary_encode("encode")
        codes, kinds = codes * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False), kinds * len(found.dictionary)
        if kinds >= 1 << 31:
            distinct, codes = np.unique(codes, return_inverse=True)
            kinds = len(distinct)
    _, places, codes = np.unique(codes, return_index=True, return_inverse=True)
    rows = zip(*(column.take(pa.array(places)).to_pylist() for column in columns))
    return pa.array([None if row[0] is None else make(*row) for row in rows], kind).take(pa.array(codes))


def _compiled_row(text: str, sheet: str, row: int, col: int) -> dict:
    spelled, refs, kind, message = formula.compiled(text, sheet, row, col)
    return {"r1c1": spelled, "refs": [dict(zip(_REF_NAMES, x)) for x in refs], "error_kind": kind, "error_msg": message}


@F.arrow_udf(COMPILED)
def _compile(text: pa.Array, sheet: pa.Array, row: pa.Array, col: pa.Array) -> pa.Array:
    return _once([text, sheet, row, col], _compiled_row, _COMPILED)


def compile_formula(text, sheet, row, col) -> Column:
    """One parse per formula: R1C1 pattern, references, error. Null for a null text."""
    return _compile(text, sheet, row, col)


@F.arrow_udf(_REAL)
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return _once([a, b], lambda x, y: None if y is None else formula.ratio(x, y), pa.float64())


SHIFT = _struct(axis=_TEXT, end=_TEXT, expected=_INT, found=_INT)
_SHIFT = to_arrow_type(SHIFT)


@F.arrow_udf(SHIFT)
def boundary_shift(pattern: pa.Array, other: pa.Array) -> pa.Array:
    def shift(a: str, b: str | None) -> dict | None:
        found = formula.boundary_shift(a, b) if b is not None else None
        return found and dict(zip(SHIFT.names, found))

    return _once([pattern, other], shift, _SHIFT)


_DRIFT_NAMES = ("axis", "target", "expected_style", "expected", "found_style", "found")
DRIFT = T.ArrayType(_struct(**dict.fromkeys(_DRIFT_NAMES, _TEXT)))
_DRIFT = to_arrow_type(DRIFT)


@F.arrow_udf(DRIFT)
def anchoring_drift(pattern: pa.Array, other: pa.Array, row: pa.Array, col: pa.Array) -> pa.Array:
    def drift(a: str, b: str | None, r: int, c: int) -> list[dict] | None:
        found = formula.anchoring_drift(a, b, r, c) if b is not None else None
        return found and [dict(zip(_DRIFT_NAMES, x)) for x in found]

    return _once([pattern, other, row, col], drift, _DRIFT)


@F.arrow_udf(_TEXT)
def number_display(x: pa.Array) -> pa.Array:
    """Thousands separators and Python's shortest digits, for numbers that aren't whole."""
    return pa.array([None if v is None else f"{v:,}" for v in x.to_pylist()], pa.string())


def letters(n: Column) -> Column:
    """Column letters of a 1-based index up to 18,278 (three letters)."""
    one = lambda k: F.char((k % 26 + 65).cast("int"))
    a, b = n - 1, F.floor((n - 1) / 26) - 1
    c = F.floor((n - 703) / 676)
    return (
        F.when(n <= 26, one(a))
        .when(n <= 702, F.concat(one(b), one(a)))
        .otherwise(F.concat(F.char((c % 26 + 65).cast("int")), one(b), one(a)))
    )


def index_of(text: Column) -> Column:
    """1-based index of column letters."""
    digits = F.transform(F.split(F.upper(text), ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(digits, F.lit(0), lambda acc, d: acc * 26 + d)


def address(row: Column, col: Column) -> Column:
    return F.concat(letters(col), row.cast("string"))


def qualified(sheet: Column, row: Column, col: Column) -> Column:
    return F.concat(sheet, F.lit("!"), address(row, col))


_AZ, _09 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def address_parts(text: Column) -> Column:
    """``$B$4`` -> struct(col_abs, col, row_abs, row); null if that doesn't spell the text."""
    text = F.upper(text)
    col_abs, row_abs = F.startswith(text, F.lit("$")), F.locate("$", text, 2) > 0
    col, row = F.translate(text, "$" + _09, ""), F.translate(text, "$" + _AZ, "")
    sign = lambda there: F.when(there, F.lit("$")).otherwise(F.lit(""))
    sound = F.char_length(col).between(1, 3) & (row != "") & (F.concat(sign(col_abs), col, sign(row_abs), row) == text) & (F.translate(col, _AZ, "") == "") & (F.translate(row, _09, "") == "")
    return F.when(sound, F.struct(col_abs.alias("col_abs"), col.alias("col"), row_abs.alias("row_abs"), row.try_cast("int").alias("row")))


def display(cell) -> Column:
    """A literal value as text; ``cell`` maps a column name to a column."""
    number = F.when(cell("value_num") == F.floor(cell("value_num")), F.format_number(cell("value_num"), 0)).otherwise(number_display(cell("value_num")))
    return (
        F.when(cell("value_type") == "bool", F.upper(cell("value_bool").cast("string")))
        .when(cell("value_type") == "num", number)
        .when(cell("value_type") == "str", F.concat(F.lit('"'), cell("value_str"), F.lit('"')))
        .when(cell("value_type") == "ts", F.date_format(cell("value_ts"), "yyyy-MM-dd HH:mm:ss"))
    )


@F.arrow_udf(_TEXT)
def base_shape(pattern: pa.Array) -> pa.Array:
    """The shape a pattern suggests, "unrecognized" for none."""
    return _once([pattern], formula.base_shape, pa.string())
