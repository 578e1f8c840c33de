"""Variant documents: session settings, strict JSON in and out, kinds, typed readers and exact comparisons as Columns.

Everything is a Catalyst expression unless the name says `_udf`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONF = {
    "spark.sql.variant.allowDuplicateKeys": "true",  # the last of equal names wins
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets the session options that the engine's semantics rest on."""
    for k, v in CONF.items():
        spark.conf.set(k, v)
    return spark


def session(name: str = "looseleaf", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()


#: A text whose first value ends before the text does: Spark's parser would pass over the rest.
def strict_json(text: Column, reject_duplicates: bool = False) -> Column:
    """The document in a JSON text, or null where the text isn't exactly one JSON value.

    Text after the value, empty text, a leading byte order mark and lone surrogates are refused, besides what the parser refuses itself.
    """
    from .json_udf import is_strict_json

    ok = is_strict_json(text, F.lit(reject_duplicates))
    return F.when(ok, F.try_parse_json(text))


def fast_json(text: Column) -> Column:
    """The document in a JSON text that is known to hold one value; null where it can't be parsed. Stays in the JVM."""
    return F.try_parse_json(text)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """`rows` with `value` as the column `name`, worked out once a row.

    A filter is moved below a projection and then works its columns out again for each mention of them; it can't pass an explode.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once, inside other lambdas as well, where nothing else keeps it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def child(v: Column, spark_path: str) -> Column:
    return F.try_variant_get(v, spark_path, "variant")


def type_text(v: Column) -> Column:
    """`schema_of_variant` of a scalar, ARRAY or OBJECT for the others (whose schema would take a walk through all of them), null for an absent value."""
    return F.when(is_array(v), "ARRAY").when(is_object(v), "OBJECT").when(v.isNotNull(), F.schema_of_variant(v))


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def kind(v: Column) -> Column:
    """NULL BOOLEAN INTEGER DECIMAL DOUBLE FLOAT STRING BINARY DATE TIMESTAMP UUID ARRAY OBJECT; null for an absent value.

    Decimals without a fraction and doubles that are whole numbers in the 64-bit range count as INTEGER, as the
    document model's number rule has it, however the parser stored them.
    """
    t = type_text(v)
    whole_decimal = t.rlike(r"^DECIMAL\([0-9]+,0\)$") & F.try_variant_get(v, "$", "bigint").isNotNull()
    d = F.try_variant_get(v, "$", "double")
    whole_double = (t == "DOUBLE") & (d == F.floor(d)) & (F.abs(d) < 9.2e18)
    return (
        F.when(t == "VOID", "NULL").when(t == "BIGINT", "INTEGER").when(whole_decimal | whole_double, "INTEGER")
        .when(t.startswith("DECIMAL"), "DECIMAL").when(t.startswith("TIMESTAMP"), "TIMESTAMP")
        .when(t.startswith("ARRAY"), "ARRAY").when(t.startswith("OBJECT"), "OBJECT").otherwise(t)
    )


def is_scalar(v: Column) -> Column:
    return v.isNotNull() & ~is_array(v) & ~is_object(v)


def is_json_null(v: Column) -> Column:
    return F.coalesce(F.is_variant_null(v), F.lit(False))


# --- typed readers: no coercion, null for another kind ---------------------------------------------------------------

def string_value(v: Column) -> Column:
    return F.when(type_text(v) == "STRING", F.try_variant_get(v, "$", "string"))


def boolean_value(v: Column) -> Column:
    return F.when(type_text(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def long_value(v: Column) -> Column:
    return F.when(kind(v) == "INTEGER", F.try_variant_get(v, "$", "bigint"))


def double_value(v: Column) -> Column:
    return F.when(type_text(v).isin("DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double"))


def decimal_value(v: Column, precision: int = 38, scale: int = 18) -> Column:
    t = type_text(v)
    return F.when((t == "BIGINT") | t.startswith("DECIMAL"), F.try_variant_get(v, "$", f"decimal({precision},{scale})"))


def binary_value(v: Column) -> Column:
    return F.when(type_text(v) == "BINARY", F.try_variant_get(v, "$", "binary"))


def date_value(v: Column) -> Column:
    return F.when(type_text(v) == "DATE", F.try_variant_get(v, "$", "date"))


def timestamp_value(v: Column) -> Column:
    return F.when(type_text(v).startswith("TIMESTAMP"), F.try_variant_get(v, "$", "timestamp"))


def fields(v: Column) -> Column:
    """Fields of an object as an array of (name, value) in name order; null for other kinds."""
    m = F.try_variant_get(v, "$", "map<string,variant>")
    return F.when(m.isNotNull(), F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("name"), F.element_at(m, k).alias("value"))))


def elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def child_count(v: Column) -> Column:
    """Number of fields or elements; 0 for a scalar; null for an absent value."""
    a, m = elements(v), F.try_variant_get(v, "$", "map<string,variant>")
    return F.when(v.isNotNull(), F.when(a.isNotNull(), F.size(a)).when(m.isNotNull(), F.size(m)).otherwise(0))


def json_text(v: Column) -> Column:
    """JSON text of a value; temporal values as ISO-8601 strings, binary as base64; an error for NaN and infinities."""
    t = type_text(v)
    bad = t.isin("DOUBLE", "FLOAT") & (F.isnan(F.try_variant_get(v, "$", "double")) | (F.abs(F.try_variant_get(v, "$", "double")) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("JSON has no spelling for a number that isn't finite")).cast("string")).otherwise(F.to_json(v))


# --- exact comparisons -----------------------------------------------------------------------------------------------

_OPS = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def number(x: int | float | Decimal) -> Decimal:
    """A numeric literal as an exact decimal without trailing zeros; doubles by their shortest spelling."""
    if isinstance(x, bool) or not isinstance(x, (int, float, Decimal)):
        raise ValueError(f"not a number: {x!r}")
    d = Decimal(repr(x)) if isinstance(x, float) else Decimal(x)
    if not d.is_finite():
        raise ValueError("a numeric literal must be finite")
    return plain(d)


def plain(d: Decimal) -> Decimal:
    """Without trailing zeros, and never in exponent form."""
    if not d:
        return Decimal(0)
    sign, digits, exponent = d.as_tuple()
    while digits and digits[-1] == 0:
        digits, exponent = digits[:-1], exponent + 1
    if exponent > 0:
        digits, exponent = digits + (0,) * exponent, 0
    return Decimal((sign, digits, exponent))


def compare_number(v: Column, op: str, literal: int | float | Decimal) -> Column:
    """Exact comparison of a numeric value of any width with a literal; false for other kinds and for NaN and infinities.

    Integers compare as integers, decimals by their digits, doubles by the decimal that their shortest spelling names.
    """
    lit = number(literal)
    t = type_text(v)
    whole = _integers(F.try_variant_get(v, "$", "bigint"), op, lit)
    exact = _decimals(F.try_variant_get(v, "$", "string"), op, lit)
    d = F.try_variant_get(v, "$", "double")
    finite = ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.coalesce(
        F.when(t == "BIGINT", whole).when(t.startswith("DECIMAL"), exact).when(t.isin("DOUBLE", "FLOAT"), finite & _doubles(d, op, lit)).otherwise(False), F.lit(False)
    )


def _integers(x: Column, op: str, lit: Decimal) -> Column:
    floor = int(lit.to_integral_value("ROUND_FLOOR"))
    if lit != floor:
        if op == "=":
            return F.lit(False)
        op, lit_int = ("<=", floor) if op in ("<", "<=") else (">", floor)
    else:
        lit_int = floor
    if lit_int > 2**63 - 1 or lit_int < -(2**63):
        return x.isNotNull() & F.lit((op in ("<", "<=")) == (lit_int > 0) and op != "=")
    return _OPS[op](x, F.lit(lit_int).cast("bigint"))


def _doubles(x: Column, op: str, lit: Decimal) -> Column:
    f = float(lit)
    if f in (float("inf"), float("-inf")):
        return F.lit((op in ("<", "<=")) == (f > 0) and op != "=")
    near = number(f)
    if near != lit:  # no double is spelled like the literal: move to its neighbour on the right side
        if op == "=":
            return F.lit(False)
        op = {True: {"<": "<=", "<=": "<=", ">": ">", ">=": ">"}, False: {"<": "<", "<=": "<", ">": ">=", ">=": ">="}}[near < lit][op]
    return _OPS[op](x, F.lit(f))


_WIDTH = 40


def _decimals(text: Column, op: str, lit: Decimal) -> Column:
    """Comparison of decimals by their plain spelling, padded so that text order is number order."""
    negative = text.startswith("-")
    digits = F.regexp_replace(text, "^-", "")
    key = F.concat(F.lpad(F.split_part(digits, F.lit("."), F.lit(1)), _WIDTH, "0"), F.rpad(F.split_part(digits, F.lit("."), F.lit(2)), _WIDTH, "0"))
    spelled = f"{lit.copy_abs():f}"
    a, _, b = spelled.partition(".")
    if len(a) > _WIDTH or len(b) > _WIDTH:
        raise ValueError("a numeric literal of more than 40 digits on one side of the point")
    other = F.lit(a.zfill(_WIDTH) + b.ljust(_WIDTH, "0"))
    flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}[op]
    below = op in ("<", "<=")
    if lit < 0:
        return F.when(negative, _OPS[flipped](key, other)).otherwise(F.lit(op in (">", ">=")))
    return F.when(negative, F.lit(below)).otherwise(_OPS[op](key, other)) if lit else F.when(negative, F.lit(below)).otherwise(_OPS[op](key, other))


def compare_text(v: Column, op: str, literal: str) -> Column:
    """Comparison of a string value with a literal in unsigned UTF-8 byte order; false for other kinds."""
    return F.coalesce((type_text(v) == "STRING") & _OPS[op](F.try_variant_get(v, "$", "string"), F.lit(literal)), F.lit(False))


def compare_boolean(v: Column, literal: bool) -> Column:
    return F.coalesce((type_text(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(literal)), F.lit(False))


def signature(v: Column) -> Column:
    """Identity of a scalar as (tag, text): equal numbers of any width are equal; null for JSON null, containers and absence.

    Tags: 0 boolean, 1 number, 2 text, 3 binary, 4 temporal, 5 UUID.
    """
    return let(v, lambda x: let(type_text(x), lambda t: _signature(x, t)))


def _signature(v: Column, t: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    trimmed = F.when(text.contains("."), F.regexp_replace(text, r"\.?0*$", "")).otherwise(text)
    d = F.try_variant_get(v, "$", "double")
    exact = F.try_variant_get(v, "$", "decimal(38,18)")
    of_double = F.when((d == F.floor(d)) & (F.abs(d) < 9.2e18), d.cast("bigint").cast("string")).when(
        exact.isNotNull() & (exact.cast("double") == d) & (F.abs(d) >= 1e-6), F.regexp_replace(d.cast("decimal(38,18)").cast("string"), r"\.?0*$", "")
    ).otherwise(d.cast("string"))
    number_ = F.when(t.isin("DOUBLE", "FLOAT"), of_double).otherwise(trimmed)
    tag = (
        F.when(t == "BOOLEAN", 0).when((t == "BIGINT") | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), 1).when(t == "STRING", 2)
        .when(t == "BINARY", 3).when(t.isin("DATE") | t.startswith("TIMESTAMP"), 4).when(t == "UUID", 5)
    )
    body = F.when(tag == 1, F.when(number_ == "-0", "0").otherwise(number_)).when(tag == 3, F.base64(F.try_variant_get(v, "$", "binary"))).otherwise(text)
    return F.when(tag.isNotNull(), F.struct(tag.cast("int").alias("tag"), body.alias("text")))


def documents_from(df: DataFrame, *columns: str, name: str = "doc") -> DataFrame:
    """`df` with the object of the given columns (all, if none) as the variant `name`; timestamps as text, so that they compare."""
    chosen = columns or df.columns
    parts = []
    for c in chosen:
        dtype = df.schema[c].dataType
        parts.append((F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)) else F.col(c)).alias(c))
    return df.withColumn(name, F.to_variant_object(F.struct(*parts)))
