"""Values of the dialect as Column expressions.

Text files hold nothing but text; there every value is text that may read as a
number (kind ``DYN``).  Tables with types keep them (``NUM``, ``TEXT``,
``TIME``).  A kind is known before a plan exists, so an operator over typed
columns becomes the plain Spark operator, which can be pushed to a Parquet
scan or hashed by a join, and only ``DYN`` operands cost a CASE.

Logic has two values.  ``Value.test`` may be null where that means false in
any case (a filter); ``Value.truth`` never is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.render import is_number

NUM, BOOL, TEXT, DYN, TIME, NULL = "num", "bool", "text", "dyn", "time", "null"

#: The whole text is a number; ``\z`` because ``$`` would also match before a last line break.
NUMERIC = r"^[ \t\n\r\f\x0B]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
#: The longest numeric start of a text, which arithmetic accepts.
PREFIX = r"^[ \t\n\r\f\x0B]*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"
EPSILON = 1e-9


def number_of(text: Column) -> Column:
    """The number that a text reads as, else null."""
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def number_text(x: Column) -> Column:
    """A double as the dialect prints it: whole numbers in full, others with six significant digits."""
    whole = F.round(x)
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x), r"([.][0-9]*?)0+(e|$)", "$1$2"), r"[.](e|$)", "$1")
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when((F.abs(x - whole) < EPSILON) & (F.abs(x) < 9e18), F.when(F.abs(x) < 9e18, whole).otherwise(0.0).cast("long").cast("string"))
        .otherwise(short)
    )


@dataclass(frozen=True)
class Value:
    """An expression of one kind.

    ``literal`` is the text of a constant; ``integral`` marks whole-number
    columns; ``compound`` is more than a column or constant, ``query`` has a
    subquery inside.
    """

    kind: str
    col: Column
    literal: str | None = None
    integral: bool = False
    compound: bool = False
    query: bool = False

    @property
    def text(self) -> Column:
        if self.literal is not None:
            return F.lit(self.literal)
        if self.kind == NUM:
            return self.col.cast("string") if self.integral else bound(lambda x: number_text(x.col.cast("double")), self)
        if self.kind == BOOL:
            return F.when(self.truth, "1").otherwise("0")
        if self.kind == TIME:
            return F.date_format(self.col, "yyyy-MM-dd HH:mm:ss")
        return self.col

    @property
    def number(self) -> Column:
        """The value as a double; null if it is no number."""
        if self.kind == NUM:
            return self.col.cast("double")
        if self.kind == BOOL:
            return F.when(self.truth, 1.0).otherwise(0.0)
        if self.kind == NULL:
            return F.lit(None).cast("double")
        if self.literal is not None:
            return F.lit(float(self.literal) if is_number(self.literal) else None).cast("double")
        return bound(lambda x: number_of(x.text), self)

    @property
    def operand(self) -> Column:
        """The value for arithmetic: a numeric start counts, any other text is an error, null stays null."""
        if self.kind in (NUM, BOOL, NULL):
            return self.number

        def read(x: Value) -> Column:
            start = F.regexp_extract(x.text, PREFIX, 1)
            bad = F.raise_error(F.concat(F.lit("Not a number: "), x.text)).cast("double")
            return F.when(x.text.isNotNull(), F.coalesce(x.number, F.when(start != "", start.try_cast("double")), bad))

        return bound(read, self)

    @property
    def whole(self) -> Column:
        if self.kind == NUM and self.integral:
            return self.col.cast("long")
        return F.round(self.operand).cast("long")

    @property
    def test(self) -> Column:
        """True where the value counts as true; null or false elsewhere."""
        if self.kind == BOOL:
            return self.col
        if self.kind == NUM:
            return F.abs(self.col) > EPSILON if self.integral else bound(lambda x: (F.abs(x.col) > EPSILON) & ~F.isnan(x.col), self)
        if self.kind == NULL:
            return F.lit(False)
        return bound(lambda x: F.when(x.number.isNotNull(), F.abs(x.number) > EPSILON).otherwise(~x.text.isin("", "0", "false", "FALSE")), self)

    @property
    def truth(self) -> Column:
        return F.coalesce(self.test, F.lit(False))

    @property
    def is_null(self) -> Column:
        never = self.literal is not None or self.kind == BOOL and self.compound  # what an operator answers is 1 or 0
        return F.lit(True) if self.kind == NULL else F.lit(False) if never else self.col.isNull()

    @property
    def rank(self) -> Column:
        """What orders values: null first, numbers before other text.  Typed columns order as they are."""
        if self.kind in (NUM, TEXT, TIME) and self.literal is None:
            return self.col
        if self.kind == BOOL:
            return self.truth
        return self.dynamic_rank

    @property
    def dynamic_rank(self) -> Column:
        """Null, the empty text, numbers, other text."""

        def rank(x: Value) -> Column:
            n = x.number
            kind = F.when(x.text == "", 0).when(n.isNotNull(), 1).otherwise(2)
            return F.when(~x.is_null, F.struct(kind.alias("t"), F.coalesce(n, F.lit(0.0)).alias("n"), F.when(n.isNull(), x.text).otherwise("").alias("s")))

        return bound(rank, self)

    @property
    def key(self) -> Column:
        """Equal texts for equal values, so that equality of ``DYN`` values can be hashed."""
        return bound(lambda x: F.coalesce((x.number + F.lit(0.0)).cast("string"), x.text), self)  # -0 is 0

    @property
    def output(self) -> Column:
        """The value as a result column: native, or 1 and 0 for truth."""
        if self.kind == BOOL:
            return F.when(self.truth, 1).otherwise(0)
        if self.kind == NULL:
            return F.lit(None).cast("string")
        if self.literal is not None and self.kind != NUM:
            return F.lit(self.literal)
        return self.col


def bound(build: Callable[..., Column], *values: Value) -> Column:
    """``build`` of the values, each computed once however often ``build`` names it.

    Without this a nested expression over dynamic values would double at every
    level.  Columns and constants cost nothing to repeat and keep generated
    code.  Spark allows no subquery in a lambda, and runs a repeated one once.
    """
    if any(x.query for x in values):
        return build(*values)
    names = [f"v{k}" if x.compound and x.literal is None and x.kind != NULL else None for k, x in enumerate(values)]
    if not any(names):
        return build(*values)
    row = F.struct(*[x.col.alias(n) for n, x in zip(names, values) if n])
    inside = lambda r: build(*[replace(x, col=r[n], compound=False) if n else x for n, x in zip(names, values)])
    return F.transform(F.array(row), inside)[0]


def literal(text: str, quoted: bool) -> Value:
    if not quoted and is_number(text):
        return Value(NUM, F.lit(float(text)), text)
    return Value(DYN if is_number(text) else TEXT, F.lit(text), text)


def null() -> Value:
    return Value(NULL, F.lit(None).cast("string"))


def of_column(col: Column, kind: T.DataType, dynamic: bool) -> Value:
    """The value of a stored column."""
    if isinstance(kind, T.StringType):
        return Value(DYN if dynamic else TEXT, col)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Value(NUM, col, integral=True)
    if isinstance(kind, T.NumericType):
        return Value(NUM, col)
    if isinstance(kind, T.BooleanType):
        return Value(BOOL, col)
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return Value(TIME, col)
    return Value(TEXT, col.cast("string"))


_ORDER: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _moment(v: Value) -> datetime | None:
    if v.literal is None:
        return None
    for shape in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S"):
        try:
            return datetime.strptime(v.literal, shape)
        except ValueError:
            pass
    return None


def _plain(x: Value, other: Value) -> Column:
    """A number beside another: a whole constant takes a whole column's type, or the scan could not use it."""
    if x.literal is not None and other.integral and float(x.literal).is_integer() and abs(float(x.literal)) < 2**53:
        return F.lit(int(float(x.literal)))
    return x.number if x.literal is not None or x.kind == BOOL else x.col


def _paired(a: Value, b: Value) -> tuple[Column, Column] | None:
    """Both as plain columns of one type, where no value decides how they compare."""
    if a.kind == b.kind == NUM:
        return _plain(a, b), _plain(b, a)
    if a.kind == b.kind == TIME:
        return a.col, b.col
    if TIME in (a.kind, b.kind):  # move the constant to the column's type, or the scan cannot use it
        moments = [x.col if x.kind == TIME else F.lit(m) if (m := _moment(x)) else None for x in (a, b)]
        return (moments[0], moments[1]) if all(x is not None for x in moments) else None
    typed = [x.kind == TEXT and x.literal is None for x in (a, b)]
    if any(typed) and all(t or x.literal is not None for t, x in zip(typed, (a, b))):
        return a.text, b.text
    if a.kind == b.kind == TEXT:
        return a.text, b.text
    if NUM in (a.kind, b.kind):
        other = b if a.kind == NUM else a
        if other.literal is not None and is_number(other.literal) or other.kind == BOOL:
            return _plain(a, b), _plain(b, a)
    return None


def compare(op: str, a: Value, b: Value) -> Value:
    """A comparison; null on either side makes it false."""
    if NULL in (a.kind, b.kind):
        return Value(BOOL, F.lit(False), compound=True)
    pair = _paired(a, b)
    if pair:
        same = pair[0] == pair[1]
        return Value(BOOL, same if op == "=" else ~same if op == "!=" else _ORDER[op](*pair), compound=True)
    if op in ("=", "!="):
        if NUM in (a.kind, b.kind) or BOOL in (a.kind, b.kind):
            same = a.number == b.number  # a key on either side that a join can hash; a text that is no number equals none
            return Value(BOOL, same if op == "=" else ~a.is_null & ~b.is_null & ~F.coalesce(same, F.lit(False)), compound=True)
        same = a.key == b.key
        return Value(BOOL, same if op == "=" else ~same, compound=True)
    by_kind = lambda x, y: F.when(x.number.isNotNull() & y.number.isNotNull(), _ORDER[op](x.number, y.number)).otherwise(_ORDER[op](x.text, y.text))
    return Value(BOOL, bound(by_kind, a, b), compound=True)


def _divided(a: Value, b: Value) -> Column:
    def quotient(x: Value, y: Value) -> Column:
        infinite = F.when(x.col > 0, float("inf")).when(x.col < 0, float("-inf")).otherwise(float("nan"))
        return F.when(x.col.isNotNull() & (y.col == 0), infinite).otherwise(x.col / F.when(y.col != 0, y.col))

    return bound(quotient, *(Value(NUM, x.operand, compound=x.compound or x.kind != NUM, query=x.query) for x in (a, b)))


def _sum_or_text(x: Value, y: Value) -> Column:
    return F.when(x.number.isNotNull() & y.number.isNotNull(), number_text(x.number + y.number)).otherwise(F.concat(x.text, y.text))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+":
        if {a.kind, b.kind} <= {NUM, BOOL}:
            return Value(NUM, a.number + b.number, compound=True)
        if TEXT in (a.kind, b.kind) or TIME in (a.kind, b.kind):
            return Value(TEXT if DYN not in (a.kind, b.kind) else DYN, F.concat(a.text, b.text), compound=True)
        return Value(DYN, bound(_sum_or_text, a, b), compound=True)
    if op in ("-", "*", "/"):
        return Value(NUM, a.operand - b.operand if op == "-" else a.operand * b.operand if op == "*" else _divided(a, b), compound=True)
    x, y = a.whole, b.whole
    if op == "%":
        out = bound(lambda m, n: m.col % F.when(n.col != 0, n.col), Value(NUM, x, query=a.query), Value(NUM, y, compound=b.compound or b.kind != NUM, query=b.query))
    else:
        out = {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y)
    return Value(NUM, out, integral=True, compound=True)


def unary(op: str, a: Value) -> Value:
    if op == "!":
        return Value(BOOL, ~a.truth, compound=True)
    if op == "~":
        return Value(NUM, F.bitwise_not(a.whole), integral=True, compound=True)
    return Value(NUM, -a.operand if op == "-" else a.operand, compound=True)


def matches(op: str, a: Value, b: Value) -> Value:
    """LIKE, where only ``%`` and ``_`` are special, and REGEXP, found anywhere in the text."""
    if NULL in (a.kind, b.kind):
        return Value(BOOL, F.lit(False), compound=True)
    if op == "REGEXP":
        return Value(BOOL, F.regexp_like(a.text, b.text), compound=True)
    if b.literal is not None:
        return Value(BOOL, a.text.like(b.literal.replace("\\", "\\\\")), compound=True)
    return Value(BOOL, F.like(a.text, F.replace(b.text, F.lit("\\"), F.lit("\\\\"))), compound=True)


def listed(op: str, a: Value, items: list[Value]) -> Value:
    """IN and NOT IN over a list; null items say nothing, a null left side is in neither."""
    items = [x for x in items if x.kind != NULL]
    if a.kind == NULL:
        return Value(BOOL, F.lit(False), compound=True)
    pairs = [_paired(a, x) for x in items]
    if items and all(pairs) and all(x.literal is not None for x in items):
        among = pairs[0][0].isin(*[p[1] for p in pairs])
    else:

        def any_of(left: Value, *rest: Value) -> Column:
            out = F.lit(False)
            for x in rest:
                out = out | compare("=", left, x).truth
            return out

        among = bound(any_of, a, *items)
    if op == "IN":
        return Value(BOOL, among, compound=True)
    return Value(BOOL, ~a.is_null & ~F.coalesce(among, F.lit(False)), compound=True)
