"""Row expressions in the source database's dialect, as Spark columns.

A text is cut into tokens and read by operator precedence into one Column over
a row image; nothing is rewritten as text. Supported: names (backquoted or not),
numbers, strings in either quotes, `b'..'`, `x'..'`, `0x..`, `0b..`; TRUE, FALSE, NULL;
`->` and `->>` on JSON; arithmetic, bit, comparison and logic operators, also as
`&&`, `||`, `!`, `XOR`, `DIV`, `MOD`, `<=>`; IS, IN, BETWEEN, LIKE, REGEXP; CASE;
and the functions below. As in the source, a division by zero is null, a
string beside a number or a time is read as one, and a number is true if it isn't 0.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import time_interval

TOKEN = re.compile(
    r"\s*(?:(?P<bits>[bB]'[01]*'|0b[01]+)|(?P<hex>[xX]'(?:[0-9a-fA-F]{2})*'|0x[0-9a-fA-F]+)|(?P<string>'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\")|(?P<quoted>`(?:[^`]|``)+`)"
    r"|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_\u0080-￿$][\w$]*)|(?P<op>->>|->|<=>|<<|>>|<=|>=|<>|!=|&&|\|\||[-+*/%^&|~!<>=(),.]))",
    re.S,
)
ESCAPES = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a"}
#: Binding powers, weakest first.
LEVELS = (("or", "||"), ("xor",), ("and", "&&"), ("not",), ("between",), ("=", "<=>", ">=", ">", "<=", "<", "<>", "!=", "is", "like", "regexp", "rlike", "in"), ("|",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%", "div", "mod"), ("^",), ("unary",), ("->", "->>"))
POWER = {op: i for i, level in enumerate(LEVELS, 1) for op in level}

BOOL, NUM, STR, TIME, DATE, SPAN, BIN, NONE = "bool", "num", "str", "time", "date", "span", "bin", "none"


class UnknownColumn(Exception):
    pass


@dataclass(frozen=True)
class Term:
    """A value and what kind it is."""

    column: Column
    kind: str


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.NumericType):
        return NUM
    if isinstance(t, T.DateType):
        return DATE
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return TIME
    if isinstance(t, T.DayTimeIntervalType):
        return SPAN
    return BIN if isinstance(t, T.BinaryType) else STR


def number(x: Term) -> Column:
    """As a number; a string by its leading number, 0 without one."""
    if x.kind == NUM:
        return x.column
    if x.kind == BOOL:
        return x.column.cast("int")
    if x.kind == BIN:
        return F.conv(F.hex(x.column), 16, 10).cast("decimal(20,0)")
    if x.kind in (TIME, DATE):
        return F.date_format(x.column, "yyyyMMddHHmmss" if x.kind == TIME else "yyyyMMdd").cast("long")
    found = F.regexp_extract(x.column.cast("string"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.when(x.column.isNotNull(), F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0)))


def truth(x: Term) -> Column:
    return x.column if x.kind == BOOL else x.column.cast("boolean") if x.kind == NONE else number(x) != 0


def stamp(x: Term) -> Column:
    """As a time without zone; a string with an offset is read in it."""
    return x.column.cast("timestamp_ntz") if x.kind in (TIME, DATE) else x.column.cast("string").try_cast("timestamp").cast("timestamp_ntz")


def alike(a: Term, b: Term) -> tuple[Column, Column]:
    """Both sides of a comparison in one type."""
    kinds = {a.kind, b.kind}
    if kinds & {TIME, DATE} and kinds <= {TIME, DATE, STR, NONE}:
        return stamp(a), stamp(b)
    if SPAN in kinds and kinds <= {SPAN, STR, NONE}:
        return tuple(x.column if x.kind == SPAN else time_interval(x.column.cast("string")) for x in (a, b))
    if BIN in kinds and kinds <= {BIN, STR, NONE}:
        return tuple(x.column.cast("binary") for x in (a, b))
    if kinds <= {STR, NONE}:
        return a.column.cast("string"), b.column.cast("string")
    return number(a), number(b)


COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<=>": lambda a, b: a.eqNullSafe(b), "<>": lambda a, b: a != b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b
}
ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": F.try_mod, "mod": F.try_mod, "div": lambda a, b: F.try_divide(a, b).cast("long"),
}
BITS: dict[str, Callable[[Column, Column], Column]] = {
    "&": lambda a, b: a.bitwiseAND(b), "|": lambda a, b: a.bitwiseOR(b), "^": lambda a, b: a.bitwiseXOR(b), "<<": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), ">>": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}


def _text(x: Term) -> Column:
    return x.column.cast("string")


def _same(kind: str, f: Callable) -> Callable[..., Term]:
    return lambda *x: Term(f(*x), kind)


def _first_kind(*terms: Term) -> str:
    kinds = [t.kind for t in terms if t.kind != NONE]
    return kinds[0] if kinds and len(set(kinds)) == 1 else STR if kinds else NONE


def _coalesce(*x: Term) -> Term:
    kind = _first_kind(*x)
    return Term(F.coalesce(*[_text(t) if kind == STR else t.column for t in x]), kind)


def _if(c: Term, a: Term, b: Term) -> Term:
    kind = _first_kind(a, b)
    one, two = (_text(t) if kind == STR else t.column for t in (a, b))
    return Term(F.when(truth(c), one).otherwise(two), kind)


def _json(x: Term, path: Term) -> Term:
    return Term(F.call_function("get_json_object", _text(x), path.column), STR)


FUNCTIONS: dict[str, Callable[..., Term]] = {
    "now": _same(TIME, lambda: F.localtimestamp()), "current_timestamp": _same(TIME, lambda: F.localtimestamp()), "curdate": _same(DATE, F.current_date), "current_date": _same(DATE, F.current_date),
    "year": _same(NUM, lambda x: F.year(stamp(x))), "month": _same(NUM, lambda x: F.month(stamp(x))), "day": _same(NUM, lambda x: F.day(stamp(x))), "dayofmonth": _same(NUM, lambda x: F.day(stamp(x))),
    "hour": _same(NUM, lambda x: F.hour(stamp(x))), "minute": _same(NUM, lambda x: F.minute(stamp(x))), "second": _same(NUM, lambda x: F.second(stamp(x))), "date": _same(DATE, lambda x: stamp(x).cast("date")),
    "abs": _same(NUM, lambda x: F.abs(number(x))), "ceil": _same(NUM, lambda x: F.ceil(number(x))), "ceiling": _same(NUM, lambda x: F.ceil(number(x))), "floor": _same(NUM, lambda x: F.floor(number(x))),
    "round": _same(NUM, lambda x, *n: F.call_function("round", number(x), *[t.column.cast("int") for t in n])), "mod": _same(NUM, lambda a, b: F.try_mod(number(a), number(b))),
    "length": _same(NUM, lambda x: F.octet_length(_text(x))), "char_length": _same(NUM, lambda x: F.char_length(_text(x))), "lower": _same(STR, lambda x: F.lower(_text(x))), "upper": _same(STR, lambda x: F.upper(_text(x))),
    "concat": _same(STR, lambda *x: F.concat(*map(_text, x))), "left": _same(STR, lambda x, n: F.left(_text(x), n.column.cast("int"))), "right": _same(STR, lambda x, n: F.right(_text(x), n.column.cast("int"))),
    "substring": _same(STR, lambda x, *n: F.call_function("substring", _text(x), *[t.column.cast("int") for t in n])), "trim": _same(STR, lambda x: F.trim(_text(x))), "replace": _same(STR, lambda x, a, b: F.replace(_text(x), _text(a), _text(b))),
    "find_in_set": _same(NUM, lambda a, b: F.find_in_set(_text(a), _text(b))), "json_extract": _json, "json_unquote": lambda x: x, "isnull": _same(BOOL, lambda x: x.column.isNull()),
    "ifnull": _coalesce, "coalesce": _coalesce, "if": _if, "nullif": lambda a, b: Term(F.when(F.coalesce(COMPARE["="](*alike(a, b)), F.lit(False)), F.lit(None)).otherwise(a.column), a.kind),
    "greatest": _same(NUM, lambda *x: F.greatest(*map(number, x))), "least": _same(NUM, lambda *x: F.least(*map(number, x))),
}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text!r} from {text[at:]!r} on")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


def unquoted(text: str) -> str:
    quote, body = text[0], text[1:-1]
    return re.sub(r"\\(.)|" + quote * 2, lambda m: ESCAPES.get(m[1], m[1]) if m[1] is not None else quote, body, flags=re.S)


class Parser:
    """One expression over the fields of a row image."""

    def __init__(self, text: str, image: str, fields: T.StructType):
        self.text, self.image, self.left = text, image, tokens(text)
        self.fields = {f.name.lower(): f for f in fields}

    def whole(self) -> Term:
        out = self.parse(0)
        if self.left[0][0] != "end":
            self.fail()
        return out

    def fail(self):
        raise ValueError(f"unexpected {self.left[0][1] or 'end'!r} in expression {self.text!r}")

    def peek(self) -> str:
        """The next operator or word, in lower case; empty for values."""
        kind, text = self.left[0]
        return text.lower() if kind in ("op", "word") else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.peek():
            self.left.pop(0)
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            self.fail()

    def parse(self, power: int) -> Term:
        left = self.prefix()
        while True:
            op = self.peek()
            negated = op == "not" and self.left[1][1].lower() in ("in", "like", "between", "regexp", "rlike")
            own = POWER.get(self.left[1][1].lower() if negated else op, 0)
            if own <= power or op == "not" and not negated:
                return left
            self.left.pop(0)
            if negated:
                op = self.left.pop(0)[1].lower()
            left = self.infix(op, left, own)
            if negated:
                left = Term(~left.column, BOOL)

    def infix(self, op: str, left: Term, power: int) -> Term:
        if op == "is":
            return self.is_(left)
        if op == "in":
            self.need("(")
            held = self.items()
            out = F.lit(False)
            for x in held:
                out |= COMPARE["="](*alike(left, x))
            return Term(out, BOOL)
        if op == "between":
            low = self.parse(POWER["between"])
            self.need("and")
            high = self.parse(POWER["between"])
            return Term(COMPARE[">="](*alike(left, low)) & COMPARE["<="](*alike(left, high)), BOOL)
        right = self.parse(power)
        if op in COMPARE:
            return Term(COMPARE[op](*alike(left, right)), BOOL)
        if op in ("->", "->>"):
            return _json(left, right)
        if op in ("or", "||"):
            return Term(truth(left) | truth(right), BOOL)
        if op in ("and", "&&"):
            return Term(truth(left) & truth(right), BOOL)
        if op == "xor":
            return Term(truth(left) != truth(right), BOOL)
        if op == "like":
            return Term(F.call_function("like", _text(left), _text(right)), BOOL)
        if op in ("regexp", "rlike"):
            return Term(F.call_function("rlike", _text(left), _text(right)), BOOL)
        if op in BITS:
            return Term(BITS[op](number(left).cast("long"), number(right).cast("long")), NUM)
        return Term(ARITHMETIC[op](number(left), number(right)), NUM)

    def is_(self, left: Term) -> Term:
        negated = self.take("not")
        if self.take("null"):
            out = left.column.isNull()
        elif self.peek() in ("true", "false", "unknown"):
            what = self.left.pop(0)[1].lower()
            out = truth(left).isNull() if what == "unknown" else F.coalesce(truth(left) == F.lit(what == "true"), F.lit(False))
        else:
            self.fail()
        return Term(~out if negated else out, BOOL)

    def items(self) -> list[Term]:
        """Terms up to a closing bracket."""
        if self.take(")"):
            return []
        out = [self.parse(0)]
        while self.take(","):
            out.append(self.parse(0))
        self.need(")")
        return out

    def prefix(self) -> Term:
        kind, text = self.left.pop(0)
        if kind == "number":
            return Term(F.lit(int(text)) if text.isdigit() else F.lit(float(text)) if "e" in text.lower() else F.expr(text), NUM)
        if kind == "string":
            return Term(F.lit(unquoted(text)), STR)
        if kind == "bits":
            return Term(F.lit(int(text.strip("bB'").removeprefix("0b") or "0", 2)), NUM)
        if kind == "hex":
            digits = text[2:-1] if text[1] == "'" else text[2:]
            return Term(F.unhex(F.lit(digits if len(digits) % 2 == 0 else "0" + digits)), BIN)
        if kind == "quoted":
            return self.name(text[1:-1].replace("``", "`"))
        word = text.lower()
        if kind == "op":
            if word == "(":
                out = self.parse(0)
                self.need(")")
                return out
            if word == "!":
                return Term(~truth(self.parse(POWER["unary"])), BOOL)
            if word in ("-", "+", "~"):
                x = number(self.parse(POWER["unary"]))
                return Term(-x if word == "-" else x if word == "+" else F.bitwise_not(x.cast("long")), NUM)
        if kind == "word":
            if word == "not":
                return Term(~truth(self.parse(POWER["not"])), BOOL)
            if word in ("true", "false"):
                return Term(F.lit(word == "true"), BOOL)
            if word == "null":
                return Term(F.lit(None), NONE)
            if word == "case":
                return self.case()
            if self.peek() == "(":
                self.left.pop(0)
                if word not in FUNCTIONS:
                    raise ValueError(f"unknown function {text} in expression {self.text!r}")
                return FUNCTIONS[word](*self.items())
            if word in ("current_timestamp", "current_date"):
                return FUNCTIONS[word]()
            return self.name(text)
        self.left.insert(0, (kind, text))
        self.fail()

    def case(self) -> Term:
        subject = None if self.peek() == "when" else self.parse(0)
        found: list[tuple[Column, Term]] = []
        while self.take("when"):
            condition = self.parse(0)
            self.need("then")
            found.append((truth(condition) if subject is None else COMPARE["="](*alike(subject, condition)), self.parse(0)))
        last = self.parse(0) if self.take("else") else Term(F.lit(None), NONE)
        self.need("end")
        kind = _first_kind(*[x for _, x in found], last)
        out = F.lit(None)
        value = lambda x: _text(x) if kind == STR else x.column
        out = value(last)
        for condition, x in reversed(found):
            out = F.when(condition, value(x)).otherwise(out)
        return Term(out, kind)

    def name(self, text: str) -> Term:
        field = self.fields.get(text.lower())
        if field is None:
            raise UnknownColumn(text)
        return Term(F.col(self.image)[field.name], kind_of(field.dataType))


def condition(text: str, image: str, fields: T.StructType) -> Column:
    """Whether the expression holds for the image; null is false. An unknown column makes it false, with a warning, so that nothing is dropped."""
    try:
        return F.coalesce(truth(Parser(text, image, fields).whole()), F.lit(False))
    except UnknownColumn as unknown:
        logging.getLogger(__name__).warning("expression %r names the unknown column %s and holds for no row", text, unknown)
        return F.lit(False)
