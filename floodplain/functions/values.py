"""Values as the source stores them: unsigned numbers, enums, sets, mapped ids, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of integer types in bits.
BITS = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32, "bigint": 64}


def unsigned(column: Column, kind: str) -> Column:
    """The unsigned reading of a signed value; a `mediumint` keeps its 24 bits, a `bigint` becomes decimal(20,0)."""
    bits = BITS[kind]
    if bits == 64:
        wide = column.cast("decimal(20,0)")
        return F.when(column < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
    return column.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def enum_label(index: Column, labels: Sequence[str]) -> Column:
    """The label of a 1-based index; 0 is the empty label, others are null."""
    return F.when(index == 0, F.lit("")).otherwise(F.try_element_at(F.array(*map(F.lit, labels)), index.cast("int")))


def set_labels(mask: Column, labels: Sequence[str]) -> Column:
    """The labels of a bit mask, joined by commas."""
    parts = [F.when(mask.cast("long").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(v)) for i, v in enumerate(labels)]
    return F.when(mask.isNotNull(), F.concat_ws(",", *parts))


#: Bits of a mapped id: instance, schema number, table number, id; the sign stays 0.
INSTANCE_BITS, SCHEMA_BITS, TABLE_BITS, ID_BITS = 4, 7, 8, 44


def partition_id(id_: Column, instance: int, schema: Column, schema_prefix: str, table: Column, table_prefix: str) -> Column:
    """instance << 59 | schema number << 52 | table number << 44 | id, with numbers after the names' prefixes.

    A part without a prefix counts as 0, and so does a name that is the prefix alone. Any other name that is not its prefix and a number, and a
    number or id without room in its bits, are errors: they would give two rows one id. A null id stays null.
    """
    if not 0 <= instance < 1 << INSTANCE_BITS:
        raise ValueError(f"instance {instance} is not from 0 to {(1 << INSTANCE_BITS) - 1}")

    def number(name: Column, prefix: str, bits: int, what: str) -> Column:
        if not prefix:
            return F.lit(0).cast("long")
        digits = F.substr(name, F.lit(len(prefix) + 1))
        named, value = name.startswith(prefix) & digits.rlike(r"^\d{0,9}$"), F.concat(F.lit("0"), digits).try_cast("long")
        wrong = F.raise_error(F.concat(F.lit(f"{what} is not {prefix!r} and a number with room in {bits} bits: "), name)).cast("long")
        return F.when(named & (value < 1 << bits), value).otherwise(wrong)

    wide = id_.cast("long")
    no_room = F.raise_error(F.concat(F.lit(f"id has no room in {ID_BITS} bits: "), id_.cast("string"))).cast("long")
    own = F.when((wide >= 0) & (wide < 1 << ID_BITS), wide).otherwise(no_room)
    parts = F.lit(instance << 59).cast("long")
    parts = parts.bitwiseOR(F.shiftleft(number(schema, schema_prefix, SCHEMA_BITS, "schema"), 52)).bitwiseOR(F.shiftleft(number(table, table_prefix, TABLE_BITS, "table"), 44))
    return F.when(id_.isNotNull(), parts.bitwiseOR(own))


def add_prefix(column: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def time_interval(text: Column) -> Column:
    """A time of day or a span from -838:59:59 to 838:59:59, with fractions, as a day-time interval."""
    p = r"^(-?)(\d+):(\d+):(\d+(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(text, p, i)
    span = F.make_dt_interval(F.lit(0), part(2).try_cast("int"), part(3).try_cast("int"), part(4).try_cast("decimal(18,6)"))
    return F.when(text.rlike(p), F.when(part(1) == "-", -span).otherwise(span))


def zero_date(text: Column) -> Column:
    """Whether a date is one without a Spark value: a zero year, month or day."""
    return text.rlike(r"^(0000-\d\d-\d\d|\d{4}-00-\d\d|\d{4}-\d\d-00)")


def json_path(column: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(column, path).try_cast(kind)


def unescape_name(name: Column) -> Column:
    """%XX in a file name's parts."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def quote_name(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def short_hash(text: Column, length: int = 6) -> Column:
    return F.left(F.sha1(text.cast("binary")), F.lit(length))


def trim_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")


def percent(finished: Column, total: Column) -> Column:
    """Share in percent; a total of nothing is finished."""
    return F.when(total == 0, F.lit(100.0)).otherwise(F.round(finished * 100.0 / total, 2))

