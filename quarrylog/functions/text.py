"""String functions on columns: pattern extraction, escapes, encodings, key-value text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "\x01"


def with_groups(value: Column, pattern: str, n: int, then: Callable[[Column, Callable[[int], Column]], Column]) -> Column:
    """then(ok, group) of an anchored pattern with n groups, evaluated once a row; group(i), from 1, is '' where none is.

    Groups are parted by U+0001, which is taken out of the value first. A lambda's variable holds the parts, so that an
    expression that uses them several times doesn't evaluate the pattern as often.
    """
    shown = "".join(f"{_SEP}${i + 1}" for i in range(n))
    parts = F.split(F.regexp_replace(F.translate(value, _SEP, ""), pattern, shown), _SEP, n + 1)

    def apply(p: Column) -> Column:
        ok = F.coalesce((F.size(p) == n + 1) & (F.get(p, F.lit(0)) == ""), F.lit(False))
        return then(ok, lambda i: F.when(ok, F.get(p, F.lit(i))).otherwise(""))

    return F.get(F.transform(F.array(parts), apply), F.lit(0))


def extract(value: Column, pattern: str, names: list[str]) -> Column:
    """Struct of (ok, *names) from one evaluation of an anchored pattern; '' where it or an optional group doesn't match."""
    return with_groups(value, pattern, len(names), lambda ok, group: F.struct(ok.alias("ok"), *(group(i + 1).alias(n) for i, n in enumerate(names))))


def found(struct: Column, always: bool = False) -> Column:
    """An array of the struct if its `ok` is true (or always), else of none: exploded, it is evaluated once for filter and fields."""
    return F.filter(F.array(struct), lambda s: F.lit(True) if always else s["ok"])


def fields_of(text: Column) -> Column:
    """The white-space separated parts of a text, for `field_in`."""
    return F.split(text, r"\s+")


def field_in(parts: Column, name: str) -> Column:
    """Value of the last part that is `name=value`, '' if there is none."""
    last = F.try_element_at(F.filter(parts, lambda p: p.startswith(f"{name}=")), F.lit(-1))
    return F.coalesce(F.substring(last, len(name) + 2, 1 << 30), F.lit(""))


def valid_utf8(value: Column) -> Column:
    """Damaged bytes become U+FFFD."""
    return F.make_valid_utf8(value)


def hex_text(value: Column) -> Column:
    """Text of a hex string of whole bytes (0x allowed), NULs as spaces, trimmed; anything else as it is."""
    bare = F.regexp_replace(value, "^0[xX]", "")
    is_hex = F.length(bare).cast("int") % 2 == 0
    is_hex = is_hex & bare.rlike("^[0-9A-Fa-f]+$")
    decoded = F.trim(F.translate(F.make_valid_utf8(F.unhex(F.when(is_hex, bare)).cast("string")), "\x00", " "))
    return F.when(is_hex, decoded).otherwise(value)


def field(text: Column, name: str) -> Column:
    """Last `name=value` of white-space separated text, '' if there is none; values keep their quotes and further '='."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|\s){name}=(\S*)"), F.lit(1))
    return F.coalesce(F.get(found, F.size(found) - 1), F.lit(""))


def unescape(value: Column) -> Column:
    """A backslash and a character become the character."""
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def clean_ip(value: Column) -> Column:
    """The first address of a chain parted by commas or semicolons."""
    return F.trim(F.regexp_replace(F.trim(F.get(F.split(F.trim(value), "[,;]", 2), F.lit(0))), "[,;]+$", ""))


def url_text(value: Column) -> Column:
    """URL-decoded text, '+' being a space; null if an escape is damaged."""
    return F.try_url_decode(value)


def base64_text(value: Column) -> Column:
    """Text of Base64, URL-safe letters, white space and missing padding allowed; null if it is no Base64."""
    bare = F.translate(F.regexp_replace(value, r"\s", ""), "-_", "+/")
    padded = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    return F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


def ascii_lower(value: Column) -> Column:
    """A-Z only, as the LIKE of the query surface folds case."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(F.format_number(n / 1024, 1), F.lit(" KB")))
        .when(n < 1024**3, F.concat(F.format_number(n / 1024**2, 1), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(n / 1024**3, 2), F.lit(" GB")))
    )
