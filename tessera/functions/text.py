"""Column functions over text, paths and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import _with

# File name extensions by kind.
KINDS = {
    "markdown": ("markdown", "md", "mdx"),
    "text": ("adoc", "org", "rst", "tex", "txt"),
    "code": tuple("bash c cc cmake cpp cs cu cuh cxx go h hh hpp hs java js jsx kt lua mjs ml php proto py rb rs scala sh sql swift toml ts tsx yaml yml zig zsh".split()),
}
EXTENSIONS = {x: kind for kind, xs in KINDS.items() for x in xs}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def source_kind(path) -> Column:
    """markdown, text or code by a path's extension, null for any other file."""
    ext = F.lower(F.regexp_extract(_col(path), r"[^/]\.([^./]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for kind, xs in KINDS.items():
        out = out.when(ext.isin(*xs), kind)
    return out


def heading(line) -> Column:
    """Text of an ATX heading line, null if the line is none."""
    line = _col(line)
    inner = F.regexp_extract(line, r"^ {0,3}#{1,6}(?:[ \t](.*))?$", 1)
    clean = F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(inner, r"^\s+|\s+$", "")), r"#+$", ""))
    return F.when(line.rlike(r"^ {0,3}#{1,6}(?:[ \t].*)?$"), F.regexp_replace(clean, r"\s+$", ""))


def is_blank(line) -> Column:
    return _col(line).rlike(r"^[ \t\n\f\r]*$")


def estimate_tokens(text) -> Column:
    """A rough count: each word costs a token per six bytes, each other visible byte
    one. One expression counts both in the bytes, read as one character each."""
    found = F.regexp_count(F.decode(_col(text).cast("binary"), "ISO-8859-1"), F.lit(r"[A-Za-z0-9_\x80-\xff]{1,6}|[^A-Za-z0-9_\x80-\xff \t\n\f\r]"))
    return found.cast("long")


def payload(path, begin, end, heading, text) -> Column:
    """One line of tab-separated fields, then the text itself."""
    flat = lambda c: F.translate(F.coalesce(_col(c), F.lit("")), "\t\n\r", "   ")
    head = F.concat_ws("\t", flat(path), _col(begin).cast("string"), _col(end).cast("string"), flat(heading))
    return F.concat(head, F.lit("\n"), _col(text))


def decode_payload(value) -> Column:
    """The fields of a payload as a struct, null if it is malformed."""
    value = _col(value)
    at = F.locate("\n", value)
    parts = F.split(F.substring(value, F.lit(1), at - 1), "\t", 4)
    begin, end = (F.get(parts, F.lit(k)).try_cast("long") for k in (1, 2))
    title = F.get(parts, F.lit(3))
    good = (at > 0) & (F.size(parts) == 4) & begin.isNotNull() & end.isNotNull() & (begin >= 0) & (end >= 0)
    return F.when(
        good,
        F.struct(F.get(parts, F.lit(0)).alias("path"), begin.alias("begin"), end.alias("end"), F.when(title != "", title).alias("heading"), F.substring(value, at + 1, F.length(value)).alias("text")),
    )


def file_name(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def context(path, heading, text) -> Column:
    """What stands before a chunk when it is embedded: its file's name and heading. A
    chunk that starts with its own heading line is not given it twice."""
    heading = _col(heading)
    named = F.concat(file_name(path), F.lit(" › "), heading, F.lit("\n"))
    return F.when(heading.isNotNull() & (heading != "") & ~_col(text).startswith("#"), named).otherwise(F.concat(file_name(path), F.lit("\n")))


def contextual_text(path, heading, text) -> Column:
    """What is embedded for a chunk: its context, then its text."""
    return F.concat(context(path, heading, text), _col(text))


def snippet(text, n: int = 160) -> Column:
    """White space collapsed, cut after ``n`` characters with an ellipsis."""
    flat = F.regexp_replace(_col(text), r"(?U)\s+", " ")
    return F.trim(F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat))


def _fixed(x: Column, digits: int, unit: str) -> Column:
    """With so many decimals, at most two; the number that is stored is rounded, not the
    shortest decimal that stands for it, and halves go to the even digit. From 1 on the
    lower half of the fraction has 26 bits, so that all steps are exact."""
    many = 10**digits

    def shown(n, x):
        parts = [F.when(x < 0, "-").otherwise(""), F.floor(n / many).cast("string")]
        return F.concat(*parts, *([F.lit("."), F.lpad((n % many).cast("string"), digits, "0")] if digits else []))

    def rounded(rest, first):
        whole, over = first + F.floor(rest), rest - F.floor(rest)
        return whole + F.when((over > 0.5) | ((over == 0.5) & (whole % 2 == 1)), 1).otherwise(0)

    def split(fraction, size):
        high = F.floor(fraction * 2.0**26) / 2.0**26
        return _with(F.floor(high * many), lambda first: _with((high * many - first) + (fraction - high) * many, lambda rest: rounded(rest, F.floor(size) * many + first)))

    def text(x):
        size = F.abs(x)
        exact = _with(_with(size - F.floor(size), lambda fraction: split(fraction, size)), lambda n: shown(n, x))
        # Beyond it there is no fraction.
        return F.concat(F.when(size < 2.0**46, exact).otherwise(F.format_string(f"%.{digits}f", x)), F.lit(f" {unit}"))

    return F.when(x.isNotNull(), _with(x.cast("double"), text))


def format_bytes(n) -> Column:
    """Binary units with one decimal."""
    n = _col(n)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024.0 ** (k + 1), _fixed(n / 1024.0**k, 1, unit))
    return out.otherwise(_fixed(n / 1024.0**4, 1, "TiB"))


def format_duration(nanos) -> Column:
    """The unit that suits the length: ns, µs, ms or s."""
    n = _col(nanos).cast("double")
    return (
        F.when(n < 1e3, _fixed(n, 0, "ns"))
        .when(n < 1e6, _fixed(n / 1e3, 1, "µs"))
        .when(n < 1e9, _fixed(n / 1e6, 2, "ms"))
        .otherwise(_fixed(n / 1e9, 2, "s"))
    )


def format_count(n) -> Column:
    """With thousands separators."""
    return F.format_number(_col(n), 0)
