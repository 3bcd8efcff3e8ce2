"""Text measures of source files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What counts as a branch, comment and key headers.
BRANCH_WORDS = ("if ", "else ", "elif ", "for ", "while ", "match ", "switch ", "case ", "catch ")
COMMENT_STARTS = ("//", "#", "--", "/*", "*", "<!--")
KEY_HEADERS = ("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----")
#: White space inside brackets.
_BLANK = r"\s\u0085   -     　"


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def non_empty_lines(text: Column) -> Column:
    """Lines with more than white space: each counts from its first other character to its end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{_BLANK}][^\n]*")).cast("long")


def branches(text: Column) -> Column:
    """Branch words and logical operators on lines that are no comments."""
    code = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?md)^[ \t]*(?://|#|\*|/\*)[^\n]*", "")
    words = "(?<![A-Za-z0-9_])(?:" + "|".join(BRANCH_WORDS) + r")|&&|\|\|"
    return F.regexp_count(code, F.lit(words)).cast("long")


def marker(line: Column) -> Column:
    """FIXME, HACK or TODO after the line's first comment sign; null without one."""
    starts = [F.when(F.instr(line, s) > 0, F.instr(line, s)) for s in COMMENT_STARTS]
    first = F.array_min(F.array(*starts))
    width = F.lit(0)
    for s, at in reversed(list(zip(COMMENT_STARTS, starts))):
        width = F.when(at == first, len(s)).otherwise(width)
    rest = F.substring(line, first + width, F.lit(1 << 30))
    return F.when(F.contains(rest, F.lit("FIXME")), "FIXME").when(F.contains(rest, F.lit("HACK")), "HACK").when(F.contains(rest, F.lit("TODO")), "TODO")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the bytes of a text.

    The bytes, read as one character each, are sorted once; equal ones are runs, so time goes with
    the length (and its logarithm), not with its square.
    """
    chars = F.array_sort(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""))
    n = F.size(chars)
    run = "STRUCT<last: STRING, run: BIGINT, bits: DOUBLE>"

    def closed(acc):
        p = acc["run"] / n
        return F.when(acc["run"] > 0, acc["bits"] - p * F.log2(p)).otherwise(acc["bits"])

    def step(acc, c):
        same = acc["last"].eqNullSafe(c)
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1)).cast("long").alias("run"), F.when(same, acc["bits"]).otherwise(closed(acc)).alias("bits"))

    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("bits")).cast(run)
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(chars, start, step, closed))


def key_header(line: Column) -> Column:
    trimmed = F.trim(F.translate(line, "\t\r", "  "))
    out = F.lit(False)
    for h in KEY_HEADERS:
        out = out | F.startswith(trimmed, F.lit(h))
    return out


def import_depth(specifier: Column) -> Column:
    """How many directories an import climbs."""
    return F.regexp_count(specifier, F.lit(r"\.\./")).cast("int")


def coverage_percent(part: Column, total: Column) -> Column:
    """Whole percent, halves up; 100 of nothing."""
    return F.when(total == 0, F.lit(100)).otherwise(F.least(F.lit(100), F.expr("0") + F.floor((part * 100 + F.floor(total / 2)) / total))).cast("int")
