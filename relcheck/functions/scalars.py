"""Scalar functions as Column expressions (X1-X10); none needs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted spellings of each unit and its milliseconds.
_UNITS = ((("", "ms"), 1), (("s", "sec", "secs", "second", "seconds"), 1_000), (("min", "mins", "minute", "minutes"), 60_000), (("h", "hr", "hour", "hours"), 3_600_000))
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def parse_duration_ms(c: Column) -> Column:
    """`5s`, `500ms`, `2min`, `1h` or bare milliseconds as a long; null if malformed or too large."""
    text = F.trim(c)
    unit = F.trim(F.regexp_extract(text, r"^[0-9]+\s*([a-z]*)$", 1))
    number = F.regexp_extract(text, r"^([0-9]+)\s*[a-z]*$", 1).try_cast("long")
    factor = F.lit(None).cast("long")
    for names, ms in _UNITS:
        factor = F.when(unit.isin(*names), F.lit(ms).cast("long")).otherwise(factor)
    return F.when(number.isNotNull(), F.try_multiply(number, factor))


def format_duration(c: Column) -> Column:
    """Milliseconds in the largest unit that divides them: 0, 12ms, 5s, 2min, 1h."""
    whole = c.cast("string")
    out = F.concat(whole, F.lit("ms"))
    for ms, unit in ((1_000, "s"), (60_000, "min"), (3_600_000, "h")):
        out = F.when(c % ms == 0, F.concat(F.floor(c / ms).cast("string"), F.lit(unit))).otherwise(out)
    return F.when(c == 0, F.lit("0")).otherwise(out)


def human_duration(c: Column) -> Column:
    """Milliseconds as people read them: 12ms, 1.5s, 2m3s."""
    seconds = F.floor(c / 1000)
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), (seconds % 60).cast("string"), F.lit("s"))
    return F.when(c < 1_000, F.concat(c.cast("string"), F.lit("ms"))).when(c < 60_000, F.concat(F.format_string("%.1f", F.bround(c / 1000.0, 1)), F.lit("s"))).otherwise(minutes)


def normalize_slug(c: Column, most: int = 80) -> Column:
    """ASCII letters and digits in lower case, anything else as single inner hyphens, 80 at most; null if empty."""
    dashed = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-|-$", "")
    cut = F.regexp_replace(F.substring(F.lower(dashed), 1, most), "-+$", "")
    return F.when(cut != "", cut)


def split_package_name(c: Column) -> Column:
    """`<uuid>-<slug>` as struct(id, slug, short_id); without a leading UUID id is null and slug empty."""
    head = F.substring(c, 1, 36)
    ok = head.rlike(_UUID)
    rest = F.regexp_replace(c.substr(F.lit(37), F.length(c)), "^-", "")
    identity = F.when(ok, F.lower(head))
    return F.struct(identity.alias("id"), F.when(ok, rest).otherwise(F.lit("")).alias("slug"), F.substring(identity, 1, 8).alias("short_id"))


def quote_identifier(c: Column) -> Column:
    """In double quotes, embedded quotes doubled."""
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def line_and_column(text: Column, offset: Column) -> Column:
    """struct(line, column), both from 1, of the character at a 0-based offset."""
    before = text.substr(F.lit(1), offset.cast("int"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def stable_key(c: Column) -> Column:
    """The first 8 bytes of the SHA-256 as a signed long, the same in every run."""
    digest = F.sha2(c.cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def uuid_version(c: Column) -> Column:
    """The version digit of a UUID text; null for anything else."""
    return F.when(c.rlike(_UUID), F.conv(F.substring(c, 15, 1), 16, 10).cast("int"))


def is_glob(c: Column) -> Column:
    return c.rlike(r"[*?\[]")


def glob_to_regex(c: Column) -> Column:
    """A glob as an anchored regular expression; null without a wildcard.

    `*` and `?` stop at `/`; `**/` is any number of folders, none too; `/**` is everything below;
    `[...]` is a class, `[!...]` its complement.
    """
    out = F.regexp_replace(c, r"([.^$+(){}|\\])", r"\\$1")
    out = F.regexp_replace(out, r"\[!", "[^")
    # control characters stand for finished parts, so that later steps leave them alone
    out = F.regexp_replace(out, r"(^|/)\*\*/", "$1\u0001")
    out = F.regexp_replace(out, r"/\*\*$", "/\u0002")
    out = F.regexp_replace(out, r"^\*\*$", "\u0002")
    out = F.regexp_replace(out, r"\*+", "[^/]*")
    out = F.regexp_replace(out, r"\?", "[^/]")
    out = F.regexp_replace(F.regexp_replace(out, "\u0001", "(?:.*/)?"), "\u0002", ".*")
    return F.when(is_glob(c), F.concat(F.lit("^(?:"), out, F.lit(")$")))


def sha256_hex(c: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a string's UTF-8 bytes or of binary."""
    return F.sha2(c.cast("binary"), 256)
