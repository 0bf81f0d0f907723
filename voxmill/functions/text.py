"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's ``str.isspace`` accepts, as a Java character class and one by one.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# fixed values: texts of accelerator out-of-memory messages
MEMORY_ERRORS = ["cuda out of memory", "out of memory", "cublas_status_alloc_failed", "cuda error: out of memory", "failed to allocate"]


def trim_space(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(trim_space(c) == "", F.lit(True))


def sanitize(c: Column) -> Column:
    """One line without pipes: pipes become spaces, runs of white space one space, ends trimmed. Null becomes empty."""
    spaced = F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit(" "))
    return F.trim(F.regexp_replace(spaced, f"{SPACE}+", " "))


def safe_name(c: Column) -> Column:
    """File-name-safe form: everything but letters, digits, ``-`` and ``_`` becomes ``_``; outer ``_`` removed; empty becomes ``item``."""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("item"))


def clock(c: Column) -> Column:
    """Seconds as HH:MM:SS; rounded half to even, negative as zero."""
    s = F.greatest(F.lit(0).cast("bigint"), F.rint(c).cast("bigint"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def ms_key(c: Column) -> Column:
    """Seconds as whole milliseconds, rounded half to even."""
    return F.rint(c * 1000).cast("bigint")


def language_or_null(c: Column) -> Column:
    """A language setting without surrounding white space; null where empty or ``auto``."""
    return F.when(F.lower(trim_space(c)).isin("", "auto"), F.lit(None)).otherwise(trim_space(c))


def truthy(c: Column) -> Column:
    """True for 1, true and yes in any case, without any white space."""
    return F.coalesce(F.lower(c).isin("1", "true", "yes"), F.lit(False))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals, rounded as its binary value is (half to even on ties); NaN is ``nan``, null stays null."""

    @F.pandas_udf("string")
    def form(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f"{v:.{digits}f}" for v in x.astype(object).tolist()], dtype=object)

    # NaN stands for null in a pandas column of numbers
    return F.when(c.isNotNull(), F.when(F.isnan(c), F.lit("nan")).otherwise(form(c.cast("double"))))


def concat_quoted(path: Column) -> Column:
    """A line of a concatenation list: the path in single quotes, those inside it escaped."""
    return F.concat(F.lit("file '"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def signature(*parts: Column, sep: str = "|", length: int = 16) -> Column:
    """The first ``length`` hex digits of the SHA-1 of the parts."""
    return F.substring(F.sha1(F.concat_ws(sep, *[p.cast("string") for p in parts])), 1, length)


def join_segments(parts: Column) -> Column:
    """Recognised segments as one text: each stripped, empty ones dropped, joined by a space and collapsed."""
    stripped = F.filter(F.transform(parts, trim_space), lambda x: x.isNotNull() & (x != ""))
    return sanitize_spaces(F.array_join(stripped, " "))


def sanitize_spaces(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def is_memory_error(c: Column) -> Column:
    """Messages of a device that ran out of memory."""
    m = F.lower(F.coalesce(c, F.lit("")))
    found = F.lit(False)
    for n in MEMORY_ERRORS:
        found = found | m.contains(n)
    return found


def relative_path(c: Column, root: str) -> Column:
    """The path below ``root`` with forward slashes; null where it lies outside."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substr(p, F.lit(len(base) + 1)))


def path_key(c: Column) -> Column:
    """Paths that differ only in surrounding white space, case, slash direction, repeated slashes or a leading ``./`` get the same key; null and blank get null."""
    p = F.lower(trim_space(c))
    p = F.regexp_replace(p, r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.nullif(p, F.lit(""))
