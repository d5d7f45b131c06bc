"""Content hygiene expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (values that decide the result).
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
LOCAL_PATH = r"(?:(?<=[\s\"'(=])|^)(?:[a-zA-Z]:[\\/]|/(?:home|Users))[a-zA-Z0-9_\\/.-]+"
SECRET = r"(?:(?:sk|ghp|AKIA)[-_a-zA-Z0-9]{16,}|-----BEGIN (?:RSA )?PRIVATE KEY-----)"


def found(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """Distinct matches of a pattern, sorted so that the value is reproducible. ``needs`` is a
    cheap test that every match implies; texts that fail it skip the pattern."""
    hits = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    if needs is None:
        return hits
    return F.when(needs, hits).otherwise(F.array().cast("array<string>"))


def has_any(text: Column, *pieces: str) -> Column:
    test = F.contains(text, F.lit(pieces[0]))
    for p in pieces[1:]:
        test = test | F.contains(text, F.lit(p))
    return test


def emails(text: Column) -> Column:
    return found(text, EMAIL, has_any(text, "@"))


def secrets(text: Column) -> Column:
    return found(text, SECRET, has_any(text, "sk", "ghp", "AKIA", "PRIVATE KEY"))


def local_paths(text: Column) -> Column:
    """Absolute user paths without elided or placeholder ones."""
    return F.filter(
        found(text, LOCAL_PATH, has_any(text, ":\\", ":/", "/home", "/Users")),
        lambda p: ~(F.endswith(p, F.lit("..")) | F.contains(F.lower(p), F.lit("placeholder"))),
    )


def sanitized(text: Column, paths: Column) -> Column:
    """The text with addresses, paths and secrets replaced, in that order."""
    no_mail = F.when(has_any(text, "@"), F.regexp_replace(text, EMAIL, "[EMAIL_REDACTED]")).otherwise(text)
    # longest path first, so that a path is never cut by one of its prefixes
    longest_first = F.array_sort(
        paths, lambda a, b: F.coalesce(F.length(b), F.lit(0)) - F.coalesce(F.length(a), F.lit(0))
    )
    no_path = F.aggregate(longest_first, no_mail, lambda acc, p: F.replace(acc, p, F.lit("[PATH_REDACTED]")))
    return F.regexp_replace(no_path, SECRET, "[SECRET_REDACTED]")


def hygiene_columns(text: str, sanitize: bool = True) -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    out = [emails(t).alias("emails"), local_paths(t).alias("local_paths"), secrets(t).alias("secrets")]
    if sanitize:
        out.append(sanitized(t, local_paths(t)).alias("sanitized"))
    return out
