"""Surrogate keys and masking hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the surrogate-key convention (public dbt_utils docs):
# NULL placeholder and field separator.
NULL_TOKEN = "_dbt_utils_surrogate_key_null_"
SEPARATOR = "-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surrogate_key(*cols) -> Column:
    """md5 hex of the string forms joined by '-', NULL replaced by a token.

    ``coalesce`` comes before the concatenation because ``concat_ws`` would
    silently drop NULLs and merge distinct keys.
    """
    parts = [F.coalesce(_c(c).cast("string"), F.lit(NULL_TOKEN)) for c in cols]
    return F.md5(parts[0] if len(parts) == 1 else F.concat_ws(SEPARATOR, *parts))


def strip_unicode(c) -> Column:
    """Remove leading/trailing whitespace of any kind (Python ``str.strip``)."""
    return F.regexp_replace(_c(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def mask_hash(c) -> Column:
    """sha256 hex of lower(strip(value)); NULL stays NULL."""
    return F.sha2(F.lower(strip_unicode(c)), 256)
