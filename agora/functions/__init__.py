"""Column-level helpers (all built-in expressions; no Python UDFs)."""

from .keys import surrogate_key, mask_hash
from .dates import day_diff, month_start
from .classify import customer_segment

__all__ = ["surrogate_key", "mask_hash", "day_diff", "month_start", "customer_segment"]
