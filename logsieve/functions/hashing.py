"""Hash keys that give the same value on every run, cluster size and row order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_key(seed: str, key: Column | str) -> Column:
    """32 hex digits; ordering by it is a reproducible shuffle."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary"))


def md5_number(seed: str, key: Column | str) -> Column:
    """First 32 bits of the key as a long in [0, 2**32)."""
    return F.conv(F.substring(md5_key(seed, key), 1, 8), 16, 10).cast("long")
