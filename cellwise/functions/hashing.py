"""Column expressions of stable hashes: the same on every machine and in any SQL engine with sha256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_prefix_number(key: Column, digits: int = 8) -> Column:
    """The first hex digits of sha256(key as text) as a number (up to 15 digits)."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, digits), 16, 10).cast("long")


def hash_modulo(key: Column, n: int) -> Column:
    """hex_prefix_number(key) mod n: the city split is this with n = 3, where 0 is held back."""
    return F.pmod(hex_prefix_number(key), F.lit(n))


def hash_fraction(key: Column) -> Column:
    """A number in [0, 1) from the first 8 bytes of sha256(key), read with the least significant byte first."""
    digest = F.substring(F.sha2(key.cast("string"), 256), 1, 16)
    swapped = F.concat(*(F.substring(digest, 2 * i + 1, 2) for i in reversed(range(8))))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Text to order by for a reproducible shuffle: sha256 of seed and keys."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256)
