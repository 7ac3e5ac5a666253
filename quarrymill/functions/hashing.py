"""Identity and sampling hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column, prefix: str = "rec_", width: int = 20) -> Column:
    """A record's identity: prefix and the first hex digits of the SHA-256 of its canonical text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, width))


def _key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def split_unit(seed: int, group: Column) -> Column:
    """A number in [0, 1) from 32 bits of a group's hash; equal for all records of a group."""
    return F.conv(F.substring(F.sha2(_key(str(seed), group), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def unit_hash(seed: int, salt: str, key: Column) -> Column:
    """A number in [0, 1) from 64 bits of a record's hash, independent of what else is in the pool."""
    return F.conv(F.substring(F.sha2(_key(str(seed), salt, key), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def sample_order(seed: int, key: Column, salt: str = "") -> Column:
    """A string whose order is a fixed pseudo-random order of the keys."""
    return F.sha2(_key(str(seed), *([salt] if salt else []), key), 256)


def split_name(unit: Column, train: float = 0.8, val: float = 0.1) -> Column:
    return F.when(unit < train, "train").when(unit < train + val, "val").otherwise("test")
