"""Column expressions on hashes and content-derived ids."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: UUID, name: Column) -> Column:
    """Name-based UUID (version 5), the same as uuid.uuid5 gives, from SQL functions alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def pseudo_vector(text: Column, dim: int) -> Column:
    """array<double> in [-1, 1] derived from the text: bytes of SHA-256 over numbered blocks, byte / 255 * 2 - 1."""
    blocks = [F.sha2(F.concat(F.lit(f"{b}:"), text), 256) for b in range(-(-dim // 32))]
    digits = F.concat(*blocks)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
