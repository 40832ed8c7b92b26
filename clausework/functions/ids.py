"""Engine-independent identifiers and digests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_id(prefix: str, *parts) -> Column:
    """``prefix-`` plus 16 hex digits of the SHA-1 of the newline-joined parts, null as empty."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(F.concat_ws("\n", *cols)), 1, 16))


def sha256(col) -> Column:
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


def hash_fraction(col) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of a SHA-256 digest."""
    return F.conv(F.substring(sha256(col), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
