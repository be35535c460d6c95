"""The held-out fold and the draws of bounded samples, shared by the trained operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id counts as the empty text, so it is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def threshold(share: float) -> int:
    """The 64-bit hash below which, or at which, a share of all hashes lies; at least the least hash."""
    return min(2**63 - 1, max(-(2**63), int(share * 2.0**64) - 2**63))


def drawn(doc_id: Column, limit: Column, seed: int) -> Column:
    """Whether a row is in the sample: its id's 64-bit hash is at most limit, a threshold()."""
    return F.xxhash64(doc_id.cast("string"), F.lit(seed)) <= limit
