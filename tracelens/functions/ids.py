"""Content addresses: SHA-256 names and base-32 ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"  # fixed value: base 32 without I, L, O, U


def chunk_id(tenant: Column, doc: Column, ordinal: Column, text: Column) -> Column:
    return F.concat(F.lit("c_"), F.substring(F.sha2(F.concat_ws("\x1f", tenant, doc, ordinal.cast("string"), text), 256), 1, 16))


def base32(hexes: Column) -> Column:
    """26 characters for the first 128 bits of a hex digest."""
    bits = F.concat(F.lit("00"), *[F.lpad(F.conv(F.substring(hexes, 8 * i + 1, 8), 16, 2), 32, "0") for i in range(4)])
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    return F.concat(*[F.element_at(letters, F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1) for i in range(26)])


def content_id(*parts: Column) -> Column:
    """The id of something that these columns make up, 26 characters."""
    return base32(F.sha2(F.concat_ws("\x1f", *parts), 256))
