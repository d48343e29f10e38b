"""Stable ids from names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_id(name: Column) -> Column:
    """60 bits of the MD5 of the lower-case name; 0 becomes 1.  The tenant is no part of it."""
    raw = F.conv(F.substring(F.md5(F.lower(name).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.when(raw == 0, F.lit(1).cast("long")).otherwise(raw)


def document_key(text: Column) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number (DECIMAL, as it may pass 2**63); 0 becomes 1."""
    raw = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(raw == 0, F.lit(1).cast("decimal(20,0)")).otherwise(raw)


def tenant_label(tenant: Column) -> Column:
    """``t`` and sixteen hex digits."""
    return F.concat(F.lit("t"), F.lpad(F.lower(F.hex(tenant)), 16, "0"))
