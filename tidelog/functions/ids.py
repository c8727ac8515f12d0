"""Record ids: a struct (key, tenant, flag, salt) that sorts as the 128-bit id does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SALT_MASK = 0x7FFF


def record_id(key: Column, tenant: Column, flag: Column, salt: Column) -> Column:
    return F.struct(
        key.cast("long").alias("key"), tenant.cast("long").alias("tenant"), flag.cast("int").alias("flag"), salt.cast("int").alias("salt")
    )


def low_half(tenant: Column, flag: Column, salt: Column) -> Column:
    """The id's lower 64 bits: tenant, one bit of flag, 15 bits of salt."""
    return F.shiftleft(tenant.cast("long"), 16).bitwiseOR(F.shiftleft(flag.cast("long"), 15)).bitwiseOR(salt.cast("long"))


def tenant_of(low: Column) -> Column:
    return F.shiftrightunsigned(low, 16)


def type_salt(struct_hash: Column) -> Column:
    """The 15 bits of a type's hash that go into the ids of its records."""
    return struct_hash.bitwiseAND(SALT_MASK)


def key_nanos(nanos: Column, count: Column) -> Column:
    """A key of the clock's millisecond in nanoseconds, its last six digits a running number, so that keys made within one differ."""
    million = F.lit(1_000_000).cast("long")
    return nanos - F.pmod(nanos, million) + F.pmod(count, million)


def successor(prefix: Column) -> Column:
    """The least key above all keys that begin with a binary prefix; null if there is none (no byte, or only FF)."""
    kept = F.regexp_extract(F.hex(prefix), "^((?:..)*?)(?:FF)*$", 1)
    last = F.conv(F.right(kept, F.lit(2)), 16, 10).cast("int") + 1
    raised = F.concat(F.substring(kept, F.lit(1), F.length(kept) - 2), F.lpad(F.hex(last), 2, "0"))
    return F.when(F.length(kept) > 0, F.unhex(raised))


def archive_id(instant: Column, tenant: Column, flag: Column, struct_hash: Column) -> Column:
    """Where the version authored at an instant is archived: the flag is turned over."""
    return record_id(instant, tenant, 1 - flag.cast("int"), type_salt(struct_hash))
