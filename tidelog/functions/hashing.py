"""SeaHash over Arrow batches, and what is addressed by it: natural keys and shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidelog.shipping import ship

# Fixed values of the hash function: its multiplier and its default seeds.
MULTIPLIER = 0x6EED0E9DA4D94A4F
SEEDS = (0x16F11FE89B0D677C, 0xB480A793D8E6C86C, 0x6FE2E5AAF078EBC9, 0x14F994A4C5259381)
DEFAULT_SHARDS = 64
# Fixed values that keep the identities of functions and of containers apart.
FUNCTION_DOMAIN = 0xF7A511D30C4B9E21
CONTAINER_DOMAIN = 0xC017A1E55D0C7A9B


def _diffuse(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(MULTIPLIER)
    x = x ^ ((x >> np.uint64(32)) >> (x >> np.uint64(60)))
    return x * np.uint64(MULTIPLIER)


def seahash_all(values: list[bytes], seeds: tuple[int, int, int, int] = SEEDS) -> np.ndarray:
    """The hash of each value, as uint64.

    Values of like lengths are hashed together and padded to at most twice their own, so
    that one long value takes no more room than its own bytes do.
    """
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    like = np.frexp(-(-sizes // 8))[1]
    out = np.empty(len(values), dtype=np.uint64)
    for length in np.unique(like):
        at = np.flatnonzero(like == length)
        out[at] = _seahash_padded([values[i] for i in at], sizes[at], seeds)
    return out


def _seahash_padded(values: list[bytes], sizes: np.ndarray, seeds: tuple[int, int, int, int]) -> np.ndarray:
    """Eight bytes of all values at a time."""
    n, words = len(values), int(-(-sizes.max(initial=0) // 8))
    raw = np.zeros((n, max(1, words) * 8), dtype=np.uint8)
    raw[np.arange(raw.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(values), dtype=np.uint8)
    blocks = raw.view("<u8")
    lanes = [np.full(n, s, dtype=np.uint64) for s in seeds]
    with np.errstate(over="ignore"):
        for k in range(words):
            has = sizes > 8 * k
            new = _diffuse(lanes[0] ^ blocks[:, k])
            for i, value in enumerate((lanes[1], lanes[2], lanes[3], new)):
                lanes[i] = np.where(has, value, lanes[i])
        return _diffuse(lanes[0] ^ lanes[1] ^ lanes[2] ^ lanes[3] ^ sizes.astype(np.uint64))


def seahash(value: Column) -> Column:
    """The hash of a binary column, as the signed long of the same bits; null for null."""

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        some = values.notna()
        out = pd.Series([None] * len(values), dtype="Int64", index=values.index)
        if some.any():
            out[some] = seahash_all([bytes(v) for v in values[some]]).view(np.int64)
        return out

    ship(SparkSession.active())
    return hashed(value)


def _little_endian(value: Column, width: int) -> Column:
    """The low ``width`` bytes of a long, lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(width)]))


def wire_string(text: Column) -> Column:
    """A string as natural keys see it: its length in four bytes, lowest first, then UTF-8."""
    return F.concat(_little_endian(F.octet_length(text).cast("long"), 4), F.encode(text, "UTF-8"))


def natural_key(*fields: Column) -> Column:
    """Hash of the concatenated bytes of string key fields."""
    return seahash(F.concat(*[wire_string(f) for f in fields]))


def collection_owner(key: Column, flag: Column, salt: Column) -> Column:
    """The ten bytes that place a collection: key, then flag and salt."""
    lower = F.shiftleft(flag.cast("long"), 15).bitwiseOR(salt.cast("long"))
    return F.concat(_little_endian(key.cast("long"), 8), _little_endian(lower, 2))


def unique_owner(tenant: Column, struct_hash: Column) -> Column:
    """The fourteen bytes that place a tenant's unique record."""
    return F.concat(_little_endian(tenant.cast("long"), 6), _little_endian(struct_hash.cast("long"), 8))


def shard(owner: Column, shards: int = DEFAULT_SHARDS) -> Column:
    """The shard of an owner's bytes: the unsigned hash modulo the number of shards."""
    if shards <= 1:
        return F.lit(0)
    h = seahash(owner)
    # 2**64 mod shards is added for hashes whose sign bit is set
    return F.pmod(F.pmod(h, F.lit(shards)) + F.when(h < 0, (1 << 64) % shards).otherwise(0), F.lit(shards)).cast("int")


def lane(tag: str, struct_hash: Column) -> Column:
    """The hash that names a lane of a type: its tag, then the type's hash."""
    return seahash(F.concat(F.encode(F.lit(tag), "UTF-8"), _little_endian(struct_hash.cast("long"), 8)))


def struct_hash(name: str, shape: str, fields: list[tuple[str, str]], seeds: tuple[int, int, int, int] = SEEDS) -> int:
    """The identity of a record type: a change of any field is another type."""
    spelled = "|".join([name, shape, *(f"{f}:{kind}" for f, kind in fields)])
    return int(seahash_all([spelled.encode()], seeds)[0])


def _fold(*words: int) -> int:
    return int(seahash_all([np.array(words, dtype="<u8").tobytes()])[0])


def compose(seed: int, parts: list[int]) -> int:
    """The identity of a function: the hash of its name, then the tags of its arguments and of its result, in order."""
    return _fold(FUNCTION_DOMAIN, seed, *parts)


def container(kind: int, element: int) -> int:
    """The tag of a container of elements of a tag."""
    return _fold(CONTAINER_DOMAIN, kind, element)


def text_hash(text: str) -> int:
    return int(seahash_all([text.encode()])[0])
