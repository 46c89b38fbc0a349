"""Hashes, fingerprints and their distances as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

US = "\x1f"
# The published 64-bit FNV-1a start, as two 32-bit limbs; the prime is 2^40 + 435.
_START_HI, _START_LO, _PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_LOW32 = 0xFFFFFFFF


def idempotency_key(*parts: Column) -> Column:
    """SHA-256 of the parts, nulls as empty, joined by the unit separator."""
    return F.sha2(F.concat_ws(US, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def shard_index(key: Column, shards: int = 64) -> Column:
    """First four bytes of the key's SHA-256 as a number, modulo ``shards``."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")


def user_shard(email: Column) -> Column:
    """URL-safe base64 of the SHA-256 of an address, lower case and trimmed."""
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(F.lower(F.trim(email)), 256))), "+/=", "-_"))


def retry_delay(attempt: Column, key: Column, base: int = 500, cap: int = 30_000) -> Column:
    """Milliseconds to wait: doubling from ``base`` up to ``cap``, and up to a fifth more by the hash of ``key``, so that a retry can be repeated."""
    plain = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.greatest(F.lit(0), attempt), F.lit(40))))
    share = F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(1000)) / 1000
    return (plain + F.floor(plain * 0.2 * share)).cast("bigint")


def fnv1a(text: Column) -> Column:
    """struct(hi, lo): 64-bit FNV-1a of a text's UTF-8 bytes as unsigned 32-bit limbs.

    Products of limbs stay below 2^41, so nothing overflows under ANSI arithmetic.
    """
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, at: Column) -> Column:
        x = acc["lo"].bitwiseXOR(F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("bigint"))
        low = x * _PRIME_LOW
        high = acc["hi"] * _PRIME_LOW + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(_LOW32)).alias("hi"), low.bitwiseAND(F.lit(_LOW32)).alias("lo"))

    return F.aggregate(places, F.struct(F.lit(_START_HI).cast("bigint").alias("hi"), F.lit(_START_LO).cast("bigint").alias("lo")), step)


def hex64(hi: Column, lo: Column) -> Column:
    """Sixteen digits of two unsigned limbs."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 8, "0"), F.lpad(F.hex(lo), 8, "0")))


def limbs(text: Column) -> tuple[Column, Column]:
    """(hi, lo) of a hexadecimal text with or without ``0x``; 0 where it is none."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    padded = F.when(bare.rlike("^[0-9a-f]{1,16}$"), F.lpad(bare, 16, "0")).otherwise(F.lit("0" * 16))
    one = lambda at: F.conv(F.substring(padded, at, 8), 16, 10).cast("bigint")
    return one(1), one(9)


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return (F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))).cast("int")


def _fnv(token: str, known: dict[str, int]) -> int:
    h = known.get(token)
    if h is None:
        h = _START_HI << 32 | _START_LO
        for byte in token.encode():
            h = (h ^ byte) * ((1 << 40) + _PRIME_LOW) & 0xFFFFFFFFFFFFFFFF
        if len(known) >= 200_000:
            known.clear()
        known[token] = h
    return h


def _by_document(df: DataFrame, key: str, tokens: Column, make, ddl: str) -> DataFrame:
    """Rows that ``make(hashes)`` gives for the FNV hashes of each document's tokens, in Arrow batches.

    A document is hashed where it is: no token is shuffled, so that none is a hot key. Workers remember a bounded number.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known: dict[str, int] = {}
        for batch in batches:
            made = [make(np.array([_fnv(t, known) for t in row or ()], np.uint64)) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * len(types), types))], [key, *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    names, types = schema.names, schema.types
    return df.select(key, tokens.alias("__tokens")).mapInArrow(run, f"`{key}` {kind}, {ddl}")


def simhash(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, sim_hi, sim_lo): a bit is set where more of a document's tokens have it than not; 0 without tokens."""

    def make(hashes):
        import numpy as np

        if not len(hashes):
            return 0, 0
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word = int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes), bitorder="little").view("<u8")[0])
        return word >> 32, word & _LOW32

    return _by_document(df, key, tokens, make, "sim_hi bigint, sim_lo bigint")


def hashed_embedding(df: DataFrame, key: str, tokens: Column, size: int = 64) -> DataFrame:
    """(key, place, value): hashed bag of tokens with signs from the top bit, scaled to length 1; zeros left out."""

    def make(hashes):
        import numpy as np

        sums = np.bincount((hashes % np.uint64(size)).astype(np.int64), 1.0 - 2.0 * (hashes >> np.uint64(63)).astype(float), size)
        at = np.flatnonzero(sums)
        norm = float(np.sqrt((sums * sums).sum())) or 1.0
        return ([{"place": int(i), "value": float(sums[i] / norm)} for i in at],)

    return _by_document(df, key, tokens, make, "cells array<struct<place:int,value:double>>").select(key, F.inline("cells"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token lists as sets, 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)
