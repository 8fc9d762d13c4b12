"""Fingerprints and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET_HI, _OFFSET_LO = 0xCBF29CE4, 0x84222325  # fixed values of FNV-1a 64
_PRIME_LO = 0x1B3  # the prime is 2^40 + 0x1B3


def fnv1a64(c: Column) -> Column:
    """'fnv1a64:' and 16 hex digits over the UTF-8 bytes, in two halves of 32 bits so that no product overflows."""
    digits = F.hex(F.encode(c, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    octets = F.when(F.length(digits) > 0, F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    low32 = F.lit((1 << 32) - 1)

    def step(acc: Column, byte: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(byte)
        product = lo * _PRIME_LO
        # times 2^40: the low half moves 8 bits up into the high half
        hi = acc["hi"] * _PRIME_LO + F.shiftrightunsigned(product, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(hi.bitwiseAND(low32).alias("hi"), product.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(_OFFSET_HI).cast("bigint").alias("hi"), F.lit(_OFFSET_LO).cast("bigint").alias("lo"))
    return F.aggregate(octets, start, step, lambda a: F.concat(F.lit("fnv1a64:"), F.lpad(F.lower(F.hex(a["hi"])), 8, "0"), F.lpad(F.lower(F.hex(a["lo"])), 8, "0")))


def section_hash(lines: Column) -> Column:
    """Hash of an array of lines, each ended by a line feed."""
    text = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return F.regexp_replace(fnv1a64(text), ":", "-")


def joined_digest(*parts: Column) -> Column:
    """SHA-256 over parts joined by '|', null parts as ''."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fnv_digest(*parts: Column, more: Column | None = None) -> Column:
    """FNV-1a 64 over parts joined by '|' and then the items of an array, each after a '|': digests of proposals (predicate,
    subject, object, owner, evidence) and of chains (candidate, evidence). Null parts and items are left out."""
    none = F.array().cast("array<string>")
    return fnv1a64(F.array_join(F.concat(F.array(*parts), F.coalesce(more, none) if more is not None else none), "|"))


def pair_digest(left: Column, right: Column, contributions: Column) -> Column:
    """Digest of two ids and their contributions, an array of structs (id, family)."""
    return fnv_digest(left, right, more=F.transform(contributions, lambda x: F.concat(x["id"], F.lit(":"), x["family"])))


def pseudo_vector(text: Column, width: int) -> Column:
    """Deterministic stand-in for an embedding: element i is xxhash64(text, i) mapped to [0, 1). Values are our own."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.shiftrightunsigned(F.xxhash64(text, i), 11) / F.lit(float(1 << 53))).cast("float"))
