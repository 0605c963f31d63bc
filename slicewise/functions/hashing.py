"""Hash-derived columns: buckets, sort keys, 64-bit scores and opaque identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def sha(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes; hex order is digest order."""
    return F.sha2(text.cast("binary"), 256)


def bucket(text: Column, size: int = 1000) -> Column:
    """0..size-1 from the first 32 bits of the digest."""
    return (F.conv(F.substring(sha(text), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def u64(text: Column) -> Column:
    """The first 8 digest bytes as an unsigned number; DECIMAL, for BIGINT overflows."""
    return F.conv(F.substring(sha(text), 1, 16), 16, 10).cast(U64)


def u63(text: Column) -> Column:
    """``u64`` without its highest bit."""
    return (u64(text) % F.lit(str(2**63)).cast(U64)).cast("bigint")


def joined(*parts) -> Column:
    """The parts with ``|`` between them."""
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def slot_set_digest(slots: Column) -> Column:
    """Digest of sorted slot ids joined by line feeds."""
    return sha(F.array_join(F.array_sort(slots), "\n"))


# Namespaces that go into digests.
CANDIDATE_SPACE = "exp009-attribution-candidate-v1"
RANDOM_SPACE = "mrf-m4-random-v1"
SWAP_SPACE = "exp009-pilot-symmetric-label-swap-v1"
REFRESH_SPACE = "exp009-pilot-balanced-cross-intent-refresh-v1"
TRAJECTORY_SPACE = "exp009-stochastic-counterfactual-certification-v1"
ROOT_SPACE = "exp009-matched-root-v1"


def opaque_candidate(slots: Column) -> Column:
    return F.concat(F.lit("candidate_"), F.substring(sha(F.concat(F.lit(CANDIDATE_SPACE + "\n"), F.array_join(F.array_sort(slots), "\n"))), 1, 12))


def opaque_record(seed: Column, *parts) -> Column:
    """``rec_`` and 16 digits of the digest of ``seed:part:…``."""
    return F.concat(F.lit("rec_"), F.substring(sha(F.concat_ws(":", seed.cast("string"), *[p.cast("string") for p in parts])), 1, 16))
