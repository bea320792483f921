"""Bit arithmetic of the membership filters, all on BIGINT words.

A filter is a set of rows (bucket, bits): 64 bits per row. Such rows are built
with the `bit_or` aggregate, which runs as a hash aggregate with map-side
combine, and tested with shifts, so both stay inside generated code. A sparse
filter costs one row per id and a dense one a row per 64 ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64
BITS_PER_PROBE = 6  # log2(WORD_BITS)
MAX_PROBES = 10  # six-bit pieces in one 64-bit hash
PROBE_SEED = 977  # any value; keeps the bit hash apart from the bucket hash


def exact_bucket(key: Column) -> Column:
    return F.shiftright(key, BITS_PER_PROBE)


def exact_mask(key: Column) -> Column:
    return _bit(key)


def _bit(number: Column) -> Column:
    """The word with one bit set: the one numbered by the lowest six bits."""
    return F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    )


def bloom_bucket(key: Column, n_buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), n_buckets)


def bloom_mask(key: Column, n_probes: Column) -> Column:
    """`n_probes` bits of one word, chosen by a second hash of the key."""
    pieces = F.xxhash64(F.lit(PROBE_SEED), key)
    mask = _bit(pieces)
    for i in range(1, MAX_PROBES):
        bit = _bit(F.shiftrightunsigned(pieces, BITS_PER_PROBE * i))
        mask = mask.bitwiseOR(F.when(n_probes > i, bit).otherwise(F.lit(0).cast("bigint")))
    return mask


def holds(bits: Column, mask: Column) -> Column:
    """All bits of `mask` are set in `bits`."""
    return bits.bitwiseAND(mask) == mask


def _false_positive_rate(bits_per_key: float, n_probes: int) -> float:
    # Keys spread over the words as a Poisson variable; a foreign key passes
    # a word of i keys if each of its bits was hit by one of i * n_probes draws.
    mean = WORD_BITS / bits_per_key
    weight, rate = math.exp(-mean), 0.0
    for i in range(0, int(mean + 20 * math.sqrt(mean) + 40)):
        hit = 1.0 - (1.0 - 1.0 / WORD_BITS) ** (n_probes * i)
        rate += weight * hit**n_probes
        weight *= mean / (i + 1)
    return rate


def bloom_shape(fpp: float) -> tuple[float, int]:
    """Smallest bits per key, with its number of probes, that meets `fpp`."""
    if not 0.0 < fpp < 1.0:
        raise ValueError("fpp must lie between 0 and 1")
    bits_per_key = 1.0
    while bits_per_key <= 4096:
        best = min(range(1, MAX_PROBES + 1), key=lambda k: _false_positive_rate(bits_per_key, k))
        if _false_positive_rate(bits_per_key, best) <= fpp:
            return bits_per_key, best
        bits_per_key *= 1.05
    raise ValueError(f"no filter of this kind reaches fpp={fpp}; build an exact one")
