"""Hashed byte n-gram features and bounded training samples for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def ngram_counts(raw: bytes, dims: int, sizes: tuple[int, ...] = (2, 3)) -> np.ndarray:
    """Counts of hashed byte n-grams, each n with its own half, third, ... of the dims."""
    part = dims // len(sizes)
    out = np.zeros(dims, np.float32)
    b = np.frombuffer(raw.translate(_LOWER), np.uint8).astype(np.uint32)
    for i, n in enumerate(sizes):
        if len(b) < n:
            continue
        code = b[:len(b) - n + 1].copy()
        for j in range(1, n):
            code *= np.uint32(257)
            code += b[j:len(b) - n + 1 + j]
        code *= np.uint32(2654435761)
        code >>= np.uint32(12)
        code %= np.uint32(part)
        out[i * part:(i + 1) * part] = np.bincount(code, minlength=part)
    return out


def bounded_sample(rows: DataFrame, key: Column, group: str, per_group: int) -> DataFrame:
    """About ``per_group`` rows of each value of ``group``, chosen by a hash of ``key``.

    The choice depends on the rows alone. The share of each group comes from its count; groups
    are the classes to be learned, so their counts are a small table.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    share = F.create_map(*[x for g, n in counts.items() for x in (
        F.lit(g), F.lit(min(1.0, per_group / n)))]) if counts else F.lit(None)
    unit = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if not counts:
        return rows.limit(0)
    return rows.filter(unit < share[F.col(group)]).limit(2 * per_group * len(counts))
