"""Seeded random numbers as a function of the row key.

The draw depends only on seed, salt and key, so it is the same for every partitioning, retry
and engine that has MD5.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _hash_sql(seed, salt: str, key: str) -> str:
    # one SQL text instead of a dozen column calls: draws are built often and in numbers
    name = "`" + key.replace("`", "``") + "`"
    prefix = f"{seed}:{salt}:".replace("\\", "\\\\").replace("'", "\\'")
    return f"cast(conv(substring(md5(concat('{prefix}', cast({name} as string))), 1, 8), 16, 10) as bigint)"


def _uniform_sql(seed, salt: str, key: str) -> str:
    return f"(({_hash_sql(seed, salt, key)} + 0.5d) / {TWO_32}d)"


def hash32(seed, salt: str, key: str) -> Column:
    """Unsigned 32-bit integer drawn from ``seed:salt:<value of the key column>``."""
    return F.expr(_hash_sql(seed, salt, key))


def uniform(seed, salt: str, key: str) -> Column:
    """Uniform draw strictly between 0 and 1."""
    return F.expr(_uniform_sql(seed, salt, key))


def normal(seed, salt: str, key: str) -> Column:
    """Standard normal draw (Box-Muller on two uniforms)."""
    u1, u2 = _uniform_sql(seed, salt + "/a", key), _uniform_sql(seed, salt + "/b", key)
    return F.expr(f"sqrt(-2d * ln({u1})) * cos({2.0 * math.pi!r}d * {u2})")


def uniform_scalar(seed, salt, key) -> float:
    """Driver twin of :func:`uniform` for choices among a few columns."""
    digest = hashlib.md5(f"{seed}:{salt}:{key}".encode()).hexdigest()
    return (int(digest[:8], 16) + 0.5) / TWO_32
