"""Column-expression helpers (all JVM-side built-ins)."""

from .scalar import (  # noqa: F401
    cents, clip, hash_normal, hash_uniform, is_finite, label, money,
)
