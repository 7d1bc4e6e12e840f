"""Column-expression helpers shared by the operators.

All of these are plain Catalyst expressions (JVM side, whole-stage codegen);
``*_sql`` twins render the same arithmetic as ANSI SQL text so that an
independent engine can check results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knuth's multiplicative hashing constant and the 32-bit modulus.
HASH_MULT = 2654435761
HASH_MOD = 4294967296


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def id_hash(c: str | Column, salt: int = 0) -> Column:
    """``(id * 2654435761) mod 2^32`` without 64-bit overflow for any BIGINT id.

    The id is folded to 32 bits and multiplied in 16-bit halves, so the
    intermediate stays below 2^49.  ``salt`` re-hashes ``h + salt``.
    """
    a = F.pmod(col_(c).cast("long"), F.lit(HASH_MOD))
    lo = F.pmod(a, F.lit(65536))
    hi = F.floor(a / F.lit(65536)).cast("long")
    h = F.pmod(lo * F.lit(HASH_MULT) + F.pmod(hi * F.lit(HASH_MULT), F.lit(HASH_MOD)) * F.lit(65536),
               F.lit(HASH_MOD))
    if salt:
        return id_hash(h + F.lit(int(salt)))
    return h


def id_hash_sql(expr: str, salt: int = 0) -> str:
    """DuckDB/ANSI twin of :func:`id_hash`."""
    a = f"((({expr}) % {HASH_MOD} + {HASH_MOD}) % {HASH_MOD})"
    h = (f"((({a} % 65536) * {HASH_MULT} + ((({a} // 65536) * {HASH_MULT}) % {HASH_MOD}) * 65536)"
         f" % {HASH_MOD})")
    if salt:
        return id_hash_sql(f"{h} + {int(salt)}")
    return h


def class_list(df, col: str) -> Column:
    """All distinct values of ``col`` as one array literal (a class list: one value for each class)."""
    kind = df.schema[col].dataType
    values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())
    return F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind.simpleString()}>")


def r6(c: str | Column, name: str | None = None) -> Column:
    out = F.round(col_(c), 6)
    return out.alias(name) if name else out


def nonfinite_to_null(c: str | Column) -> Column:
    """NaN and +/-Inf become NULL (the engine's single missing marker)."""
    x = col_(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two numeric arrays, accumulated in double."""
    return F.aggregate(
        F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


# Wichura's AS241 (PPND16) coefficients for the inverse normal CDF.
_AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
            1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
            3.3430575583588128105e4, 2.5090809287301226727e3]
_AS241_B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
            5.2264952788528545610e3]
_AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
            3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
            2.27238449892691845833e-2, 7.74545014278341407640e-4]
_AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
            1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
            1.05075007164441684324e-9]
_AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
            2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
            2.71155556874348757815e-5, 2.01033439929228813265e-7]
_AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
            2.04426310338993978564e-15]


def _poly(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + F.lit(c)
    return out


def inv_norm_cdf(p: str | Column) -> Column:
    """Inverse standard-normal CDF as column math (AS241, ~1e-16 relative).

    Spark SQL has no ``erf``/``probit``; this keeps the map JVM-side.
    ``p`` outside (0, 1) gives +/-inf, NULL stays NULL.
    """
    p = col_(p).cast("double")
    q = p - F.lit(0.5)
    central = q * _poly(_AS241_A, F.lit(0.180625) - q * q) / _poly(_AS241_B, F.lit(0.180625) - q * q)
    r = F.least(p, F.lit(1.0) - p)
    rr = F.sqrt(-F.log(F.greatest(r, F.lit(1e-300))))
    near = _poly(_AS241_C, rr - F.lit(1.6)) / _poly(_AS241_D, rr - F.lit(1.6))
    far = _poly(_AS241_E, rr - F.lit(5.0)) / _poly(_AS241_F, rr - F.lit(5.0))
    tail = F.when(rr <= F.lit(5.0), near).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    out = F.when(F.abs(q) <= F.lit(0.425), central).otherwise(tail)
    out = F.when(p <= 0, F.lit(-math.inf)).when(p >= 1, F.lit(math.inf)).otherwise(out)
    return F.when(p.isNull(), F.lit(None).cast("double")).otherwise(out)
