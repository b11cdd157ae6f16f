"""Repeatable random numbers from hashes, so a lost task redraws the same values."""

import math

from pyspark.sql import functions as F


def uniform(*parts):
    """Uniform in [0, 1) from the first 32 bits of an MD5 over the parts."""
    text = F.concat_ws("|", *[p.cast("string") if hasattr(p, "cast") else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts):
    """Standard normal by Box-Muller on two uniforms."""
    u1 = F.greatest(uniform(*parts, "a"), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * uniform(*parts, "b"))


def sql_uniform(*parts):
    """The same draw as DuckDB text."""
    return f"(('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,8))::BIGINT/4294967296.0)"


def sql_normal(*parts):
    return (f"(sqrt(-2.0*ln(greatest({sql_uniform(*parts, chr(39)+'a'+chr(39))},1e-12)))"
            f"*cos({2 * math.pi!r}*{sql_uniform(*parts, chr(39)+'b'+chr(39))}))")
