"""Score mappings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed display cut-offs.
MISS_BELOW = 0.2
MAKE_FROM = 0.6


def remap(raw: Column, lo: Column, hi: Column) -> Column:
    """Monotone map with lo -> 0.2, hi -> 0.6 and 1 -> 1."""
    low = F.when(lo > 0, MISS_BELOW * raw / lo).otherwise(0.0)
    mid = MISS_BELOW + (MAKE_FROM - MISS_BELOW) * (raw - lo) / (hi - lo)
    high = F.when(hi < 1, MAKE_FROM + (1 - MAKE_FROM) * (raw - hi) / (1 - hi)).otherwise(1.0)
    return F.when(raw < lo, low).when(raw < hi, mid).otherwise(high)


def ai_score(rating: Column, score: Column) -> Column:
    """Highlight score from a rating struct of strings; junk numbers fall back to 4, 2 and 2."""
    num = lambda f, d: F.coalesce(rating[f].try_cast("double"), F.lit(float(d)))
    rated = num("highlight_score", 4) + 0.25 * (num("difficulty", 2) + num("athleticism", 2) - 4)
    warm = F.when(rating["game_context"].eqNullSafe("warm_up"), 1.0).otherwise(0.0)
    return F.when(rating.isNull(), 4.0 + 2.0 * score).otherwise(F.round(rated - warm + 0.5 * score, 3))
