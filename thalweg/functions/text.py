"""Short texts and checks of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def abbreviated(ids: Column, limit: int = 15, braces: bool = False) -> Column:
    """Ids as text; of more than ``limit`` only the first and last, with dots between (the odd one goes to the front)."""
    back = limit // 2
    words = F.transform(ids, lambda x: x.cast("string"))
    cut = F.concat(F.slice(words, 1, limit - back), F.array(F.lit("...")), F.slice(words, -back, back) if back else F.array().cast("array<string>"))
    inner = F.array_join(F.when(F.size(words) <= limit, words).otherwise(cut), ", ")
    return F.concat(F.lit("{" if braces else "["), inner, F.lit("}" if braces else "]"))


def require_location_frame(df: DataFrame, link: str | None = "link") -> bool:
    """True, or ValueError if ``df`` isn't what locating gives: ``segnum``, ``seg_ndist`` and links of two points or none."""
    for name in ("segnum", "seg_ndist"):
        if name not in df.columns:
            raise ValueError(f"loc_df must have {name!r} column; was it created by locate?")
    if link is not None:
        if link not in df.columns:
            raise TypeError("loc_df must have a geometry column")
        if df.where(~F.coalesce(F.size(link), F.lit(0)).isin(0, 2)).limit(1).count():
            raise ValueError("geometry expected to only have two coordinates")
    return True
