"""Best-window similarity of a key and a page (J5, F6, A14): the one linkage function Spark has no expression for.

The ratio is that of Python's difflib, which is not symmetric: the key is the first sequence, the window the second.
Pairs whose page contains the key are decided by `contains` outside, and no text of theirs goes to Python. Windows are bounded by
their shared letters before the ratio is taken, which is exact: a ratio can't exceed that bound.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

RESULT = StructType().add("score", DoubleType()).add("occurrence", StringType())


def best_window(key: str, page: str) -> tuple[float, str]:
    """Highest ratio of the key with a window of its length, rounded to 6 places, and the first such window."""
    if not key or not page:
        return 0.0, ""
    if key in page:
        return 1.0, key
    n = len(key)
    if len(page) <= n:
        return round(SequenceMatcher(None, key, page).ratio(), 6), page
    want = Counter(key)
    have = Counter(page[:n])
    shared = sum((want & have).values())
    best, where = 0.0, page[:n]
    for at in range(len(page) - n + 1):
        if at:
            gone, come = page[at - 1], page[at + n - 1]
            if gone != come:
                have[gone] -= 1
                shared -= have[gone] < want[gone]
                shared += have[come] < want[come]
                have[come] += 1
        if shared / n > best:  # 2 * shared / (n + n) bounds the ratio
            ratio = SequenceMatcher(None, key, page[at : at + n]).ratio()
            if ratio > best:
                best, where = ratio, page[at : at + n]
                if ratio >= 0.999:
                    break
    return round(best, 6), where


@F.pandas_udf(RESULT)
def _windows(keys: pd.Series, pages: pd.Series) -> pd.DataFrame:
    seen: dict[tuple[str, str], tuple[float, str]] = {}
    out = []
    for pair in zip(keys, pages, strict=True):
        if pair not in seen:
            seen[pair] = best_window(*(x if isinstance(x, str) else "" for x in pair))
        out.append(seen[pair])
    return pd.DataFrame(out, columns=["score", "occurrence"])


def window_similarity(key: Column, page: Column) -> Column:
    """struct(score, occurrence) of a compact key in a compact page; nulls count as empty."""
    k, p = F.coalesce(key, F.lit("")), F.coalesce(page, F.lit(""))
    empty, found = (k == "") | (p == ""), F.contains(p, k)
    # Spark evaluates a Python function for every row, so rows that need none give it nulls
    open_ = ~empty & ~found
    settled = lambda score, text: F.struct(F.lit(score).alias("score"), text.alias("occurrence"))
    return F.when(empty, settled(0.0, F.lit(""))).when(found, settled(1.0, k)).otherwise(_windows(F.when(open_, k), F.when(open_, p)))
