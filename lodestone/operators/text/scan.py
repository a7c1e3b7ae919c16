"""Scan search: every whitespace term has to be contained in some field; ranked by how well a field fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_search(docs: DataFrame, query: str, fields: list[str], doc: str = "doc", limit: int = 20) -> DataFrame:
    """doc, rank: the best field's rank is 2 where it equals the query, 1 where it starts with it, 0 where terms are contained."""
    terms = query.lower().split()
    if not 1 <= len(terms) <= 16:
        raise ValueError("a scan search takes 1 to 16 terms")
    lower = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    test = F.lit(True)
    for t in terms:
        some = F.lit(False)
        for c in lower.values():
            some = some | F.contains(c, F.lit(t))
        test = test & some
    whole = " ".join(terms)
    ranks = [F.when(c == whole, 2).when(F.startswith(c, F.lit(whole)), 1).otherwise(0) for c in lower.values()]
    rank = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return docs.where(test).select(F.col(doc).alias("doc"), rank.alias("rank")).orderBy(F.desc("rank"), F.asc("doc")).limit(limit)
