from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_table(spark, rows, extra: str = ""):
    """Documents from (doc_id, text) pairs, with the other columns null and clashing ones on request."""
    names = [n for n in extra.split() if n]
    schema = ", ".join([DOCS, *(f"`{n}` string" for n in names)])
    return spark.createDataFrame([(i, t, None, None, None, *["x"] * len(names)) for i, t in rows], schema)


def groups_of(n: int, links) -> list[int]:
    """Smallest member of each one's group."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def stored_tables(spark, folder: str, **tables) -> str:
    """Tables written as a folder of Parquet files, the way queries and stages read them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return folder
