"""Full-text search: an inverted index and BM25, and exact names before others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import stage

K1, B = 1.2, 0.75


def tokens(text):
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def bm25(docs: DataFrame, query: str, most: int = 20) -> DataFrame:
    """(id, score): the best documents for the query's terms; ties by id.

    Texts are cut once, into a table of lengths and of the query's terms found;
    only those are counted and shuffled.
    """
    # the query is cut where documents are
    wanted = F.array_distinct(tokens(F.lit(query)))
    t = stage(docs.select("id", tokens("text").alias("ts")).select("id", F.size("ts").alias("len"), F.filter("ts", lambda x: F.array_contains(wanted, x)).alias("hits")))
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    hits = t.where(F.size("hits") > 0).select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    # df has a row per query term, stats one row
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    return scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), "id").limit(most)


def named_first(hits: DataFrame, query: str, most: int) -> DataFrame:
    """hits (name, rank, ...) with exact names, or exact last parts of dotted ones, before the others."""
    q = query.lower()
    exact = (F.lower("name") == q) | (F.lower(F.substring_index("name", ".", -1)) == q)
    return hits.where(F.col("rank") <= max(3 * most, 30)).orderBy(exact.desc(), "rank").limit(most)


def symbol_search(symbols: DataFrame, query: str, kind: str | None = None, most: int = 20) -> DataFrame:
    """Symbols whose name contains query; exact ones first, short names before long, then by id."""
    q = query.lower()
    hit = symbols.where(F.contains(F.lower("name"), F.lit(q)))
    hit = hit.where(F.col("type") == kind) if kind else hit
    return hit.orderBy((F.lower("name") == q).desc(), F.length("name"), "id").limit(most).select("id", "name", "type", "path", "start_line")


def typed(symbols: DataFrame, returns: str | None = None, params: list[str] | None = None, most: int = 20) -> DataFrame:
    """(id, name) of symbols (id, name, signature) whose signature returns and takes what is asked for, whatever the case; short names first."""
    sig = F.lower("signature")
    taken = F.regexp_extract(sig, r"(?s)\((.*)\)", 1)
    given = F.regexp_extract(sig, r"(?s)\).*?->\s*(.*)$", 1)
    hit = symbols
    if returns:
        hit = hit.where(F.contains(given, F.lit(returns.lower())))
    for p in params or ():
        hit = hit.where(F.contains(taken, F.lit(p.lower())))
    return hit.orderBy(F.length("name"), "id").limit(most).select("id", "name")
