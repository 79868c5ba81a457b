"""Unified diffs as tables of changed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, line) of the added lines in diffs (diff_id, diff).

    Every line that starts '--- ' or '+++ ' is a header, whatever it stands
    for; /dev/null keeps the file before. Lines count from a hunk's new start,
    or from 0 without one; removed lines and backslash lines don't count.
    Nothing counts before the first file.
    """
    rows = diffs.select("diff_id", F.posexplode(F.split("diff", "\n")).alias("pos", "text"))
    header = F.col("text").startswith("--- ") | F.col("text").startswith("+++ ")
    name = F.regexp_replace(F.substring_index(F.substring("text", 5, 1 << 30), "\t", 1), "^[ab]/", "")
    hunk = ~header & F.col("text").rlike(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@")
    added = ~header & F.col("text").startswith("+") & ~F.col("text").startswith("+++")
    removed = ~header & F.col("text").startswith("-") & ~F.col("text").startswith("---")
    other = ~header & ~F.col("text").startswith("@@") & ~added & ~removed & ~F.col("text").startswith("\\")
    w = Window.partitionBy("diff_id").orderBy("pos")
    rows = rows.select(
        "diff_id", "pos", F.when(header & (name != "/dev/null"), name).alias("name"),
        F.when(hunk, F.regexp_extract("text", r"\+(\d+)", 1).cast("int")).alias("start"), added.alias("added"), (added | other).alias("counts"))
    rows = rows.withColumn("path", F.last("name", ignorenulls=True).over(w)).where("path IS NOT NULL")
    # a hunk header before the first file sets nothing
    rows = rows.withColumn("hunk", F.count("start").over(w))
    v = Window.partitionBy("diff_id", "hunk").orderBy("pos")
    rows = rows.withColumn("first", F.coalesce(F.max("start").over(Window.partitionBy("diff_id", "hunk")), F.lit(0)))
    line = F.col("first") + F.sum(F.col("counts").cast("int")).over(v) - 1
    return rows.withColumn("line", line).where("added").select("diff_id", "path", F.col("line").cast("int").alias("line")).distinct()
