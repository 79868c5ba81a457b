"""Quality rules and a likelihood ratio over hashed n-grams, as column expressions alone.

Words and pairs of neighbouring words are hashed to buckets. Two multinomials
over the buckets are counted: of the whole corpus, and of trusted documents
(labelled as good). A document's score is the mean logarithm of their ratio
over its n-grams; it is kept if that is not below a threshold, which trusted
documents give that were set apart. Weights
are whole micro-nats, so sums are exact and the verdict is the same in any
order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labelled import held_out
from .sql import CRC_TABLE, crc32

#: Buckets of n-grams; n-grams that the corpus multinomial lends to the trusted one; trusted documents of the SQL, which stops there.
BUCKETS, LENT, TRUSTED = 65_536, 1000, 16_384
#: Of the trusted documents set apart, so many in a thousand may score below the threshold; one in APART is set apart.
PER_MILLE, APART = 5, 4
#: Fixed values of the base rules: the fewest words, the largest percentage of repeated ones, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
#: What separates words, and what counts as a symbol.
BLANK, SYMBOL = "[ \t-\r]", "[#*$%&|<>]"


def words(text: Column) -> Column:
    """The runs of characters without blanks, in order."""
    return F.array_remove(F.split(text, f"{BLANK}+"), "")


def number(word: Column) -> Column:
    return F.crc32(word.cast("binary"))


def paired(a: Column, b: Column, most: int) -> Column:
    """The bucket of two neighbours by their numbers."""
    return ((31 * a + b) % most).cast("int")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, words); a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("words", words(F.col("text")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, fits) of all documents labelled 1 outside the held-out fold; one in APART, by a hash, fits nothing."""
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL")
             .groupBy("doc_id").agg(F.max("y").alias("y")).where("y = 1").where(~held_out(F.col("doc_id"))))
    place = number(F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    return known.select("doc_id", (place % APART > 0).alias("fits"))


def weights(docs: DataFrame, trusted: DataFrame, most: int = BUCKETS, lent: int = LENT) -> DataFrame:
    """(bucket, raw, target, weight) of every bucket: n-grams of all documents, of trusted ones that fit, and micro-nats.

    All rows with a trusted id count. weight is ln((t + lent * p) / ((T + lent) * p))
    with p = (raw + 1) / (R + most): a bucket that neither has seen weighs as
    little as the corpus allows. Without trusted documents weights are 0.
    """
    # ids alone: Spark broadcasts them while they are few, and no text is shuffled then
    rows = _texts(docs).join(trusted.where("fits"), "doc_id", "left")
    pairs = rows.select("fits", F.inline(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), F.size("words")).alias("b"))))
    pairs = pairs.select("fits", number(F.col("a")).alias("a"), number(F.col("b")).alias("b"))
    grams = pairs.select("fits", F.explode(F.array((F.col("a") % most).cast("int"), paired(F.col("a"), F.col("b"), most))).alias("bucket")).where("bucket IS NOT NULL")
    counted = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("fits").alias("target"))
    every = docs.sparkSession.range(most).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    every = common.settle(every)  # as many rows as there are buckets
    sums = every.agg(F.sum("raw").alias("r"), F.sum("target").alias("t"))
    p = (F.col("raw") + 1) / (sums.select("r").scalar() + most)
    ratio = (F.col("target") + lent * p) / ((sums.select("t").scalar() + lent) * p)
    return every.withColumn("weight", F.round(F.log(ratio) * 1_000_000).cast("bigint"))


def repeated(texts: DataFrame, size: int = WINDOW) -> DataFrame:
    """texts (words, numbers, ...) with n_repeat_words: words in windows of `size` words that the text has twice or more.

    Windows are compared by hash first. Only texts in which two hashes agree
    sort their windows, by hash and by words, so no hash decides alone.
    """
    w, n = F.col("words"), F.col("numbers")
    hashes = F.when(F.size(n) >= size, F.transform(F.sequence(F.lit(0), F.size(n) - size), lambda i: F.xxhash64(*[n[i + k] for k in range(size)])))
    t = texts.withColumn("_hashes", hashes)
    h = F.col("_hashes")
    windows = F.transform(h, lambda x, i: F.struct(x.alias("h"), F.concat_ws(" ", F.slice(w, i + 1, size)).alias("t"), i.alias("i")))
    t = t.withColumn("_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(windows)))
    s = F.col("_sorted")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["t"] == y["t"]), F.lit(False))

    at = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
    t = t.withColumn("_at", F.sort_array(F.filter(at, lambda x: x.isNotNull())))
    p = F.col("_at")
    new = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate(new, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    return t.drop("_hashes", "_sorted", "_at")


def scored(docs: DataFrame, found: DataFrame, most: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, n_grams) of each row; found has the weights."""
    listed = found.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("w"))
    text, n = F.col("text"), F.col("numbers")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(BLANK.replace("[", "[^")))
    pairs = F.greatest(F.size(n) - 1, F.lit(0))
    grams = F.concat(F.transform(n, lambda a: (a % most).cast("int")),
                     F.zip_with(F.slice(n, F.lit(1), pairs), F.slice(n, F.lit(2), pairs), lambda a, b: paired(a, b, most)))
    t = repeated(_texts(docs).withColumn("numbers", F.transform("words", number)))
    t = t.withColumn("lines", lines).withColumn("grams", grams).select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size(F.split(text, SYMBOL)) - 1).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words", "grams",
        F.size("grams").cast("bigint").alias("n_grams"))
    # one value for all rows, found once; it is named once, so that Spark puts it where it is used and copies it into no row
    t = t.withColumn("weights", listed.scalar())
    return t.withColumn("llr", F.aggregate("grams", F.lit(0).cast("bigint"), lambda a, b: a + F.col("weights")[b])).drop("weights", "grams")


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr, n_grams) of each row.

    llr is the sum of the weights of the n_grams, in micro-nats. A document
    that passes the base rules is kept if llr / n_grams is not below the
    threshold: what PER_MILLE in a thousand of the trusted documents that
    were set apart stay below. Null texts are empty: no words, failed.
    Repeated rows are each judged. An empty table gives no rows; without
    labels the base rules decide. Other columns are ignored.
    """
    trusted = common.settle(trusted_ids(labels))
    # as a table: a condition on the result must not be pushed into expressions that are costly to repeat
    t = common.settle(scored(docs, common.settle(weights(docs, trusted))))
    mean = F.floor(F.col("llr").cast("double") / F.col("n_grams")).cast("bigint")
    apart = t.where(~_failed()).select("doc_id", mean.alias("m")).join(trusted.where("NOT fits").select("doc_id"), "doc_id", "left_semi").select("m")
    apart = common.settle(apart)
    n = apart.count()
    # the least of them, as many as the threshold's rank, found by each task and merged
    least = apart.orderBy("m").limit(n * PER_MILLE // 1000 + 1).agg(F.max("m")).first()[0] if n else -(2**40)
    t = t.withColumn("least", F.lit(least).cast("bigint"))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"),
                    (~_failed() & (F.col("llr") >= F.col("least") * F.col("n_grams"))).alias("kept"), "llr", "n_grams")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


_FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"
OP12_SQL = f"""
WITH {CRC_TABLE},
d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
tr AS MATERIALIZED (SELECT doc_id, place % {APART} > 0 AS fits FROM (SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} AS own, {crc32("('t' || CAST(doc_id AS VARCHAR))")} AS place
  FROM (SELECT doc_id, max(quality) AS y FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id), crc WHERE y = 1) WHERE own % 3 <> 1 ORDER BY place, doc_id LIMIT {TRUSTED}),
wd AS (SELECT row_id, doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
num AS MATERIALIZED (SELECT w, {crc32('w')} AS u FROM (SELECT DISTINCT w FROM wd), crc),
n AS (SELECT row_id, doc_id, u, lead(u) OVER (PARTITION BY row_id ORDER BY i) AS v FROM wd JOIN num USING (w)),
g AS MATERIALIZED (SELECT row_id, doc_id, u % {BUCKETS} AS b FROM n UNION ALL SELECT row_id, doc_id, (31 * u + v) % {BUCKETS} FROM n WHERE v IS NOT NULL),
c AS MATERIALIZED (SELECT b, count(*) AS r, count(*) FILTER (doc_id IN (SELECT doc_id FROM tr WHERE fits)) AS t FROM g GROUP BY b),
w AS MATERIALIZED (SELECT b, CAST(round(1000000 * ln((t + {LENT} * p) / (((SELECT sum(t) FROM c) + {LENT}) * p))) AS BIGINT) AS w
  FROM (SELECT b, t, CAST(r + 1 AS DOUBLE) / ((SELECT sum(r) FROM c) + {BUCKETS}) AS p FROM c)),
s AS (SELECT row_id, sum(w) AS llr FROM g JOIN w USING (b) GROUP BY row_id),
wi AS (SELECT row_id, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d WHERE len(words) >= {WINDOW}),
ww AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS k FROM wi JOIN d USING (row_id)),
rw AS (SELECT row_id, count(DISTINCT p) AS n FROM (SELECT row_id, unnest(range(i, i + {WINDOW})) AS p FROM ww WHERE k > 1) GROUP BY row_id),
m AS MATERIALIZED (SELECT row_id, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    (SELECT count(*) - count(DISTINCT l) FROM (SELECT unnest(string_split(d.text, chr(10))) AS l) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS n_dup_lines,
    coalesce(rw.n, 0) AS n_repeat_words, CAST(coalesce(s.llr, 0) AS BIGINT) AS llr, CAST(greatest(2 * len(words) - 1, 0) AS BIGINT) AS n_grams
  FROM d LEFT JOIN rw USING (row_id) LEFT JOIN s USING (row_id)),
th AS (SELECT list_sort(list(CAST(floor(CAST(llr AS DOUBLE) / n_grams) AS BIGINT))) AS l FROM m WHERE NOT {_FAILED} AND doc_id IN (SELECT doc_id FROM tr WHERE NOT fits))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_FAILED} AS base_failed,
  NOT {_FAILED} AND llr >= coalesce(l[1 + len(l) * {PER_MILLE} // 1000], -1099511627776) * n_grams AS kept, llr, n_grams FROM m, th"""
