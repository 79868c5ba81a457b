"""The note graph: links and mentions in text, resolution through aliases, backlinks, related notes, search, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr

NOTES = {"id": "string", "title": "string", "content": "string", "tags": "array<string>", "created_at": "string",
         "updated_at": "string", "is_code_note": "boolean"}
#: What may stand before a title.
PREFIXES = ("feature:", "decision:", "note:", "func:")


def links(notes: DataFrame) -> DataFrame:
    """(id, pos, target) of each [[link]], as written."""
    return notes.select("id", F.posexplode(expr.note_links(F.col("content"))).alias("pos", "target")).withColumn("target", F.trim("target"))


def mentions(notes: DataFrame) -> DataFrame:
    return notes.select("id", F.explode(expr.note_mentions(F.col("content"))).alias("name"))


def aliases(notes: DataFrame) -> DataFrame:
    """(alias, note): ids, lower-cased titles and slugs, with and without a prefix; an id beats a title, then the smallest note."""
    title = F.trim("title")
    low = F.lower(title)
    rest = F.regexp_extract(title, "(?i)^(?:" + "|".join(PREFIXES) + r")\s*(.*)$", 1)
    names = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("id").alias("alias")), F.struct(F.lit(1).alias("rank"), F.lower("id").alias("alias")),
        F.struct(F.lit(2).alias("rank"), low.alias("alias")), F.struct(F.lit(2).alias("rank"), expr.slug(title).alias("alias")),
        F.struct(F.lit(3).alias("rank"), F.lower(rest).alias("alias")), F.struct(F.lit(3).alias("rank"), expr.slug(rest).alias("alias")))
    return (notes.select(F.col("id").alias("note"), F.explode(names).alias("a")).where("a.alias <> ''")
            .groupBy(F.col("a.alias").alias("alias")).agg(F.min_by("note", F.struct("a.rank", "note")).alias("note")))


def resolved(notes: DataFrame) -> DataFrame:
    """(id, pos, target, note): links with the note they lead to, null if none.

    Tried in turn: the target as it is, lower-cased, its slug, then aliases
    that end in the slug, or that it ends in, at a whole word. The last step
    joins on exploded word suffixes rather than on every pair.
    """
    known = aliases(notes)
    l = links(notes).withColumn("slug", expr.slug(F.col("target")))  # noqa: E741
    named = lambda key, out: known.select(F.col("alias").alias(key), F.col("note").alias(out))
    out = (l.withColumn("low", F.lower("target")).join(named("target", "n1"), "target", "left").join(named("low", "n2"), "low", "left")
           .join(named("slug", "n3"), "slug", "left"))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "-"))),
                                 lambda k: F.array_join(F.slice(F.split(c, "-"), k, F.size(F.split(c, "-"))), "-"))
    long_alias = known.where("length(alias) >= 3")
    tails = long_alias.select("alias", "note", F.explode(ends(F.col("alias"))).alias("tail")).where("tail <> alias")
    wanted = out.where("coalesce(n1, n2, n3) IS NULL AND length(slug) >= 3").select("slug").distinct()
    a = wanted.join(tails, F.col("slug") == F.col("tail")).select("slug", "alias", "note")
    b = (wanted.select("slug", F.explode(ends(F.col("slug"))).alias("alias")).where("alias <> slug")
         .join(long_alias, "alias").select("slug", "alias", "note"))
    last = a.unionByName(b).groupBy("slug").agg(F.min_by("note", "alias").alias("n4"))
    return out.join(last, "slug", "left").select("id", "pos", "target", F.coalesce("n1", "n2", "n3", "n4").alias("note"))


def edges(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, relation, target): links_to between notes, mentions of symbols (name) that exist."""
    to = resolved(notes).where("note IS NOT NULL AND note <> id").select(
        F.col("id").alias("source"), F.lit("links_to").alias("relation"), F.col("note").alias("target")).distinct()
    known = symbols.select("name").distinct()
    said = mentions(notes).withColumn("name", F.col("name")).join(known, "name").select(
        F.col("id").alias("source"), F.lit("mentions").alias("relation"), F.col("name").alias("target"))
    return to.unionByName(said)


def unresolved(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(kind, id, target): links and mentions that lead nowhere."""
    gone = resolved(notes).where("note IS NULL").select(F.lit("link").alias("kind"), "id", "target").distinct()
    lost = mentions(notes).join(symbols.select("name").distinct(), "name", "left_anti").select(
        F.lit("mention").alias("kind"), "id", F.col("name").alias("target"))
    return gone.unionByName(lost)


def stats(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row: notes, links and mentions that lead somewhere, and the lists of those that don't."""
    e = edges(notes, symbols).groupBy().agg(F.count_if(F.col("relation") == "links_to").alias("links"), F.count_if(F.col("relation") == "mentions").alias("mentions"))
    gone = unresolved(notes, symbols)
    pick = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("target"))))
    lost = gone.groupBy().agg(pick("link").alias("unresolved_links"), pick("mention").alias("unresolved_mentions"))
    return notes.groupBy().agg(F.count(F.lit(1)).alias("notes")).crossJoin(e).crossJoin(lost)  # one row each


def backlinks(notes: DataFrame) -> DataFrame:
    """(id, source): notes that link to each."""
    return resolved(notes).where("note IS NOT NULL AND note <> id").select(F.col("note").alias("id"), F.col("id").alias("source")).distinct()


def related(notes: DataFrame, most: int = 10) -> DataFrame:
    """(id, k, other): notes it links to in order, then those that link to it."""
    out = resolved(notes).where("note IS NOT NULL AND note <> id").groupBy("id", F.col("note").alias("other")).agg(
        F.min(F.struct(F.lit(0).alias("back"), F.col("pos"))).alias("o"))
    back = backlinks(notes).select("id", F.col("source").alias("other"), F.struct(F.lit(1).alias("back"), F.lit(0).alias("pos")).alias("o"))
    both = out.unionByName(back).groupBy("id", "other").agg(F.min("o").alias("o"))
    w = Window.partitionBy("id").orderBy("o", "other")
    return both.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("id", "k", "other")


def search(notes: DataFrame, query: str, tag: str | None = None) -> DataFrame:
    """Notes with query in title, content or a tag, whatever the case; with a tag, only those that have it."""
    q = query.lower()
    hit = F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("content"), F.lit(q)) | F.exists(
        "tags", lambda t: F.contains(F.lower(t), F.lit(q)))
    out = notes.where(hit)
    return out.where(F.array_contains("tags", tag)) if tag else out


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))


def drawn_type(tags, is_code_note):
    """What a note is drawn as: the tag decision, then feature, decides; else code_note or note."""
    return (F.when(F.array_contains(tags, "decision"), "decision").when(F.array_contains(tags, "feature"), "feature")
            .when(is_code_note, "code_note").otherwise("note"))


def upsert(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """notes with changes: new content and time, while title, tags and creation stay unless given; titles have no line breaks."""
    c = changes.select(*[F.col(n).alias(f"c_{n}") for n in NOTES])
    joined = notes.join(c, notes["id"] == c["c_id"], "full_outer")
    pick = lambda n, new_first: F.coalesce(*([f"c_{n}", n] if new_first else [n, f"c_{n}"])).alias(n)
    out = joined.select(
        pick("id", True), pick("title", True), pick("content", True), pick("tags", True), pick("created_at", False),
        pick("updated_at", True), pick("is_code_note", True))
    return out.withColumn("title", F.regexp_replace("title", r"[\r\n]+", " "))


def delete(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("id").distinct(), "id", "left_anti")


#: What marks a note as made from the specification.
GENERATED = "<!-- generated -->"


def feature_id(name: Column) -> Column:
    return F.concat(F.lit("feature-"), expr.slug(name))


def feature_bodies(features: DataFrame) -> DataFrame:
    """(id, title, content, tags): the note of each feature: its description, decisions with reasons and constraints, files, and links to what it needs."""
    entry = lambda d: F.concat(F.lit("- "), d["id"], F.lit(": "), d["description"], F.when(
        F.coalesce(d["rationale"], F.lit("")) != "", F.concat(F.lit(" (because: "), d["rationale"], F.lit(")"))).otherwise(""),
        F.array_join(F.transform(d["constraints"], lambda c: F.concat(F.lit("\n  - Constraint: "), c)), ""))
    part = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(lines, "\n")))
    body = F.concat_ws("\n\n", F.lit(GENERATED), F.concat(F.lit("Note on **"), "name", F.lit("**, made from the specification; change it there.")),
                       F.when(F.coalesce("description", F.lit("")) != "", F.col("description")), part("Decisions", F.transform("decisions", entry)),
                       part("Files", F.transform("file_patterns", lambda p: F.concat(F.lit("- `"), p, F.lit("`")))),
                       part("Dependencies", F.transform("dependencies", lambda d: F.concat(F.lit("- [["), feature_id(d), F.lit("]]")))))
    return features.select(feature_id(F.col("name")).alias("id"), F.concat(F.lit("Feature: "), "name").alias("title"), F.concat(body, F.lit("\n")).alias("content"),
                           F.array(F.lit("feature")).alias("tags"))


def feature_notes(features: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, outcome, content): create a note for each feature, refresh a generated one that reads otherwise, leave one written by hand; content is what it reads then."""
    have = notes.select("id", F.col("content").alias("old"))
    own, same = F.contains("old", F.lit(GENERATED)), F.trim("old") == F.trim(F.regexp_replace("content", r"\s+$", ""))
    outcome = F.when(F.col("old").isNull(), "created").when(~own, "skipped").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("refreshed")
    return feature_bodies(features).join(have, "id", "left").select("id", outcome.alias("outcome"), F.when(own | F.col("old").isNull(), F.col("content")).otherwise(F.col("old")).alias("content"))


#: Notes over the bound tables, for any SQL engine.
EXAMPLE_SQL = """
SELECT concat('nation-', lower(replace(n_name, ' ', '-'))) AS id, concat('Note: ', n_name) AS title,
       concat('Part of [[', r_name, ']] near [[', CASE WHEN n_nationkey % 3 = 0 THEN 'nowhere ' ELSE '' END, lower(r_name), ']], see @C',
              CAST(n_nationkey % 60 AS STRING), '.', n_name, ' and @plain and @Two_words.') AS content,
       CASE WHEN n_nationkey % 4 = 0 THEN 'feature,nation' ELSE 'nation' END AS tag_list, n_nationkey % 2 = 0 AS is_code_note
FROM {nation} n JOIN {region} r ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('region-', lower(replace(r_name, ' ', '-'))), concat('Feature: ', r_name),
       concat('Region with [[nation-', CASE WHEN r_regionkey % 2 = 0 THEN 'france' ELSE 'brazil' END, ']]'), 'region', false
FROM {region} r"""


def example(spark: SparkSession, nation: DataFrame, region: DataFrame) -> DataFrame:
    n = spark.sql(EXAMPLE_SQL, nation=nation, region=region)
    return n.select("id", "title", "content", F.split("tag_list", ",").alias("tags"), F.lit("2024-01-01").alias("created_at"),
                    F.lit("2024-01-01").alias("updated_at"), "is_code_note")
