"""Features of a project specification: which files they own, what a change means for them, how well they align."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.stages import stage
from ..schema import FUNCTIONS, SYMBOLS, Graph

#: Constraint words that make a decision affected.
SENSITIVE = ("auth", "security", "performance", "api", "contract")

#: File patterns of a specification; they are broadcast.
MOST_PATTERNS = 10_000

SPEC_SCHEMA = (
    "name string, ordinal int, description string, owner string, status string, "
    "decisions array<struct<id:string,description:string,rationale:string,constraints:array<string>>>, "
    "constraints array<string>, file_patterns array<string>, dependencies array<string>"
)


def patterns(features: DataFrame) -> DataFrame:
    """(feature, ordinal, regex) of each file pattern of features (name, ordinal, file_patterns).

    A specification is one document, so its patterns are few; they become
    regular expressions on the driver. More than MOST_PATTERNS are an error.
    """
    rows = features.select("name", "ordinal", F.explode("file_patterns").alias("p")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} file patterns")
    made = [(r.name, r.ordinal, expr.glob_regex(r.p)) for r in rows]
    return features.sparkSession.createDataFrame(made, "feature string, ordinal int, regex string")


def feature_files(features: DataFrame, files: DataFrame) -> DataFrame:
    """(feature, ordinal, id, path): every feature whose patterns cover a file."""
    p = F.broadcast(patterns(features))
    return files.select("id", "path").join(p, F.expr("path RLIKE regex")).select("feature", "ordinal", "id", "path").distinct()


def file_owner(features: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, feature): the first feature in the specification that covers a file, null if none does."""
    own = feature_files(features, files).groupBy("id").agg(F.min_by("feature", "ordinal").alias("feature"))
    return files.select("id", "path").join(own, "id", "left")


def owners(features: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """(f, feature), a number from 1 on for each name; and (id, f) of the nodes that have a file, with the number of the feature that owns it, 0 if none does."""
    known = sorted(r[0] for r in features.select("name").where("name IS NOT NULL").distinct().limit(MOST_PATTERNS + 1).collect())
    if len(known) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} features")
    names = features.sparkSession.createDataFrame([(k + 1, n) for k, n in enumerate(known)], "f int, feature string")
    files = file_owner(features, g.files).join(F.broadcast(names), "feature", "left").select(F.col("id").alias("file_id"), F.coalesce("f", F.lit(0)).alias("f"))
    return names, stage(g.nodes.select("id", "file_id").join(files, "file_id").select("id", "f"))


def feature_functions(g: Graph, features: DataFrame) -> DataFrame:
    """(feature, functions): visible functions in each feature's files."""
    f = feature_files(features, g.files).select("feature", F.col("id").alias("file_id"))
    n = g.nodes.where(F.col("type").isin(*FUNCTIONS)).where(expr.visible_name(F.col("name"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return f.join(n, "file_id").groupBy("feature").agg(F.sum("n").alias("functions"))


def hot_functions(g: Graph, features: DataFrame, most: int = 10) -> DataFrame:
    """(feature, id, callers): each feature's most called functions."""
    from pyspark.sql import Window

    from .callers import caller_counts

    f = feature_files(features, g.files).select("feature", F.col("id").alias("file_id"))
    n = g.nodes.where(F.col("type").isin(*FUNCTIONS)).select("id", "file_id").join(
        caller_counts(g).withColumnRenamed("t_id", "id"), "id")
    w = Window.partitionBy("feature").orderBy(F.desc("callers"), "id")
    return f.join(n, "file_id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("feature", "id", "callers")


def impact_by_feature(g: Graph, features: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, feature, functions, has_root): what a change of each root reaches, by owning feature or unassigned."""
    from .traverse import levels, _steps

    names, owned = owners(features, g)
    steps = _steps(g, True).join(owned.withColumnRenamed("id", "to_id"), "to_id", "left").select("from_id", "to_id", "f")
    reached = levels(roots.select("id").join(owned, "id", "left"), steps, depth, carry=("f",)).where("f IS NOT NULL")
    n = reached.groupBy("root", "f").agg(F.count(F.lit(1)).alias("functions"), F.bool_or(F.col("depth") == 0).alias("has_root"))
    return n.join(F.broadcast(names), "f", "left").select("root", F.coalesce("feature", F.lit("unassigned")).alias("feature"), "functions", "has_root")


def risk_levels(g: Graph, features: DataFrame, roots: DataFrame, depth: int = 3, split: DataFrame | None = None) -> DataFrame:
    """(root, callers, files, features, risk, guessed) of each root.

    Counted are direct confirmed callers outside tests, or guesses where there
    are none (guessed), their files, and the named features that own the root,
    its callers and indirect callers. split are the callers where they are
    known already. Features flow to the nodes called, a level at a time: all
    within depth count, since confirmed callers count anyway; so no list of
    indirect callers is made.
    """
    from .callers import callers_split
    from .traverse import _steps

    r = roots.select(F.col("id").alias("root")).distinct()
    split = (callers_split(g) if split is None else split).join(r, F.col("t_id") == F.col("root"), "left_semi")
    per = split.groupBy(F.col("t_id").alias("root")).agg(
        F.count_if(F.col("bucket") == "callers").alias("sure"), F.count_if(F.col("bucket") == "ambiguous").alias("guess"))
    used = split.join(per, F.col("t_id") == F.col("root")).where(
        "(sure > 0 AND bucket = 'callers') OR (sure = 0 AND bucket = 'ambiguous')").select("root", F.col("s_id").alias("id"), "s_path")
    files = used.groupBy("root").agg(F.count(F.lit(1)).alias("callers"), F.countDistinct("s_path").alias("files"))
    place = owners(features, g)[1].where("f > 0")
    steps, within = stage(_steps(g, True)), place
    for _ in range(depth):
        within = place.unionByName(steps.join(within, F.col("to_id") == F.col("id")).select(F.col("from_id").alias("id"), "f")).distinct()
    within = within.withColumnRenamed("id", "root").join(r, "root", "left_semi")
    named = used.select("root", "id").join(place, "id").select("root", "f").unionByName(within.select("root", "f")).groupBy("root").agg(F.countDistinct("f").alias("features"))
    zero = F.lit(0).cast("bigint")
    out = (r.join(files, "root", "left").join(named, "root", "left").join(per, "root", "left")
           .select("root", *[F.coalesce(c, zero).alias(c) for c in ("callers", "files", "features")],
                   (F.coalesce("sure", zero) == 0).alias("none_sure")))
    c, fl, ft = F.col("callers"), F.col("files"), F.col("features")
    risk = (F.when(c == 0, "LOW").when((c > 20) | (ft > 3) | (fl > 10), "HIGH")
            .when((c > 5) | (ft > 1) | (fl > 3), "MEDIUM").otherwise("LOW"))
    return out.select("root", "callers", "files", "features", risk.alias("risk"), (F.col("none_sure") & (c > 0)).alias("guessed"))


def overall_risk(risks: DataFrame) -> DataFrame:
    """The highest risk and the sum of callers."""
    rank = F.array_position(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.col("risk"))
    top = F.max(rank).cast("int")
    return risks.agg(F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), top).alias("risk"), F.sum("callers").alias("downstream"))


def affected_decisions(features: DataFrame) -> DataFrame:
    """(feature, decision): decisions with a constraint on a sensitive matter, each once."""
    d = features.select(F.col("name").alias("feature"), F.explode("decisions").alias("d"))
    touched = F.exists("d.constraints", lambda c: F.lower(c).rlike("|".join(SENSITIVE)))
    return d.where(touched).select("feature", F.col("d.id").alias("decision"))


def divergence(features: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, feature, constraint): 'must not X' constraints whose X is in a source (id, feature, code)."""
    c = features.select(F.col("name").alias("feature"), F.explode(F.concat(
        "constraints", F.flatten(F.transform("decisions", lambda d: d["constraints"])))).alias("constraint"))
    c = c.where(F.lower("constraint").contains("must not"))
    banned = F.trim(F.element_at(F.split(F.lower("constraint"), "must not"), -1))
    return sources.join(c, "feature").where(
        (F.length(banned) > 0) & F.contains(F.lower("code"), banned)).select("id", "feature", "constraint")


def warnings(g: Graph, features: DataFrame, roots: DataFrame, code: DataFrame) -> DataFrame:
    """(root, kind, said) of each root: unmapped, if no feature owns it; else constraints its code (id, code) violates, and deprecated, if its feature is."""
    r = roots.select(F.col("id").alias("root")).distinct().join(g.nodes.select(F.col("id").alias("root"), "file_id"), "root")
    r = stage(r.join(file_owner(features, g.files).select(F.col("id").alias("file_id"), "feature"), "file_id").select("root", "feature"))
    unmapped = r.where("feature IS NULL").select("root", F.lit("unmapped").alias("kind"), F.lit("").alias("said"))
    broken = divergence(features, r.select(F.col("root").alias("id"), "feature").join(code.select("id", "code"), "id")).select(
        F.col("id").alias("root"), F.lit("constraint").alias("kind"), F.col("constraint").alias("said"))
    old = r.join(features.where("status = 'deprecated'").select(F.col("name").alias("feature")), "feature").select("root", F.lit("deprecated").alias("kind"), F.col("feature").alias("said"))
    return unmapped.unionByName(broken).unionByName(old)


def alignment(g: Graph, features: DataFrame) -> DataFrame:
    """(feature, files, functions, decisions, constraints, issues, fully_aligned) of every feature."""
    f = feature_files(features, g.files).select("feature", F.col("id").alias("file_id"))
    n = g.nodes.where(F.col("type").isin(*SYMBOLS)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    per = f.join(n, "file_id", "left").groupBy("feature").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("functions"))
    zero = F.lit(0).cast("bigint")
    out = features.select(F.col("name").alias("feature"), F.size("decisions").alias("decisions"), F.size("constraints").alias("constraints"),
                          F.size("file_patterns").alias("patterns")).join(per, "feature", "left")
    out = out.select("feature", F.coalesce("files", zero).alias("files"), F.coalesce("functions", zero).alias("functions"),
                     "decisions", "constraints", "patterns")
    issues = F.concat_ws(",", F.when(F.col("patterns") == 0, "no_patterns"),
                         F.when((F.col("patterns") > 0) & (F.col("files") == 0), "no_files"), F.when(F.col("decisions") == 0, "no_decisions"))
    return out.select("feature", "files", "functions", "decisions", "constraints", issues.alias("issues"), (issues == "").alias("fully_aligned"))


def unmapped_files(g: Graph, features: DataFrame) -> DataFrame:
    return g.files.select("id", "path").join(feature_files(features, g.files).select("id").distinct(), "id", "left_anti")


def search_features(features: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return features.where(F.contains(F.lower("name"), q) | F.contains(F.lower("description"), q)).select("name", "ordinal")


def example_features(spark: SparkSession) -> DataFrame:
    """A specification for the bound tables; its last feature matches nothing."""
    none: list = []
    d = lambda i, *c: {"id": i, "description": f"decision {i}", "rationale": "", "constraints": list(c)}
    rows = [
        ("Promotions", 0, "promoted parts", "ann", "active", [d("DEC-001", "API contract stays stable")], ["must not block"], ["promo/**"], none),
        ("Small", 1, "small parts", "ben", "active", [d("DEC-002", "fits in memory")], none, ["small/b1?.py"], ["Promotions"]),
        ("Economy tests", 2, "tests", "cy", "active", none, ["must not call network"], ["economy/tests/*"], none),
        ("Standard", 3, "standard parts", "di", "active", [d("DEC-003", "performance under 1 s", "auth required"), d("DEC-004", "none")], none,
         ["standard/", "./small/b11.js"], none),
        ("Everything odd", 4, "odd brands", "ed", "active", none, none, ["**/b?1.js", "**/b?3.js"], ["Small"]),
        ("No patterns", 5, "nothing yet", "flo", "active", none, none, none, none),
        ("Nowhere", 6, "matches nothing", "gus", "active", none, none, ["missing/**"], none),
    ]
    return spark.createDataFrame(rows, SPEC_SCHEMA)
