"""Specifications as tables: each line gets its feature, its section and its decision by running windows, and is then what its shape says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import stage

#: The words a specification's headings, properties and lists are known by.
LISTS = {"files": "file_patterns", "file patterns": "file_patterns", "dependencies": "dependencies"}
SECTIONS = {"constraints": "constraints", **LISTS}
NOTHING = ("none", "n/a", "-")
MADE = "GEN-"
BECAUSE, CONSTRAINT, FEATURE = "(because:", "constraint:", "feature:"
PROPERTY = r"^-\s*\*\*([A-Za-z ]+)\*\*:\s*(.*)$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(texts: DataFrame) -> DataFrame:
    """(doc, pos, line, h2, name, h3): trimmed lines with what headings say; name is null below a heading of no feature."""
    rows = texts.select(F.monotonically_increasing_id().alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("pos", "line")).withColumn("line", _strip(F.col("line")))
    line = F.col("line")
    said = F.regexp_extract(line, r"(?i)^##\s+feature(?:[:\s])(.*)$", 1)
    name = F.when(F.contains(line, F.lit(":")), F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).otherwise(said)
    is_feature = line.rlike(r"(?i)^##\s+feature[:\s]")
    h2, h3 = F.startswith(line, F.lit("## ")), F.startswith(line, F.lit("### "))
    return rows.select("doc", "pos", "line", h2.alias("h2"), F.when(h2 & is_feature, F.btrim(_strip(name), F.lit("*` "))).alias("name"), (h3 & ~h2).alias("h3"))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines below a feature with its occurrence (feature_at, name), their section (section_at, section) and scope, the last heading of either kind."""
    w = Window.partitionBy("doc").orderBy("pos")
    heading = F.when(F.col("h2"), F.struct("pos", "name"))
    rows = lines.withColumn("f", F.last(heading, ignorenulls=True).over(w)).withColumn(
        "scope", F.last(F.when(F.col("h2") | F.col("h3"), F.struct("pos", F.when(F.col("h3"), _strip(F.lower(F.substring("line", 5, 1 << 20)))).alias("s"))), ignorenulls=True).over(w))
    return rows.where("f.name IS NOT NULL AND NOT h2").select(
        "doc", "pos", "line", "h3", F.col("f.pos").alias("feature_at"), F.col("f.name").alias("name"), F.col("scope.pos").alias("scope"), F.col("scope.s").alias("section"))


def _sorted(kind: str, value: Column, name: str) -> Column:
    """The values of lines of a kind, in order."""
    got = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "k", value.alias("v")))))
    return F.transform(got, lambda x: x["v"]).alias(name)


def _items(rows: DataFrame) -> DataFrame:
    """(doc, feature_at, name, pos, k, kind, value) of list entries, descriptions and states."""
    line, key = F.col("line"), F.lower(_strip(F.regexp_extract("line", PROPERTY, 1)))
    value = _strip(F.regexp_extract("line", PROPERTY, 2))
    cut = F.transform(F.split(value, "[,;]"), lambda x: F.btrim(_strip(x), F.lit("`")))
    wanted = F.when(key == "dependencies", F.filter(F.transform(cut, lambda x: F.regexp_replace(x, "(?i)^feature:\\s*", "")), lambda x: ~F.lower(x).isin(*NOTHING))).otherwise(cut)
    entry = _strip(F.substring("line", 2, 1 << 20))
    listed = F.when(F.col("section") == "constraints", entry).when(F.col("section") == "dependencies", _strip(F.regexp_replace(entry, "^Feature:", ""))).otherwise(F.btrim(entry, F.lit("`")))
    by_name = lambda c, names: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in names.items()])
    prop = F.col("what") == "property"
    kind = (F.when(prop, F.when(key == "description", "description").otherwise(by_name(key, LISTS))).when(F.col("what") == "entry", by_name(F.col("section"), SECTIONS))
            .when(F.col("what") == "text", "description").when(F.col("h3") & F.startswith("section", F.lit("status:")), "status"))
    values = (F.when(prop & (key == "description"), F.array(value)).when(prop, F.filter(wanted, lambda x: x != "")).when(F.col("what") == "entry", F.array(listed))
              .when(F.col("what") == "text", F.array(_strip(F.regexp_replace(line, "^Description:", "")))).otherwise(F.array(_strip(F.substring("section", 8, 1 << 20)))))
    found = rows.withColumn("kind", kind).where("kind IS NOT NULL").select("doc", "feature_at", "name", "pos", "kind", F.posexplode(values).alias("k", "value"))
    return found.where("kind <> 'file_patterns' OR value <> ''")


def _decisions(rows: DataFrame) -> DataFrame:
    """(doc, feature_at, pos, d): decisions with their constraints; those without an id are numbered through the whole text."""
    body = F.when(F.col("what") == "property", F.regexp_extract("line", PROPERTY, 2)).otherwise(F.regexp_replace("line", "^-+", ""))
    at = F.locate(BECAUSE, body)
    head = _strip(F.when(at > 0, F.substr(body, F.lit(1), at - 1)).otherwise(body))
    tail = F.when(at > 0, F.substr(body, at + len(BECAUSE))).otherwise("")
    w = Window.partitionBy("doc").orderBy("pos")
    own = F.regexp_extract("head", r"^(\w+-\d+):\s*.+$", 1)
    rows = rows.withColumn("head", head).withColumn("decided", F.max(F.when(F.col("what") == "decision", F.col("pos")).when(F.col("told"), F.col("pos"))).over(
        Window.partitionBy("doc", "scope").orderBy("pos")))
    made = rows.where("what = 'decision' OR told").withColumn("own", own).withColumn("n", F.count(F.when(F.col("own") == "", 1)).over(w)).select(
        "doc", "feature_at", "pos", F.when(F.col("own") != "", F.col("own")).otherwise(F.concat(F.lit(MADE), F.lpad(F.col("n").cast("string"), 3, "0"))).alias("id"),
        F.when(F.col("own") != "", _strip(F.regexp_extract("head", r"^\w+-\d+:\s*(.+)$", 1))).otherwise(F.col("head")).alias("description"),
        _strip(F.regexp_replace(_strip(tail), r"\)$", "")).alias("rationale"))
    bound = rows.where("what = 'constraint'").select("doc", F.col("decided").alias("pos"), F.struct("pos", _strip(F.regexp_replace("line", r"(?i)-\s*constraint:\s*", "")).alias("v")).alias("c"))
    bound = bound.groupBy("doc", "pos").agg(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["v"]).alias("constraints"))
    none = F.array().cast("array<string>")
    return made.join(bound, ["doc", "pos"], "left").select("doc", "feature_at", "pos", F.struct("id", "description", "rationale", F.coalesce("constraints", none).alias("constraints")).alias("d"))


def spec(texts: DataFrame) -> DataFrame:
    """Features of each specification (text): name, ordinal, description, owner, status, decisions, constraints, file_patterns, dependencies.

    Of features of one name in a text the last counts, at the place of the
    first. Lines outside features say nothing; a null text has no features.
    """
    lines = stage(_lines(texts))  # once, as its numbers of texts name them
    rows = _placed(lines)
    line, section = F.col("line"), F.coalesce("section", F.lit(""))
    bullet, prop = F.startswith(line, F.lit("-")), line.rlike(PROPERTY)
    bound = bullet & ~prop & F.contains(F.lower(line), F.lit(CONSTRAINT))
    told = prop & (F.lower(_strip(F.regexp_extract(line, PROPERTY, 1))) == "decisions") & (F.regexp_extract(line, PROPERTY, 2) != "")
    listed = bullet & ~prop & (section == "decisions")
    # a constraint belongs to a decision before it in its scope; without any, a line of the list of decisions is one itself
    before = Window.partitionBy("doc", "scope").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("told", told & ~F.col("h3")).withColumn("open", F.coalesce(F.max(F.col("told") | (listed & ~F.col("h3"))).over(before), F.lit(False)))
    what = (F.when(F.col("h3"), "heading").when(prop, "property").when(bound & F.col("open"), "constraint").when(listed, "decision").when(bullet & section.isin(*SECTIONS), "entry")
            .when((line != "") & F.col("section").isNull() & ~bullet & ~F.startswith(line, F.lit("#")), "text"))
    rows = rows.withColumn("what", F.coalesce(what, F.lit("")))
    heads = lines.where("h2 AND name IS NOT NULL").select("doc", F.col("pos").alias("feature_at"), "name")
    last = heads.groupBy("doc", "name").agg(F.max("feature_at").alias("feature_at"), F.min("feature_at").alias("first_at"))
    last = last.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc").orderBy("first_at")) - 1)
    items = _items(rows).groupBy("doc", "feature_at").agg(
        _strip(F.array_join(_sorted("description", F.col("value"), "x"), " ")).alias("description"), F.try_element_at(_sorted("status", F.col("value"), "x"), F.lit(-1)).alias("status"),
        *[_sorted(k, F.col("value"), k) for k in ("constraints", "file_patterns", "dependencies")])
    made = _decisions(rows).groupBy("doc", "feature_at").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"]).alias("decisions"))
    none = F.array().cast("array<string>")
    out = last.join(items, ["doc", "feature_at"], "left").join(made, ["doc", "feature_at"], "left")
    no_decisions = F.array().cast("array<struct<id:string,description:string,rationale:string,constraints:array<string>>>")
    return out.select("name", "ordinal", F.coalesce("description", F.lit("")).alias("description"), F.lit("").alias("owner"), F.coalesce("status", F.lit("active")).alias("status"),
                      F.coalesce("decisions", no_decisions).alias("decisions"), *[F.coalesce(k, none).alias(k) for k in ("constraints", "file_patterns", "dependencies")])
