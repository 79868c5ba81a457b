"""JavaScript sources as facts, and the call edges that they show where calls are dispatched at run time.

Each file is cut into tokens and gone through once (a table function); braces
tell which class, object or map a token stands in. It covers the forms named
below, not the language. Everything that needs another file is joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..plans.stages import stage
from ..schema import FUNCTIONS, Graph

#: kind: import (local name, specifier), class (name, base), constant (NAME, text), entry (owner, key, text, @reference or identifier),
#: register (command, handler), execute (command), create (class), component (key), property (owner class, name, class), this_call (owner
#: class, property, method), own_call (owner class, method). Names that refer to a map's entry or a constant start with @.
FACTS = "path string, kind string, owner string, name string, value string, line int"
#: Fixed value: what marks edges that are recomputed from these facts.
OWNED = '{"js":"dispatch"}'

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|(?P<id>[A-Za-z_$][\w$]*)"""
    r"""|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|[^\s\w])""", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: What a slash divides after; elsewhere it starts a regular expression.
_VALUE = ("id", "num", "str")


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) without blanks and comments; regular expressions count as text."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = None
        if text[at] == "/" and text[at:at + 2] not in ("//", "/*") and not (out and (out[-1][0] in _VALUE or out[-1][1] in ")]")):
            m = _PATTERN.match(text, at)
        if m:
            out.append(("pattern", m[0], line))
        else:
            m = _TOKEN.match(text, at)
            if m.lastgroup != "skip":
                out.append((m.lastgroup, m[0][1:-1] if m.lastgroup == "str" else m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


class _Reader:
    """One pass over a file's tokens. `inside` has what each open brace belongs to: a kind and a name."""

    def __init__(self, path: str, text: str):
        self.path, self.t, self.rows = path, tokens(text), []
        self.inside: list[tuple[str, str]] = []
        self.next_brace = ("block", "")

    def word(self, i: int) -> str:
        return self.t[i][1] if i < len(self.t) and self.t[i][0] == "id" else ""

    def op(self, i: int, text: str) -> bool:
        return i < len(self.t) and self.t[i][0] == "op" and self.t[i][1] == text

    def dotted(self, i: int) -> tuple[str, int]:
        """A chain of names from token i, and the token after it."""
        name = self.word(i)
        if not name:
            return "", i
        i += 1
        while self.op(i, ".") and self.word(i + 1):
            name, i = f"{name}.{self.word(i + 1)}", i + 2
        return name, i

    def argument(self, i: int) -> str:
        """A text, or the reference that a name or chain of names is."""
        if i < len(self.t) and self.t[i][0] == "str":
            return self.t[i][1]
        name, _ = self.dotted(i)
        return f"@{name}" if name else ""

    def add(self, i: int, kind: str, name: str, value: str = "", owner: str = "") -> None:
        self.rows.append((self.path, kind, owner, name, value, self.t[i][2]))

    def owner(self) -> str:
        return next((name for kind, name in reversed(self.inside) if kind == "class"), "")

    def read(self) -> list[tuple]:
        for i, (kind, text, _) in enumerate(self.t):
            if kind == "op" and text == "{":
                self.inside.append(self.next_brace)
                self.next_brace = ("block", "")
            elif kind == "op" and text == "}":
                if self.inside:
                    self.inside.pop()
            elif kind in ("id", "str"):
                if self.inside and self.inside[-1][0] in ("object", "mirror", "properties") and (self.op(i - 1, "{") or self.op(i - 1, ",")):
                    self.entry(i, text, *self.inside[-1])
                if kind == "id" and not self.op(i - 1, ".") and not self.op(i + 1, ":"):
                    self.statement(i, text)
            elif kind == "op" and text == "." and self.op(i + 2, "("):
                self.method(i, self.word(i + 1))
        return self.rows

    def entry(self, i: int, key: str, kind: str, name: str) -> None:
        if not self.op(i + 1, ":"):
            if kind == "object" and self.word(i) and (self.op(i + 1, ",") or self.op(i + 1, "}")):
                self.add(i, "entry", key, f"#{key}", name)  # { Shape } stands for { Shape: Shape }
        elif kind == "mirror":
            self.add(i, "entry", key, key, name)
        elif kind == "properties":
            if self.word(i + 2) == "new" and self.word(i + 3):
                self.add(i, "property", f"{name}.{key}", self.dotted(i + 3)[0].split(".")[-1], self.owner())
        elif i + 2 < len(self.t) and self.t[i + 2][0] == "str":
            self.add(i, "entry", key, self.t[i + 2][1], name)
        else:
            chain, after = self.dotted(i + 2)
            if chain and (self.op(after, ",") or self.op(after, "}")):
                self.add(i, "entry", key, f"@{chain}" if "." in chain else f"#{chain}", name)

    def statement(self, i: int, text: str) -> None:
        if text == "import":
            self.imports(i)
        elif text == "class" and self.word(i + 1):
            base = self.dotted(i + 3)[0] if self.word(i + 2) == "extends" else ""
            self.add(i, "class", self.word(i + 1), base)
            self.next_brace = ("class", self.word(i + 1))
        elif text in ("const", "let", "var") and self.word(i + 1) and self.op(i + 2, "="):
            self.variable(i, self.word(i + 1))
        elif text == "new" and self.word(i + 1):
            chain, after = self.dotted(i + 1)
            if self.op(after, "["):
                self.add(i, "create", f"@{chain}.*")
            elif "." in chain:
                self.add(i, "create", f"@{chain}")
            else:
                self.add(i, "create", chain)
        elif text == "this" and self.op(i + 1, ".") and self.word(i + 2):
            self.member(i)

    def imports(self, i: int) -> None:
        names, j = [], i + 1
        while j < min(len(self.t), i + 400) and self.t[j][0] != "str" and not self.op(j, ";"):
            word = self.word(j)
            if word and word not in ("from", "as", "type") and not (self.word(j + 1) == "as"):
                names.append(word)
            j += 1
        if j < len(self.t) and self.t[j][0] == "str":
            for name in names or [""]:
                self.add(i, "import", name, self.t[j][1])

    def variable(self, i: int, name: str) -> None:
        if i + 3 < len(self.t) and self.t[i + 3][0] == "str":
            if name.isupper():
                self.add(i, "constant", name, self.t[i + 3][1])
        elif self.op(i + 3, "{"):
            self.next_brace = ("object", name)
        elif self.op(i + 4, "(") and self.op(i + 5, "{") and self.word(i + 3).lower() == "keymirror":
            self.next_brace = ("mirror", name)
        elif self.word(i + 3) == "require" and self.op(i + 4, "(") and i + 5 < len(self.t) and self.t[i + 5][0] == "str":
            self.add(i, "import", name, self.t[i + 5][1])

    def member(self, i: int) -> None:
        """this.p = ..., this.p.m(...), this.p.k.m(...) and this.m(...)."""
        owner, name = self.owner(), self.word(i + 2)
        if self.op(i + 3, "=") and not self.op(i + 4, "="):
            if self.word(i + 4) == "new" and self.word(i + 5):
                self.add(i, "property", name, self.dotted(i + 5)[0].split(".")[-1], owner)
            elif self.op(i + 4, "{"):
                self.next_brace = ("properties", name)
            elif self.word(i + 4) == "this" and self.word(i + 6) == "getComponent" and self.op(i + 7, "("):
                self.add(i, "component_property", name, self.argument(i + 8), owner)
        elif self.op(i + 3, "("):
            self.add(i, "own_call", name, "", owner)
        elif self.op(i + 3, ".") and self.word(i + 4) and self.op(i + 5, "("):
            self.add(i, "this_call", name, self.word(i + 4), owner)
        elif self.op(i + 3, ".") and self.op(i + 5, ".") and self.word(i + 6) and self.op(i + 7, "("):
            self.add(i, "this_call", f"{name}.{self.word(i + 4)}", self.word(i + 6), owner)

    def method(self, i: int, name: str) -> None:
        if name == "register":
            command = self.argument(i + 3)
            after = self.dotted(i + 3)[1] if self.word(i + 3) else i + 4
            handler = self.dotted(after + 1)[0] if self.op(after, ",") else ""
            self.add(i, "register", command if handler else "", handler or command.removeprefix("@"))
        elif name == "execute" and self.argument(i + 3):
            self.add(i, "execute", self.argument(i + 3))
        elif name == "getComponent" and self.argument(i + 3):
            self.add(i, "component", self.argument(i + 3))


def read(path: str, text: str) -> list[tuple]:
    return _Reader(path, text).read()


def facts(sources: DataFrame) -> DataFrame:
    """(path, kind, owner, name, value, line) of sources (path, text), references resolved.

    A reference is an entry of a map in the same file, else of a map of that
    name anywhere (the first file by path); or a constant likewise. Others
    stay as they are written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            yield pd.DataFrame([f for p, t in zip(b["path"], b["text"]) for f in read(p, t or "")], columns=names)

    raw = stage(sources.select("path", "text").mapInPandas(run, FACTS))
    entries = raw.where("kind = 'entry' AND NOT value RLIKE '^[@#]'").select(F.concat_ws(".", "owner", "name").alias("ref"), "path", "value").unionByName(
        raw.where("kind = 'constant'").select(F.col("name").alias("ref"), "path", "value"))
    own = entries.groupBy("path", "ref").agg(F.min("value").alias("own"))
    others = entries.groupBy("ref").agg(F.min_by("value", "path").alias("other"))

    def told(df: DataFrame, column: str) -> DataFrame:
        refers = F.col(column).startswith("@") & ~F.col(column).endswith(".*")
        ref = F.when(refers, F.substring(column, 2, 1 << 20))
        out = df.withColumn("ref", ref).join(own, ["path", "ref"], "left").join(others, "ref", "left")
        return out.withColumn(column, F.when(refers, F.coalesce("own", "other", "ref")).otherwise(F.col(column))).drop("ref", "own", "other")

    done = told(told(raw.where("kind <> 'create'"), "name"), "value")
    # `new Map[x]()` may make any of a map's classes, `new Map.key()` that one, `new space.Name()` that name
    members = raw.where("kind = 'entry' AND value LIKE '#%'").select(F.col("owner").alias("map"), F.col("name").alias("key"), F.substring("value", 2, 1 << 20).alias("member")).distinct()
    made = raw.where("kind = 'create'")
    dotted = made.where("name LIKE '@%'").withColumn("map", F.regexp_extract("name", r"^@(.*)\.[^.]*$", 1)).withColumn("key", F.substring_index("name", ".", -1))
    hit = dotted.join(members.withColumnRenamed("key", "m_key"), "map", "left").where("m_key IS NULL OR key = '*' OR key = m_key")
    created = hit.where("member IS NOT NULL OR key <> '*'").withColumn("name", F.coalesce("member", "key")).select(*raw.columns)
    return done.unionByName(made.where("NOT name LIKE '@%'")).unionByName(created).select(
        "path", "kind", "owner", "name", F.regexp_replace("value", "^#", "").alias("value"), "line")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(m?jsx?|cjs|tsx?)$", "")


def import_target(path: Column, specifier: Column) -> Column:
    """A relative specifier as a path: joined with the importer's folder, . and .. resolved, extension cut off."""
    joined = F.concat_ws("/", F.regexp_extract(path, "^(.*)/[^/]*$", 1), specifier)
    parts = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    flat = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(
        p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return _stem(F.array_join(flat, "/"))


def imported(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, target): local names and the files their specifiers mean.

    Relative ones are resolved exactly, others match the end of a path at a
    folder, an alias root ('@/ui/shape') taken off; both also mean an index.
    """
    i = found.where("kind = 'import'").select("path", "name", "value").distinct()
    stem = files.select(F.col("path").alias("target"), F.regexp_replace(_stem(F.col("path")), "/index$", "").alias("stem")).unionByName(
        files.select(F.col("path").alias("target"), _stem(F.col("path")).alias("stem"))).distinct()
    near = i.where("value LIKE '.%'").select("path", "name", import_target(F.col("path"), F.col("value")).alias("stem")).join(stem, "stem")
    alias = F.when(F.col("value").startswith("@") & F.col("value").contains("/"), F.regexp_extract("value", "^[^/]*/(.*)$", 1)).otherwise(F.col("value"))
    parts = F.split("stem", "/")
    tails = stem.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("tail"))
    far = i.where("NOT value LIKE '.%'").select("path", "name", _stem(alias).alias("tail")).join(tails, "tail")
    return near.select("path", "name", "target").unionByName(far.select("path", "name", "target")).where("path <> target").distinct()


def import_edges(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target) of imports that lead to a file, or to an index in a folder."""
    return imported(found, files).select("path", "target").distinct()


def class_of(uses: DataFrame, classes: DataFrame, imports: DataFrame) -> DataFrame:
    """uses (path, name, ...) with the class_path that each name means there, whatever its case.

    The same file comes first, then the file that the name is imported from,
    then one that is imported at all, then code that isn't a test, the file
    that shares most folders, and the path.
    """
    known = classes.select(F.lower("name").alias("low"), F.col("path").alias("class_path")).distinct()
    pairs = uses.select("path", "name").distinct().withColumn("low", F.lower("name")).join(known, "low")
    by_name = imports.select("path", "name", F.col("target").alias("class_path"), F.lit(True).alias("named")).distinct()
    any_of = imports.select("path", F.col("target").alias("class_path"), F.lit(True).alias("imports")).distinct()
    c = pairs.join(by_name, ["path", "name", "class_path"], "left").join(any_of, ["path", "class_path"], "left")
    folders = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    both = F.arrays_zip(folders("path").alias("a"), folders("class_path").alias("b"))
    differ = F.array_position(F.transform(both, lambda z: ~z["a"].eqNullSafe(z["b"])), True)
    near = F.when(differ > 0, differ - 1).otherwise(F.size(both))
    tier = F.when(F.col("path") == F.col("class_path"), 0).when(F.col("named"), 1).when(F.col("imports"), 2).otherwise(3)
    order = F.struct(tier.alias("tier"), expr.is_test_path(F.col("class_path")).alias("test"), (-near).alias("near"), "class_path")
    best = c.groupBy("path", "name").agg(F.min(order).alias("o")).select("path", "name", "o.class_path")
    return uses.join(best, ["path", "name"])


def created_classes(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, line, name, class_path): each `new X`, led to its class."""
    made = found.where("kind = 'create'").select("path", "line", "name").distinct()
    imports = imported(found, files if files is not None else found.select("path").distinct())
    return class_of(made, found.where("kind = 'class'"), imports).select("path", "line", "name", "class_path")


def callers_of_command(found: DataFrame, command: str) -> DataFrame:
    return found.where(F.col("kind") == "execute").where(F.col("name") == command).select("path", "line").distinct()


def component_class(found: DataFrame) -> DataFrame:
    """(path, line, key, class_name): component keys as class names (IMAGE_LOADER as ImageLoader)."""
    return found.where("kind = 'component'").select("path", "line", F.col("name").alias("key"), expr.camel_key(F.substring_index("name", ".", -1)).alias("class_name"))


def property_calls(found: DataFrame) -> DataFrame:
    """(path, line, class_name, method): this.x.method() where the class has this.x = new X, or a component's."""
    kinds = found.where("kind = 'property'").select("path", "owner", F.col("name").alias("property"), F.col("value").alias("class_name")).unionByName(
        found.where("kind = 'component_property'").select("path", "owner", F.col("name").alias("property"), expr.camel_key(F.substring_index("value", ".", -1)).alias("class_name"))).distinct()
    return found.where("kind = 'this_call'").select("path", "owner", "line", F.col("name").alias("property"), F.col("value").alias("method")).join(
        kinds, ["path", "owner", "property"]).select("path", "line", "class_name", "method").distinct()


def live_names(found: DataFrame) -> DataFrame:
    """Names that anything creates, runs, registers or extends."""
    return found.where("kind IN ('create', 'execute', 'component')").select("name").union(
        found.where("kind IN ('register', 'class', 'property') AND value <> ''").select("value")).distinct()


def enclosing(found: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Facts with the id of the innermost definition around their line, the module where there is none."""
    from ..operators.intervals import innermost

    g = Graph(files, nodes, nodes.sparkSession.createDataFrame([], "source_id bigint, target_id bigint, relation string"))
    at = found.join(files.select(F.col("id").alias("file_id"), "path"), "path")
    return at.join(innermost(g, at.select("file_id", "line").distinct()), ["file_id", "line"])


def commands(found: DataFrame) -> DataFrame:
    """(command, handler, handler_path): registered by name, or by an object that has the name as an entry; the last by path counts."""
    named = found.where("kind = 'register' AND name <> ''").select(F.col("name").alias("command"), F.col("value").alias("handler"), F.col("path").alias("handler_path"))
    entry = found.where("kind = 'entry' AND name = 'name'").select("path", F.col("owner").alias("handler"), F.col("value").alias("command"))
    by_object = found.where("kind = 'register' AND name = ''").select("path", F.col("value").alias("handler")).join(entry, ["path", "handler"]).select(
        "command", "handler", F.col("path").alias("handler_path"))
    return named.unionByName(by_object).groupBy("command").agg(F.max_by(F.struct("handler", "handler_path"), F.struct("handler_path", "handler")).alias("h")).select("command", "h.*")


def command_edges(found: DataFrame) -> DataFrame:
    """(path, line, command, handler, handler_path): what runs a command, and who registered it."""
    run = found.where("kind = 'execute'").select("path", "line", F.col("name").alias("command")).distinct()
    return run.join(commands(found), "command").select("path", "line", "command", "handler", "handler_path")


def graph_edges(found: DataFrame, g: Graph) -> DataFrame:
    """(source_id, target_id, family): calls that patterns of dynamic dispatch show, between nodes of the graph, each once a family.

    command: what runs a command calls the `execute` of the file that registers
    it; create: a class and its file's constructor; component: the class of the
    key; property: the method of a property's class; own: a method of one's
    class. Callers are the innermost definition around the line, or the module.
    """
    files = g.files
    first = Window.partitionBy("path", "name").orderBy("id")
    s = g.symbols.select("id", "path", "name", "type")
    methods = s.where(F.col("type").isin(*FUNCTIONS)).withColumn("k", F.row_number().over(first)).where("k = 1").select(
        F.col("path").alias("m_path"), F.col("name").alias("m_name"), F.col("id").alias("m_id"))
    class_nodes = s.where("type = 'class'").withColumn("k", F.row_number().over(Window.partitionBy("path", F.lower("name")).orderBy("id"))).where("k = 1").select(
        F.col("path").alias("class_path"), F.lower("name").alias("low"), F.col("id").alias("c_id"))
    imports = stage(imported(found, files))
    classes = s.where("type = 'class'").select("path", "name")
    of_class = lambda uses: class_of(uses, classes, imports)
    method_in = lambda df, name: df.join(methods, (F.col("class_path") == F.col("m_path")) & (name == F.col("m_name"))).select("path", "line", F.col("m_id").alias("target_id"))
    node_of = lambda df: df.withColumn("low", F.lower("name")).join(class_nodes, ["class_path", "low"]).select("path", "line", F.col("c_id").alias("target_id"))
    run = command_edges(found).join(methods.where("m_name = 'execute'"), F.col("handler_path") == F.col("m_path")).select("path", "line", F.col("m_id").alias("target_id"))
    made = stage(of_class(found.where("kind = 'create'").select("path", "line", "name").distinct()))
    parts = of_class(component_class(found).select("path", "line", F.col("class_name").alias("name")).distinct())
    typed = of_class(property_calls(found).withColumnRenamed("class_name", "name"))
    own = of_class(found.where("kind = 'own_call' AND owner <> ''").select("path", "line", F.col("owner").alias("name"), F.col("name").alias("method")).distinct())
    families = {"command": run, "create": node_of(made).unionByName(method_in(made, F.lit("constructor"))), "component": node_of(parts),
                "property": method_in(typed, F.col("method")), "own": method_in(own, F.col("method"))}
    every = stage(reduce(DataFrame.unionByName, [df.withColumn("family", F.lit(name)) for name, df in families.items()]))
    at = enclosing(every, g.nodes, files)
    return at.where("node_id IS NOT NULL").select(F.col("node_id").alias("source_id"), "target_id", "family").distinct()
