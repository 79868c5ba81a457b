"""Scalar rules as column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders, file names and infixes that mark test code.
TEST_FOLDERS = ("tests", "test", "__tests__", "spec", "specs")
TEST_NAMES = ("tests", "test", "conftest")
TEST_INFIXES = (".test.", ".spec.")


def is_test_path(path: Column) -> Column:
    """Whether a path holds test code, by a folder, the file's stem or an infix."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.substring_index(p, "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = p.rlike(f"(^|/)({'|'.join(TEST_FOLDERS)})/")
    infix = name.contains(TEST_INFIXES[0]) | name.contains(TEST_INFIXES[1])
    return folder | stem.startswith("test_") | stem.rlike("_tests?$") | stem.isin(*TEST_NAMES) | infix


def described(path: Column, qname: Column) -> Column:
    return F.concat_ws(":", path, qname)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def symbol_line(path: Column, start: Column, end: Column, kind: Column, name: Column,
                signature: Column | None = None, returns: Column | None = None) -> Column:
    """path:start[-end] kind name [signature] [-> returns]; no end where it equals the start."""
    none = F.lit(None).cast("string")
    where = F.concat(path, F.lit(":"), start.cast("string"),
                     F.when(end.isNotNull() & (end != start), F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit("")))
    signature = none if signature is None else F.when(F.length(signature) > 0, squeezed(signature))
    returns = none if returns is None else F.when(F.length(returns) > 0, F.concat(F.lit("-> "), squeezed(returns)))
    return F.concat_ws(" ", where, kind, name, signature, returns)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def path_matches(path: Column, part: Column) -> Column:
    """Equal, or one ends with the other after a slash; leading ./ doesn't count."""
    a, b = normal_path(path), normal_path(part)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def module_path(path: Column) -> Column:
    """Dotted module of a Python file; a package is its folder."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def module_matches(path: Column, dotted: Column) -> Column:
    stem = F.replace(dotted, F.lit("."), F.lit("/"))
    return path_matches(path, F.concat(stem, F.lit(".py"))) | path_matches(path, F.concat(stem, F.lit("/__init__.py")))


def split_symbol(symbol: Column) -> Column:
    """struct(file, name): file.py:C.m and file.py::f have both, other forms only a name."""
    s = F.trim(F.replace(symbol, F.lit("\\"), F.lit("/")))
    shape = r"^(.*[^:]):{1,2}([^/:]+)$"
    found = s.rlike(shape)
    return F.struct(
        F.when(found, F.regexp_extract(s, shape, 1)).alias("file"),
        F.when(found, F.regexp_extract(s, shape, 2)).otherwise(s).alias("name"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(
        F.left(text, F.lit(most)), F.lit("... [truncated, "), F.length(text).cast("string"), F.lit(" chars total]"))).otherwise(text)


def excerpt(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def note_links(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def code_like(text: Column) -> Column:
    """Has a dot or underscore, is in capitals alone (two or more characters, digits allowed), or has two capitals."""
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    alone = (F.length(text) > 1) & (F.upper(text) == text) & (F.lower(text) != text)
    return text.contains(".") | text.contains("_") | alone | (capitals >= 2)


def note_mentions(content: Column) -> Column:
    """Names after @ that look like code, each once, in order of the alphabet."""
    names = F.regexp_extract_all(content, F.lit(r"@([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)"), F.lit(1))
    paths = F.regexp_extract_all(content, F.lit(r"@([\w./-]+\.[A-Za-z0-9]+)"), F.lit(1))
    return F.array_sort(F.filter(F.array_union(names, paths), code_like))


def location(text: Column) -> Column:
    """struct(path, start, end) of f, f:12 and f:10-15."""
    shape = r"^(.*):(\d+)(?:-(\d+))?$"
    found = text.rlike(shape)
    number = lambda k: F.expr("try_cast(null as int)") if k is None else F.regexp_extract(text, shape, k).try_cast("int")
    start = F.when(found, number(2))
    return F.struct(
        F.when(found, F.regexp_extract(text, shape, 1)).otherwise(text).alias("path"),
        start.alias("start"), F.when(found, F.coalesce(number(3), start)).alias("end"))


def camel_key(key: Column) -> Column:
    """IMAGE_LOADER as ImageLoader."""
    return F.array_join(F.transform(F.split(key, "_"), lambda p: F.initcap(p)), "")


def glob_regex(pattern: str) -> str:
    """The regular expression of a file pattern, for rlike.

    ** spans folders, * and ? stay within a segment; the pattern may start at
    any folder and covers what lies below a folder it names.
    """
    pattern = pattern.strip().replace("\\", "/")
    pattern = re.sub(r"^(\./)+", "", pattern).strip("/")
    kinds = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: kinds.get(m[0]) or re.escape(m[0]), pattern)
    return f"(?:^|/){body}(?:/.*)?$"


def visible_name(name: Column) -> Column:
    """Names shown as functions; the underscore of test_ is a wildcard and case doesn't count."""
    return ~name.ilike("test_%") & ~name.isin("__init__", "<module>")


def escaped_like(text: str) -> str:
    """text for LIKE ... ESCAPE '!'."""
    return text.replace("!", "!!").replace("%", "!%").replace("_", "!_")


def folder(path: Column) -> Column:
    """First folder of a path, <root> where there is none."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("<root>")


def within_budget(json: Column, most: int = 50_000) -> Column:
    """A response, or an error row in its place if it is too long."""
    error = F.to_json(F.struct(F.lit("response_too_large").alias("error"), F.length(json).alias("chars"), F.lit(most).alias("limit")))
    return F.when(F.length(json) > most, error).otherwise(json)


def sanitized_id(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9_-]+", "-")
