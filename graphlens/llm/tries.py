"""How sources of a language diverge in their words, over mergeable radix tries.

A task counts terms in radix tries over UTF-8 bytes, one per language; a leaf
holds the documents and, per source, the occurrences of its term. Tries are
cut at prefixes into pieces, in which each leaf names the bytes it shares with
the leaf before it. Pieces are dealt by ranges of prefixes and merged, prefix
by prefix. Walking a merged trie gives terms in UTF-8 order: blocks of them
are what the divergences are summed over and the most telling terms taken from.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a language that keep a term; telling terms listed for a group.
LEAST_DOCS, LISTED = 10, 10
#: Fixed values of the measure: probabilities in units of 1 / UNIT, SMOOTH occurrences more for every term.
UNIT, SMOOTH = 1_000_000_000, 2
#: Bytes of the prefixes that tries are cut at first, and leaves of a prefix that are cut deeper by so many bytes.
PREFIX, HOT, DEEPER = 3, 2_000_000, 3
#: Leaves (or bytes of labels, by 50), with a quarter of their counts by source, that a task's tries hold before they are cut and given on; different terms of sources counted before they go into tries.
LEAVES, COUNTED = 400_000, 400_000
#: Leaves of pieces that are given on at a time, with the piece that exceeds them.
GIVEN = 16_384
#: Terms of a block; entries of a matrix at a time.
BLOCK, ENTRIES = 2048, 1 << 21
#: Bytes of terms, A to Z as lower case; all others separate.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
PIECES = ("lang string, prefix binary, leaves int, names array<string>, shared array<int>, rest array<binary>, docs array<bigint>, "
          "width array<int>, source array<int>, n array<bigint>")
BLOCKS = "lang string, terms array<string>, names array<string>, sums array<bigint>, width array<int>, source array<int>, n array<bigint>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


class Node:
    """A node of a radix trie; counts is None where no term ends."""

    __slots__ = ("label", "kids", "docs", "counts")

    def __init__(self, label: bytes, kids: dict | None = None):
        self.label, self.kids, self.docs, self.counts = label, kids, 0, None


class RadixTrie:
    def __init__(self):
        self.root, self.leaves, self.size, self.entries = Node(b""), 0, 0, 0

    def leaf(self, term: bytes) -> Node:
        """The node of a term, made if there is none."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            first = term[at]
            kids = node.kids
            if kids is None:
                kids = node.kids = {}
            kid = kids.get(first)
            if kid is None:
                kid = kids[first] = Node(term[at:])
                self.size += end - at
                at = end
            elif term.startswith(kid.label, at):
                at += len(kid.label)
            else:
                label, k = kid.label, 1
                most = min(len(label), end - at)
                while k < most and label[k] == term[at + k]:
                    k += 1
                upper = kids[first] = Node(label[:k], {label[k]: kid})
                kid.label = label[k:]
                kid = upper
                at += k
            node = kid
        if node.counts is None:
            node.counts = {}
            self.leaves += 1
        return node

    def walk(self) -> Iterator[tuple[int, bytes, Node]]:
        """(bytes shared with the term before, term, node) in the order of bytes."""
        stack, path, low = [(self.root, 0)], b"", 0
        while stack:
            node, at = stack.pop()
            low = min(low, at)
            path = path[:at] + node.label
            if node.counts is not None:
                yield low, path, node
                low = len(path)
            if node.kids:
                stack.extend((node.kids[b], len(path)) for b in sorted(node.kids, reverse=True))

    def merge(self, piece: dict) -> None:
        """Add the leaves of a piece."""
        names, at, term = piece["names"], 0, b""
        source, n = piece["source"], piece["n"]
        for shared, rest, docs, width in zip(piece["shared"], piece["rest"], piece["docs"], piece["width"]):
            term = term[:shared] + rest
            node = self.leaf(term)
            node.docs += docs
            c = node.counts
            for k in range(at, at + width):
                s = names[source[k]]
                c[s] = c.get(s, 0) + n[k]
            at += width


class _Pieces:
    """Pieces on their way out, as columns: lists are flat, with where each row's begin."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.flat: dict[str, list] = {f.name: [] for f in _PIECES}
        self.begin: dict[str, list[int]] = {f.name: [] for f in _PIECES if pa.types.is_list(f.type)}

    def cut(self, lang: str, trie: RadixTrie, depth: int) -> Iterator[pa.RecordBatch]:
        """The trie's pieces; those that are full batches are given at once, the last ones stay."""
        flat, prefix, index, first = self.flat, None, {}, 0
        names, shared_of, rest, docs, width, source, n_of = (flat[c] for c in ("names", "shared", "rest", "docs", "width", "source", "n"))
        for shared, term, node in trie.walk():
            if prefix is None or term[:depth] != prefix:
                if prefix is not None:
                    flat["leaves"].append(len(rest) - first)
                if len(rest) >= GIVEN:
                    yield from self.batches()
                    flat = self.flat
                    names, shared_of, rest, docs, width, source, n_of = (flat[c] for c in ("names", "shared", "rest", "docs", "width", "source", "n"))
                prefix, shared, index, first = term[:depth], 0, {}, len(rest)
                flat["lang"].append(lang)
                flat["prefix"].append(prefix)
                for c, at in self.begin.items():
                    at.append(len(flat[c]))
            shared_of.append(shared)
            rest.append(term[shared:])
            docs.append(node.docs)
            width.append(len(node.counts))
            for s, n in node.counts.items():
                k = index.get(s)
                if k is None:
                    k = index[s] = len(index)
                    names.append(s)
                source.append(k)
                n_of.append(n)
        if prefix is not None:
            flat["leaves"].append(len(rest) - first)

    def batches(self, step: int = 4096) -> Iterator[pa.RecordBatch]:
        columns = []
        for f in _PIECES:
            flat = self.flat[f.name]
            if f.name in self.begin:
                columns.append(pa.ListArray.from_arrays(pa.array([*self.begin[f.name], len(flat)], pa.int32()), pa.array(flat, f.type.value_type)))
            else:
                columns.append(pa.array(flat, f.type))
        whole = pa.RecordBatch.from_arrays(columns, schema=_PIECES)
        self.clear()
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, lists of numbers by way of numpy."""
    lists, plain = {}, {}
    for name, c in zip(b.schema.names, b.columns):
        if pa.types.is_list(c.type):
            lists[name] = (c.offsets.to_numpy().tolist(), c.values.to_numpy(zero_copy_only=False) if not pa.types.is_struct(c.type.value_type) else c.values.to_pylist())
        else:
            plain[name] = c.to_pylist()
    for k in range(b.num_rows):
        row = {name: v[k] for name, v in plain.items()}
        for name, (at, v) in lists.items():
            part = v[at[k]:at[k + 1]]
            row[name] = part if isinstance(part, list) else part.tolist()
        yield row


def _list(kind: pa.DataType) -> pa.DataType:
    return pa.list_(kind)


_PIECES = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("leaves", pa.int32()), ("names", _list(pa.string())), ("shared", _list(pa.int32())), ("rest", _list(pa.binary())),
                     ("docs", _list(pa.int64())), ("width", _list(pa.int32())), ("source", _list(pa.int32())), ("n", _list(pa.int64()))])
_BLOCKS = pa.schema([("lang", pa.string()), ("terms", _list(pa.string())), ("names", _list(pa.string())), ("sums", _list(pa.int64())), ("width", _list(pa.int32())),
                     ("source", _list(pa.int32())), ("n", _list(pa.int64()))])


def _uncollected(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run without the collector of cycles, which tries have none of and which would go through all their nodes again and again."""

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return quiet


def _count(counted_most: int, leaves_most: int):
    """Makes pieces of the tries of a task's documents (lang, source, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, RadixTrie] = defaultdict(RadixTrie)
        docs: dict[str, Counter] = defaultdict(Counter)
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)
        out = _Pieces()

        def pour() -> None:
            for lang, seen in docs.items():
                leaf = tries[lang].leaf
                at = {t: leaf(t) for t in seen}
                for t, n in seen.items():
                    at[t].docs += n
                for (where, source), counts in found.items():
                    if where == lang:
                        for t, n in counts.items():
                            c = at[t].counts
                            if source not in c:
                                tries[lang].entries += 1
                            c[source] = c.get(source, 0) + n
            docs.clear()
            found.clear()

        def cut() -> Iterator[pa.RecordBatch]:
            pour()
            while tries:
                yield from out.cut(*tries.popitem(), PREFIX)
            yield from out.batches()

        held = 0
        for b in batches:
            for lang, source, text in ((x.as_py() for x in row) for row in zip(*b.columns)):
                words = terms(text)
                once = set(words)
                docs[lang].update(once)
                found[lang, source].update(words)
                held += len(once)
                if held > counted_most:
                    if sum(map(len, found.values())) > counted_most // 2:
                        pour()
                        if sum(max(t.leaves + t.entries // 4, t.size // 50) for t in tries.values()) > leaves_most:
                            yield from cut()
                    held = 0
        yield from cut()

    return _uncollected(run)


def _deepen(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pieces()
        for b in batches:
            for row in _rows(b):
                trie = RadixTrie()
                trie.merge(row)
                yield from out.cut(row["lang"], trie, depth)
                yield from out.batches()

    return run


def counted(docs: DataFrame, counted_most: int = COUNTED, leaves_most: int = LEAVES, hot_leaves: int = HOT) -> DataFrame:
    """Pieces (see PIECES) of the terms of documents (lang, source, text); a null is empty.

    A prefix with over hot_leaves in all is cut deeper, as often as that parts them.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source", "text")]
    rows = docs.select(text[0].alias("lang"), text[1].alias("source"), text[2].cast("binary").alias("text"))
    now, depth, kept = common.settle(rows.mapInArrow(_count(counted_most, leaves_most), PIECES)), PREFIX, []
    while True:
        sizes = now.groupBy("lang", "prefix").agg(F.sum("leaves").alias("all"), F.count(F.lit(1)).alias("parts"))
        hot = common.settle(sizes.where((F.col("all") > hot_leaves) & (F.col("all") > 4 * F.col("parts"))).select("lang", "prefix"))
        if hot.isEmpty():
            return reduce(DataFrame.unionByName, kept, now)
        # a row for so many leaves at least, so this is a small table, and pieces stay where they are
        depth += DEEPER
        kept.append(now.join(hot, ["lang", "prefix"], "left_anti").select(*now.columns))
        now = common.settle(now.join(hot, ["lang", "prefix"], "left_semi").select(*now.columns).mapInArrow(_deepen(depth), PIECES))


def _merge(least: int, block_terms: int = BLOCK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, RadixTrie()
        block: dict | None = None
        index: dict[str, int] = {}

        def given() -> Iterator[pa.RecordBatch]:
            if block is not None and block["terms"]:
                yield pa.RecordBatch.from_pylist([block], schema=_BLOCKS)

        def empty(lang: str) -> None:
            nonlocal block
            block = {"lang": lang, "terms": [], "names": [], "sums": [], "width": [], "source": [], "n": []}
            index.clear()

        def closed() -> Iterator[pa.RecordBatch]:
            """The kept terms of the prefix that ends here go to blocks of their language."""
            if now is None:
                return
            if block is None or block["lang"] != now[0]:
                yield from given()
                empty(now[0])
            for _, term, node in trie.walk():
                if node.docs < least:
                    continue
                if len(block["terms"]) >= block_terms or len(block["n"]) >= ENTRIES:
                    yield from given()
                    empty(now[0])
                block["terms"].append(term.decode("utf-8", "replace"))
                block["width"].append(len(node.counts))
                for s, n in node.counts.items():
                    k = index.get(s)
                    if k is None:
                        k = index[s] = len(index)
                        block["names"].append(s)
                        block["sums"].append(0)
                    block["sums"][k] += n
                    block["source"].append(k)
                    block["n"].append(n)

        for b in batches:
            for row in _rows(b):
                if (row["lang"], row["prefix"]) != now:
                    yield from closed()
                    now, trie = (row["lang"], row["prefix"]), RadixTrie()
                trie.merge(row)
        yield from closed()
        yield from given()

    return _uncollected(run)


def probability(count: np.ndarray, total: np.ndarray | int, v: int) -> np.ndarray:
    """p of counts, exact: beyond what 64 bits hold, by whole numbers of any size."""
    if len(count) and int(count.max()) > 9_000_000_000:
        wide = count.astype(object)
        return (1 + UNIT * (wide + SMOOTH) // (np.asarray(total).astype(object) + SMOOTH * v)).astype(np.int64)
    return 1 + UNIT * (count + SMOOTH) // (total + SMOOTH * v)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over blocks of terms for pairs of sources, and the first LISTED terms of each group of these blocks.

    Blocks come with v and their language's sources (profile: source, total).
    """
    sums: dict[str, tuple[list[str], np.ndarray]] = {}
    best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

    def rows(cells: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(cells), 50_000):
            c = list(zip(*cells[at:at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "part", "item", "value"])

    def given() -> Iterator[pa.RecordBatch]:
        for lang, (names, m) in sums.items():
            for i in range(len(names)):
                yield from rows([(lang, names[i], "pair", names[j], int(m[i, j])) for j in range(i + 1, len(names)) if m[i, j]])
        sums.clear()

    for b in batches:
        for r in _rows(b):
            lang, names, v = r["lang"], [x["source"] for x in r["profile"]], r["v"]
            total, place = np.array([x["total"] for x in r["profile"]], np.int64), {s["source"]: i for i, s in enumerate(r["profile"])}
            of = np.array([place[s] for s in r["names"]], np.int64)[np.array(r["source"], np.int64)]
            row, n = np.repeat(np.arange(len(r["terms"])), r["width"]), np.array(r["n"], np.int64)
            if lang not in sums:
                if sum(m.size for _, m in sums.values()) > ENTRIES:
                    yield from given()
                sums[lang] = (names, np.zeros((len(names), len(names)), np.int64))
            m = sums[lang][1]
            step = max(1, ENTRIES // len(names))
            for at in range(0, len(r["terms"]), step):
                end = min(at + step, len(r["terms"]))
                here = (row >= at) & (row < end)
                count = np.zeros((len(names), end - at), np.int64)
                count[of[here], row[here] - at] = n[here]
                p = np.stack([probability(c, t, v) for c, t in zip(count, total)])
                q = probability(count.sum(axis=0), int(total.sum()), v)
                for i in range(len(names)):
                    m[i, i + 1:] += divergence(p[i + 1:], p[i]).sum(axis=1)
                    told = np.flatnonzero((count[i] > 0) & (p[i] > q))
                    f = divergence(p[i][told], q[told])
                    first = np.argsort(-f, kind="stable")[:LISTED]
                    new = [(-int(f[x]), r["terms"][at + int(told[x])].encode()) for x in first]
                    if new:
                        key = (lang, names[i])
                        best[key] = sorted(best.get(key, []) + new)[:LISTED]
    yield from given()
    yield from rows([(lang, s, "term", t.decode(), -f) for (lang, s), found in best.items() for f, t in found])


def divergences(docs: DataFrame, least: int = LEAST_DOCS, block_terms: int = BLOCK, **limits: int) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its most telling terms.

    Nulls are empty texts and names. A row is a document, repeated ones too.
    Groups without terms have pairs of the value 0; an empty table gives no
    rows. Ties go by the item's bytes. Other columns are ignored. limits are those of counted.
    """
    pieces = counted(docs, **limits)
    blocks = common.settle(pieces.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(_merge(least, block_terms), BLOCKS))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    total = blocks.select("lang", F.inline(F.arrays_zip(F.col("names").alias("source"), F.col("sums").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = common.settle(docs.select(*group).distinct().join(total, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))))
    profile = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("profile"))  # as long as the answer's rows are for one source
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    measured = common.settle(blocks.join(profile.join(kept, "lang"), "lang").mapInArrow(_measure, "lang string, source string, part string, item string, value bigint"))
    half = measured.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(measured.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where(f"part = 'pair' OR rank <= {LISTED}")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(common.table(spark, sf_dir, "documents"))


_F = "((p - q) * (p - q)) // (p + q)"
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT row_id, lang, source, unnest(w) AS t FROM d),
k AS MATERIALIZED (SELECT lang, t FROM o GROUP BY lang, t HAVING count(DISTINCT row_id) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, t, count(*) AS c FROM o JOIN k USING (lang, t) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, t, coalesce(c.c, 0) AS c, CAST(1 + ({UNIT} * (CAST(coalesce(c.c, 0) AS HUGEINT) + {SMOOTH})) // (coalesce(n.n, 0) + {SMOOTH} * v.v) AS HUGEINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t) LEFT JOIN n USING (lang, source)),
l AS (SELECT lang, t, CAST(1 + ({UNIT} * (CAST(sum(c) AS HUGEINT) + {SMOOTH})) // ((SELECT sum(n) FROM n WHERE n.lang = c.lang) + {SMOOTH} * (SELECT v FROM v WHERE v.lang = c.lang)) AS HUGEINT) AS q FROM c GROUP BY lang, t),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum({_F}) FROM (SELECT x.p AS p, y.p AS q FROM p x JOIN p y USING (lang, t) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
tm AS (SELECT p.lang, p.source, 'term' AS part, t AS item, {_F} AS value FROM p JOIN l USING (lang, t) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm)) WHERE part = 'pair' OR rank <= {LISTED}"""
