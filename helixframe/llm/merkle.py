"""Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources, and a proof for each row.

Leaves get their place in their source by a prefix scan. Then every task walks its
leaves as events: a child's digest goes to the partial parent that its place
names; a parent whose children are all there, as many as its place and the
source's size ask for, gets its digest and is at once an event for its own parent.
Leaves come in order, so nearly all parents are met whole in one task. What stays
open at a task's ends, a few digests a level, is the frontier: it is dealt anew
by parent with combineByKey, which may complete parents in turn, until none is
open; each round reaches one level at least.

A node's parent follows from its place, so proofs are made downwards by joins on
it: a node's path is its siblings left and right of it and its parent's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import scan
from helixframe.session import Scratch

#: Children of a node, but for the last of a level; digits of its number in bits.
BITS = 4
ARITY = 1 << BITS
#: Columns of a leaf, in the order of its digest.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: What a task or a round gives: nodes (children, and docs and tampered of leaves), and open children (digest, doc, altered) of parents that lack others.
GROWN = "tree string, level int, idx long, n long, digest string, children array<string>, docs array<long>, altered array<string>, doc long, other string, open boolean"
_ARROW = pa.schema(
    [
        ("tree", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string())), ("docs", pa.list_(pa.int64())),
        ("altered", pa.list_(pa.string())), ("doc", pa.int64()), ("other", pa.string()), ("open", pa.bool_()),
    ]
)


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of values: each is `-` if null, else its length in UTF-8 bytes, a colon and itself."""
    parts = []
    for v in values:
        text = v.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def source_key(source: Column) -> Column:
    """A source as a string that is never null and sorts as null first, then by its bytes."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


def leaves(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """tree, doc, digest and other (the digest with another text; null where altered_text is null or not given) of each row."""
    of = lambda c: F.col(f"`{c}`")
    plain = digest(*map(of, FIELDS))
    other = F.lit(None).cast("string") if altered_text is None else F.when(altered_text.isNotNull(), digest(*map(of, FIELDS[:-1]), altered_text))
    return docs.select(source_key(of("source")).alias("tree"), of("doc_id").cast("long").alias("doc"), plain.alias("digest"), other.alias("other"))


def placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves with idx, from 0 in the order of doc (null first) and digest, and n, the number of leaves, of their tree."""
    dealt = scan.deal(rows, ["tree"], ["doc", "digest"], scratch, "leaves")
    held = dealt.groupBy(scan.RANGE, "tree").agg(F.count("*").alias("held"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy(scan.RANGE).rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select(scan.RANGE, "tree", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"), F.sum("held").over(whole).alias("n"))
    met = dealt.join(bases.hint("merge"), [scan.RANGE, "tree"])
    place = F.col("base") + F.row_number().over(scan.within(["tree"])) - 1
    return met.select("tree", place.cast("long").alias("idx"), "n", "digest", "doc", "other")


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _arity(n: int, parent: int) -> int:
    """Children of a parent where its level has n of them."""
    return min(ARITY, n - (parent << BITS))


def _node(key: tuple[str, int, int], n: int, children: list[tuple]) -> tuple:
    """The row of a parent whose children, as (idx, digest, doc, other), are all there. A lone leaf stays as it is."""
    tree, level, parent = key
    children.sort(key=lambda c: c[0])
    digests = [c[1] for c in children]
    own = digests[0] if n == 1 else _hash(digests)
    docs, altered = ([c[2] for c in children], [c[3] for c in children]) if level == 0 else (None, None)
    return (tree, level + 1, parent, -(-n // ARITY), own, digests, docs, altered, None, None, False)


def _open(key: tuple[str, int, int], n: int, children: list[tuple]) -> Iterator[tuple]:
    """The rows of the children of a parent that lacks others."""
    for idx, own, doc, other in children:
        yield (key[0], key[1], idx, n, own, None, None, None, doc, other, True)


def _ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map side: every parent that the task's leaves complete, and then the children that wait for others."""
    waiting: dict[tuple[str, int, int], list[tuple]] = {}
    sizes: dict[tuple[str, int, int], int] = {}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        out = []
        for tree, idx, n, own, doc, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, child = (tree, 0, idx >> BITS), (idx, own, doc, other)
            while True:
                have = waiting.setdefault(key, [])
                have.append(child)
                if len(have) < _arity(n, key[2]):
                    sizes[key] = n
                    break
                del waiting[key]
                sizes.pop(key, None)
                node = _node(key, n, have)
                out.append(node)
                n = node[3]
                if n == 1:
                    break
                key, child = (tree, node[1], node[2] >> BITS), (node[2], node[4], None, None)
        if out:
            yield made(out)
    rest = [row for key, have in waiting.items() for row in _open(key, sizes[key], have)]
    for at in range(0, len(rest), 10_000):
        yield made(rest[at : at + 10_000])


def _settled(combined: Iterator[tuple]) -> Iterator[tuple]:
    """Of each combined parent its node, which is an open child of the next level unless it is the root, or else its children again."""
    for key, (n, children) in combined:
        if len(children) < _arity(n, key[2]):
            yield from _open(key, n, children)
            continue
        node = _node(key, n, children)
        yield node
        if node[3] > 1:
            yield (node[0], node[1], node[2], node[3], node[4], None, None, None, None, None, True)


def grow(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """All nodes above the leaves (tree, idx, n, digest, doc, other): tree, level from 1, idx, n of that level, digest, children, docs, altered.

    The root of a tree has n = 1. A tree of one leaf has that leaf's digest as its only node.
    """
    spark = rows.sparkSession
    grown = scratch.save(rows.select("tree", "idx", "n", "digest", "doc", "other").mapInArrow(_ancestors, GROWN), f"{name}-0")
    every, step = grown, 0
    waiting = grown.filter("open").select("tree", "level", "idx", "n", "digest", "doc", "other")
    while not waiting.isEmpty():
        step += 1
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = waiting.rdd.map(lambda r: ((r[0], r[1], r[2] >> BITS), (r[3], (r[2], r[4], r[5], r[6]))))
        combined = pairs.combineByKey(lambda v: (v[0], [v[1]]), lambda c, v: (c[0], [*c[1], v[1]]), lambda c, d: (c[0], c[1] + d[1]), tasks)
        grown = scratch.save(spark.createDataFrame(combined.mapPartitions(_settled), GROWN, verifySchema=False), f"{name}-{step}")
        every = every.unionByName(grown)
        waiting = grown.filter("open").select("tree", "level", "idx", "n", "digest", "doc", "other")
    return every.filter("not open").select("tree", "level", "idx", "n", "digest", "children", "docs", "altered")


#: A path: for each level, from below, the siblings left and right of a node, their digests joined.
PATH = "array<struct<left: string, right: string>>"


def _step(children: str, at: str) -> Column:
    """The siblings of the child with a number, as an array of one step."""
    left = F.array_join(F.slice(children, F.lit(1), F.col(at)), "")
    right = F.array_join(F.slice(children, F.col(at) + 2, F.lit(ARITY)), "")
    return F.array(F.struct(left.alias("left"), right.alias("right")))


def _children(nodes: DataFrame, *more: str | Column) -> DataFrame:
    """idx and path of the children of nodes with a path, and more columns of the node. The child of a lone leaf's node is that leaf, without siblings."""
    each = nodes.select("*", F.posexplode("children").alias("at", "child"))
    lone = (F.col("n") == 1) & (F.size("children") == 1)
    path = F.when(lone, F.col("path")).otherwise(F.concat(_step("children", "at"), F.col("path")))
    return each.select((F.col("idx") * ARITY + F.col("at")).alias("idx"), path.alias("path"), *more)


def descend(nodes: DataFrame, tops: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The nodes of level 1 with path, and with the other columns of tops: tree, path of its root, and more."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    highest = nodes.agg(F.max("level")).first()[0] or 0
    now = None
    for level in range(highest, 0, -1):
        here = nodes.filter(F.col("level") == level)
        found = here.filter("n = 1").join(tops.hint("merge"), "tree")
        if now is not None:
            found = found.unionByName(here.filter("n > 1").join(_children(now, "tree", *more).hint("merge"), ["tree", "idx"]))
        now = scratch.save(found, f"{name}-{level}") if level > 1 else found
    return now if now is not None else nodes.join(tops, "tree")


def proofs(docs: DataFrame, altered_text: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, altered_leaf, subroot, root, path.

    docs has doc_id, source, lang, n_chars and text; other columns are not read, so
    none can clash. The leaf is the digest of the five; altered_leaf is that with
    altered_text as the text, null where that is null. path has the siblings of
    each level from the leaf to the root, as left and right (their digests joined
    in order); fold() goes up by it. Leaves of a source are in the order of doc_id,
    null first, ties by leaf; rows alike in all five are leaves each. A null source
    is one of its own, before all others. Null, empty and long texts are digested
    as they are. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    nodes = grow(placed(leaves(docs, altered_text), scratch), scratch, "source")
    subroots = scratch.save(nodes.filter("n = 1").select("tree", F.col("digest").alias("subroot")), "subroots")
    n = subroots.count()
    ranked = scratch.save(scan.number(subroots, ["tree"], name="place").withColumn("place", F.col("place") - 1), "ranked")
    above = grow(ranked.select(F.lit("").alias("tree"), F.col("place").alias("idx"), F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest"), F.lit(None).cast("long").alias("doc"), F.lit(None).cast("string").alias("other")), scratch, "top")
    top = above.filter("n = 1").select("tree", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    places = _children(descend(above, top, scratch, "top-path"), "root").withColumnRenamed("idx", "place")
    tops = scratch.save(ranked.join(places.hint("merge"), "place").select("tree", "path", "subroot", "root"), "tops")
    low = descend(nodes, tops, scratch, "path")
    leaf = F.struct(F.get("docs", F.col("at")).alias("doc_id"), F.col("child").alias("leaf"), F.get("altered", F.col("at")).alias("altered_leaf"))
    found = _children(low, "subroot", "root", leaf.alias("leaf"))
    return found.select("leaf.doc_id", "leaf.leaf", "leaf.altered_leaf", "subroot", "root", "path")


def proof_text(path: Column) -> Column:
    """All siblings of a path, joined."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    step = lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256)
    return F.aggregate(path, leaf, step)
