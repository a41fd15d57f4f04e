"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

Radius mode: documents whose 64-bit fingerprints differ in at most `radius` bits
are linked. The tables are masks with structure: every bit of the fingerprint
gets a code of radius + 1 bits, and the mask of table v holds the bits whose
code has an odd product with v. For any set of at most `radius` differing bits
some v is orthogonal to all their codes, so the two fingerprints agree under that
mask and meet in its table: no pair within the radius is missed.

Similarity mode: the same tables give the pairs within the radius, none missed,
and each is verified on the full shingle sets. A Jaccard similarity of 0.8 moves
about 15 % of a SimHash's bits, more than a radius that tables can cover, so the
links beyond the radius are found besides: documents meet by short sketches of
their shingles (pairs of minima), are compared by a 256-bit SimHash, and are
verified alike. Where a bucket of either kind is too crowded for all its pairs,
those that the SimHash ranks first are tried first; the components that are then
left in it are compared in full.

Documents with equal fingerprints or shingle sets are one node from the start,
so a group of copies of any size costs one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import worker
from helixframe.llm.rows import ROW, carried, returned
from helixframe.llm.words import split
from helixframe.operators.graph import connected_components
from helixframe.session import Scratch

BITS = 64
#: Nodes of a bucket that are compared in one step; larger buckets are compared block by block.
BLOCK = 2048
#: Buckets up to this size give all their close pairs; larger ones a spanning forest and each node's nearest ones.
ALL_PAIRS, NEAREST = 16, 4
#: Similarity mode: sketches of two minima each, and the 256-bit distance up to which a pair is verified.
SKETCHES, SLACK = 10, 80
#: Shingle sets of a cell of a crowded bucket, in bytes, about half of what it holds.
CELL_BYTES = 1 << 23
#: Shingles that are counted at once.
CHUNK = 1 << 16

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text with A-Z lower-cased, repeats included.

    Fewer words than size: the whole sequence is the one shingle. No words: none.
    """
    words = split(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words).lower()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash family's value of each shingle hash."""
    x = (h ^ (h >> np.uint64(31))) * (_MIX[k % 4] + np.uint64(2 * k))
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2**(radius + 1) - 1 covering masks. Bit i's code is i mod 2**(radius + 1), so codes are spread evenly."""
    codes = [i % (1 << (radius + 1)) for i in range(bits)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def _table_keys(node: str, radius: int):
    """The bucket of a fingerprint, a signed long, in each of the covering tables."""
    return F.array(*[F.xxhash64(F.lit(t), F.col(node).bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks(radius))])


def _sign(node: str):
    """A fingerprint's eight bytes."""
    return F.unhex(F.lpad(F.hex(node), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, node: the 64-bit SimHash of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("neardup")
        for batch in batches:
            made = [_signed(majority(shingle_hashes(t, size))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node long")


def _mark():
    """Tells the rows of one doc_id, or of none, apart by their text."""
    return F.xxhash64(F.col("text").cast("string"))


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, mark (hash of the text), node (hash of the shingle set), print (64-bit SimHash), sign (256-bit SimHash), keys (sketches) of every row."""

    def one(text: str | None) -> tuple[int, int, bytes, list[int]]:
        h = np.unique(shingle_hashes(text, size))
        node = xxhash.xxh3_64_intdigest(h.astype("<u8").tobytes())
        sign = b"".join(majority(_mixed(h, 100 + k)).to_bytes(8, "little") for k in range(4))
        least = [int(_mixed(h, k).min()) if len(h) else 0 for k in range(2 * SKETCHES)]
        keys = [_signed(xxhash.xxh3_64_intdigest(b"%d %d %d" % (k, least[2 * k], least[2 * k + 1]))) for k in range(SKETCHES)]
        return _signed(node), _signed(majority(h)), sign, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("neardup")
        for batch in batches:
            nodes, prints, signs, keys = zip(*map(one, batch.column(1).to_pylist()), strict=True) if len(batch) else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "node", "print", "sign", "keys"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _mark().alias("mark"))
    return plain.mapInArrow(run, "doc_id long, mark long, node long, print long, sign binary, keys array<long>")


def _distance(signs: np.ndarray, i: int) -> np.ndarray:
    return np.bitwise_count(signs ^ signs[i]).sum(axis=1, dtype=np.int64)


def close_pairs(signs: np.ndarray, most: int, everything: bool) -> list[tuple[int, int, int]]:
    """(i, j, distance) of pairs within `most` bits: all, or else a minimum spanning forest and nearest ones.

    The forest joins whatever is joined by links of any bound, so it keeps every component.
    """
    n, out = len(signs), []
    if n <= ALL_PAIRS and everything:
        for i in range(n - 1):
            d = _distance(signs[i:], 0)
            out += [(i, i + int(j), int(d[j])) for j in np.flatnonzero(d[1:] <= most) + 1]
        return out
    best, parent = _distance(signs, 0), np.zeros(n, np.int64)
    best[0], done = np.iinfo(np.int64).max, np.zeros(n, bool)
    done[0] = True
    for _ in range(n - 1):
        j = int(best.argmin())
        if best[j] <= most:
            out.append((int(parent[j]), j, int(best[j])))
        done[j] = True
        d = _distance(signs, j)
        if everything:
            d[j] = np.iinfo(np.int64).max
            out += [(j, int(k), int(d[k])) for k in np.argpartition(d, NEAREST)[:NEAREST] if d[k] <= most]
        nearer = (d < best) & ~done
        best[nearer], parent[nearer] = d[nearer], j
        best[j] = np.iinfo(np.int64).max
    return out


def links(rows: DataFrame, most: int, everything: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes that share a key and whose signs differ in at most `most` bits.

    rows: key long, node long, sign binary, each node once for a key. Buckets of
    one node are dropped after counting. A bucket of over BLOCK nodes is dealt
    out as cells, pairs of blocks, so that no task holds it whole and no pair of
    its nodes is left out. A cell gives a number of pairs that is linear in its nodes.
    """
    held = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.expr("transform(sequence(0, blocks - 1), o -> named_struct('i', least(o, own), 'j', greatest(o, own)))")
    dealt = rows.join(held, "key").withColumn("own", own).select("key", "node", "sign", F.explode(cells).alias("cell")).select("key", "cell.i", "cell.j", "node", "sign")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("neardup")
        left: pa.Table | None = None

        def compare(table: pa.Table) -> pa.RecordBatch:
            key, i, j, node = (table.column(c).to_numpy() for c in range(4))
            signs = np.frombuffer(b"".join(table.column(4).to_pylist()), "<u8").reshape(len(key), -1) if len(key) else np.zeros((0, 1), np.uint64)
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(key)]])
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            near = two[np.bitwise_count(signs[two] ^ signs[two + 1]).sum(axis=1) <= most]
            a, b = [node[near]], [node[near + 1]]
            for s, e in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist(), strict=True):
                if pairs := close_pairs(signs[s:e], most, everything):
                    x = np.array(pairs)
                    a.append(node[s + x[:, 0]])
                    b.append(node[s + x[:, 1]])
            both = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([left, table]).combine_chunks() if left is not None else table
            key, i, j = (table.column(c).to_numpy() for c in range(3))
            last = np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
            if cut:
                yield compare(table.slice(0, cut))
            left = table.slice(cut)
        if left is not None:
            yield compare(left)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_components(made: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, node, component_id of each row of made: the smallest doc_id of all rows in the node's component. roots: node, component."""
    first = nodes.select("node", "least").join(roots, "node")
    of_root = first.groupBy("component").agg(F.min("least").alias("__least"))
    linked = first.join(of_root, "component").select("node", F.col("__least").alias("linked"))
    named = nodes.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("linked", "least").alias("component_id"))
    return made.join(named, "node")


def by_radius(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """doc_id, node (fingerprint as signed long), component_id of every row of docs (doc_id, text).

    Links: fingerprints that differ in at most radius bits; component_id is the
    smallest doc_id reachable, the row's own included. Null and empty texts have
    fingerprint 0 and are linked like any other. A null doc_id takes part; it is
    a component's id only where no row of the component has one. Repeated rows
    each give a row; of equal doc_ids no order matters. An empty table gives no
    rows. Texts are used whole, however long. Other columns than doc_id and text
    are not read, so none can clash.
    """
    scratch = Scratch(docs.sparkSession)
    made = scratch.save(fingerprints(docs, size), "fingerprints")
    nodes = scratch.save(made.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    edges = scratch.save(links(nodes.select(F.explode(_table_keys("node", radius)).alias("key"), "node", _sign("node").alias("sign")), radius), "links")
    return _with_components(made, nodes, connected_components(edges))


def _texts(docs: DataFrame, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """__node and __text of some of the nodes, by the doc_id and mark of their first row."""
    chosen = nodes.join(some, "node").select(F.col("node").alias("__node"), F.col("least").alias("__least"), F.col("mark").alias("__mark"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__least"), F.col("text").cast("string").alias("__text"), _mark().alias("__mark"))
    same = (texts["__mark"] == chosen["__mark"]) & texts["__least"].eqNullSafe(chosen["__least"])
    return texts.join(chosen, same).select("__node", "__text")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """node and the sorted distinct shingle hashes (little-endian) of rows with __node and __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("neardup")
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            own = pa.array([_signed(xxhash.xxh3_64_intdigest(x)) for x in sets], pa.int64())
            made = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
            yield made.filter(pc.equal(own, batch.column(0)))  # a mark may stand for several texts

    return docs.select("__node", "__text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges whose shingle sets have at least that Jaccard similarity."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("neardup")
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(same >= similarity * (len(p) + len(q) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def missing_links(root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) between members of different components, as many as it takes to join all that any pair links.

    Every pair whose components are not yet joined is compared. No set is empty.
    """
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    label, mark, out = np.unique(root, return_inverse=True)[1], np.zeros(len(kinds), np.int32), []
    for i in range(len(sets) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = flat[starts[i] : ends[i]]
        mark[own] = 1
        same = np.add.reduceat(mark[flat[ends[i] :]], starts[i + 1 :] - ends[i])
        mark[own] = 0
        for j in (np.flatnonzero(same >= similarity * (sizes[i] + sizes[i + 1 :] - same)) + i + 1).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _crowded(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root of the buckets of over ALL_PAIRS nodes that hold more than one component. rows: key, node."""
    many = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > ALL_PAIRS).select("key")
    named = rows.join(many, "key").join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return named.join(mixed, "key")


def _missed(crowded: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the components of each crowded bucket that any pair of its nodes links.

    A bucket is dealt out as pairs of blocks, as in links; sets go to the cells
    and are compared there, and a cell gives fewer links than it has nodes.
    """
    rows = crowded.join(sets.filter(F.length("shingles") > 0), "node")
    blocks = F.ceil(F.greatest(F.sum(F.length("shingles")) / CELL_BYTES, F.count("*") / BLOCK)).cast("int")
    held = rows.groupBy("key").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.expr("transform(sequence(0, blocks - 1), o -> named_struct('i', least(o, own), 'j', greatest(o, own)))")
    dealt = rows.join(held, "key").withColumn("own", own).select("key", F.explode(cells).alias("cell"), "node", "root", "shingles").select("key", "cell.i", "cell.j", "node", "root", "shingles")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("neardup")
        cell, node, root, sets_ = None, [], [], []

        def compare() -> pa.RecordBatch:
            x = np.array(missing_links(np.array(root), sets_, similarity), np.int64).reshape(-1, 2)
            at = np.array(node, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[x[:, 0]]), pa.array(at[x[:, 1]])], names=["a", "b"])

        for batch in batches:
            key, i, j, n, r = (batch.column(c).to_pylist() for c in range(5))
            for k, row in enumerate(zip(key, i, j, strict=True)):
                if row != cell:
                    if len(node) > 1:
                        yield compare()
                    cell, node, root, sets_ = row, [], [], []
                node.append(n[k])
                root.append(r[k])
                sets_.append(np.frombuffer(batch.column(5)[k].as_py(), "<u8"))
        if len(node) > 1:
            yield compare()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _similar(docs: DataFrame, similarity: float, size: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, node), nodes (node, least and mark of the first row by doc_id, nulls last) and roots (node, component) of linked nodes."""
    scratch = Scratch(docs.sparkSession)
    made = scratch.save(sketches(docs, size), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    nodes = made.groupBy("node").agg(first, *[F.any_value(c).alias(c) for c in ("print", "sign", "keys")])
    nodes = scratch.save(nodes.select("node", F.col("first.doc_id").alias("least"), F.col("first.mark").alias("mark"), "print", "sign", "keys"), "nodes")
    covered = nodes.select(F.explode(_table_keys("print", radius)).alias("key"), "node", _sign("print").alias("sign"))
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "sign")
    within = scratch.save(links(covered, radius, True), "within")
    near = scratch.save(within.union(links(keyed, SLACK, True)).distinct(), "near")
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = _shingle_sets(_texts(docs, nodes, ends), size)
    edges = scratch.save(_verified(near, sets, similarity), "links")
    roots = connected_components(edges)
    crowded = scratch.save(_crowded(covered.select("key", "node").union(keyed.select("key", "node")), roots), "crowded")
    if not crowded.isEmpty():
        sets = scratch.save(_shingle_sets(_texts(docs, nodes, crowded.select("node").distinct()), size), "sets")
        missed = scratch.save(_missed(crowded, sets, similarity), "missed")
        if not missed.isEmpty():
            roots = connected_components(edges.unionByName(missed))
    return made.select("doc_id", "node"), nodes, roots


def by_similarity(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, node, component_id of every row: linked if the Jaccard similarity of the shingle sets is at least that.

    Rows as in by_radius. Rows without words have equal, empty shingle sets and
    are copies of each other. A pair at the similarity bound whose 64-bit
    fingerprints differ in at most radius bits is never missed. Another pair at the similarity bound shares a sketch with
    probability 1 - (1 - similarity**2)**SKETCHES, 0.99996 at 0.8. Where its
    texts have 4 and 5 shingles, the worst case, a bit of the SimHash differs with
    probability 0.1875, so over SLACK of 256 bits do with 5.5e-7: a pair at 0.8 is
    missed with 3.7e-5 in all.
    """
    return _with_components(*_similar(docs, similarity, size, radius))


def deduplicate(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = 3) -> DataFrame:
    """The rows of docs of which each group of near-duplicates keeps one: that of its smallest doc_id.

    Columns are those of docs, whatever their names. Repeated rows of one doc_id
    and text are copies, one stays; rows of one doc_id, or of none, whose texts are
    not near-duplicates all stay. A row without doc_id is kept only where its whole
    group has none. Null and empty texts, and texts without words, are copies of
    each other. Texts are used whole. An empty table gives no rows.
    """
    _, nodes, roots = _similar(docs, similarity, size, radius)
    root = F.coalesce("component", "node")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node", "mark")).alias("first")
    kept = nodes.join(roots, "node", "left").groupBy(root.alias("root")).agg(first).select(F.col("first.least").alias("keep"), F.col("first.mark").alias("kept"))
    # rows of one doc_id and text differ only in their other columns; the least hash of these decides
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]))
    rows = carried(docs, F.col("doc_id").cast("long").alias("id"), _mark().alias("mark"), F.xxhash64(others).alias("order"))
    same = (rows["mark"] == kept["kept"]) & rows["id"].eqNullSafe(kept["keep"])
    found = rows.join(kept, same, "left_semi").groupBy("id", "mark").agg(F.min_by(ROW, "order").alias(ROW))
    return found.select(*returned(found))


def hex_fingerprint(node: str = "node"):
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(node), 16, "0"))
