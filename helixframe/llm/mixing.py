"""Mixing sources to target weights by a time-varying curriculum.

Each source s has a target T_s (words) and a weight schedule over training time
t in [0, 1], w_s(t) = T_s * (1 + a_s * (2t - 1)), whose integral over [0, 1] is T_s.
The documents of a source, in a fixed pseudo-random order and repeated epoch
after epoch, form its token stream. A document copy whose stream offset is c is
trained on at the time t where the integrated schedule D_s(t) = T_s * (t + a_s * (t^2 - t))
reaches c; D_s is inverted in closed form. Documents are range-sorted by t.

Only DataFrame and SQL functions are used. The running sums within a source and
those over sources are prefix scans over ranges, so no source, however hot, and no
list of sources, however long, is gathered into one task. Rows of one id and text,
of which there may be any number, are summed by the split that they stand in, so
they aren't either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.rows import ROW, carried, returned
from helixframe.llm.words import n_words
from helixframe.operators import scan
from helixframe.session import Scratch

def _running(rows: DataFrame, scratch: Scratch, name: str, order: Sequence[str], **sums: str) -> DataFrame:
    """rows with running sums over the whole order, the row itself left out: ranges of rows first, then each range alone.

    order has no ties. sums: new column by column that is summed.
    """
    ranged = scratch.save(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), name)
    ends = ranged.groupBy("range").agg(*[F.sum(c).alias(new) for new, c in sums.items()])  # as many rows as partitions
    before = Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("range", *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"{new}_base") for new in sums])
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(F.broadcast(bases), "range")
    return found.select(*rows.columns, *[(F.col(f"{new}_base") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(new) for new, c in sums.items()])


def targets(
    sizes: DataFrame,
    weights: Mapping[str | None, int] | None = None,
    cycle: Sequence[int] = (1, 2, 3),
    epochs: int = 3,
) -> DataFrame:
    """One row for each source: src, source_size, rank (from 1), target (double).

    sizes has src and source_size. The targets share 100 % of all sizes by
    weight; a target stops at epochs times its source's size and the excess is
    shared again by weight until none is above. That fixed point is reached at
    once in the order of size over weight: the capped sources are a prefix. Any
    number of sources: no task holds them all.
    """
    scratch = Scratch(sizes.sparkSession)
    ranked = _running(sizes.select("src", "source_size", F.lit(1).cast("long").alias("one")), scratch, "sources", ["src"], earlier="one")
    ranked = ranked.withColumn("rank", F.col("earlier") + 1)
    turn = ((F.col("rank") - 1) % len(cycle)).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), turn + 1).cast("long")
    if weights is not None:
        table = F.create_map(*[x for k, w in weights.items() for x in (F.lit("z" if k is None else "s" + k), F.lit(int(w)))])
        weight = F.coalesce(F.element_at(table, F.col("src")).cast("long"), F.lit(0).cast("long"))
    ranked = ranked.withColumn("weight", weight)
    # a source without weight takes nothing, so it comes last
    ranked = ranked.withColumn("ratio", F.when(F.col("weight") > 0, F.col("source_size") / F.col("weight")).otherwise(float("inf")))
    total = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    size, mass = (int(x or 0) for x in total)
    filled = _running(ranked.select("src", "source_size", "rank", "weight", "ratio"), scratch, "shares", ["ratio", "src"], size_before="source_size", weight_before="weight")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    filled = filled.withColumn("rest", F.lit(size).cast("long") - epochs * F.col("size_before")).withColumn("rest_weight", F.lit(mass).cast("long") - F.col("weight_before"))
    is_open = epochs * big("source_size") * big("rest_weight") >= big("rest") * big("weight")
    first = filled.filter(is_open).agg(F.min(F.struct("ratio", "src", "rest", "rest_weight"))).first()[0]  # one row
    capped = (epochs * F.col("source_size")).cast("double")
    if first is None:
        return filled.select("src", "source_size", "rank", capped.alias("target"))
    after = F.struct("ratio", "src") >= F.struct(F.lit(first["ratio"]).alias("ratio"), F.lit(first["src"]).alias("src"))
    share = (F.col("weight") * F.lit(first["rest"])).cast("double") / F.lit(float(first["rest_weight"] or 1))
    return filled.select("src", "source_size", "rank", F.when(after, share).otherwise(capped).alias("target"))


def _time(offset: Column, target: Column, slope: Column) -> Column:
    """Training time in [0, 1] at which the integrated schedule reaches offset."""
    u = offset / target
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)
    return F.when(slope == 0, u).otherwise((root - (1 - slope)) / (2 * slope))


def _placed(docs: DataFrame, weights: Mapping[str | None, int] | None = None, cycle: Sequence[int] = (1, 2, 3), epochs: int = 3, slopes: Sequence[float] = (0.5, -0.5, 0.0), keep: Sequence[str] | None = None) -> DataFrame:
    """ROW, doc, size, source_size, target, copies, start and slope of each document; see mix()."""
    scratch = Scratch(docs.sparkSession)
    of = lambda c: F.col(f"`{c}`")
    order = F.md5(F.concat(F.lit("mix "), F.coalesce(of("doc_id").cast("string"), F.lit("-"))))
    source = F.coalesce(F.concat(F.lit("s"), of("source").cast("string")), F.lit("z"))
    place = [F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("at")]  # as written, so they stay what they are
    # words are counted once; what is read twice below is this table
    sized = scratch.save(carried(docs, source.alias("src"), n_words(of("text")).alias("size"), order.alias("order"), of("doc_id").alias("doc"), F.xxhash64(of("text")).alias("tie"), *place, only=keep), "sized")
    # rows of one id and text are alike: each split has its run of them, and only runs are put in order
    alike = ["src", "order", "tie", "split"]
    parts = scratch.save(sized.groupBy(*alike).agg(F.sum("size").alias("held")), "parts")
    plan = scratch.save(targets(parts.groupBy("src").agg(F.sum("held").alias("source_size")), weights, cycle, epochs), "plan")
    turn = ((F.col("rank") - 1) % len(slopes)).cast("int")
    starts = (
        scan.running(parts, ["order", "tie", "split"], ["src"], upto="held")
        .join(plan, "src")
        .select(*alike, (F.col("upto") - F.col("held")).alias("base"), "source_size", "target", F.element_at(F.array(*[F.lit(float(a)) for a in slopes]), turn + 1).alias("slope"))
    )
    within = Window.partitionBy(*alike).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts.hint("merge"), alike).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    taken = lambda e: ((2 * (e * F.col("source_size") + F.col("start")) + F.col("size")).cast("double") <= 2 * F.col("target")).cast("int")
    copies = sum((taken(e) for e in range(1, epochs)), taken(0)).cast("long")
    return placed.select(ROW, "doc", "size", "source_size", "target", copies.alias("copies"), "start", "slope")


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, int] | None = None,
    cycle: Sequence[int] = (1, 2, 3),
    epochs: int = 3,
    slopes: Sequence[float] = (0.5, -0.5, 0.0),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row for each document with what the mix takes of it.

    docs has doc_id, text and source. Result: the columns in keep (all by
    default), then __size, __source_size, __target, __copies (0 to epochs) and
    __position (training time of the first copy; null if none is taken),
    __start, __slope for the later copies; they replace columns of these names.

    A source is a string in code point order, null last. A null or empty text has
    size 0; a long one is counted whole. Copy e of a document starts at
    e * source_size + offset; it is taken if its middle lies within the target, so
    a source's total misses its target by at most half of one document. Documents
    of size 0 are taken as their offset says and add no words. Repeated rows each
    count; rows that agree in doc_id and text are alike, so their order does not
    matter; rows without doc_id are in the order of their text's hash. An empty
    table gives an empty result. slopes: a_s of the schedules in turn, each in
    [-1, 1].
    """
    found = _placed(docs, weights, cycle, epochs, slopes, keep)
    first = F.when((F.col("copies") > 0) & (F.col("target") > 0), _time(F.col("start").cast("double"), F.col("target"), F.col("slope")))
    added = {"size": "__size", "source_size": "__source_size", "target": "__target", "copies": "__copies", "start": "__start", "slope": "__slope"}
    named = [F.col(c).alias(n) for c, n in added.items()]
    return found.select(*returned(found, *named[:4], first.alias("__position"), *named[4:]))


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """The training stream: each taken copy as a row with the columns of docs, range-sorted by training time.

    options and what holds for odd rows as in mix(). All columns of docs return as
    they are, whatever their names. Copies of one training time are in the order of
    doc_id, null first, then by epoch.
    """
    mixed = _placed(docs, **options)
    copies = mixed.filter("copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    offset = (F.col("epoch") * F.col("source_size") + F.col("start")).cast("double")
    when = F.when(F.col("target") > 0, _time(offset, F.col("target"), F.col("slope"))).otherwise(0.0)
    ordered = copies.withColumn("when", when).orderBy("when", "doc", "epoch")
    return ordered.select(*returned(ordered))
