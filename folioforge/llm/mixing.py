"""Mixing sources to target weights by entropy balancing (Hainmueller, 2012), with DataFrame operations only.

Document rates are as close as they can be, in relative entropy, to one each, under the constraint that the tokens of
each source come to its target and that no rate exceeds two.  The solution tilts rates exponentially,
``rate = min(2, exp(lambda_source * size / mean size))``; the multipliers minimise the convex dual and are found by
Newton steps for all sources at once.  A rate depends on source and size alone, so the steps run on the distributed
table of counts per (source, size).  Rates become copies by systematic rounding along the sizes of a source, followed by
a few single-copy corrections towards the target.

Defined cases: a null text has size 0 and is taken 0 words; null is a source of its own, the last; empty and repeated
rows count like others; sources without words have target 0; an empty table gives an empty result; null ids are
allowed; further columns are ignored or, in ``mixed``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import numbered, written

WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a (source, size) cell in which documents are ranked on their own: one for each PART_ROWS rows of the whole table, so that no part
#: can hold more than about so many rows of one size, and at least CELL_PARTS.
CELL_PARTS, PART_ROWS = 256, 100_000
MOST_STEPS = 40
TOLERANCE = 1e-7
CORRECTIONS = 4


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target of each source: s, source, source_size, target.  ``sources``: s, source, source_size, one row each.

    Each source gets the common level times its weight, but at most ``most`` times its size.  Sorted by the level at which
    they stop, the stopped sources come first, so one running sum finds the level.
    """
    every = W.orderBy(F.asc_nulls_last("source"))
    nth = F.pmod(F.row_number().over(every) - 1, F.lit(len(weights)))
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (nth + 1).cast("int")))
    weighed = weighed.withColumn("most", most * F.col("source_size"))
    line = W.orderBy(F.col("most") / F.col("w"), "s")
    whole, before = W.partitionBy(), line.rowsBetween(W.unboundedPreceding, -1)
    running = weighed.select(
        "*",
        (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    ).withColumn("level", F.when(F.col("left") * F.col("w") <= F.col("most") * F.col("w_left"), F.col("left") / F.col("w_left")))
    level = F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(F.col("most") / F.col("w"), F.col("s")))).over(whole)
    return running.withColumn("common", level).select(
        "s", "source", "source_size",
        F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("common") * F.col("w"))).alias("target"),
    )


def source_targets(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, source_size, target of every source."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(word_count(text_col)).cast("double").alias("source_size"))
    return targets(sizes.withColumn("s", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))), weights, share, most).drop("s")


def multipliers(cells: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """The dual's solution: s, scale, lam (null: every rate is at its maximum).  ``cells``: s, size, n.

    A Newton step that leaves the interval known to hold the solution is replaced by bisection.  Only the largest
    relative error comes to the driver.
    """
    start = goals.select(
        "s", "target", (F.col("source_size") / F.col("n_docs")).alias("scale"),
        F.when((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)), F.log(F.col("target") / F.col("source_size"))).alias("lam"),
        F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(1.0).alias("error"),
    )
    state = written(start, "dual")
    for _ in range(MOST_STEPS):
        rate = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))
        tokens = F.col("n") * F.col("size")
        sums = (
            cells.join(state.where("lam is not null"), "s")
            .groupBy("s", "target", "scale", "lam", "lo", "hi")
            .agg(
                F.sum(tokens * F.least(rate, F.lit(most))).alias("got"),
                F.sum(F.when(rate < most, tokens * F.col("size") / F.col("scale") * rate).otherwise(0.0)).alias("slope"),
            )
        )
        over = F.col("got") > F.col("target")
        step = sums.select(
            "s", "target", "scale", "lam",
            F.when(over, F.col("lo")).otherwise(F.col("lam")).alias("lo"), F.when(over, F.col("lam")).otherwise(F.col("hi")).alias("hi"),
            F.try_divide(F.col("got") - F.col("target"), F.col("slope")).alias("by"),
            F.abs(F.col("got") / F.col("target") - 1).alias("error"),
        )
        to = F.col("lam") - F.col("by")
        inner = F.when((to > F.col("lo")) & (to < F.col("hi")), to).otherwise(
            # Without a useful slope: away from the known side, in growing steps, then by halves.
            F.when(F.col("hi") >= 1e6, 2 * F.greatest(F.abs("lam"), F.lit(1.0)))
            .when(F.col("lo") <= -1e6, -2 * F.greatest(F.abs("lam"), F.lit(1.0)))
            .otherwise((F.col("lo") + F.col("hi")) / 2)
        )
        moved = step.select("s", "target", "scale", F.when(F.col("error") < TOLERANCE, F.col("lam")).otherwise(inner).alias("lam"), "lo", "hi", "error")
        fixed = state.where("lam is null").withColumn("error", F.lit(0.0))
        state = written(moved.unionByName(fixed), "dual")
        if (state.agg(F.max("error")).first()[0] or 0.0) < TOLERANCE:
            break
    else:
        raise RuntimeError("the dual did not converge")
    return state.select("s", "scale", "lam")


def copies(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Copies of every row: id, node, size, source_size, target, copies."""
    cell_parts = max(CELL_PARTS, docs.count() // PART_ROWS)
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("node"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("s"),
            F.col(source_col).alias("source"),
            word_count(text_col).alias("size"),
            F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(cell_parts)).cast("int").alias("part"),
            F.xxhash64(F.col(id_col), F.lit(29)).alias("draw"),
        ),
        "mix-rows",
    )
    parts = written(rows.groupBy("s", "size", "part").agg(F.count("*").alias("n"), F.min("source").alias("source")), "mix-parts")
    cells = written(parts.groupBy("s", "size").agg(F.sum("n").alias("n"), F.min("source").alias("source")), "mix-cells")
    sources = cells.groupBy("s").agg(
        F.min("source").alias("source"), F.sum(F.col("n") * F.col("size")).cast("double").alias("source_size"), F.sum("n").alias("n_docs")
    )
    goals = written(targets(sources, weights, share, most).join(sources.select("s", "n_docs"), "s"), "mix-goals")
    dual = multipliers(cells.where("size > 0"), goals, most)

    # Systematic rounding along each source's sizes, the longest first, where an error weighs most.
    rate = F.when(F.col("lam").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    line = W.partitionBy("s").orderBy(F.desc("size"))
    wanted = cells.select("s", "size", "n").join(dual, "s").withColumn("want", F.col("n") * rate).withColumn("part", F.col("want") - F.floor("want"))
    summed = F.sum("part").over(line)
    grid = wanted.withColumn("extra", F.floor(summed + 0.5) - F.floor(summed - F.col("part") + 0.5))
    grid = written(
        grid.select("s", "size", "n", F.least(F.floor("want") + F.greatest(F.lit(0), F.least(F.lit(1), F.col("extra"))), most * F.col("n")).cast("long").alias("k")), "mix-grid"
    )
    for _ in range(CORRECTIONS):
        short = written(
            grid.groupBy("s").agg(F.sum(F.col("k") * F.col("size")).alias("got")).join(goals.select("s", "target"), "s")
            .select("s", (F.col("target") - F.col("got")).alias("e")).where("abs(e) >= 1"),
            "mix-short",
        )
        fits = grid.where("size > 0").join(short, "s").where(f"(e > 0 and k < {most} * n) or (e < 0 and k > 0)").where("abs(abs(e) - size) < abs(e)")
        best = written(fits.groupBy("s").agg(F.min(F.struct(F.abs(F.abs("e") - F.col("size")).alias("off"), "size", F.signum("e").cast("long").alias("by"))).alias("b")).select("s", "b.size", "b.by"), "mix-best")
        grid = written(grid.join(best, ["s", "size"], "left").select("s", "size", "n", (F.col("k") + F.coalesce("by", F.lit(0))).alias("k")), "mix-grid")

    # A cell's copies go to its parts in proportion, and in a part to the documents in the order of their draws.
    upto = W.partitionBy("s", "size").orderBy("part")
    cum = F.sum("n_part").over(upto)
    whole = lambda x: F.expr(f"cast(({x}) * cast(k as decimal(19,0)) as decimal(38,0)) div n")
    dealt = (
        parts.select("s", "size", "part", F.col("n").alias("n_part")).join(grid, ["s", "size"])
        .withColumn("cum", cum.cast("decimal(19,0)")).withColumn("was", (cum - F.col("n_part")).cast("decimal(19,0)"))
        .withColumn("k_part", (whole("cum") - whole("was")).cast("long"))
        .select("s", "size", "part", "n_part", "k_part")
    )
    dealt = written(dealt, "mix-dealt")
    rank = F.row_number().over(W.partitionBy("s", "size", "part").orderBy("draw", "id", "node"))
    base = F.expr("k_part div n_part")
    return (
        rows.join(dealt, ["s", "size", "part"])
        .withColumn("copies", (base + F.when(rank <= F.col("k_part") - base * F.col("n_part"), 1).otherwise(0)).cast("int"))
        .join(goals.select("s", F.col("source_size").cast("long").alias("source_size"), "target"), "s")
        .select("id", "node", "size", "source_size", "target", "copies")
    )


#: Production parameters: weights of the sources in turn, the share of all tokens that is taken, the most copies.
WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    return copies(docs, weights, share, most, id_col, text_col, source_col).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as the mix holds them: rows that it leaves out are gone, rows taken twice come twice."""
    names, docs = docs.columns, numbered(docs)  # no column's name can clash
    id_col, text_col, source_col = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    taken = copies(docs, weights, share, most, id_col, text_col, source_col).groupBy("id", "node").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    taken = written(taken.where("__copies > 0"), "mix-taken").withColumnsRenamed({"id": "__id", "node": "__node"})
    joined = docs.withColumn("__key", F.xxhash64(text_col)).join(
        taken, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__node"))
    )
    # Equal repeated rows share their copies: row i of r gets its part of the sum.
    repeated = joined.where("__rows > 1")
    nth = F.row_number().over(W.partitionBy("__id", "__node").orderBy(F.lit(0)))
    several = repeated.withColumn("__i", nth).withColumn("__copies", F.expr("__copies * __i div __rows - __copies * (__i - 1) div __rows"))
    single = joined.where("__rows = 1").withColumn("__i", F.lit(1))
    every = single if taken.where("__rows > 1").isEmpty() else single.unionByName(several)
    return every.where("__copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns).toDF(*names)
