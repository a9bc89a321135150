"""Mixing sources to target weights by weighted fair queueing, with Spark's own expressions only.

Each source is a queue of its shuffled documents, repeated ``max_repeats`` times. The virtual finish time of a
document is what its queue has sent up to and including it, divided by the source's target. The mix is the
longest prefix in the order of finish times whose words fit into the budget (``share`` times all words).

Nothing is sorted in one task: running sums are taken inside (source, hash bucket) groups and inside bins of finish
times, on top of prefix sums over the totals of these groups (sources x 4,096 and a few thousand rows). Only the one bin
that holds the cut is ordered. A source with a third of all rows is 4,096 groups.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have none: size and words taken are 0. A null source is a source of
its own, the last one. Repeated rows queue one by one (rows equal in id and text are interchangeable). A source
without words has the target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutsites.llm.common import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
BINS = 1024
SIZE = r"coalesce(cast(regexp_count(`{text}`, '[^\\x20\\x09-\\x0D]+') as bigint), 0L)"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Target of every source by water filling; ``sizes`` has one row per source (__key, __size), sorted keys get the weights in turn.

    A target is the smaller of ``max_repeats`` times the size and level times weight. Sources fill up in the order of capacity by weight; the
    level of a source is what the fuller ones leave, divided by the weights not yet full.
    """
    turn = f"element_at(array({', '.join(f'{w}D' for w in weights)}), cast((row_number() over (order by __key) - 1) % {len(weights)} as int) + 1)"
    ranked = sizes.withColumn("__weight", F.expr(turn)).withColumn("__cap", F.expr(f"{float(max_repeats)}D * __size"))
    order = "order by __cap / __weight, __key rows between"
    filled = ranked.select(
        "*",
        F.expr(f"coalesce(sum(__cap) over ({order} unbounded preceding and 1 preceding), 0D)").alias("__before"),
        F.expr(f"sum(__weight) over ({order} current row and unbounded following)").alias("__left"),
        F.expr("sum(__size) over ()").alias("__all"),
    ).withColumn("__level", F.expr(f"({share!r}D * __all - __before) / __left"))
    # The level is that of the first source which does not fill up.
    return filled.select(
        "__key", "__size", F.expr(f"{share!r}D * __all").alias("__budget"),
        F.expr("least(__cap, coalesce((min(case when __cap > __level * __weight then struct(__cap / __weight as a, __key as b, __level as level) end) over ()).level, __cap / __weight) * __weight)").alias("__target"),
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
    seed: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id",
) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted); these replace columns of the same names."""
    new = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.expr(f"coalesce(concat('0', cast(`{source}` as string)), '1')").alias("__key"),
        F.expr(SIZE.format(text=text)).alias("__words"),
        F.expr(f"md5(concat_ws(':', '{seed}', cast(`{doc_id}` as string)))").alias("__h"),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__tie"),
    ).withColumn("__bucket", F.expr("substring(__h, 1, 3)"))
    narrow = written(rows.select("__key", "__bucket", "__h", "__tie", "__words"), "mix")

    totals = narrow.groupBy("__key", "__bucket").agg(F.sum("__words").alias("__sum"))
    before = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sources = targets(totals.groupBy("__key").agg(F.sum("__sum").alias("__size")), weights, share, max_repeats)
    groups = totals.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).join(sources, "__key").drop("__sum")
    groups = written(groups, "mix-groups")  # sources x 4,096 rows, used twice

    inside = Window.partitionBy("__key", "__bucket").orderBy("__h", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    finish = "transform(sequence(0, {n}), e -> (e * __size + __sent) / __target)".format(n=max_repeats - 1)

    def queued(df: DataFrame) -> DataFrame:
        sent = df.join(groups, ["__key", "__bucket"]).withColumn("__sent", F.col("__offset") + F.sum("__words").over(inside))
        return sent.withColumn("__finish", F.expr(f"case when __target > 0 and __words > 0 then {finish} else array() end"))

    items = queued(narrow).select("__key", "__words", "__budget", F.explode("__finish").alias("__v"))
    items = items.withColumn("__bin", F.expr(f"cast(floor(__v * {BINS}) as bigint)"))
    bins = items.groupBy("__bin").agg(F.sum("__words").alias("__sum"), F.max("__budget").alias("__budget"))
    upto = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("__upto", F.sum("__sum").over(upto))
    # The first bin that goes beyond the budget is ordered; one row each reaches the driver.
    cut = bins.where("__upto > __budget").select(F.min_by(F.struct("__bin", F.expr("__upto - __sum").alias("__before"), "__budget"), "__bin").alias("c")).first()
    if cut is None or cut.c is None:
        limit = F.struct(F.lit(float("inf")).alias("v"), F.lit("").alias("k"))  # the budget holds everything
    else:
        run = F.lit(cut.c["__before"]) + F.sum("__words").over(Window.partitionBy("__bin").orderBy("__v", "__key").rowsBetween(Window.unboundedPreceding, 0))
        ordered = items.where(F.col("__bin") == cut.c["__bin"]).withColumn("__run", run)
        last = ordered.where(F.col("__run") <= cut.c["__budget"]).select(F.max(F.struct("__v", "__key")).alias("l")).first().l
        v, k = (last["__v"], last["__key"]) if last else (cut.c["__bin"] / BINS, "")  # none: the mix ends before the bin
        limit = F.struct(F.lit(v).alias("v"), F.lit(k).alias("k"))
    taken = F.size(F.filter("__finish", lambda v: F.struct(v.alias("v"), F.col("__key").alias("k")) <= limit))
    return (
        queued(rows).withColumn("taken", F.col("__words") * taken)
        .select(*[F.col(f"`{c}`") for c in kept], F.col("__words").alias("size"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), "taken")
    )
