"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize

#: No source is taken more often than this.
MOST_EPOCHS = 3
#: Documents of a slice of the sampling keys, about and at most: the slice in which a budget ends is sorted in one task.
SLICE_ROWS = 50_000
#: Characters of markup and tables, which lower a document's weight.
MARKUP = "#$%&*|!~^<>{}"


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: how free of markup characters a text is."""
    text = F.coalesce(text, F.lit(""))
    share = (F.length(text) - F.length(F.translate(text, MARKUP, ""))) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), 1.0 - 4.0 * share)


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the key alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, shares: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, rows, source_size, target) for each source of ``sizes`` (source, size), which has one row per document.

    Sources by code point, null last, weigh ``shares`` in turn and divide all words by weight; a source at
    MOST_EPOCHS times its size leaves its excess to the others, by weight. The windows without a partition
    run over one row per source.
    """
    each = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    ranked = each.withColumn("i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).select(
        "source", "rows", "source_size", (F.lit(MOST_EPOCHS) * F.col("source_size")).alias("cap"), F.element_at(F.array(*map(F.lit, shares)), (F.col("i") % len(shares) + 1).cast("int")).alias("w")
    )
    # by cap per weight: the first source below its cap at the level that it and the rest allow sets the level, which is the highest such
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ranked.withColumn("level", (F.sum("source_size").over(whole) - before) / after)
    level = level.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(whole))
    return level.select("source", "rows", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: int) -> dict[str, Column]:
    """What the plan needs to know of each row; ``row`` tells rows of equal ids apart."""
    weight = quality_weight(F.col(text_col)) if weight is None else weight
    return {
        "row": F.monotonically_increasing_id(),
        "id": F.col(id_col),
        "source": F.col(source_col),
        "size": F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long"),
        "key": -F.log(uniform(seed, F.col(id_col))) / weight,
    }


def _slice() -> Column:
    """Slices of equal width; keys are densest at 0, where a slice of a source of so many rows has SLICE_ROWS of them."""
    return F.floor(F.col("key") * F.ceil(F.col("rows") / SLICE_ROWS)).cast("long")


def plan_sources(keyed: DataFrame) -> DataFrame:
    """(s_source, source_size, target, base, rows, s_slice, cut): of ``keyed`` (row, id, source, size, key), one row per source.

    A source is taken ``base`` times in whole, and once more up to the place ``cut`` = (key, id, size, row), null
    if nothing. Sums of slices of the keys tell the slice in which the budget ends; in that slice, rows of one
    key, id and size of one partition are counted first, and only those among which the budget ends are sorted.
    So neither a large source nor an id that very many rows share is sorted whole.
    """
    targets = source_targets(keyed).withColumn("base", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = materialize(targets.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "targets")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    sliced = keyed.alias("k").join(targets.select("source", "rows").alias("t"), same("k", "t")).select("k.*", _slice().alias("slice"))
    by_slice = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = materialize(sliced.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(by_slice), F.lit(0))), "slices")
    # slices that begin within the budget; the last of them is where it ends
    ends = slices.alias("s").join(targets.alias("t"), same("s", "t")).filter("before <= rest").groupBy("t.source", "rest").agg(F.max(F.struct("slice", "before")).alias("e"))
    ends = materialize(ends.select("source", "rest", "e.slice", "e.before"), "ends")
    last = materialize(sliced.alias("k").join(ends.alias("e"), same("k", "e") & (F.col("k.slice") == F.col("e.slice"))).select("k.source", "row", "id", "size", "key", "before", "rest"), "last")
    # tied rows of one partition count as one; of the first of these that the budget doesn't cover, some are taken
    ties = last.groupBy("source", "key", "id", "size", F.shiftrightunsigned("row", 33).alias("part")).agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = W.partitionBy("source").orderBy("key", "id", "size", "part").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    taken = F.when(left >= F.col("size") / 2, F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.try_divide(left - F.col("size") / 2, F.col("size"))).cast("long") + 1))).otherwise(0)
    ended = ties.withColumn("taken", taken).filter("taken > 0").groupBy("source").agg(F.max(F.struct("key", "id", "size", "part", "taken")).alias("c"))
    of_cut = last.alias("l").join(ended.alias("c"), same("l", "c") & (F.col("l.key") == F.col("c.c.key")) & F.col("l.id").eqNullSafe(F.col("c.c.id")) & (F.col("l.size") == F.col("c.c.size")) & (F.shiftrightunsigned("l.row", 33) == F.col("c.c.part")))
    nth = of_cut.select("l.source", "l.key", "l.id", "l.size", "l.row", "c.c.taken", F.row_number().over(W.partitionBy("l.source").orderBy("l.row")).alias("i"))
    cuts = nth.filter("i = taken").select("source", F.struct("key", "id", "size", "row").alias("cut"))
    # the first document of the slice may be too large: then everything before the slice is taken
    bound = ends.alias("e").join(cuts.alias("c"), same("e", "c"), "left").select("e.source", "slice", "cut")
    out = targets.alias("t").join(bound.alias("b"), same("t", "b"), "left").select(F.col("t.source").alias("s_source"), "rows", "source_size", "target", "base", F.col("slice").alias("s_slice"), "cut")
    return materialize(out, "sources")


def _epochs() -> Column:
    place = F.struct("key", "id", "size", "row")
    part = (_slice() < F.col("s_slice")) | ((_slice() == F.col("s_slice")) & (place <= F.col("cut")))
    return F.col("base") + F.coalesce(part, F.lit(False)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 42) -> DataFrame:
    """(id, source, size, source_size, target, epochs, taken) for each row of ``docs``.

    Each source's target is met by complete epochs, then by a part: documents in the order of their keys
    -ln(u) / weight, while the words before them and half of their own are within the rest. So the words
    taken differ from the target by half a document at most. ``weight`` is a document's quality weight, above
    0 and at most 1. Keys depend on the seed and the id, so that reruns agree; ties go by id and size, and of
    rows that are equal in both as many are taken as the budget has room for.
    Null texts have no words; null sources form one source.
    """
    keyed = materialize(docs.select(*[c.alias(k) for k, c in _keyed(docs, id_col, text_col, source_col, weight, seed).items()]), "keyed")
    out = keyed.join(plan_sources(keyed), F.col("source").eqNullSafe(F.col("s_source"))).withColumn("epochs", _epochs())
    return out.select("id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, seed: int = 42) -> DataFrame:
    """The documents that ``mix`` takes at least once, with columns size, source_size, target, epochs and taken after their own.

    Columns of these names are replaced. Texts aren't moved: each row is held against its source's plan.
    ``docs`` is read twice and must come in the same partitions, as a table does.
    """
    added = ("size", "source_size", "target", "epochs", "taken")
    docs = docs.drop(*added)
    made = [c.alias(k) for k, c in _keyed(docs, id_col, text_col, source_col, weight, seed).items()]
    keyed = materialize(docs.select(*made), "keyed")
    each = docs.select(F.struct(*docs.columns).alias("doc"), *made)
    out = each.join(plan_sources(keyed), F.col("source").eqNullSafe(F.col("s_source"))).withColumn("epochs", _epochs()).filter("epochs > 0")
    return out.select("doc.*", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))
