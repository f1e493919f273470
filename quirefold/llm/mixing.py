"""Mixing sources to target weights along a training run.

Sources get target volumes by weight (none above ``max_epochs`` times its own size, the
excess reshared by weight). A schedule says how each weight moves over the run: it is
integrated per source, and the cumulative demand of a source is inverted to find the
moment at which a document is due. Documents are range-sorted by that moment.

Everything is DataFrame expressions. A source of any size is split over hash slots:
only slot totals are ordered per source, documents are ordered within a slot. Null
sources form the last source; null, empty and blank texts have size 0 and are never
taken; a table without words gives targets of 0. Rows that repeat an id are placed one
after the other, by size. Columns beyond those named below are ignored or, when kept,
travel inside one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import WORD, table, word_count
from quirefold.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Knots of the run: (moment, multiplier of each weight class); linear between knots.
SCHEDULE = ((0.0, (1.5, 1.0, 0.5)), (0.5, (1.0, 1.0, 1.0)), (1.0, (0.5, 1.0, 1.5)))
MAX_EPOCHS = 3.0
#: Hex digits of the hash that name a slot: 16**3 slots in each source.
SLOT_DIGITS = 3


def _number(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def inverse_demand(share: str, cls: str, schedule=SCHEDULE) -> str:
    """SQL for the moment at which ``share`` (0..1) of a source's demand has been met.

    The multiplier runs from m to n over a piece of length d, so the demand met after a
    part u of it is d * (m*u + (n-m)*u*u/2); u is the root of that quadratic.
    """
    classes = []
    for c in range(len(schedule[0][1])):
        knots = [(t, m[c]) for t, m in schedule]
        pieces = [(t, n - t, a, b, (n - t) * (a + b) / 2) for (t, a), (n, b) in zip(knots, knots[1:])]
        area, met, arms = sum(p[4] for p in pieces), 0.0, []
        for k, (t, d, a, b, part) in enumerate(pieces):
            rest = f"greatest(0.0e0, ({share}) * {_number(area)} - {_number(met)}) / {_number(d)}"
            root = f"{_number(t)} + {_number(d)} * least(1.0e0, 2.0e0 * {rest} / ({_number(a)} + sqrt(greatest(0.0e0, {_number(a * a)} + {_number(2 * (b - a))} * {rest}))))"
            met += part
            arms.append(root if k == len(pieces) - 1 else f"when ({share}) * {_number(area)} < {_number(met)} then {root}")
        classes.append(f"when {c} then (case {' '.join(arms[:-1])} else {arms[-1]} end)" if len(arms) > 1 else f"when {c} then {arms[0]}")
    return f"case {cls} {' '.join(classes)} end"


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``_src, _source_size`` -> plus ``_cls, _target``: one row per source.

    Filling up in order of cap/weight, a source is capped when the water level that
    just fills it needs no more than the total.
    """
    by_name = Window.orderBy("_src")
    by_ratio = Window.orderBy("_ratio", "_src")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    named = (
        sizes.withColumn("_cls", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
        .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_cls") + 1))
        .withColumn("_cap", F.col("_source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_total", F.sum("_source_size").over(whole) * F.lit(float(share)))
    )
    levels = named.withColumn(
        "_full",
        F.col("_ratio") * F.sum("_w").over(onward) + F.coalesce(F.sum("_cap").over(before), F.lit(0.0)) <= F.col("_total"),
    )
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole)
    return levels.select(
        "_src", "_source_size", "_cls",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * (left / open_w)).alias("_target"),
    )


def mix(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    max_epochs: float = MAX_EPOCHS,
    schedule=SCHEDULE,
    seed: str = "mix",
    slot_digits: int = SLOT_DIGITS,
) -> DataFrame:
    """One row per document: ``row`` (struct of ``keep``), size, source_size, target, taken, position.

    A source's quota is its rounded target. Whole passes over the source come first; the
    last pass ends inside one document, which is taken up to that word. ``position`` is
    the moment of the first use in 0..1, NULL for a document that is not taken.
    """
    sized = (
        docs.select(
            F.struct(*[F.col(c) for c in keep]).alias("row"),
            F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2")).alias("_src"),
            F.col("doc_id").alias("_id"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_h"),
        )
        .withColumn("_slot", F.substring("_h", 1, slot_digits))
    )
    slots = materialize(sized.groupBy("_src", "_slot").agg(F.sum("size").alias("_slot_size")))
    ahead = Window.partitionBy("_src").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.withColumn("_start", F.coalesce(F.sum("_slot_size").over(ahead), F.lit(0))).drop("_slot_size")
    targets = source_targets(slots.groupBy("_src").agg(F.sum("_slot_size").alias("_source_size")), weights, share, max_epochs)
    plan = starts.join(targets.withColumn("_quota", F.floor(F.col("_target") + 0.5).cast("bigint")), "_src")

    inside = Window.partitionBy("_src", "_slot").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("_within", F.sum("size").over(inside) - F.col("size"))
        .join(plan, ["_src", "_slot"])
        .withColumn("_at", F.col("_start") + F.col("_within"))
        .withColumn("_passes", F.expr("if(_source_size = 0, 0L, _quota div _source_size)"))
    )
    rest = F.col("_quota") - F.col("_passes") * F.col("_source_size") - F.col("_at")
    taken = F.col("_passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(
        "row", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        taken.cast("bigint").alias("taken"), "_cls", "_at", "_quota",
    ).select(
        "*", F.when(F.col("taken") > 0, F.expr(inverse_demand("cast(_at as double) / cast(_quota as double)", "_cls", schedule))).alias("position")
    )


def training_order(mixed: DataFrame, schedule=SCHEDULE) -> DataFrame:
    """One row per use of a document, range-sorted by its moment: ``row, words, size, position``.

    ``words`` is below the document's size only for the one cut document of a source.
    """
    uses = mixed.where("taken > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.expr("int(ceil(taken / size)) - 1"))).alias("_use")
    )
    met = "(cast(_at as double) + _use * cast(source_size as double)) / cast(_quota as double)"
    return uses.select(
        "row", F.expr("least(size, taken - _use * size)").alias("words"), "size", F.expr(inverse_demand(met, "_cls", schedule)).alias("position"), "_use"
    ).orderBy("position", F.col("row").getField("doc_id"), "_use")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def op1_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "position"
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP1_SQL = rf"""
with sized as (
  select doc_id, coalesce('1' || source, '2') as src, md5('mix:' || coalesce(cast(doc_id as varchar), '')) as h,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
named as (
  select src, cast(sum(size) as bigint) as source_size, cast((row_number() over (order by encode(src)) - 1) % 3 as int) as cls from sized group by src),
weighed as (
  select *, [5.0, 2.0, 1.0][cls + 1]::double as w, source_size * 3.0::double as cap, cast(sum(source_size) over () as double) as total from named),
levelled as (
  select *, (cap / w) * sum(w) over (order by cap / w, encode(src) rows between current row and unbounded following)
     + coalesce(sum(cap) over (order by cap / w, encode(src) rows between unbounded preceding and 1 preceding), 0) <= total as filled from weighed),
aimed as (
  select *, case when filled then cap else w * ((total - coalesce(sum(case when filled then cap end) over (), 0)) / sum(case when not filled then w end) over ()) end as target
  from levelled),
quotas as (select src, source_size, cls, target, cast(floor(target + 0.5) as bigint) as quota,
           case when source_size = 0 then 0 else cast(floor(target + 0.5) as bigint) // source_size end as passes from aimed),
placed as (
  select s.doc_id, s.size, q.*, cast(sum(s.size) over (partition by s.src order by s.h, s.doc_id nulls first, s.size rows between unbounded preceding and current row) - s.size as bigint) as at_
  from sized s join quotas q using (src)),
used as (select *, cast(passes * size + greatest(0, least(size, quota - passes * source_size - at_)) as bigint) as taken from placed)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then {inverse_demand("cast(at_ as double) / cast(quota as double)", "cls")} end as position
from used
"""
