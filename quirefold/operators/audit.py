"""Integrity audit: every declared constraint, counted over whole tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold import schemas as S
from quirefold.session import materialize

#: References to one parent that a bit mask has room for, beside the bit of the parent itself.
MOST_REFERENCES = 62


@dataclass
class _Plan:
    """What is judged: constraints by number, and the families of keys in which they meet."""

    labels: list[str] = field(default_factory=list)
    families: dict[str, int] = field(default_factory=dict)
    slots: dict[str, int] = field(default_factory=dict)

    def label(self, name: str) -> int:
        self.labels.append(name)
        return len(self.labels) - 1

    def family(self, name: str) -> int:
        return self.families.setdefault(name, len(self.families))

    def slot(self, parent: str) -> int:
        """The bit of one more reference to a parent; bit 0 is the parent row."""
        self.slots[parent] = self.slots.get(parent, 0) + 1
        if self.slots[parent] > MOST_REFERENCES:
            raise ValueError(f"too many references to {parent}")
        return self.slots[parent]


@dataclass(frozen=True)
class _Entry:
    """One constraint of one table: which rows take part, and the key they bring to their family."""

    kind: str  # check, unique, reference or owner (a parent row, unique as well)
    label: int
    family: int
    slot: int
    when: Column
    key: tuple[str, ...]


def _given(columns) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _entries(name: str, df: DataFrame, tables: dict[str, DataFrame], plan: _Plan) -> list[_Entry]:
    out = []

    def check(label: str, bad: Column) -> None:
        out.append(_Entry("check", plan.label(label), plan.family(label), 0, F.coalesce(bad, F.lit(False)), ()))

    def keyed(kind: str, label: str, family: str, columns, slot: int = 0) -> None:
        out.append(_Entry(kind, plan.label(label), plan.family(family), slot, _given(columns), tuple(columns)))

    for table, column, test in S.CHECKS:
        if table == name and column in df.columns:
            check(f"{name}.{column} check", ~F.expr(test.format(c=column)))
    for column in df.columns:
        if column in S.TABLES[name] and column not in S.NULLABLE.get(name, []):
            check(f"{name}.{column} not null", F.col(column).isNull())
    for key in [k for t, k in S.UNIQUE if t == name and set(k) <= set(df.columns)]:
        label = f"{name}({', '.join(key)}) unique"
        keyed("unique", label, label, key)
    # the rows that references name are told apart by the same key, so a parent brings it once
    own = ["ws", "id"] if "ws" in df.columns else ["id"]
    label, parent = f"{name}({', '.join(own)}) unique", name == "workspace" or any(p == name for _, _, p in S.FOREIGN)
    keyed("owner" if parent else "unique", label, f"rows of {name}" if parent else label, own)
    for child, column, parent in S.FOREIGN:
        if child == name and parent in tables and column in df.columns:
            keyed("reference", f"{name}.{column} -> {parent}", f"rows of {parent}", ["ws", column], plan.slot(parent))
    if "ws" in df.columns and "workspace" in tables:
        keyed("reference", f"{name}.ws -> workspace", "rows of workspace", ["ws"], plan.slot("workspace"))
    return out


def _digest(entry: _Entry) -> list[Column]:
    """128 bits of a key in two numbers; zeros for a check, whose violations meet in one row."""
    if not entry.key:
        return [F.lit(0).cast("bigint")] * 2
    parts = [F.col(c).cast("string") for c in entry.key]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def _exploded(df: DataFrame, entries: list[_Entry], value) -> DataFrame:
    """``family, d1, d2`` and what ``value`` adds, for each entry that a row takes part in."""
    made = []
    for e in entries:
        d1, d2 = _digest(e)
        made.append(F.when(e.when, F.struct(F.lit(e.family).alias("family"), d1.alias("d1"), d2.alias("d2"), *value(e))))
    # a plain array: of anything else Spark takes the size first, and makes all entries again for that
    return df.select(F.explode(F.array(*made)).alias("_e")).where(F.col("_e").isNotNull()).select("_e.*")


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per constraint, for the tables given. Zero rows are reported too.

    First every table is scanned once. Its violated checks and the digests of its keys, 128
    bits each whatever the key, meet in one aggregate: per digest, how many rows bring it as
    their own key and which references and parent rows it stands for. Only digests that look
    violated (a unique key that came twice, a reference without its parent) are looked up
    again, with their real keys, in the tables they can come from.
    """
    spark = next(iter(tables.values())).sparkSession
    plan = _Plan()
    entries = {name: _entries(name, df, tables, plan) for name, df in tables.items()}
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    big = lambda n: F.lit(n).cast("bigint")
    bit = lambda e: [big(1 << e.slot if e.kind in ("reference", "owner") else 0).alias("mask"), big(int(e.kind != "reference")).alias("own")]
    met = union([_exploded(df, entries[name], bit) for name, df in tables.items()]).groupBy("family", "d1", "d2").agg(F.bit_or("mask").alias("mask"), F.sum("own").alias("n"))
    checks = {e.family: e.label for some in entries.values() for e in some if e.kind == "check"}
    check = F.col("family").isin(list(checks))
    orphaned = (F.col("mask") != 0) & (F.col("mask").bitwiseAND(big(1)) == 0)
    odd = materialize(met.where(check | orphaned | (F.col("n") > 1)).select("family", "d1", "d2", "n", (~orphaned).alias("unique")))

    # as many as there are constraints, at most
    seen = {(r.family, r.unique) for r in odd.select("family", "unique").distinct().collect()}
    axis = spark.range(1).select(F.posexplode(F.array(*map(F.lit, plan.labels))).alias("label", "constraint"))
    number = F.create_map(*[F.lit(x) for pair in checks.items() for x in pair])
    found = odd.where(check).select(F.element_at(number, F.col("family")).alias("label"), F.col("n").alias("violations"))
    suspects = odd.where(~check).select("family", "d1", "d2", "unique")
    unique = lambda e: e.kind != "reference"
    real = lambda e: [F.lit(e.label).alias("label"), F.lit(unique(e)).alias("unique"), F.concat_ws("\x01", *[F.col(c).cast("string") for c in e.key]).alias("key")]
    again = {name: [e for e in some if e.kind != "check" and (e.family, unique(e)) in seen] for name, some in entries.items()}
    looked = [_exploded(tables[name], some, real) for name, some in again.items() if some]
    if looked:
        keys = union(looked).join(suspects, ["family", "d1", "d2", "unique"], "left_semi").groupBy("label", "unique", "key").agg(F.count("*").alias("n"))
        wrong = F.when(~F.col("unique"), F.col("n")).when(F.col("n") > 1, 1)
        found = found.unionByName(keys.groupBy("label").agg(F.sum(wrong).alias("violations")))
    return axis.join(found, "label", "left").select("constraint", F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"))
