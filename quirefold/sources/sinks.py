"""Writers: typed tables, the append-only release log, trial files, report documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold import schemas as S
from quirefold.sources.commits import append_together


def typed(df: DataFrame, table: str) -> DataFrame:
    """Every declared column in order, NULL where the frame has none, under its stored name."""
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias("workspace_id" if f.name == "ws" else f.name)
        for f in S.schema(table)
    ]
    return df.select(*cols)


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    typed(df, table).write.mode(mode).parquet(path)


def append_release_log(releases: DataFrame, root: str, commit: str | None = None) -> bool:
    """Append releases and their audit events in one commit; nothing is ever rewritten.

    ``commit`` names the append, by default after the releases in it. One that is in the log
    already adds nothing and gives False, so an append may be repeated until it is known to
    have worked. ``readers.release_log`` reads both tables.
    """
    audit = releases.select(
        F.concat(F.lit("ae-"), "id").alias("id"), "ws", "actor", F.concat(F.lit("release."), "action").alias("action"), F.lit("channel").alias("subject_kind"),
        F.col("channel_id").alias("subject_id"), F.col("id").alias("after_hash"), "created_at")
    if commit is None:
        n, mark = releases.agg(F.count("*"), F.sum(F.xxhash64("ws", "id").cast("decimal(38,0)"))).first()
        commit = f"{n}-{mark or 0}"
    return append_together(root, commit, {"release": typed(releases, "release"), "audit_event": typed(audit, "audit_event")})


def write_trials(samples: DataFrame, path: str, most: int = 10_000) -> None:
    """JSON documents of a trial's samples; a trial of more than about ``most`` is spread over several."""
    names = [c for c in samples.columns if c not in ("config", "trial")]
    parts = samples.groupBy("config", "trial").agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = samples.join(parts, ["config", "trial"]).withColumn("_part", F.pmod(F.xxhash64("page_id"), F.col("_parts")))
    dealt.groupBy("config", "trial", "_part").agg(F.sort_array(F.collect_list(F.struct("page_id", *[n for n in names if n != "page_id"]))).alias("samples")).drop("_part").write.json(path)


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """Sections as (section, body) rows; each body is one JSON object."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body")) for name, df in sections.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    report(sections).write.mode("overwrite").json(path)
