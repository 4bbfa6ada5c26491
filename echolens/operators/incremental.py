"""Daily slide: lower bounds, slices, run log and the ingest job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from .filters import derived_target, within
from ..session import settled, small
from .ordering import ranked


def lower_bounds(targets: DataFrame, comments: DataFrame, lookback_days: int = 1) -> DataFrame:
    """Newest time per target minus the lookback; NULL for a target without comments."""
    newest = comments.groupBy("target_id").agg(F.max("posted_at").alias("_newest"))
    bound = F.col("_newest") - F.expr(f"interval {int(lookback_days)} days")
    return targets.join(newest, "target_id", "left").withColumn("posted_after", bound).drop("_newest")


def slices(remote: DataFrame, bounds: DataFrame, default_count: int = 50) -> DataFrame:
    """Rows at or after the target's bound (all when it has none), at most ``count`` newest.

    ``count`` differs per target and has no upper limit, so positions come from the range-partitioned
    ranking of narrow rows, and the wanted keys are joined back.
    """
    side = bounds.select("target_id", "posted_after", F.coalesce("count", F.lit(default_count)).alias("_count"))
    inside = remote.join(small(side), "target_id").filter(within(F.col("posted_at"), F.col("posted_after"), None))
    narrow = inside.select("target_id", "id", "posted_at", "_count")
    wanted = ranked(narrow, ["target_id"], [F.desc_nulls_last("posted_at"), F.asc("id")], "_rn").filter("_rn <= _count")
    return remote.join(wanted.select("id"), "id", "left_semi")


def run_log(
    fetched: DataFrame, before: DataFrame, analyzed: DataFrame, embedded: DataFrame, failed: DataFrame,
) -> DataFrame:
    """Per target: rows fetched, new rows, rows analyzed, rows with a vector, and whether it failed.

    ``fetched``/``before``: comments; ``analyzed``/``embedded``: (target_id, id); ``failed``: (target_id, error).
    """
    count = lambda df, name: df.groupBy("target_id").agg(F.count("*").alias(name))
    new = fetched.join(before.select("platform", "source_id"), ["platform", "source_id"], "left_anti")
    log = (
        count(fetched, "fetched").join(count(new, "inserted"), "target_id", "full")
        .join(count(analyzed, "analyzed"), "target_id", "full").join(count(embedded, "embedded"), "target_id", "full")
        .join(failed.select("target_id", "error"), "target_id", "full")
    )
    numbers = ["fetched", "inserted", "analyzed", "embedded"]
    return log.select(
        "target_id", F.col("error").isNull().alias("ok"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), "error")


def isolated(stage: str, step: Callable[[], DataFrame], errors: list[tuple[str, str]]) -> DataFrame | None:
    """Run one optional stage; its failure is noted and does not stop the others."""
    try:
        return step()
    except Exception as error:  # noqa: BLE001 - the next stage must still run
        errors.append((stage, str(error)[:500]))
        return None


def with_failures(raw: DataFrame) -> DataFrame:
    """The landed rows with their target and, where a row cannot be merged, the reason.

    A reader that could not fetch or parse a payload lands a row with a ``failure``.
    """
    target = derived_target(F.col("platform"), F.col("target_key"), F.col("extra_json"))
    no_key = F.coalesce(F.trim("platform"), F.lit("")) == ""
    no_id = F.coalesce(F.trim("source_id"), F.lit("")) == ""
    reason = (
        F.when(no_key, "no platform").when(no_id, "no source id")
        .when(F.col("extra_json").isNotNull() & F.try_parse_json("extra_json").isNull(), "extras are no JSON")
    )
    given = F.col("failure").cast("string") if "failure" in raw.columns else F.lit(None).cast("string")
    return raw.withColumn("failure", F.coalesce(given, reason)).withColumn("_target", F.coalesce(target, F.lit("(unknown)")))


def split_by_target(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """Rows to land, quarantined rows, failed targets, and the counts of all.

    A target with a row that failed lands nothing this time; its other rows are held back in the quarantine beside it. All other
    targets land. The counts are taken while the rows are written.
    """
    seen = Observation()
    marked = settled(with_failures(raw).observe(seen, F.count("*").alias("rows"), F.count("failure").alias("failed")))
    failed = small(marked.filter("failure IS NOT NULL").groupBy("_target").agg(F.min("failure").alias("error")))
    good = marked.join(failed, "_target", "left_anti").drop("failure", "_target")
    held = marked.join(failed, "_target").withColumn("failure", F.coalesce("failure", F.concat(F.lit("held back: "), "error"))).drop("error")
    return good, held.withColumnRenamed("_target", "target_id"), failed.withColumnRenamed("_target", "target_id"), seen.get


MAX_TARGETS = 10_000  # targets are a configuration; beyond this a failing stage is not divided


def divided(rows: DataFrame, step: Callable[[DataFrame], DataFrame], target: str = "target_id") -> tuple[DataFrame | None, dict[str, str]]:
    """Run a stage on all targets at once; when it fails, on halves of them, until the failing targets stand alone.

    Returns what the others gave and the error of each failing target. A stage that works costs one run; each
    failing target costs about twice the logarithm of their number.
    """
    try:
        return settled(step(rows)), {}
    except Exception as error:  # noqa: BLE001 - find the targets that cause it
        first = str(error)[:500]
    names = [r[0] for r in rows.select(target).distinct().limit(MAX_TARGETS + 1).collect()]
    if len(names) > MAX_TARGETS:
        raise RuntimeError(first)
    found: list[DataFrame] = []
    bad: dict[str, str] = {}

    def run(part: list, error: str | None) -> None:
        if error is None:
            try:
                one = F.coalesce(F.col(target), F.lit("")).isin([x or "" for x in part])
                found.append(settled(step(rows.filter(one))))
                return
            except Exception as e:  # noqa: BLE001
                error = str(e)[:500]
        if len(part) == 1:
            bad[part[0]] = error
        else:
            for half in (part[: len(part) // 2], part[len(part) // 2 :]):
                run(half, None)

    if names:
        run(sorted(names, key=lambda x: x or ""), first)
    return (reduce(DataFrame.unionByName, found) if found else None), bad
