"""Usage warehouse: summaries, rollups, period buckets, retention and economics over the usage fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 100
QUOTA_TOKENS, USD_PER_MILLION = 6_000_000, 3.0


def in_scope(path: Column, scope: str) -> Column:
    """Whether a path is the scope or lies below it, at a path boundary."""
    return (path == scope) | path.startswith(f"{scope}/") if scope else F.lit(True)


def savings_pct(read: Column, saved: Column) -> Column:
    return F.when(read > 0, 100.0 * saved / read).otherwise(0.0)


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("commands"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum("exec_time_ms"), F.lit(0)).alias("total_time_ms"),
    ]


def _rated(df: DataFrame) -> DataFrame:
    """Weighted percentage and whole average time from sums."""
    return df.withColumn("savings_pct", savings_pct(F.col("input_tokens"), F.col("saved_tokens"))).withColumn("avg_time_ms", F.when(F.col("commands") > 0, F.expr("total_time_ms div commands")).otherwise(0))


def summary(facts: DataFrame) -> DataFrame:
    """One row: counts, sums, weighted percentage, whole average time."""
    return _rated(facts.agg(*_totals()))


def by_client(facts: DataFrame) -> DataFrame:
    """Totals by client; a client that is not named counts as 'default'."""
    return _rated(facts.groupBy(F.when(F.coalesce("client", F.lit("")) == "", "default").otherwise(F.col("client")).alias("client")).agg(*_totals()))


def by_command(facts: DataFrame) -> DataFrame:
    """Counts, sums, the plain mean of percentages and the whole average time of each command."""
    return facts.groupBy("lom_cmd").agg(
        F.count(F.lit(1)).alias("n"), F.sum("saved_tokens").alias("saved"), F.avg("savings_pct").alias("pct"), F.floor(F.sum("exec_time_ms") / F.count(F.lit(1))).cast("long").alias("avg_time_ms")
    )


def rollup_key(command: Column) -> Column:
    """The bucket of a command: the filter's name, 'fallback', the tool, or the command itself."""
    word = lambda c, i: F.split_part(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit(" "), F.lit(i))
    tool = F.when(word(command, 1) == "lom", word(command, 2)).otherwise("")
    filtered = word(F.substring(command, 10, 1 << 20), 1)
    return (
        F.when(command.startswith("lom:toml "), F.concat(F.lit("toml:"), F.when(filtered == "", "toml").otherwise(filtered)))
        .when(command.startswith("lom fallback:"), "fallback")
        .when(tool != "", tool)
        .otherwise(command)
    )


def rolled_up(commands: DataFrame, top: int) -> DataFrame:
    """by_command() by rollup key: percentages weighted by savings, times by count; the first `top` by savings."""
    rolled = commands.groupBy(rollup_key(F.col("lom_cmd")).alias("key")).agg(
        F.sum("n").alias("n"), F.sum("saved").alias("saved"), F.sum(F.col("pct") * F.col("saved")).alias("weighted"), F.sum(F.col("avg_time_ms") * F.col("n")).alias("time")
    )
    rated = rolled.select("key", "n", "saved", F.when(F.col("saved") > 0, F.col("weighted") / F.col("saved")).otherwise(0.0).alias("pct"), F.expr("time div n").alias("avg_time_ms"))
    return rated.orderBy(F.desc("saved"), F.desc("n"), "key").limit(min(max(top, 1), MOST_ROWS))


def by_period(facts: DataFrame, unit: str) -> DataFrame:
    """Totals by day, by week (Monday to Sunday) or by month."""
    stamp = F.col("timestamp")
    if unit == "month":
        keys = [F.date_format(stamp, "yyyy-MM").alias("month")]
    elif unit == "week":
        monday = F.to_date(F.date_trunc("week", stamp))
        keys = [F.date_format(monday, "yyyy-MM-dd").alias("week_start"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd").alias("week_end")]
    else:
        keys = [F.date_format(stamp, "yyyy-MM-dd").alias("day")]
    return _rated(facts.groupBy(*keys).agg(*_totals()))


def last_days(facts: DataFrame, n: int) -> DataFrame:
    """The latest n days, in ascending order."""
    return by_period(facts, "day").orderBy(F.desc("day")).limit(n).orderBy("day")


def recent(facts: DataFrame, n: int, scope: str = "") -> DataFrame:
    """The latest n commands of a scope."""
    return facts.where(in_scope(F.col("project_path"), scope)).orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def retained(facts: DataFrame, days: int) -> DataFrame:
    """Facts no older than so many days before the latest one."""
    newest = facts.agg(F.max("timestamp").alias("_newest"))
    return facts.join(F.broadcast(newest), F.col("timestamp") >= F.col("_newest") - F.make_dt_interval(F.lit(days))).drop("_newest")


def failure_summary(failures: DataFrame) -> DataFrame:
    return failures.agg(F.count(F.lit(1)).alias("total"), F.count_if("fallback_succeeded").alias("recovered")).withColumn(
        "recovery_pct", F.when(F.col("total") > 0, 100.0 * F.col("recovered") / F.col("total")).otherwise(0.0)
    )


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def telemetry(facts: DataFrame, hours: int = 24) -> DataFrame:
    """Totals over all facts and over the last hours."""
    newest = facts.agg(F.max("timestamp").alias("_newest"))
    late = F.col("timestamp") >= F.col("_newest") - F.make_dt_interval(hours=F.lit(hours))
    return facts.join(F.broadcast(newest)).agg(
        F.count_if(late).alias("commands_since"), F.sum("saved_tokens").alias("saved"), F.coalesce(F.sum(F.when(late, F.col("saved_tokens"))), F.lit(0)).alias("saved_since"),
        savings_pct(F.sum("input_tokens"), F.sum("saved_tokens")).alias("pct"),
    )


def quota(facts: DataFrame, tier: float = 1.0) -> DataFrame:
    """What the savings are worth, and their share of a quota."""
    saved = F.sum("saved_tokens")
    return facts.agg(saved.alias("saved"), (saved * USD_PER_MILLION / 1e6).alias("usd"), (100.0 * saved / (QUOTA_TOKENS * tier)).alias("quota_pct"))


def bypass_rate(facts: DataFrame, disabled: Column, least_pct: float = 10.0) -> DataFrame:
    """Share of commands that went round the filters, only where it is above a limit."""
    return facts.agg(F.count(F.lit(1)).alias("commands"), (100.0 * F.avg(disabled.cast("int"))).alias("bypass_pct")).where(F.col("bypass_pct") > least_pct)


def bars(df: DataFrame, value: str, width: int = 10) -> DataFrame:
    """A bar of each row's share of the largest value."""
    share = F.round(F.col(value) * width / F.greatest(F.max(value).over(Window.partitionBy()), F.lit(1))).cast("int")
    return df.withColumn("bar", F.concat(F.repeat(F.lit("#"), share), F.repeat(F.lit("."), F.lit(width) - share)))


def merged_periods(spend: DataFrame, savings: DataFrame) -> DataFrame:
    """Spend and savings by period, rows of either side kept, with weighted unit costs.

    Output weighs 5, cache writes 1.25 and cache reads 0.1 of an input token; savings are worth the weighted cost of
    an input token, or nothing where there was no spend.
    """
    doubles = lambda df: df.select("key", *[F.col(c).cast("double") for c in df.columns if c != "key"])
    joined = doubles(spend).join(doubles(savings), "key", "full_outer")
    units = F.col("input") + 5.0 * F.col("output") + 1.25 * F.col("cache_create") + 0.1 * F.col("cache_read")
    cpt = F.when(units > 0, F.col("cost") / units)
    blended = F.when(F.col("input") + F.col("output") + F.col("cache_create") + F.col("cache_read") > 0, F.col("cost") / (F.col("input") + F.col("output") + F.col("cache_create") + F.col("cache_read")))
    active = F.when(F.col("input") + F.col("output") > 0, F.col("cost") / (F.col("input") + F.col("output")))
    return joined.withColumns({"weighted_cpt": cpt, "saved_usd": F.col("saved") * cpt, "blended_cpt": blended, "active_cpt": active})


def economics_totals(periods: DataFrame) -> DataFrame:
    units = F.sum("input") + 5.0 * F.sum("output") + 1.25 * F.sum("cache_create") + 0.1 * F.sum("cache_read")
    return periods.agg(
        F.count(F.lit(1)).alias("periods"), F.sum("cost").alias("cost"), F.sum("saved").alias("saved"), F.avg("saved_usd").alias("mean_saved_usd"), F.when(units > 0, F.sum("cost") / units).alias("weighted_cpt")
    )
