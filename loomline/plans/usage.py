"""Queries over the usage warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..sources import tables as T
from .catalog import query

_TOTALS = "COUNT(*) AS commands, SUM(input_tokens)::BIGINT AS input_tokens, SUM(output_tokens)::BIGINT AS output_tokens, SUM(saved_tokens)::BIGINT AS saved_tokens, SUM(exec_time_ms)::BIGINT AS total_time_ms, 100.0::DOUBLE * SUM(saved_tokens) / SUM(input_tokens) AS savings_pct, (SUM(exec_time_ms) // COUNT(*))::BIGINT AS avg_time_ms"


def _over(body: str) -> str:
    return T.with_views(body, "commands")


@query("E1_summary", _over(f"SELECT {_TOTALS} FROM commands"))
def e1(spark, d):
    return U.summary(T.commands(spark, d))


@query("E2_by_client", _over(f"SELECT CASE WHEN client = '' THEN 'default' ELSE client END AS client, {_TOTALS} FROM commands GROUP BY 1"))
def e2(spark, d):
    return U.by_client(T.commands(spark, d))


_RAW = "SELECT lom_cmd, COUNT(*) AS n, SUM(saved_tokens)::BIGINT AS saved, AVG(savings_pct) AS pct, floor(SUM(exec_time_ms)::DOUBLE / COUNT(*))::BIGINT AS avg_time_ms FROM commands GROUP BY 1"


@query("E3_by_command", _over(_RAW))
def e3(spark, d):
    return U.by_command(T.commands(spark, d))


@query("E4_rollup_key", _over("SELECT DISTINCT lom_cmd, split_part(lom_cmd, ' ', 2) AS key FROM commands"))
def e4(spark, d):
    return T.commands(spark, d).select("lom_cmd", U.rollup_key(F.col("lom_cmd")).alias("key")).distinct()


@query("E5_rollup", _over(f"SELECT split_part(lom_cmd, ' ', 2) AS key, SUM(n)::BIGINT AS n, SUM(saved)::BIGINT AS saved, SUM(pct * saved) / SUM(saved) AS pct, (SUM(avg_time_ms * n) // SUM(n))::BIGINT AS avg_time_ms FROM ({_RAW}) GROUP BY 1"))
def e5(spark, d):
    return U.rolled_up(U.by_command(T.commands(spark, d)), 10)


@query("E6_by_day", _over(f"SELECT strftime(timestamp, '%Y-%m-%d') AS day, {_TOTALS} FROM commands GROUP BY 1"))
def e6(spark, d):
    return U.by_period(T.commands(spark, d), "day")


@query("E7_by_week", _over(f"SELECT strftime(date_trunc('week', timestamp), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', timestamp) + INTERVAL 6 DAYS, '%Y-%m-%d') AS week_end, {_TOTALS} FROM commands GROUP BY 1, 2"))
def e7(spark, d):
    return U.by_period(T.commands(spark, d), "week")


@query("E8_by_month", _over(f"SELECT strftime(timestamp, '%Y-%m') AS month, {_TOTALS} FROM commands GROUP BY 1"))
def e8(spark, d):
    return U.by_period(T.commands(spark, d), "month")


@query("E9_parse_failures", T.with_views("SELECT COUNT(*) AS total, COUNT(*) FILTER (fallback_succeeded) AS recovered, 100.0::DOUBLE * COUNT(*) FILTER (fallback_succeeded) / COUNT(*) AS recovery_pct FROM parse_failures", "parse_failures"))
def e9(spark, d):
    return U.failure_summary(T.parse_failures(spark, d))


@query("E9_top_failing", T.with_views("SELECT raw_command, COUNT(*) AS n FROM parse_failures GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "parse_failures"))
def e9_top(spark, d):
    return U.top_counts(T.parse_failures(spark, d), "raw_command", 10)


@query("E10_telemetry", _over("SELECT COUNT(*) FILTER (timestamp >= m - INTERVAL 24 HOURS) AS commands_since, SUM(saved_tokens)::BIGINT AS saved, SUM(saved_tokens) FILTER (timestamp >= m - INTERVAL 24 HOURS)::BIGINT AS saved_since, 100.0::DOUBLE * SUM(saved_tokens) / SUM(input_tokens) AS pct FROM commands, (SELECT MAX(timestamp) AS m FROM commands)"))
def e10(spark, d):
    return U.telemetry(T.commands(spark, d))


@query("E36_quota", _over("SELECT SUM(saved_tokens)::BIGINT AS saved, SUM(saved_tokens) * 3.0::DOUBLE / 1e6 AS usd, 100.0::DOUBLE * SUM(saved_tokens) / 6000000 AS quota_pct FROM commands"))
def e36(spark, d):
    return U.quota(T.commands(spark, d))


@query("E37_bypass_rate", _over("SELECT COUNT(*) AS commands, 100.0::DOUBLE * AVG((lom_cmd LIKE '%error%')::INT) AS bypass_pct FROM commands HAVING bypass_pct > 10"))
def e37(spark, d):
    return U.bypass_rate(T.commands(spark, d), F.col("lom_cmd").contains("error"))


@query("F10_last_days", _over(f"SELECT strftime(timestamp, '%Y-%m-%d') AS day, {_TOTALS} FROM commands GROUP BY 1 ORDER BY 1 DESC LIMIT 10"))
def f10(spark, d):
    return U.last_days(T.commands(spark, d), 10)


@query("F11_bars", _over("SELECT client, saved, repeat('#', s) || repeat('.', 10 - s) AS bar FROM (SELECT client, saved, round(saved * 10.0 / MAX(saved) OVER ())::INT AS s FROM (SELECT CASE WHEN client = '' THEN 'default' ELSE client END AS client, SUM(saved_tokens)::BIGINT AS saved FROM commands GROUP BY 1))"))
def f11(spark, d):
    return U.bars(U.by_client(T.commands(spark, d)).select("client", F.col("saved_tokens").alias("saved")), "saved")


@query("F12_recent", _over("SELECT id, timestamp, lom_cmd, saved_tokens FROM commands WHERE project_path = '/p/3' OR starts_with(project_path, '/p/3/') ORDER BY timestamp DESC, id DESC LIMIT 25"))
def f12(spark, d):
    return U.recent(T.commands(spark, d), 25, "/p/3").select("id", "timestamp", "lom_cmd", "saved_tokens")


@query("C10_project_scope", _over(f"SELECT {_TOTALS} FROM commands WHERE project_path = '/p/1' OR starts_with(project_path, '/p/1/')"))
def c10(spark, d):
    return U.summary(T.commands(spark, d).where(U.in_scope(F.col("project_path"), "/p/1")))


@query("I7_retention", _over("SELECT COUNT(*) AS kept, MIN(timestamp) AS oldest FROM commands, (SELECT MAX(timestamp) AS m FROM commands) WHERE timestamp >= m - INTERVAL 7 DAYS"))
def i7(spark, d):
    return U.retained(T.commands(spark, d), 7).agg(F.count(F.lit(1)).alias("kept"), F.min("timestamp").alias("oldest"))


def _economics(unit: str) -> str:
    units = "(input + 5.0::DOUBLE * output + 1.25 * cache_create + 0.1 * cache_read)"
    return f"""SELECT COALESCE(s.key, v.key) AS key, input::DOUBLE AS input, output::DOUBLE AS output, cache_create::DOUBLE AS cache_create, cache_read::DOUBLE AS cache_read, cost, saved::DOUBLE AS saved, commands::DOUBLE AS commands,
 cost / {units} AS weighted_cpt, saved * (cost / {units}) AS saved_usd, cost / (input + output + cache_create + cache_read) AS blended_cpt, cost / (input + output) AS active_cpt
 FROM ({T.spend_sql(unit)}) s FULL JOIN ({T.savings_sql(unit)}) v ON s.key = v.key"""


for _unit in ("day", "week", "month"):

    @query(f"D2_economics_by_{_unit}", _economics(_unit))
    def d2(spark, d, unit=_unit):
        return U.merged_periods(T.spend(spark, d, unit), T.savings(spark, d, unit))


@query("E15_economics_totals", f"SELECT COUNT(*) AS periods, SUM(cost) AS cost, SUM(saved)::DOUBLE AS saved, AVG(saved_usd) AS mean_saved_usd, SUM(cost) / (SUM(input) + 5.0::DOUBLE * SUM(output) + 1.25 * SUM(cache_create) + 0.1 * SUM(cache_read)) AS weighted_cpt FROM ({_economics('month')})")
def e15(spark, d):
    return U.economics_totals(U.merged_periods(T.spend(spark, d, "month"), T.savings(spark, d, "month")))
