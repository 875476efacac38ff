"""Sources: the test tables, and views that give them the shapes that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage fact: one row a command that was run, with tokens in, out and saved."""
    k = F.get_json_object("props", "$.k").cast("int")
    client = F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"), F.lit("")), (F.col("user_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("lom "), "event_type", F.lit(" -k"), k).alias("lom_cmd"),
        F.concat(F.lit("/p/"), F.col("user_id") % 7, F.lit("/m"), F.col("user_id") % 3).alias("project_path"),
        client.alias("client"),
        F.floor(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.floor(F.col("value") * 100 * (k % 80) / 100).cast("long").alias("output_tokens"),
        (F.col("event_id") % 500).alias("exec_time_ms"),
    )
    return rows.withColumns(
        {
            "saved_tokens": F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)),
            "savings_pct": F.when(F.col("input_tokens") > 0, 100.0 * F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0)) / F.col("input_tokens")).otherwise(0.0),
        }
    )


def parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.concat(F.lit("cmd"), k % 10).alias("raw_command"), F.lit("bad flag").alias("error_message"), (k % 2 == 0).alias("fallback_succeeded")
    )


def spend(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """External spend by period ('day', 'week' or 'month')."""
    key = period_key(F.col("o_orderdate"), unit)
    return table(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(
        F.count(F.lit(1)).alias("input"), (F.count(F.lit(1)) * 2).alias("output"), F.sum(F.col("o_custkey") % 10).alias("cache_create"), F.sum(F.col("o_custkey") % 100).alias("cache_read"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
    ).select("key", "input", "output", "cache_create", "cache_read", (F.col("cents") / 100.0).alias("cost"))


def savings(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """Savings by period."""
    key = period_key(F.col("l_shipdate"), unit)
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("key")).agg(F.sum(F.col("l_quantity").cast("long")).alias("saved"), F.count(F.lit(1)).alias("commands"))


def period_key(stamp, unit: str):
    """A day, the Monday of a week, or a month, as text that sorts by time."""
    if unit == "month":
        return F.date_format(stamp, "yyyy-MM")
    return F.date_format(F.date_trunc("week", stamp) if unit == "week" else stamp, "yyyy-MM-dd")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of a session in order, with their outcome."""
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("int")
    flag = F.element_at(F.array(*[F.lit(x) for x in ("--all", "--fast", "--json")]), (k % 3 + 1).cast("int"))
    failed = F.col("event_type") == "error"
    why = F.element_at(F.array(*[F.lit(x) for x in ("error: unexpected argument", "command not found", "error: requires a value", "Permission denied", "No such file or directory: cannot open", "failed: error", "user declined")]), (k % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"),
        F.concat(F.lit("git "), F.element_at(F.array(F.lit("log"), F.lit("diff")), (k % 2 + 1).cast("int")), F.lit(" "), flag, F.when(k % 5 == 0, F.lit(" -v")).otherwise("")).alias("command"),
        failed.alias("is_error"), F.when(failed, why).otherwise("ok").alias("output"),
    )
    return rows


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.concat("p_type", F.lit(".py"))).alias("file_path"),
        (F.col("p_partkey") % 1000).cast("int").alias("line_start"), (F.col("p_partkey") % 1000 + F.col("p_size")).cast("int").alias("line_end"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between symbols, each once."""
    return calls(spark, sf_dir).distinct()


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between symbols: of each line item, from its part to the part numbered like its supplier times 17. Repeats are
    kept, for what is made distinct later on."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_to"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey"), (F.col("l_suppkey") * 17).alias("_to"), "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "N", "IMPORTS").otherwise("TYPE_REF")
    return lines.join(parts.hint("merge"), "_to", "left_semi").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("p"), "_to").alias("target"), kind.alias("type"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "N", "modified").otherwise("removed")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.concat(F.lit("p"), "l_partkey").alias("symbol_id"), F.concat(F.lit("c"), "l_orderkey").alias("commit_hash"), change.alias("change_type"), F.col("l_shipdate").alias("timestamp")
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent memory records from user turns."""
    kinds = ("rule", "preference", "fact", "decision", "task_state", "episode")
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    return t.select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("turn") % 6 + 1).cast("int")).alias("type"), F.col("text").alias("content"),
        F.concat(F.lit("u"), F.col("conv_id") % 5).alias("user_id"), F.when(F.col("conv_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("proj"), F.col("conv_id") % 3)).alias("project_id"),
        F.when(F.col("conv_id") % 7 == 0, "archived").otherwise("active").alias("status"), ((F.col("conv_id") % 11) / 10.0).alias("confidence"), (F.col("turn") % 10).cast("int").alias("priority"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 86400).alias("updated_at"),
    )


#: The same views in SQL, for oracles.
SQL = {
    "commands": """SELECT *, CASE WHEN input_tokens > 0 THEN 100.0::DOUBLE * saved_tokens / input_tokens ELSE 0 END AS savings_pct FROM (
 SELECT *, greatest(input_tokens - output_tokens, 0) AS saved_tokens FROM (
 SELECT event_id AS id, ts AS timestamp, 'lom ' || event_type || ' -k' || k AS lom_cmd, '/p/' || user_id % 7 || '/m' || user_id % 3 AS project_path,
 CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE '' END AS client, floor(value * 100)::BIGINT AS input_tokens,
 floor(value * 100 * (k % 80) / 100)::BIGINT AS output_tokens, event_id % 500 AS exec_time_ms
 FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)))""",
    "parse_failures": """SELECT event_id AS id, ts AS timestamp, 'cmd' || k % 10 AS raw_command, k % 2 = 0 AS fallback_succeeded
 FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE event_type = 'error'""",
    "executions": """SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS seq,
 'git ' || (CASE k % 2 WHEN 0 THEN 'log' ELSE 'diff' END) || ' ' || (CASE k % 3 WHEN 0 THEN '--all' WHEN 1 THEN '--fast' ELSE '--json' END) || (CASE WHEN k % 5 = 0 THEN ' -v' ELSE '' END) AS command,
 event_type = 'error' AS is_error, CASE WHEN event_type <> 'error' THEN 'ok' ELSE (CASE k % 7 WHEN 0 THEN 'error: unexpected argument' WHEN 1 THEN 'command not found' WHEN 2 THEN 'error: requires a value'
 WHEN 3 THEN 'Permission denied' WHEN 4 THEN 'No such file or directory: cannot open' WHEN 5 THEN 'failed: error' ELSE 'user declined' END) END AS output
 FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)""",
    "symbols": """SELECT 'p' || p_partkey AS id, p_name AS name, lower(p_type) AS kind, replace(p_brand, '#', '') || '/' || p_type || '.py' AS file_path,
 (p_partkey % 1000)::INT AS line_start, (p_partkey % 1000 + p_size)::INT AS line_end FROM part""",
    "edges": """SELECT DISTINCT 'p' || l_partkey AS source, 'p' || (l_suppkey * 17) AS target, CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'IMPORTS' ELSE 'TYPE_REF' END AS type
 FROM lineitem WHERE l_suppkey * 17 IN (SELECT p_partkey FROM part)""",
    "episodes": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, 'p' || l_partkey AS symbol_id, 'c' || l_orderkey AS commit_hash,
 CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'N' THEN 'modified' ELSE 'removed' END AS change_type, l_shipdate AS timestamp FROM lineitem""",
    "memories": """SELECT 'm' || conv_id || '-' || turn AS id, (['rule','preference','fact','decision','task_state','episode'])[(turn % 6 + 1)::INT] AS type, text AS content, 'u' || conv_id % 5 AS user_id,
 CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'proj' || conv_id % 3 END AS project_id, CASE WHEN conv_id % 7 = 0 THEN 'archived' ELSE 'active' END AS status,
 (conv_id % 11) / 10.0::DOUBLE AS confidence, (turn % 10)::INT AS priority, make_timestamp((1700000000 + conv_id * 86400) * 1000000) AS updated_at FROM conversations WHERE role = 'user'""",
}


def spend_sql(unit: str) -> str:
    return f"SELECT {_key_sql('o_orderdate', unit)} AS key, COUNT(*) AS input, COUNT(*) * 2 AS output, SUM(o_custkey % 10)::BIGINT AS cache_create, SUM(o_custkey % 100)::BIGINT AS cache_read, SUM(round(o_totalprice * 100)::BIGINT) / 100.0::DOUBLE AS cost FROM orders GROUP BY 1"


def savings_sql(unit: str) -> str:
    return f"SELECT {_key_sql('l_shipdate', unit)} AS key, SUM(l_quantity::BIGINT) AS saved, COUNT(*) AS commands FROM lineitem GROUP BY 1"


def _key_sql(stamp: str, unit: str) -> str:
    return f"strftime({stamp}, '%Y-%m')" if unit == "month" else f"strftime(date_trunc('{unit}', {stamp}), '%Y-%m-%d')"


def with_views(body: str, *names: str, **more: str) -> str:
    """An oracle: the named views, further ones, and a query over them."""
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}"
