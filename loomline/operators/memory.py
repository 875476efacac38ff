"""Agent memory: scoped records, deduplication, hybrid scores and context under a token budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .retrieval import K1, B

#: Weights of hybrid scores and caps by type. Fixed values.
KEYWORD, RECENCY, CONFIDENCE, PRIORITY = 0.20, 0.10, 0.05, 0.05
CAPS = {"rule": 8, "preference": 8, "fact": 10, "decision": 10, "task_state": 6, "episode": 12}
ORDER = tuple(CAPS)


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` that the store doesn't have: by user and normalised content among active rows, first by id."""
    norm = lambda df: df.withColumn("normal", X.normalise_content(F.col("content")))
    first = F.row_number().over(Window.partitionBy("user_id", "normal").orderBy("id"))
    fresh = norm(new).withColumn("_n", first).where("_n = 1").drop("_n")
    return fresh.join(norm(store.where("status = 'active'")).select("user_id", "normal"), ["user_id", "normal"], "left_anti")


def listed(store: DataFrame, user: str, n: int | None, status: str = "active", project: str | None = None, kind: str | None = None) -> DataFrame:
    rows = store.where((F.col("user_id") == user) & (F.col("status") == status))
    if project is not None:
        rows = rows.where(F.col("project_id").isNull() | (F.col("project_id") == project))
    if kind is not None:
        rows = rows.where(F.col("type") == kind)
    rows = rows.orderBy(F.desc("priority"), F.desc("updated_at"), "id")
    return rows if n is None else rows.limit(n)


def archived(store: DataFrame, condition: Column) -> DataFrame:
    return store.withColumn("status", F.when(condition, "archived").otherwise(F.col("status")))


def forgotten(store: DataFrame, condition: Column) -> DataFrame:
    return store.where(~F.coalesce(condition, F.lit(False)))


def core(store: DataFrame, user: str, n: int) -> DataFrame:
    """Rules, preferences and task states of a user, with scores."""
    score = F.least(F.lit(1.0), 0.5 * F.col("confidence") + 0.5 * F.col("priority") / 100.0)
    rows = store.where((F.col("user_id") == user) & (F.col("status") == "active") & F.col("type").isin("rule", "preference", "task_state")).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def hybrid(store: DataFrame, keyword: DataFrame, now: Column, least: float = 0.0) -> DataFrame:
    """Scores from keywords (id, score), recency, confidence and priority, to nine digits so that ties are ties."""
    rows = store.join(keyword.select("id", F.col("score").alias("kw")), "id", "left")
    total = KEYWORD * F.coalesce("kw", F.lit(0.0)) + RECENCY * X.recency(F.to_date("updated_at"), now) + CONFIDENCE * F.col("confidence") + PRIORITY * F.col("priority") / 100.0
    return rows.withColumn("score", F.round(total, 9)).drop("kw").where(F.col("score") >= least)


def context(scored: DataFrame, budget: int, caps: dict[str, int] = CAPS) -> DataFrame:
    """What fits a token budget of (id, user_id, type, content, score): first of equal contents, the best of each type
    up to its cap, then in order of score while the running sum of tokens stays within the budget."""
    normal = X.normalise_content(F.col("content"))
    once = scored.withColumn("_d", F.row_number().over(Window.partitionBy("user_id", normal).orderBy(F.desc("score"), "id"))).where("_d = 1")
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("type")), F.lit(12))
    capped = once.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "type").orderBy(F.desc("score"), "id"))).where(F.col("_k") <= cap)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return capped.withColumn("tokens", F.sum(X.estimate_tokens(F.col("content"))).over(order)).where(F.col("tokens") <= budget).drop("_d", "_k")


def rendered(packed: DataFrame) -> DataFrame:
    """One block of text a user, types in fixed order."""
    place = F.array_position(F.array(*[F.lit(t) for t in ORDER]), F.col("type"))
    items = F.array_sort(F.collect_list(F.struct(place.alias("p"), (-F.col("score")).alias("s"), "id", "content")))
    return packed.groupBy("user_id").agg(F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i["content"])), "\n").alias("block"))


def extracted(turns: DataFrame) -> DataFrame:
    """Candidates of (user, assistant) turns that ask to be remembered: rules or preferences."""
    asks = F.col("user").rlike(r"(?i)\b(remember|always|never|from now on)\b")
    rule = F.lower("user").rlike("always|never|from now on")
    return turns.where(asks).select("*", F.when(rule, "rule").otherwise("preference").alias("type"), F.lit(0.85).alias("confidence"), F.when(rule, 90).otherwise(75).alias("priority"))


def valid(candidates: DataFrame, least: float = 0.70) -> DataFrame:
    """Candidates that are sure enough and neither hold secrets nor instructions to the agent."""
    secret = F.col("user").rlike(r"(?i)(password|secret|token|api_?key)\s*[:=]\s*\S{6,}|AKIA[A-Z0-9]{16}")
    return candidates.where((F.col("confidence") >= least) & ~secret & ~X.injection(F.col("user")))


def searched(store: DataFrame, query: str, user: str, n: int, project: str | None = None, session: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """id, type and keyword score (0 to 1) of a user's active records that hold a word of the query, best first.

    Scores are BM25 over all records of the store; words that most records hold count next to nothing, but not less.
    """
    terms = sorted(set(re.findall(r"\w+", query.lower())))
    words = store.select("id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)\w+"), F.lit(0))).alias("term"))
    index = words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    lengths = index.groupBy("id").agg(F.sum("tf").alias("len"))
    corpus = store.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(lengths.agg(F.sum("len").alias("words"))))
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = K1 * (1 - B + B * F.col("len") * F.col("n") / F.col("words"))
    rows = hits.join(F.broadcast(df), "term").join(lengths, "id").join(F.broadcast(corpus))
    scored = rows.groupBy("id").agg(F.sum(idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score"))
    wanted = store.where((F.col("user_id") == user) & (F.col("status") == "active"))
    for column, value in (("project_id", project), ("session_id", session)):
        if value is not None:
            wanted = wanted.where(F.col(column).isNull() | (F.col(column) == value))
    if kinds:
        wanted = wanted.where(F.col("type").isin(*kinds))
    found = wanted.join(scored, "id").select("id", "type", F.round(F.least("score", F.lit(1.0)), 9).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(n)


#: Records of an export at most, unless it asks for all. Fixed value.
MOST_EXPORTED = 10_000
RECORD = "id string, type string, content string, confidence double, priority int"


def events(log: DataFrame, user: str, n: int) -> DataFrame:
    """The newest events (id, event_type, created_at, ...) of a user."""
    return log.where(F.col("user_id") == user).orderBy(F.desc("created_at"), "id").limit(n)


def exported(store: DataFrame, user: str, form: str, project: str | None = None, most: int | None = MOST_EXPORTED) -> DataFrame:
    """One row a record, in order of the list: `text`, a JSON object or a section of Markdown. With None as `most` all are."""
    rows = listed(store, user, most, project=project)
    if form == "json":
        return rows.select("id", F.to_json(F.struct("id", "type", "content", "confidence", "priority")).alias("text"))
    return rows.select("id", F.concat(F.lit("## "), "id", F.lit(" ("), "type", F.lit(")\n\n"), "content", F.lit("\n")).alias("text"))


def imported(store: DataFrame, lines: DataFrame, user: str, project: str | None = None) -> DataFrame:
    """Records of exported JSON (text) that the store doesn't have, as new ones of the user's own; broken lines drop."""
    parsed = lines.select(F.from_json("text", RECORD).alias("r")).where("r.content is not null").select("r.*")
    own = parsed.withColumn("user_id", F.lit(user)).withColumn("project_id", F.lit(project).cast("string")).withColumn("source", F.lit("user")).withColumn("status", F.lit("active"))
    return added(store, own)


def scope(env: Column, default_user: Column, root: Column, folder: Column, detect: bool = True) -> Column:
    """Struct of user, project, session, agent and workspace: from a map of settings, then from defaults, the name of the
    repository's root or else of the folder. Empty settings count as unset."""
    get = lambda name: F.nullif(F.try_element_at(env, F.lit(name)), F.lit(""))
    base = lambda path: F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit(""))
    found = F.coalesce(base(root), base(folder), F.lit("default")) if detect else F.lit(None).cast("string")
    return F.struct(
        F.coalesce(get("MEMORY_USER_ID"), default_user).alias("user"), F.coalesce(get("MEMORY_PROJECT_ID"), found).alias("project"),
        F.coalesce(get("SESSION_ID"), get("MEMORY_SESSION_ID")).alias("session"), get("MEMORY_AGENT_ID").alias("agent"), F.coalesce(get("MEMORY_WORKSPACE_ID"), folder).alias("workspace"),
    )


class MemoryStore:
    """Records of agents as one object over a table: each change gives a new store, and tables are written by `save`."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def add(self, new: DataFrame) -> MemoryStore:
        return MemoryStore(self.rows.unionByName(added(self.rows, new).drop("normal"), allowMissingColumns=True))

    def search(self, query: str, user: str, n: int = 20, **scope) -> DataFrame:
        return searched(self.rows, query, user, n, **scope)

    def list(self, user: str, n: int = 100, **scope) -> DataFrame:
        return listed(self.rows, user, n, **scope)

    def archive(self, condition: Column) -> MemoryStore:
        return MemoryStore(archived(self.rows, condition))

    def forget(self, condition: Column) -> MemoryStore:
        return MemoryStore(forgotten(self.rows, condition))

    def delete_all(self, user: str, mode: str = "archive") -> MemoryStore:
        own = F.col("user_id") == user
        return self.archive(own) if mode == "archive" else self.forget(own)

    def context(self, keyword: DataFrame, now: Column, budget: int) -> DataFrame:
        return context(hybrid(self.rows, keyword, now), budget)

    def save(self, folder: str) -> None:
        """Writes the table to a folder that isn't the one it is read from, by user."""
        self.rows.write.mode("overwrite").partitionBy("user_id").parquet(folder)
