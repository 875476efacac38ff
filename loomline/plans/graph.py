"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import tables as T
from .catalog import query

_V = ("symbols", "edges")


def _both(spark, d):
    return T.symbols(spark, d), T.edges(spark, d)


def _lines(spark, d):
    """(file_path, line_no, line): every line of every document, which is a file."""
    return T.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _spans(spark, d):
    """Symbols with their spans, dealt out over the documents."""
    n = T.table(spark, d, "documents").agg((F.max("doc_id") + 1).alias("n"))
    place = F.concat(F.lit("d"), F.expr("p_partkey % n"))
    return T.table(spark, d, "part").join(F.broadcast(n)).select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), place.alias("file_path"), F.expr("cast(p_partkey % 13 as int)").alias("line_start"), F.expr("cast(p_partkey % 13 + p_size % 9 as int)").alias("line_end"))


_LINES = """lines AS (SELECT 'd' || doc_id AS file_path, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
 spans AS (SELECT 'p' || p_partkey AS id, p_name AS name, 'd' || (p_partkey % (SELECT MAX(doc_id) + 1 FROM documents)) AS file_path, (p_partkey % 13)::INT AS line_start, (p_partkey % 13 + p_size % 9)::INT AS line_end FROM part)"""


def _sql(body: str, *views: str, lines: bool = False) -> str:
    out = T.with_views(body, *(views or _V))
    return out.replace(f") {body}", f"), {_LINES} {body}") if lines else out


@query("D8_valid_edges", _sql("SELECT * FROM edges WHERE source IN (SELECT id FROM symbols) AND target IN (SELECT id FROM symbols)"))
def d8(spark, d):
    s, e = _both(spark, d)
    return G.valid_edges(e, s)


@query("E18_degrees", _sql("SELECT id, SUM(i)::BIGINT AS incoming, SUM(1 - i)::BIGINT AS outgoing, COUNT(*) AS degree FROM (SELECT source AS id, 0 AS i FROM edges UNION ALL SELECT target, 1 FROM edges) GROUP BY 1"))
def e18(spark, d):
    return G.degrees(T.edges(spark, d))


@query("D4_edge_counts", _sql("SELECT s.id, (SELECT COUNT(*) FROM edges e WHERE e.source = s.id OR e.target = s.id) AS degree FROM symbols s"))
def d4(spark, d):
    s, e = _both(spark, d)
    return s.select("id").join(G.edge_counts(e), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("D5_dead_code", _sql("SELECT id, name, file_path FROM symbols WHERE id NOT IN (SELECT target FROM edges) AND NOT file_path ILIKE '%test%'"))
def d5(spark, d):
    s, e = _both(spark, d)
    return G.dead_code(s, e).select("id", "name", "file_path")


for _name, _dir, _near, _far in (("callers", "in", "target", "source"), ("callees", "out", "source", "target")):

    @query(f"D6_{_name}", _sql(f"SELECT e.{_near} AS \"of\", e.{_far} AS id, e.type, s.name, s.file_path FROM edges e JOIN symbols s ON s.id = e.{_far} WHERE e.type = 'CALLS' AND e.{_near} IN ('p17', 'p34', 'p51', 'p510')"))
    def d6(spark, d, direction=_dir):
        s, e = _both(spark, d)
        return G.related(e, s, s.where("id in ('p17', 'p34', 'p51', 'p510')"), direction, ["CALLS"])


@query("L2_importers", _sql("SELECT e.target AS \"of\", e.source AS id, e.type, s.name, s.file_path FROM edges e JOIN symbols s ON s.id = e.source WHERE e.type IN ('IMPORTS', 'TYPE_REF')"))
def l2(spark, d):
    s, e = _both(spark, d)
    return G.related(e, s, s, "in", ["IMPORTS", "TYPE_REF"])


@query("L13_context_card", _sql("""SELECT "of", role, id, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY "of", role ORDER BY id) AS rank FROM (
 SELECT target AS "of", 'caller' AS role, source AS id FROM edges WHERE type = 'CALLS' UNION ALL SELECT source, 'callee', target FROM edges WHERE type = 'CALLS' UNION ALL SELECT target, 'importer', source FROM edges WHERE type = 'IMPORTS'
 UNION ALL SELECT source, 'type', target FROM edges WHERE type = 'TYPE_REF') JOIN symbols USING (id) WHERE "of" IN ('p17', 'p170', 'p85')) WHERE rank <= 20"""))
def l13(spark, d):
    s, e = _both(spark, d)
    return G.context_card(e, s, s.where("id in ('p17', 'p170', 'p85')"))


@query("L14_incident_edges", _sql("""SELECT o.*, s.name AS other_name FROM (SELECT source AS "of", source, target, type, target AS other FROM edges UNION ALL SELECT target, source, target, type, source FROM edges WHERE source <> target) o LEFT JOIN symbols s ON s.id = o.other WHERE "of" IN ('p17', 'p340', 'p5')"""))
def l14(spark, d):
    s, e = _both(spark, d)
    return G.incident(e, s, s.where("id in ('p17', 'p340', 'p5')"))


_SEEDS = "('p3', 'p17', 'p700')"


@query("L1_impact", _sql(f"""SELECT id, MIN(depth)::INT AS depth FROM (WITH RECURSIVE r AS (SELECT id, 0 AS depth FROM symbols WHERE id IN {_SEEDS} UNION SELECT e.source, r.depth + 1 FROM r JOIN edges e ON e.target = r.id WHERE r.depth < 3) SELECT * FROM r) GROUP BY 1"""))
def l1(spark, d):
    s, e = _both(spark, d)
    return G.reached(e, s.where(f"id in {_SEEDS}"), 3, "in")


@query("L3_walk", _sql(f"""SELECT id, MIN(depth)::INT AS depth FROM (WITH RECURSIVE r AS (SELECT id, 0 AS depth FROM symbols WHERE id IN {_SEEDS} UNION SELECT e.target, r.depth + 1 FROM r JOIN edges e ON e.source = r.id WHERE r.depth < 2 AND e.type IN ('CALLS', 'IMPORTS')) SELECT * FROM r) GROUP BY 1"""))
def l3(spark, d):
    s, e = _both(spark, d)
    return G.reached(e, s.where(f"id in {_SEEDS}"), 2, "out", ["CALLS", "IMPORTS"])


_WALK = """SELECT origin, id, depth, via FROM (WITH RECURSIVE h AS ({hops}), r AS (SELECT id AS origin, id, 0 AS depth FROM symbols WHERE id IN {seeds} UNION SELECT r.origin, h.next, r.depth + 1 FROM r JOIN h ON h.id = r.id WHERE r.depth < {depth}),
 f AS (SELECT origin, id, MIN(depth)::INT AS depth FROM r GROUP BY 1, 2) SELECT f.origin, f.id, f.depth, MIN(h.via) AS via FROM f JOIN f p ON p.origin = f.origin AND p.depth = f.depth - 1 JOIN h ON h.id = p.id AND h.next = f.id GROUP BY 1, 2, 3)"""


@query("L1_impact_by_origin", _sql("SELECT origin, id, depth, via FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, id) AS r FROM (" + _WALK.format(hops="SELECT target AS id, source AS next, type AS via FROM edges", seeds=_SEEDS, depth=4) + ")) WHERE r <= 200"))
def l1_by_origin(spark, d):
    s, e = _both(spark, d)
    return G.walked(e, s.where(f"id in {_SEEDS}"), 4, "in", limit=200)


@query("L3_walk_both_ways", _sql(_WALK.format(hops="SELECT source AS id, target AS next, type AS via FROM edges WHERE type IN ('CALLS', 'TYPE_REF') UNION ALL SELECT target, source, type FROM edges WHERE type IN ('CALLS', 'TYPE_REF')", seeds=_SEEDS, depth=2)))
def l3_both_ways(spark, d):
    s, e = _both(spark, d)
    return G.walked(e, s.where(f"id in {_SEEDS}"), 2, "both", ["CALLS", "TYPE_REF"])


def _kindred(spark, d):
    """Edges between symbols of one kind: their components are many, as those of all edges are not."""
    s, e = _both(spark, d)
    kind = lambda end: s.select(F.col("id").alias(end), F.col("kind").alias(f"{end}_kind"))
    return e.join(kind("source"), "source").join(kind("target"), "target").where("source_kind = target_kind").select("source", "target", "type")


_COMMUNITIES = """SELECT id, label AS community, COUNT(*) OVER (PARTITION BY label) AS n FROM (
 WITH RECURSIVE x AS (SELECT source AS a, target AS b FROM kindred WHERE source <> target UNION SELECT target, source FROM kindred WHERE source <> target),
 r(id, label) USING KEY (id) AS (SELECT DISTINCT a, a FROM x UNION SELECT x.b, MIN(r.label) FROM r JOIN x ON x.a = r.id JOIN recurring.r o ON o.id = x.b WHERE r.label < o.label GROUP BY x.b)
 SELECT * FROM r)"""
_KINDRED = "SELECT e.source, e.target, e.type FROM edges e JOIN symbols a ON a.id = e.source JOIN symbols b ON b.id = e.target WHERE a.kind = b.kind"


@query("L4_communities", T.with_views(_COMMUNITIES, *_V, kindred=_KINDRED))
def l4(spark, d):
    return G.communities(_kindred(spark, d))


@query("L5_bridges", T.with_views(f"""SELECT id, COUNT(DISTINCT community) AS communities FROM (SELECT source AS id, target AS n FROM edges UNION ALL SELECT target, source FROM edges) JOIN (SELECT id AS n, community FROM ({_COMMUNITIES})) USING (n) GROUP BY 1 HAVING COUNT(DISTINCT community) >= 2""", *_V, kindred=_KINDRED))
def l5(spark, d):
    return G.bridges(T.edges(spark, d), G.communities(_kindred(spark, d)))


#: The walk in SQL: whole score tables follow one another, 25 rounds at most, and the first is kept that hardly changes.
PAGERANK = """WITH RECURSIVE steps AS (SELECT id, next, SUM(w) / SUM(SUM(w)) OVER (PARTITION BY id) AS share FROM (SELECT source AS id, target AS next, 1.0::DOUBLE AS w FROM edges UNION ALL SELECT target, source, 0.5 FROM edges) GROUP BY 1, 2),
 start AS ({start}),
 r AS (SELECT 0 AS k, id, weight AS score FROM start UNION ALL SELECT k + 1, id, SUM(score) FROM (
  SELECT r.k, s.next AS id, r.score * s.share * 0.25 AS score FROM r JOIN steps s ON s.id = r.id WHERE r.k < 25 UNION ALL SELECT DISTINCT r.k, start.id, start.weight * 0.75 FROM r, start WHERE r.k < 25) GROUP BY k, id),
 c AS (SELECT k, SUM(ABS(x)) AS change FROM (SELECT k, id, SUM(v) AS x FROM (SELECT k, id, score AS v FROM r UNION ALL SELECT k + 1, id, -score FROM r WHERE k < 25) GROUP BY 1, 2) GROUP BY 1)
 SELECT id, score FROM r WHERE k = (SELECT COALESCE(MIN(k), 25) FROM c WHERE k > 0 AND change < 1e-6) AND score > 0"""


@query("K5_pagerank", _sql("SELECT id, round(score, 9) AS score FROM (" + PAGERANK.format(start="SELECT id, 1.0::DOUBLE / COUNT(*) OVER () AS weight FROM symbols WHERE name = 'red widget'") + ")"))
def k5(spark, d):
    s, e = _both(spark, d)
    return G.pagerank(e, s.where("name = 'red widget'").select("id", F.lit(1.0).alias("weight"))).select("id", F.round("score", 9).alias("score")).where("score > 0")


@query("D9_enclosing_symbol", _sql("""SELECT l.file_path, l.line_no, l.line, arg_min(s.id, {'k': s.line_end - s.line_start, 'i': s.id}) FILTER (s.id IS NOT NULL) AS symbol FROM lines l LEFT JOIN spans s ON s.file_path = l.file_path AND l.line_no BETWEEN s.line_start AND s.line_end GROUP BY 1, 2, 3""", lines=True))
def d9(spark, d):
    return G.enclosing(_lines(spark, d), _spans(spark, d))


@query("E19_complexity", _sql(r"""SELECT s.id, s.name, (1 + COALESCE(SUM(len(regexp_extract_all(l.line, '\b(in|and|the|of)\b'))), 0))::BIGINT AS complexity FROM spans s LEFT JOIN lines l ON s.file_path = l.file_path AND l.line_no BETWEEN s.line_start AND s.line_end GROUP BY 1, 2""", lines=True))
def e19(spark, d):
    return G.complexity(_lines(spark, d), _spans(spark, d), G.words("in", "and", "the", "of"))


@query("D10_owning_scope", _sql("SELECT f.path, MAX(CASE WHEN starts_with(f.path || '/', s.prefix || '/') THEN s.prefix END) AS scope FROM (SELECT DISTINCT file_path AS path FROM symbols) f, (SELECT DISTINCT split_part(file_path, '/', 1) AS prefix FROM symbols WHERE file_path LIKE 'Brand1%') s GROUP BY 1"))
def d10(spark, d):
    s = T.symbols(spark, d)
    scopes = s.where("file_path like 'Brand1%'").select(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("prefix")).distinct()
    return G.owning_scope(s.select(F.col("file_path").alias("path")).distinct(), scopes)


@query("D12_resolution", _sql("""SELECT status, COUNT(*) AS n, COUNT(target) AS targets FROM (SELECT r.source, r.name, CASE WHEN l.n = 1 THEN l.id WHEN l.n IS NULL AND w.n = 1 THEN w.id END AS target,
 CASE WHEN l.n = 1 OR (l.n IS NULL AND w.n = 1) THEN 'resolved' WHEN COALESCE(l.n, w.n) IS NULL THEN 'missing' ELSE 'ambiguous' END AS status
 FROM (SELECT id AS source, file_path, split_part(name, ' ', 1) || ' ' || split_part(file_path, '/', 1) AS name FROM symbols) r
 LEFT JOIN (SELECT file_path, name, COUNT(*) AS n, MIN(id) AS id FROM (SELECT id, file_path, split_part(name, ' ', 1) || ' ' || CASE WHEN line_start % 3 = 0 THEN split_part(file_path, '/', 1) ELSE kind END AS name FROM symbols) GROUP BY 1, 2) l USING (file_path, name)
 LEFT JOIN (SELECT name, COUNT(*) AS n, MIN(id) AS id FROM (SELECT id, split_part(name, ' ', 1) || ' ' || CASE WHEN line_start % 3 = 0 THEN split_part(file_path, '/', 1) ELSE kind END AS name FROM symbols) GROUP BY 1) w USING (name)) GROUP BY 1"""))
def d12(spark, d):
    s = T.symbols(spark, d)
    word, top = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("file_path", F.lit("/"), F.lit(1))
    defined = s.withColumn("name", F.concat_ws(" ", word, F.when(F.col("line_start") % 3 == 0, top).otherwise(F.col("kind"))))
    refs = s.select(F.col("id").alias("source"), "file_path", F.concat_ws(" ", word, top).alias("name"))
    return G.resolved(refs, defined).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("targets"))


_FILES = "SELECT DISTINCT a.file_path AS source_file, b.file_path AS target_file FROM edges e JOIN symbols a ON a.id = e.source JOIN symbols b ON b.id = e.target WHERE a.file_path <> b.file_path"


@query("L15_file_edges", _sql(_FILES))
def l15(spark, d):
    s, e = T.symbols(spark, d), T.calls(spark, d)
    return G.file_edges(e, s)


@query("D13_used_by", _sql(f"SELECT target_file AS file_path, array_to_string(list_sort(list(source_file)), ',') AS importers, COUNT(*) AS n FROM ({_FILES}) GROUP BY 1"))
def d13(spark, d):
    s, e = T.symbols(spark, d), T.calls(spark, d)
    return G.used_by(G.file_edges(e, s))


@query("D14_package_edges", _sql(f"SELECT DISTINCT split_part(source_file, '/', 1) AS package, split_part(target_file, '/', 1) AS depends_on FROM ({_FILES}) WHERE split_part(source_file, '/', 1) <> split_part(target_file, '/', 1)"))
def d14(spark, d):
    s, e = T.symbols(spark, d), T.calls(spark, d)
    return G.package_edges(G.file_edges(e, s))


@query("D15_entry_points", _sql("SELECT id FROM symbols WHERE id IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)"))
def d15(spark, d):
    s, e = _both(spark, d)
    return s.select("id").join(e.select(F.col("source").alias("id")), "id", "left_semi").join(e.select(F.col("target").alias("id")), "id", "left_anti")


@query("E24_key_files", _sql(f"""SELECT directory, file_path, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY score DESC, file_path) AS rank FROM (SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, file_path, 10 * COALESCE(n, 0) + COUNT(*) AS score
 FROM symbols LEFT JOIN (SELECT target_file AS file_path, COUNT(*) AS n FROM ({_FILES}) GROUP BY 1) USING (file_path) GROUP BY 1, 2, n)) WHERE rank <= 5"""))
def e24(spark, d):
    s, e = T.symbols(spark, d), T.calls(spark, d)
    return G.key_files(s, G.file_edges(e, s))


@query("E21_directories", _sql("""SELECT directory, COUNT(DISTINCT file_path) AS files, COUNT(*) AS symbols, (SELECT kind FROM symbols t WHERE regexp_extract(t.file_path, '^(.*)/[^/]*$', 1) = directory GROUP BY kind ORDER BY COUNT(*) DESC, kind LIMIT 1) AS modal_kind FROM (SELECT *, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory FROM symbols) GROUP BY 1""", "symbols"))
def e21(spark, d):
    return G.directories(T.symbols(spark, d))


@query("E22_kinds", _sql("SELECT kind, COUNT(*) AS n FROM symbols GROUP BY 1", "symbols"))
def e22(spark, d):
    return T.symbols(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("E23_hubs", _sql("SELECT target AS id, COUNT(*) AS inbound, COUNT(DISTINCT source) AS dependents FROM edges GROUP BY 1 ORDER BY inbound DESC, id LIMIT 10"))
def e23(spark, d):
    return G.hubs(T.edges(spark, d), 10)


@query("K13_repo_map", _sql("SELECT (SELECT COUNT(*) FROM symbols) AS symbols, (SELECT COUNT(DISTINCT file_path) FROM symbols) AS files, (SELECT COUNT(*) FROM edges) AS edges"))
def k13(spark, d):
    s, e = _both(spark, d)
    return s.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files")).join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges"))))


@query("E20_evolution", _sql("""SELECT p.symbol_id, s.name, p.changes, p.commits, p.last_change, p.latest_change, p.last_ts, p.changes * 10.0::DOUBLE + COALESCE(g.n, 0) * 2.0 AS compound, COALESCE(g.n, 0) * 1.0::DOUBLE AS impact FROM (
 SELECT symbol_id, COUNT(*) AS changes, COUNT(DISTINCT commit_hash) AS commits, MAX(change_type) AS last_change, arg_max(change_type, {'t': timestamp, 'i': id}) AS latest_change, MAX(timestamp) AS last_ts FROM episodes GROUP BY 1) p
 JOIN symbols s ON s.id = p.symbol_id LEFT JOIN (SELECT id, COUNT(*) AS n FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) g ON g.id = p.symbol_id""", "symbols", "edges", "episodes"))
def e20(spark, d):
    return G.evolution(T.episodes(spark, d), *_both(spark, d))


@query("E20_overview", _sql("SELECT split_part(s.file_path, '/', 1) AS module, COUNT(*) AS changes, COUNT(DISTINCT e.symbol_id) AS symbols FROM episodes e JOIN symbols s ON s.id = e.symbol_id GROUP BY 1", "symbols", "episodes"))
def e20_overview(spark, d):
    rows = T.episodes(spark, d).join(T.symbols(spark, d).select(F.col("id").alias("symbol_id"), "file_path"), "symbol_id")
    return rows.groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("module")).agg(F.count(F.lit(1)).alias("changes"), F.countDistinct("symbol_id").alias("symbols"))


@query("E20_novel", _sql("SELECT e.id, e.symbol_id, s.name, e.timestamp FROM episodes e JOIN symbols s ON s.id = e.symbol_id WHERE e.change_type = 'added' ORDER BY e.timestamp DESC, e.id LIMIT 50", "symbols", "episodes"))
def e20_novel(spark, d):
    rows = T.episodes(spark, d).where("change_type = 'added'").join(T.symbols(spark, d).select(F.col("id").alias("symbol_id"), "name"), "symbol_id")
    return rows.orderBy(F.desc("timestamp"), "id").limit(50).select("id", "symbol_id", "name", "timestamp")


@query("E20_directional", _sql("SELECT symbol_id, change_type, COUNT(*) AS changes, MAX(timestamp) AS last_ts FROM episodes WHERE symbol_id IN (SELECT id FROM symbols) GROUP BY 1, 2", "symbols", "episodes"))
def e20_directional(spark, d):
    rows = T.episodes(spark, d).join(T.symbols(spark, d).select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    return rows.groupBy("symbol_id", "change_type").agg(F.count(F.lit(1)).alias("changes"), F.max("timestamp").alias("last_ts"))


@query("D3_episode_symbols", _sql("SELECT e.id, s.name, s.file_path, e.change_type FROM episodes e JOIN symbols s ON s.id = e.symbol_id", "symbols", "episodes"))
def d3(spark, d):
    return T.episodes(spark, d).join(T.symbols(spark, d).select(F.col("id").alias("symbol_id"), "name", "file_path"), "symbol_id").select("id", "name", "file_path", "change_type")


@query("L16_timeline", _sql("SELECT id, commit_hash, change_type, timestamp FROM episodes WHERE symbol_id = 'p17' ORDER BY timestamp DESC, id LIMIT 20", "episodes"))
def l16(spark, d):
    return T.episodes(spark, d).where("symbol_id = 'p17'").orderBy(F.desc("timestamp"), "id").limit(20).select("id", "commit_hash", "change_type", "timestamp")


@query("I6_changes_since", _sql("SELECT COUNT(*) AS n, arg_max(id, {'t': timestamp, 'i': id}) AS anchor FROM episodes WHERE timestamp >= TIMESTAMP '2000-01-01'", "episodes"))
def i6(spark, d):
    return T.episodes(spark, d).where("timestamp >= timestamp '2000-01-01'").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("timestamp", "id")).alias("anchor"))


@query("D16_changed_files", _sql("SELECT id, name FROM symbols WHERE file_path IN ('Brand1/SMALL.py', 'Brand2/ECONOMY.py')", "symbols"))
def d16(spark, d):
    changed = spark.createDataFrame([("Brand1/SMALL.py",), ("Brand2/ECONOMY.py",)], "file_path string")
    return T.symbols(spark, d).join(F.broadcast(changed), "file_path", "left_semi").select("id", "name")


@query("C14_fuzzy_names", _sql("SELECT id, name FROM symbols WHERE name ILIKE '%WIDG%' ORDER BY length(name), id LIMIT 40", "symbols"))
def c14(spark, d):
    return T.symbols(spark, d).where(F.col("name").ilike("%WIDG%")).orderBy(F.length("name"), "id").limit(40).select("id", "name")


@query("C19_exact_lookup", _sql("SELECT id, file_path FROM symbols WHERE name = 'red widget' ORDER BY id LIMIT 20", "symbols"))
def c19(spark, d):
    return T.symbols(spark, d).where("name = 'red widget'").orderBy("id").limit(20).select("id", "file_path")


@query("A10_git_log", "SELECT 'c' || l_orderkey AS commit_hash, strftime(MIN(l_shipdate), '%Y-%m-%d') AS stamp, COUNT(*) AS files FROM lineitem GROUP BY l_orderkey")
def a10(spark, d):
    rows = T.table(spark, d, "lineitem")
    repo = F.concat(F.lit("repo"), F.expr("l_orderkey div 200"))  # as many as the table has room for
    heads = rows.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s")).select(repo.alias("source"), (F.col("l_orderkey") * 1_000_000).alias("line_no"), F.concat(F.lit("c"), "l_orderkey", F.lit("|"), F.date_format("s", "yyyy-MM-dd")).alias("line"))
    changes = rows.select(repo.alias("source"), (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey") % 99_999 + 1).alias("line_no"), F.concat("l_returnflag", F.lit("\tsrc/p"), "l_partkey").alias("line"))
    return G.carried_headers(heads.unionByName(changes), r"^c\d+\|").groupBy("commit_hash", "stamp").agg(F.count(F.lit(1)).alias("files"))


@query("A8_fingerprints", "SELECT COALESCE(a.doc_id, b.doc_id)::VARCHAR AS path, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN b.doc_id % 10 = 3 THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 3) b USING (doc_id)")
def a8(spark, d):
    docs = T.table(spark, d, "documents")
    f = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.sha2("text", 256).alias("hash"), "doc_id")
    before = f.where("doc_id % 7 <> 3").withColumn("mtime", F.when(F.col("doc_id") % 10 == 3, 2).otherwise(1)).withColumn("hash", F.when(F.col("doc_id") % 10 == 3, "other").otherwise(F.col("hash")))
    return G.fingerprint_changes(f.where("doc_id % 7 <> 0"), before)


@query("A8_lazy_fingerprints", """SELECT COALESCE(a.doc_id, b.doc_id)::VARCHAR AS path, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.doc_id % 10 = 3 OR a.text IS NULL THEN 'changed' ELSE 'unchanged' END AS status,
 CASE WHEN a.doc_id IS NULL THEN NULL WHEN b.doc_id IS NOT NULL AND a.doc_id % 10 IN (3, 4) OR b.doc_id IS NULL THEN sha256(a.text) ELSE 'known' END AS hash FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 3) b USING (doc_id)""")
def a8_lazy(spark, d):
    """Of known files a tenth has another time and contents, a tenth another time alone; the others aren't hashed again."""
    docs = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"), F.col("text").alias("content"), "doc_id")
    kind = F.col("doc_id") % 10
    known = F.when(kind == 3, "other").when(kind == 4, F.sha2("content", 256)).otherwise("known")
    before = docs.where("doc_id % 7 <> 3").select("path", "size", F.when(kind.isin(3, 4), 2).otherwise(1).alias("mtime"), known.alias("hash"))
    now = docs.where("doc_id % 7 <> 0")
    return G.probed(now, before, now).select("path", "status", "hash")


@query("A9_removed_paths", "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 <> 0)")
def a9(spark, d):
    pages = T.table(spark, d, "pages")
    return pages.select("url").distinct().join(pages.where("page_id % 3 <> 0").select("url"), "url", "left_anti")


@query("B7_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_name END AS p_name FROM part")
def b7(spark, d):
    part = T.table(spark, d, "part").select("p_partkey", "p_name")
    return G.upserted(part, part.where("p_partkey % 4 = 0").withColumn("p_name", F.lit("new")), "p_partkey")


@query("B6_projection", _sql("SELECT DISTINCT source, target, type FROM edges WHERE source <> target AND source IN (SELECT id FROM symbols WHERE kind <> 'small') AND target IN (SELECT id FROM symbols WHERE kind <> 'small')"))
def b6(spark, d):
    s, e = _both(spark, d)
    return G.valid_edges(e.where("source <> target").distinct(), s.where("kind <> 'small'"))


@query("B10_drift", "SELECT kind, COUNT(*) AS n FROM (SELECT CASE WHEN b.page_id IS NULL THEN 'coverage' WHEN a.page_id IS NULL THEN 'removed' WHEN a.page_id % 4 = 0 THEN 'content_drift' ELSE 'ok' END AS kind FROM (SELECT page_id FROM pages WHERE page_id % 7 <> 0) a FULL JOIN (SELECT page_id FROM pages WHERE page_id % 7 <> 3) b USING (page_id)) GROUP BY 1")
def b10(spark, d):
    pages = T.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.length("html").alias("size"), F.lit(1).alias("mtime"), F.md5("html").alias("hash"), "page_id")
    cards = pages.where("page_id % 7 <> 3").withColumn("hash", F.when(F.col("page_id") % 4 == 0, "stale").otherwise(F.col("hash"))).withColumn("mtime", F.lit(0))
    names = {"added": "coverage", "removed": "removed", "changed": "content_drift", "unchanged": "ok"}
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("status"))
    return G.fingerprint_changes(pages.where("page_id % 7 <> 0"), cards).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("L9_definitions", """SELECT file_path, line_no, kind, name, file_path || '::' || name || CASE WHEN n > 1 THEN '~' || n ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY file_path, name ORDER BY line_no) AS n FROM (
 SELECT 'm' || p_partkey % 9 || '.py' AS file_path, p_partkey AS line_no, CASE p_partkey % 3 WHEN 0 THEN 'function' ELSE 'class' END AS kind, split_part(p_name, ' ', 2) AS name FROM part WHERE p_partkey % 3 < 2))""")
def l9(spark, d):
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("    async def "), word, F.lit("(self):"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("class "), word, F.lit("(Base):"))).otherwise(F.concat(F.lit("x = "), word))
    return G.definitions(T.table(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey") % 9, F.lit(".py")).alias("file_path"), F.col("p_partkey").alias("line_no"), line.alias("line")))


@query("L8_scopes", _sql("SELECT split_part(file_path, '/', 1) AS scope, COUNT(*) AS nodes FROM symbols GROUP BY 1 HAVING COUNT(*) >= 5", "symbols"))
def l8(spark, d):
    return T.symbols(spark, d).groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("scope")).agg(F.count(F.lit(1)).alias("nodes")).where("nodes >= 5")


@query("E26_counts", _sql("SELECT status, type, COUNT(*) AS n FROM memories GROUP BY 1, 2", "memories"))
def e26(spark, d):
    return T.memories(spark, d).groupBy("status", "type").agg(F.count(F.lit(1)).alias("n"))


@query("E38_candidates", _sql("SELECT file_path, COUNT(*) AS n FROM symbols GROUP BY 1 ORDER BY n DESC, file_path LIMIT 15", "symbols"))
def e38(spark, d):
    return T.symbols(spark, d).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(15)
