"""A code base made from the test tables: what an extractor gives of its files, as views in SQL of both engines.

Packages have 40 symbols of 10 files each, so that the code base grows with the tables. Names are unique, shared within
a package or shared by all, in turn.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shuffled
from .tables import table

_N = "z.n"

#: View by view; each may use those before it.
SQL = {
    "cb_size": "SELECT count(*) AS n FROM part",
    "cb_nodes": """SELECT p_partkey AS k, 'n' || CAST(p_partkey AS STRING) AS id,
 CASE p_size % 3 WHEN 0 THEN 'u' || CAST(p_partkey AS STRING) WHEN 1 THEN 'w' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || '_' || CAST(p_partkey % 11 AS STRING) ELSE 's' || CAST(p_partkey % 97 AS STRING) END AS name,
 CASE p_size % 8 WHEN 0 THEN 'function' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'method' WHEN 4 THEN 'method' WHEN 5 THEN 'class' WHEN 6 THEN 'interface' ELSE 'constant' END AS kind,
 'pkg' || CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING) || '/' || CASE p_partkey % 5 WHEN 0 THEN 'util' WHEN 1 THEN 'index' WHEN 2 THEN 'cache' WHEN 3 THEN '__init__' ELSE 'main' END || CASE WHEN p_partkey % 3 = 0 THEN '.py' ELSE '.ts' END AS file,
 CASE WHEN p_size % 8 = 2 AND p_partkey % 40 >= 15 THEN 'n' || CAST(p_partkey - 15 AS STRING) END AS parent, p_size AS line FROM part""",
    "cb_refs": f"""SELECT s.id AS source, s.file AS file, t.name AS name, CASE WHEN l_linenumber % 4 > 0 THEN 'CALLS' WHEN l_returnflag = 'A' THEN 'CALLS' WHEN l_returnflag = 'N' THEN 'EXTENDS' ELSE 'TYPE_REF' END AS kind,
 CASE l_linenumber % 4 WHEN 1 THEN 'self' WHEN 2 THEN 'typed' WHEN 3 THEN 'untyped' END AS receiver,
 CASE l_linenumber % 4 WHEN 2 THEN v.name WHEN 3 THEN CASE WHEN l_partkey % 2 = 0 THEN 'v' || CAST(l_suppkey % 10 AS STRING) ELSE v.name END END AS variable, l_orderkey * 10 + l_linenumber AS position
 FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN l_partkey + l_linenumber ELSE l_orderkey % {_N} END AS tk, l_orderkey * 7 % {_N} AS vk FROM lineitem CROSS JOIN cb_size z) l JOIN cb_nodes s ON s.k = l_partkey JOIN cb_nodes t ON t.k = tk JOIN cb_nodes v ON v.k = vk""",
    "cb_imports": f"""SELECT a.file AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'v' || CAST(o_custkey % 10 AS STRING) ELSE b.name END AS local, CASE WHEN o_orderkey % 17 = 0 THEN '*' ELSE b.name END AS imported,
 CASE WHEN o_orderkey % 13 = 0 THEN 'react' WHEN o_orderkey % 13 = 1 THEN './' || split_part(b.file, '/', 2) WHEN o_orderkey % 13 = 2 THEN '../' || split_part(b.file, '/', 1)
 WHEN a.file LIKE '%.py' AND o_orderkey % 2 = 0 THEN split_part(b.file, '/', 1) || '.' || split_part(split_part(b.file, '/', 2), '.', 1)
 ELSE '../' || split_part(b.file, '.', 1) END AS module, o_orderkey AS position
 FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN (ak + o_custkey) % n ELSE ak + o_custkey % 7 END AS bk FROM (SELECT *, o_orderkey % {_N} AS ak FROM orders CROSS JOIN cb_size z) p) o JOIN cb_nodes a ON a.k = ak JOIN cb_nodes b ON b.k = bk""",
    "cb_bindings": f"""SELECT a.file AS file, 'v' || CAST(c_nationkey % 10 AS STRING) AS variable, b.name AS type, c_custkey AS position FROM (SELECT *, c_custkey % {_N} AS ak, (c_custkey % {_N} + c_nationkey) % {_N} AS bk FROM customer CROSS JOIN cb_size z) c JOIN cb_nodes a ON a.k = ak JOIN cb_nodes b ON b.k = bk WHERE b.kind IN ('class', 'interface', 'constant')""",
    "cb_owners": "SELECT m.id AS method, t.name AS type, m.file AS file FROM cb_nodes m JOIN cb_nodes t ON t.k = m.k - m.line % 7 WHERE m.kind = 'method' AND m.parent IS NULL AND t.kind IN ('class', 'interface', 'function')",
    "cb_relations": f"SELECT a.file AS file, a.name AS from_name, b.name AS to_name, 'IMPLEMENTS' AS kind, c_custkey AS position FROM (SELECT *, c_custkey * 3 % {_N} AS ak, (c_custkey * 3 % {_N} + 1 + c_nationkey % 5) % {_N} AS bk FROM customer CROSS JOIN cb_size z) c JOIN cb_nodes a ON a.k = ak JOIN cb_nodes b ON b.k = bk WHERE a.kind IN ('class', 'interface') AND b.kind IN ('class', 'interface', 'method')",
}

#: Repositories of a supplier each, with their files and manifests. In texts | is a line's end and ~ a quotation mark.
REPOSITORIES = {
    "cb_count": "SELECT count(*) AS n FROM supplier",
    "cb_sources": """SELECT 'r' || CAST(l_suppkey AS STRING) AS repo, CASE l_linenumber % 7 WHEN 0 THEN 'packages/p' || CAST(l_partkey % 7 AS STRING) || '/src/f' || CAST(l_orderkey % 5 AS STRING) || '.ts'
 WHEN 1 THEN 'apps/' || CASE WHEN l_partkey % 2 = 0 THEN 'web' ELSE 'api' END || '/main' || CAST(l_orderkey % 3 AS STRING) || '.ts' WHEN 2 THEN 'libs/x' || CAST(l_partkey % 3 AS STRING) || '/y' || CAST(l_orderkey % 4 AS STRING) || '/z.rs'
 WHEN 3 THEN 'tools/t' || CAST(l_partkey % 40 AS STRING) || '/a.py' WHEN 4 THEN 'top' || CAST(l_partkey % 3 AS STRING) || '.ts' WHEN 5 THEN 'deep/a/b' || CAST(l_partkey % 2 AS STRING) || '/c.go'
 ELSE 'packages/p' || CAST(l_partkey % 7 AS STRING) || '/sub/q' || CAST(l_orderkey % 2 AS STRING) || '/g.ts' END AS path, CASE WHEN l_returnflag = 'A' THEN 'file' ELSE 'function' END AS kind FROM lineitem""",
    "cb_manifests": """SELECT 'r' || CAST(o_custkey % z.n AS STRING) AS repo, CASE o_orderkey % 6 WHEN 0 THEN 'tools/t' || CAST(o_custkey % 40 AS STRING) WHEN 1 THEN 'packages/p' || CAST(o_custkey % 7 AS STRING) WHEN 2 THEN 'libs' WHEN 3 THEN 'deep/a/b1' WHEN 4 THEN 'libs/x1' ELSE 'apps/web' END
 || '/' || CASE o_custkey % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'setup.py' WHEN 2 THEN 'Cargo.toml' ELSE 'README.md' END AS path, '{}' AS text FROM orders CROSS JOIN cb_count z WHERE o_orderkey % 3 > 0
 UNION ALL SELECT 'r' || CAST(s_suppkey AS STRING), CASE s_suppkey % 5 WHEN 0 THEN 'pnpm-workspace.yaml' WHEN 3 THEN 'Cargo.toml' WHEN 4 THEN 'go.work' ELSE 'package.json' END,
 replace(replace(CASE s_suppkey % 5 WHEN 0 THEN 'packages:|  - ~packages/*~|  - "apps/web"|other:|  - libs/*|' WHEN 1 THEN '{"workspaces": ["packages/*", 3, "libs/**"]}' WHEN 2 THEN '{"name": "x", "workspaces": {"packages": ["./apps/*/"]}}'
 WHEN 3 THEN '[package]|name = "x"|[workspace]|# members = ["no"]|members = [|  "libs/*", # a "note"|  ~deep/a/b0~,|]|[other]|members = ["tools/*"]' ELSE 'go 1.20||use (|  ./tools/t1|  ./deep/a/b1|)|use ./packages|' END, '|', chr(10)), '~', chr(39)) FROM supplier""",
}


def repositories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Their files (repo, path, kind), a row a symbol, and their manifests (repo, path, text)."""
    found = _made(spark, sf_dir, REPOSITORIES)
    return found["cb_sources"], found["cb_manifests"]


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views by name, without their prefix."""
    found = _made(spark, sf_dir, SQL)
    return {name.removeprefix("cb_"): found[name] for name in SQL if name != "cb_size"}


def _made(spark: SparkSession, sf_dir: str, queries: dict[str, str]) -> dict[str, DataFrame]:
    found = {name: table(spark, sf_dir, name) for name in ("part", "lineitem", "orders", "customer", "supplier")}
    for name, sql in queries.items():
        used = {other: df for other, df in found.items() if re.search(rf"\b{other}\b", sql)}
        sql = sql.replace("{", "{{").replace("}", "}}")
        for other in used:
            sql = re.sub(rf"\b{other}\b(?!\.)", f"{{{other}}}", sql)
        made = spark.sql(sql, **used)
        found[name] = shuffled(made) if name == "cb_nodes" else made
    return found


def with_views(body: str, **more: str) -> str:
    """An oracle: all views, further ones, and a query over them."""
    kept = lambda name, sql: "" if name in sql.split() else "MATERIALIZED "  # noqa: E731  not what refers to itself
    return "WITH RECURSIVE " + ", ".join(f"{name} AS {kept(name, sql)}({sql})" for name, sql in (SQL | REPOSITORIES | more).items()) + f" {body}"


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path, line_no, line: a source file for each part, in three languages by turns, with blocks whose length is the
    part's size modulo 5."""
    k, n = F.col("p_partkey").cast("string"), F.expr("p_size % 5")
    text = lambda line: F.concat(*[x for i, part in enumerate(line.split("@")) for x in ([k] if i else []) + [F.lit(part)]])
    block = lambda *lines: F.array(*map(text, lines))
    rust = F.concat(
        block("/// Doc of S@.", "#[derive(Debug)]", "pub struct S@ {", "    x: i32, // }", "}", "", "impl T for S@ {", "    pub fn get@(", "        &self,", "    ) -> i32 {"), F.array_repeat(F.lit('        let a = "}";'), n),
        block("    }", "}", "const C@: i32 = 2;", "fn one@() { 1 }"),
    )
    python = F.concat(block("class A@(B@, object):", '    """Doc of A@."""', "", "    def get@(self):"), F.array_repeat(F.lit("        x = 1"), n), block("        return x", "", "def top@():", "    pass", ""))
    script = F.concat(block("export class A@ extends B implements C, D {", "  get@(x: number): number {"), F.array_repeat(F.lit("    if (x) { y(); }"), n), block("  }", "}", "export const go@ = async (x) => {", "};", "type T@ = string;"))
    turn = F.col("p_partkey") % 3
    path = F.concat(F.lit("f"), k, F.when(turn == 0, ".rs").when(turn == 1, ".py").otherwise(".ts"))
    lines = F.when(turn == 0, rust).when(turn == 1, python).otherwise(script)
    return table(spark, sf_dir, "part").select(path.alias("file_path"), F.posexplode(lines).alias("n", "line")).select("file_path", (F.col("n") + 1).alias("line_no"), "line")
