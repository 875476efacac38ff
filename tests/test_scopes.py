"""Scopes of repositories by their layout, manifests and workspaces, and retrieval by scope."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import retrieval as Q
from loomline.operators import scopes as S

#: Case: (source files, manifests, prefixes of the scopes).
CASES = {
    "plain": (["src/a.ts", "main.py"], {"package.json": "{}"}, [""]),
    "markers": (["frontend/src/a.ts", "backend/b.py", "docs/x.py"], {"frontend/package.json": "{}", "backend/pyproject.toml": "", "docs/readme.md": ""}, ["", "backend", "frontend"]),
    "depth": (["a/b/c/d.ts", "a/b/x.ts"], {"a/b/c/package.json": "{}"}, [""]),
    "nested": (["web/api/x.ts", "web/y.ts"], {"web/package.json": "{}", "web/api/package.json": "{}"}, ["", "web"]),
    "member of an outer marker": (["web/api/x.ts", "web/y.ts"], {"web/package.json": "{}", "package.json": '{"workspaces": ["web/*"]}'}, ["", "web", "web/api"]),
    "deep members": (["a/b/c/d/e.ts", "a/b/x.ts"], {"package.json": '{"workspaces": ["a/b/c/*"]}'}, ["", "a/b/c/d"]),
    "two stars": (["libs/a/b/c.ts"], {"package.json": '{"workspaces": ["libs/**"]}'}, ["", "libs/a"]),
    "all": (["x/y/a.ts", "z/b.ts"], {"package.json": '{"workspaces": ["*"]}'}, ["", "x", "z"]),
    "yaml": (["p/a/x.ts", "p/b/x.ts", "q/x.ts"], {"pnpm-workspace.yaml": "packages:\n  - 'p/*'\n  - \"!p/b/**\"\nx: 1\n  - q\n"}, ["", "p/a", "p/b"]),
    "yaml without end": (["q/x.ts"], {"pnpm-workspace.yaml": "name: x\n  - no\npackages:\n- q\n"}, ["", "q"]),
    "toml": (["crates/a/x.rs", "tool/x.rs"], {"Cargo.toml": "[package]\nmembers = ['tool']\n[workspace] \nresolver = '2'\nmembers = ['crates/*', \"gone\"]\n"}, ["", "crates/a"]),
    "go": (["svc/a.go", "lib/b.go", "x/c.go"], {"go.work": "go 1.21\nuse ./svc\nuse (\n\t\"./lib\"\n\t.\n)\n"}, ["", "lib", "svc"]),
    "broken": (["a/x.ts"], {"package.json": "{", "Cargo.toml": "", "go.work": "use", "pnpm-workspace.yaml": ""}, [""]),
    "object": (["a/x.ts"], {"package.json": '{"workspaces": {"packages": ["./a/", 7, null]}}'}, ["", "a"]),
    "exotic": (["a/x.ts"], {"package.json": '{"workspaces": ["a*", "**/a", "{a,b}"]}'}, [""]),
}


@pytest.fixture(scope="module")
def found(spark):
    sources = spark.createDataFrame([(c, p) for c, (files, _, _) in CASES.items() for p in files], "repo string, path string")
    manifests = spark.createDataFrame([(c, p, t) for c, (_, m, _) in CASES.items() for p, t in m.items()], "repo string, path string, text string")
    return S.discover(sources, manifests)


def test_discovery(found):
    got = {}
    for r in found.collect():
        got.setdefault(r.repo, []).append(r.prefix)
    assert {c: sorted(p) for c, p in got.items()} == {c: want for c, (_, _, want) in CASES.items()}


def test_owners_and_substance(spark, found):
    scopes = spark.createDataFrame([("r", p, []) for p in ("", "frontend", "frontend/app", "tiny")], "repo string, prefix string, markers array<string>")
    paths = spark.createDataFrame([("r", p) for p in ("frontend/a.ts", "frontend-utils/main.ts", "frontend/app/b.ts", "frontend/app", "x.ts", "tiny/a.ts")] + [("other", "frontend/a.ts")], "repo string, path string")
    got = {(r.repo, r.path): r.scope for r in S.owners(paths, scopes).collect()}
    assert got == {("r", "frontend/a.ts"): "frontend", ("r", "frontend-utils/main.ts"): "", ("r", "frontend/app/b.ts"): "frontend/app", ("r", "frontend/app"): "frontend/app", ("r", "x.ts"): "", ("r", "tiny/a.ts"): "tiny", ("other", "frontend/a.ts"): ""}
    nodes = spark.createDataFrame([("r", "frontend/a.ts", "function")] * 5 + [("r", "tiny/a.ts", "function")] * 4 + [("r", "tiny/a.ts", "file")] * 3, "repo string, path string, kind string")
    assert {r.prefix for r in S.substantial(scopes, nodes).collect()} == {"", "frontend"}


@pytest.mark.parametrize(("given", "want"), [("./a/b/", "a/b"), ("a\\b", "a/b"), ("/a", "a"), ("././x", "x"), ("", "")])
def test_prefixes(spark, given, want):
    assert spark.range(1).select(S.normal_prefix(F.lit(given)).alias("v")).first()["v"] == want


def test_a_scope_takes_part_by_name_or_by_coverage(spark):
    rows = [("a1", "parseConfig", "a", ""), ("a2", "other", "a", ""), ("b1", "helper", "b", "parse the config of a file"), ("b2", "thing", "b", "x"), ("c1", "zzz", "c", "config"), ("c2", "yyy", "c", "w"), ("c3", "qqq", "c", "config")]
    docs = spark.createDataFrame(rows, "id string, name string, scope string, doc string")
    index, owners = Q.postings(docs.select("id", "name", "doc")), docs.select(F.col("id").alias("doc_id"), "scope")
    terms = ["parse", "config", "file"]
    figures = Q.scope_terms(index, owners, terms)
    gates = {r.scope: r for r in Q.participation(Q.scoped_bm25(index, owners, figures), index, figures, docs).collect()}
    assert gates["a"].best_doc == "a1" and gates["a"].share > 0.4 and gates["b"].share == 0 and gates["b"].coverage == 1.0
    assert gates["c"].best_doc == "c1" and gates["c"].coverage < 0.5
    hits, weak = Q.scoped_ask(index, owners, docs, terms, 10)
    assert {(r.doc_id, r.first_list) for r in hits.collect()} == {("a1", "a"), ("b1", "b")} and [r.scope for r in weak.collect()] == ["c"]
