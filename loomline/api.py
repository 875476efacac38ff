"""One object over the tables of a code base, its tools by name, and a line protocol that serves them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph as G
from .operators import render
from .operators import retrieval as R


@dataclass
class Workspace:
    """symbols (id, name, kind, file_path, line_start, line_end), edges (source, target, type) and lines (file_path,
    line_no, line) of a code base, and its cards (file_path, card) if there are any."""

    symbols: DataFrame
    edges: DataFrame
    lines: DataFrame
    cards: DataFrame | None = None

    def ask(self, question: str, n: int = 10) -> DataFrame:
        """Symbols that best answer a question, by name and path."""
        docs = self.symbols.select("id", "name", F.col("file_path").alias("path"))
        terms = sorted({t for word in question.split() for t in (word.lower().strip("?.,!:;"),) if t})
        found = R.top(R.bm25(R.postings(docs), terms), n).withColumnRenamed("doc_id", "id")
        return found.join(self.symbols, "id").orderBy(F.desc("score"), "id")

    def skeleton(self, path: str) -> DataFrame:
        return R.skeleton(self.symbols.where(F.col("file_path") == path))

    def grep(self, pattern: str, per_file: int = 25, most: int = 200) -> DataFrame:
        """Matching lines with the symbols around them."""
        return G.enclosing(R.grep(self.lines, pattern, per_file, most).drop("rank"), self.symbols).orderBy("file_path", "line_no")

    def map(self, hubs: int = 10) -> DataFrame:
        """Directories with their files, symbols and most frequent kind, and the nodes most depended on."""
        parts = G.directories(self.symbols).select(F.lit("directory").alias("what"), F.col("directory").alias("name"), F.col("symbols").alias("n"))
        return parts.unionByName(G.hubs(self.edges, hubs).select(F.lit("hub").alias("what"), F.col("id").alias("name"), F.col("inbound").alias("n"))).orderBy("what", F.desc("n"), "name")

    def relations(self, name: str, direction: str = "in", types: list[str] | None = None) -> DataFrame:
        return G.related(self.edges, self.symbols, self.symbols.where(F.col("name") == name), direction, types).orderBy("of", "id", "type")

    def check(self) -> DataFrame:
        """Cards that are stale, missing or without a file."""
        files = G.file_edges(self.edges, self.symbols)
        old = self.cards if self.cards is not None else self.symbols.sparkSession.createDataFrame([], "file_path string, card string")
        now = render.cards(self.symbols, files, old)
        missing = now.join(old.select("file_path"), "file_path", "left_anti").select("file_path", F.lit("missing").alias("state"))
        stale = now.join(old.select("file_path"), "file_path", "left_semi").where("status = 'written'").select("file_path", F.lit("stale").alias("state"))
        return missing.unionByName(stale).unionByName(render.orphans(old, now).select("file_path", F.lit("removed").alias("state"))).orderBy("file_path")

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        return {name: getattr(self, name) for name in ("ask", "skeleton", "grep", "map", "relations", "check")}


#: Numbers of errors in the line protocol. Fixed values.
BROKEN, UNKNOWN, FAILED = -32700, -32601, -32000


def serve(lines: Iterable[str], tools: dict[str, Callable[..., DataFrame]], most: int = 200) -> Iterator[str]:
    """Answers of a JSON-RPC conversation, a line each: tools/list, tools/call, and shutdown or exit to end it.
    Notifications and blank lines get no answer; a broken line gets one without a number."""
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            method, number = request["method"], request.get("id")
        except (ValueError, TypeError, KeyError):
            yield json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": BROKEN, "message": "not a request"}})
            continue
        result, error = None, None
        if method == "tools/list":
            result = {"tools": [{"name": name, "description": (f.__doc__ or "").strip().split("\n")[0]} for name, f in tools.items()]}
        elif method == "tools/call":
            asked = request.get("params") or {}
            try:
                rows = tools[asked["name"]](**asked.get("arguments", {})).limit(most).collect()
                result = {"rows": [r.asDict(recursive=True) for r in rows]}
            except KeyError:
                error = {"code": UNKNOWN, "message": "no such tool"}
            except Exception as e:  # noqa: BLE001  a failed call must not end the conversation
                error = {"code": FAILED, "message": str(e).split("\n")[0]}
        elif method in ("shutdown", "exit"):
            result = {}
        elif method != "initialize":
            error = {"code": UNKNOWN, "message": f"no method {method}"}
        else:
            result = {"capabilities": {"tools": {}}}
        if number is not None:
            yield json.dumps({"jsonrpc": "2.0", "id": number} | ({"error": error} if error else {"result": result}), default=str)
        if method in ("shutdown", "exit"):
            return
