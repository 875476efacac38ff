"""Findings and their report see the whole text of every document."""

import re
from collections import Counter

from loomline.operators import privacy
from loomline.plans import registry

FAR = "word " * 40
TEXTS = [f"{FAR}write to ann@mail.example.org or https://a.example.org/x?m=b@c.example.org now", f"{FAR}paid $1,200.50 from 10.1.2.3", "call +44 20 7946 0958", "a@b.example.org", "", None, "nothing"]


def find(text):
    """Findings of a text by start, rank and length."""
    out = []
    for kind, (pattern, _) in (privacy.PATTERNS | privacy.SECRETS).items():
        for m in re.finditer(pattern, text or ""):
            if kind != "IP" or m[0] not in privacy.LOCAL and not m[0].startswith(privacy.LOCAL_PREFIX):
                out.append({"kind": kind, "value": m[0], "start": m.start(), "end": m.end()})
    return sorted(out, key=lambda f: (f["start"], -privacy.PRIORITY.get(f["kind"], 1), f["start"] - f["end"]))


def brute(text):
    kept = []
    for f in find(text):
        if not kept or f["start"] >= kept[-1]["end"]:
            kept.append(f)
    return kept


def test_whole_texts_are_scanned(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, f["kind"], f["value"], f["start"], f["end"]) for i, t in enumerate(TEXTS) for f in brute(t)}
    rows = registry.QUERIES["M3_findings"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.kind, r.value, r.start, r.end) for r in rows} == want and len(rows) == len(want)
    assert {(0, "EMAIL", "ann@mail.example.org"), (0, "URL", "https://a.example.org/x?m=b@c.example.org"), (1, "MONEY", "$1,200.50"), (1, "IP", "10.1.2.3"), (3, "EMAIL", "a@b.example.org")} <= {w[:3] for w in want}
    report = registry.QUERIES["M8_report"](spark, str(tmp_path)).collect()
    assert {r.kind: r.n for r in report} == Counter(w[1] for w in want)
