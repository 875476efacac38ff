"""Shell command lines: tokens, words, chains and rewriting. These depend on order, so they run in Python by Arrow batch."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = "array<struct<kind:string,value:string,offset:int>>"
_REDIRECT = re.compile(rb"\d*(?:&>>|&>|>>|<<|>&\d|>|<)")
_SHELLISM = frozenset(bytes([c]) for c in b"*?(){}!`&")
#: What can't begin anything but an argument, and what can go on with one (digits may begin a redirect).
_PLAIN, _MORE = re.compile(rb"[^\s\\'\"&|;<>$*?(){}!`0-9]+"), re.compile(rb"[^\s\\'\"&|;<>$*?(){}!`]+")


def tokens(line: str | None) -> list[dict]:
    """Tokens with byte offsets. Quotes and backslashes stay in arguments; an open quote takes the rest."""
    data = (line or "").encode()
    out: list[dict] = []
    word, start, i = bytearray(), 0, 0

    def close() -> None:
        if word:
            out.append({"kind": "Arg", "value": word.decode(errors="replace"), "offset": start})
            word.clear()

    def emit(kind: str, value: bytes, at: int) -> None:
        close()
        out.append({"kind": kind, "value": value.decode(errors="replace"), "offset": at})

    while i < len(data):
        if m := (_MORE if word else _PLAIN).match(data, i):
            start = start if word else i
            word += m[0]
            i = m.end()
            continue
        c = data[i : i + 1]
        begin = start if word else i
        if c == b"\\":
            word += data[i : i + 2]
            i, start = i + 2, begin
        elif c in (b"'", b'"'):
            j = i + 1
            while j < len(data) and data[j : j + 1] != c:
                j += 2 if c == b'"' and data[j : j + 1] == b"\\" else 1
            word += data[i : j + 1]
            i, start = j + 1, begin
        elif c.isspace():
            close()
            i += 1
        elif data[i : i + 2] in (b"&&", b"||"):
            emit("Operator", data[i : i + 2], i)
            i += 2
        elif c == b";":
            emit("Operator", c, i)
            i += 1
        elif (m := _REDIRECT.match(data, i)) and (not word or not m[0][:1].isdigit()):
            emit("Redirect", m[0], i)
            i = m.end()
        elif c == b"|":
            emit("Pipe", c, i)
            i += 1
        elif c in _SHELLISM:
            emit("Shellism", c, i)
            i += 1
        elif c == b"$" and not re.match(rb"[A-Za-z_]", data[i + 1 : i + 2]):
            emit("Shellism", c, i)
            i += 1
        else:
            word += c
            i, start = i + 1, begin
    close()
    return out


def words(line: str | None) -> list[str]:
    """Words split at spaces and tabs, without quotes; a backslash takes the next character, but not in single quotes."""
    out, word, quote, some, escaped = [], "", "", False, False
    for c in line or "":
        if escaped:
            word, escaped = word + c, False
        elif c == "\\" and quote != "'":
            escaped = some = True
        elif quote:
            if c == quote:
                quote = ""
            else:
                word += c
        elif c in "'\"":
            quote, some = c, True
        elif c in " \t":
            if word or some:
                out.append(word)
            word, some = "", False
        else:
            word += c
    return out + [word] if word or some else out


def chain(line: str | None) -> list[str]:
    """The commands of a line joined by && || and ;, up to the first pipe; heredocs and arithmetic stay whole."""
    text = line or ""
    if "<<" in text or "$((" in text:
        return [text.strip()] if text.strip() else []
    data, out, at = text.encode(), [], 0
    for t in tokens(text):
        if t["kind"] in ("Operator", "Pipe"):
            out.append(data[at : t["offset"]].decode(errors="replace").strip())
            at = t["offset"] + len(t["value"].encode())
        if t["kind"] == "Pipe":
            return [c for c in out if c]
    return [c for c in [*out, data[at:].decode(errors="replace").strip()] if c]


def rewritten(line: str | None, prefixes: dict[str, str], excluded: tuple[str, ...] = ()) -> str | None:
    """The line with each command of a chain that begins with a known prefix under its replacement; null if none does."""
    text = line or ""
    if "<<" in text or "$((" in text:
        return None
    data, pieces, at, changed = text.encode(), [], 0, False

    def one(part: str) -> str:
        nonlocal changed
        bare = part.strip()
        for prefix, by in prefixes.items():
            if (bare == prefix or bare.startswith(f"{prefix} ")) and bare.split(" ", 1)[0] not in excluded:
                changed = True
                return part.replace(prefix, by, 1)
        return part

    piped = False
    for t in tokens(text):
        if t["kind"] in ("Operator", "Pipe"):
            part = data[at : t["offset"]].decode(errors="replace")
            pieces += [part if piped else one(part), t["value"]]
            at, piped = t["offset"] + len(t["value"].encode()), t["kind"] == "Pipe"
    part = data[at:].decode(errors="replace")
    pieces.append(part if piped else one(part))
    return "".join(pieces) if changed else None


def _udf(f, kind: str):
    def applied(values: pd.Series) -> pd.Series:
        return values.map(f)

    return F.pandas_udf(applied, kind)


def lex(line: Column | str) -> Column:
    return _udf(tokens, TOKENS)(line)


def split_words(line: Column | str) -> Column:
    return _udf(words, "array<string>")(line)


def split_chain(line: Column | str) -> Column:
    return _udf(chain, "array<string>")(line)


def rewrite(line: Column | str, prefixes: dict[str, str], excluded: tuple[str, ...] = ()) -> Column:
    return _udf(lambda x: rewritten(x, prefixes, excluded), "string")(line)
