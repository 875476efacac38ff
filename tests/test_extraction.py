"""Symbols of small sources in several languages: spans, parents, documentation and bases."""

import pytest

from loomline.operators import extraction as E

RUST = '''use std::fmt;

/// A cache.
/// Keeps things.
#[derive(Debug)]
pub struct Cache {
    x: i32, // }
}

impl fmt::Display for Cache {
    fn fmt(&self, f: &mut F) -> R {
        let a = "}";
        if a { b() } else {
            c();
        }
    }

    /// Long head.
    pub(crate) async fn load(
        &self,
        b: i32,
    ) -> i32
    {
        1
    }
}

trait T { fn one(&self); }
pub const LIMIT: i32 = 5;
fn one() { 1 }
struct Unit;
mod tests {
    fn one() {}
}
'''
PYTHON = '''import os


class Cache(Base, metaclass=M):
    """Keeps things."""

    def read(self, key):
        if key:
            return 1

# a note at the edge
        return 2

    async def load(self):
        def inner():
            pass
        return inner


def top(
    a,
    b,
):
    \'\'\'Does it.\'\'\'
    return a


class Empty(object): pass
x = 1
'''
TS = '''import { a } from './a';
export class Cache extends Base implements Storable, Other {
  constructor(x: number) {
    if (x) { y(); }
  }

  async load(key: string): Promise<void> {
    const f = () => {
      return `}`;
    };
  }
}
interface Storable { get(): void }
export type Key = string;
type Shape = {
  x: number;
};
export const go = async (k: Key) => {
  return k;
};
function last()
{
}
'''
GO = "package m\n\n// Cache holds.\ntype Cache struct {\n\tx int\n}\n\nfunc (c *Cache) Read() int {\n\treturn 1\n}\ntype K int\nfunc main() {\n"
RUBY = "module M\n  class A < B\n    def read?\n      if x\n        1\n      end\n    end\n  end\nend\n"
JAVA = "public final class A extends B implements C {\n  public int get(int x) {\n    return x;\n  }\n  enum E { X }\n}\n"

WANT = {
    "a.rs": {
        "Cache": ("struct", 6, 8, None, "A cache. Keeps things.", []), "Cache~2": ("impl", 10, 26, None, "", ["fmt::Display"]), "fmt": ("method", 11, 16, "Cache~2", "", []), "load": ("method", 19, 25, "Cache~2", "Long head.", []),
        "T": ("trait", 28, 28, None, "", []), "LIMIT": ("constant", 29, 29, None, "", []), "one": ("function", 30, 30, None, "", []), "Unit": ("struct", 31, 31, None, "", []), "tests": ("module", 32, 34, None, "", []), "one~2": ("function", 33, 33, "tests", "", []),
    },
    "a.py": {
        "Cache": ("class", 4, 17, None, "Keeps things.", ["Base", ]), "read": ("method", 7, 12, "Cache", "", []), "load": ("method", 14, 17, "Cache", "", []), "inner": ("function", 15, 16, "load", "", []),
        "top": ("function", 20, 25, None, "", []), "Empty": ("class", 28, 28, None, "", []),
    },
    "a.ts": {
        "Cache": ("class", 2, 12, None, "", ["Base", "Storable", "Other"]), "constructor": ("method", 3, 5, "Cache", "", []), "load": ("method", 7, 11, "Cache", "", []), "f": ("function", 8, 10, "load", "", []), "Storable": ("interface", 13, 13, None, "", []),
        "Key": ("type", 14, 14, None, "", []), "Shape": ("type", 15, 17, None, "", []), "go": ("function", 18, 20, None, "", []), "last": ("function", 21, 23, None, "", []),
    },
    "a.go": {"Cache": ("struct", 4, 6, None, "", []), "Read": ("method", 8, 10, None, "", []), "K": ("type", 11, 11, None, "", []), "main": ("function", 12, 12, None, "", [])},
    "a.rb": {"M": ("module", 1, 9, None, "", []), "A": ("class", 2, 8, "M", "", ["B"]), "read?": ("method", 3, 7, "A", "", [])},
    "A.java": {"A": ("class", 1, 6, None, "", ["B", "C"]), "E": ("enum", 5, 5, "A", "", [])},
    "notes.txt": {},
    "empty.py": {},
}


@pytest.fixture(scope="module")
def found(spark):
    sources = {"a.rs": RUST, "a.py": PYTHON, "a.ts": TS, "a.go": GO, "a.rb": RUBY, "A.java": JAVA, "notes.txt": "def x():\n  pass\n", "empty.py": ""}
    rows = [(p, i, line) for p, text in sources.items() for i, line in enumerate(text.split("\n"), 1)] + [("a.py", 999, None)]
    df = spark.createDataFrame(rows, "file_path string, line_no int, line string").repartition(3)
    out = {p: {} for p in sources}
    for r in E.extract(df).collect():
        out[r.file_path][r.id.split("::", 1)[1]] = r
    return out


@pytest.mark.parametrize("path", sorted(WANT))
def test_symbols(found, path):
    short = lambda i: i and i.split("::", 1)[1]
    got = {k: (r.kind, r.line_start, r.line_end, short(r.parent), r.doc, r.bases) for k, r in found[path].items()}
    assert got == WANT[path]


def test_signatures(found):
    assert found["a.rs"]["fmt"].signature == "fn fmt(&self, f: &mut F) -> R" and found["a.py"]["Cache"].signature == "class Cache(Base, metaclass=M)"
