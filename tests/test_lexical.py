"""The code scan on files whose layout differs: comments, strings and calls over several lines, bodies that aren't indented, four languages."""

import pytest

from graphloom.sources import extract

FILES = {
    "src/a.ts": """/* function gone() {
   fetch('/no')
*/
import {
  one,
  two
} from './b'
import type { T } from "lib-t" // import x from 'no'
const s = "function nope() { call('x') }"
export default async function main(
  a: number,
  { b, c }: T,
) {
helper(`select * from
  orders where x = ${a}`)
app.get(prefix,
  '/items', (req) => {
    fetch(
      'https://h.example/stock',
      { method: 'POST' },
    )
})
}
class Box<T> extends Base<T> implements Shape,
  geo.Sized {
  constructor(private x: T) { super(x) }
  async put(
    item: T,
  ): Promise<void> {
    if (item) { helper(item) }
    bus.emit('box.put'); const y = new Thing(item)
  }
  get size() { return 1 }
}
interface Shape { area(): number }
declare function sign(): void;
function* helper(v) { return v }
it("isn't fooled by 'quotes'", () => { })
""",
    "src/b.js": "function one() {\nreturn two( /* '/x' */ 'a')\n}\nfunction two(q) { return q }\n// function three() {}\nvar o = { four() { one() } }\n",
    "app/c.py": '''"""Docs: from nowhere, def fake():
def fake(): pass
"""
import os.path, sys
from .d import thing
@app.post("/py")
def outer(a,
          b="def x():"):
    text = """
insert into audit values (1)
"""
    def inner():
        requests.get(
            "/remote")
        return outer(1)

    # def hidden():
    return inner()


class Model:
  def save(self): return self.load(
  1)
  def load(self, n):
      return n
print(Model())
''',
    "src/D.java": """package p;
import static java.util.List.of;
/** class Fake { void no() {} } */
public interface Payer {
  void pay(int n);
}
public class Till implements Payer, java.io.Closeable {
  private final String q = "update tills set x = 1";
  public Till(int a) { this.a = a; }
  @Override
  public void pay(int n) throws IOException {
    count(n); new Till(2);
  }
  int count(int n) {
  return n; }
}
""",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(None, p, c) for p, c in FILES.items()]
    got = extract.parse(spark.createDataFrame(rows, "repo string, path string, content string"))
    return {"nodes": got.nodes.collect(), "edges": got.edges.collect(), "unresolved": got.unresolved.collect(), "chunks": {r.id: r.text for r in got.chunks.collect()}}


def test_symbols_and_their_lines(parsed):
    got = {r.id: (r.kind, r.start_line, r.end_line) for r in parsed["nodes"] if r.kind in ("Function", "Method", "Class", "Interface")}
    a, b, c, d = "src/a.ts:", "src/b.js:", "app/c.py:", "src/D.java:"
    assert got == {
        f"fn:{a}main": ("Function", 10, 23), f"cls:{a}Box": ("Class", 24, 34), f"fn:{a}constructor": ("Method", 26, 26), f"fn:{a}put": ("Method", 27, 32), f"fn:{a}size": ("Method", 33, 33), f"iface:{a}Shape": ("Interface", 35, 35), f"fn:{a}helper": ("Function", 37, 37),
        f"fn:{b}one": ("Function", 1, 3), f"fn:{b}two": ("Function", 4, 4), f"fn:{b}four": ("Method", 6, 6),
        f"fn:{c}outer": ("Function", 7, 18), f"fn:{c}inner": ("Function", 12, 15), f"cls:{c}Model": ("Class", 21, 25), f"fn:{c}save": ("Function", 22, 23), f"fn:{c}load": ("Function", 24, 25),
        f"iface:{d}Payer": ("Interface", 4, 6), f"fn:{d}pay": ("Method", 5, 5), f"cls:{d}Till": ("Class", 7, 16), f"fn:{d}Till": ("Method", 9, 9), f"fn:{d}count": ("Method", 14, 15),
    }
    assert parsed["chunks"][f"chunk:fn:{b}one"] == "function one() {\nreturn two( /* '/x' */ 'a')\n}"


def test_edges(parsed):
    got = {(r.type, r.from_id, r.to_id, r.line) for r in parsed["edges"] if r.type not in ("CONTAINS",)}
    a, b, c, d = "fn:src/a.ts:", "fn:src/b.js:", "fn:app/c.py:", "fn:src/D.java:"
    assert got == {
        ("CALLS", a + "main", a + "helper", 14), ("CALLS", a + "put", a + "helper", 30), ("READS", a + "main", "table:orders", 14), ("EXPOSES", a + "main", "api:GET:/items", 16), ("CONSUMES", a + "main", "api:GET:/items", 16),
        ("CONSUMES", a + "main", "api:GET:/stock", 18), ("PUBLISHES", a + "put", "event:box.put", 31), ("IMPLEMENTS", "cls:src/a.ts:Box", "iface:src/a.ts:Shape", 24),
        ("IMPORTS", "file:src/a.ts", "file:src/b.ts", 4), ("IMPORTS", "file:src/a.ts", "ext:lib-t", 8),
        ("CALLS", b + "one", b + "two", 2), ("CALLS", b + "four", b + "one", 6),
        ("CALLS", c + "outer", c + "inner", 18), ("CALLS", c + "inner", c + "outer", 15), ("CALLS", c + "save", c + "load", 22), ("WRITES", c + "outer", "table:audit", 9), ("EXPOSES", c + "outer", "api:POST:/py", 6), ("CONSUMES", c + "inner", "api:GET:/remote", 13), ("EXPOSES", c + "inner", "api:GET:/remote", 13),
        ("IMPORTS", "file:app/c.py", "ext:os.path", 4), ("IMPORTS", "file:app/c.py", "ext:d", 5),
        ("CALLS", "cls:src/D.java:Till", d + "count", 12), ("WRITES", "cls:src/D.java:Till", "table:tills", 8), ("IMPLEMENTS", "cls:src/D.java:Till", "iface:src/D.java:Payer", 7), ("IMPORTS", "file:src/D.java", "ext:java.util.List.of", 2),
    }


def test_calls_left_for_the_workspace(parsed):
    got = {(r.type, r.from_id, r.callee) for r in parsed["unresolved"]}
    assert not any(x[2] in ("call", "nope", "gone", "Thing", "no", "fake", "hidden") for x in got)
    assert {x for x in got if x[1].startswith("fn:src/b")} == set()
