"""The lexer on files whose right answer is known, and the plug-in that falls back file by file."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, extract, lexer, structure

SOURCE = """/* class Fake {} */
import {
  a as b,
  type C
} from
  "./multi";
import "./side"
import type D from '../d';
export { helper } from "./helper";
export * as ns from './star'
const s = "import x from 'no'", r = /["'`{]/.test(s), { u, v } = s, w: Map<string, number> = new Map<string, Set<number>>()
export const q = `a ${ [1, {b: `class X {} ${1}`}] } function no() {}`, z = <T, U>(x: T) => { return require('./inner') }
export default async function* run() { function nested() {} }
@Component({ a: 1 }) export class Service extends Base<{a: 1}> { m() { class Inner {} } }
export const enum E { A }
interface I { a: string }
export type N = string | Map<string, number>
let type = 3
function ret(): { a: number } { return {a: 1} }
const lib = require("./lib"), x2 = y.require("./no"), d = a / b / c
var one = 1, two = foo<A, B, C>(1);
const f2 = function named() {}, k2 = class Q {}
export default {}
const dyn = import("./dyn"), both = require("./a" + b)
"""


def test_lexer_on_a_module():
    got = lexer.graph("a.ts", SOURCE)
    want = "s const 11 -,r const 11 -,w const 11 -,q const 12 e,z const 12 e,run function 13 e,Service class 14 e,E enum 15 e,I interface 16 -,N type 17 e,type variable 18 -,ret function 19 -,lib const 20 -,x2 const 20 -,d const 20 -,one variable 21 -,two variable 21 -,f2 const 22 -,k2 const 22 -,dyn const 24 -,both const 24 -"
    assert ",".join(f"{s.name} {s.kind} {s.line} {'e' if s.exported else '-'}" for s in got.symbols) == want
    assert got.dependencies == [("./multi", 6), ("./side", 7), ("../d", 8), ("./helper", 9), ("./star", 10), ("./inner", 12), ("./lib", 20)]
    signature = {s.name: s.signature for s in got.symbols}
    assert signature["Service"] == "class Service extends Base<{a: 1}> { m() { class Inner {} } }" and signature["N"] == "type N = string | Map<string, number>"
    assert signature["ret"] == "function ret(): { a: number } { return {a: 1} }"


@pytest.mark.parametrize("text", ['"abc\n', "f(", "/* a", "`a ${", "a)", "(]", "'"])
def test_lexer_refuses(text):
    with pytest.raises(lexer.Malformed):
        lexer.graph("a.ts", text)


def test_lexer_agrees_with_patterns_on_plain_files(spark):
    """One declaration or import a line, nothing nested: both ways read the same."""
    kinds = ["export function f{i}() {}", "class C{i} {}", "export interface I{i} { a: string }", "type T{i} = string;", "enum E{i} { A }", "export const c{i} = () => 1;", "let v{i} = 2;", "import x{i} from './m{i}';", "export { y{i} } from \"../n{i}\";", "const r{i} = require('./r{i}');"]
    rows = [(f"f{k}.ts", "\n".join(kinds[(i * (k + 1) + k) % 10].replace("{i}", str(i)) for i in range(k + 3))) for k in range(12)] + [("empty.ts", ""), ("none.ts", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    found = extract.extracted(files, "lexer")
    pick = lambda df: sorted(map(tuple, df.select("path", "name", "kind", "line", "exported").collect()))
    assert pick(extract.symbols(found)) == pick(structure.symbols(files)) and found.where("reason IS NOT NULL").count() == 0
    assert sorted(map(tuple, extract.dependencies(found).collect())) == sorted(map(tuple, structure.dependencies(files).collect()))


def test_a_failing_extractor_loses_no_file(spark):
    def graph(path, text):
        if "boom" in text:
            raise RuntimeError("boom")
        return lexer.Graph([lexer.Symbol("own", "class", 1, "own", True)], [("own-dep", 1)])

    extract.register(extract.Extractor("frail", lambda p: p.endswith(".ts"), graph, 30))
    try:
        rows = [("a.ts", "class A {}"), ("b.ts", "class B {} // boom"), ("c.py", "def c(): pass\nimport os"), ("d.ts", "class D {}" + " " * 40), ("a.ts", "class A {}"), (None, "class N {}"), ("e.ts", None)]
        files = spark.createDataFrame(rows, "path string, text string").withColumn("reason", F.lit("a clashing column"))
        found = extract.extracted(files, "frail")
        assert {r.reason: r.files for r in extract.reasons(found).collect()} == {None: 3, extract.FAILED: 1, extract.LANGUAGE: 2, extract.LARGE: 1}
        assert sorted((r.path or "", r.name) for r in extract.symbols(found).collect()) == [("", "N"), ("a.ts", "own"), ("a.ts", "own"), ("b.ts", "B"), ("c.py", "c"), ("d.ts", "D"), ("e.ts", "own")]
        assert sorted((r.path, r.specifier) for r in extract.dependencies(found).collect()) == [("a.ts", "own-dep"), ("a.ts", "own-dep"), ("c.py", "os"), ("e.ts", "own-dep")]
        for name, reason in ((extract.PATTERNS, None), ("unknown", extract.MISSING)):
            other = extract.extracted(files, name)
            assert {r.reason for r in other.collect()} == {reason}
            assert sorted((r.path or "", r.name) for r in extract.symbols(other).collect()) == sorted((r.path or "", r.name) for r in structure.symbols(files).collect())
        assert extract.symbols(extract.extracted(files.limit(0), "frail")).count() == 0
    finally:
        del extract.EXTRACTORS["frail"]
    for name in ("", extract.PATTERNS):
        with pytest.raises(ValueError):
            extract.register(extract.Extractor(name, bool, graph))


def test_chunks_at_declarations(spark):
    text = "// head\n\n" + "".join(f"export function f{i}() {{\n  return {'1 + ' * i}1;\n}}\n" for i in range(12)) + f"const long = `{'x y\n' * 60}`;\n" + "class Last {}"
    files = spark.createDataFrame([("a.ts", text), ("a.md", text), ("e.ts", ""), ("n.ts", None)], "path string, text string")
    limits = chunking.Limits(target=120, overlap=0, most=None)
    rows = extract.chunk_files(files, "lexer", limits).orderBy("path", "ordinal").collect()
    mine = [r for r in rows if r.path == "a.ts"]
    assert "".join(r.text for r in mine) == text and all(r.reason is None for r in mine)
    lines = text.split("\n")
    for r in mine:  # each starts where it says, and no declaration that fits is cut
        assert lines[r.start_line - 1].startswith(r.text.split("\n")[0]) or "x y" in r.text
        assert r.text.startswith(("// head", "export function", "const long", "class Last")) or "x y" in r.text
    assert [(r.start_line, r.end_line, r.text) for r in rows if r.path == "a.md"] == list(chunking.chunks(text, limits))
    assert [(r.start_line, r.end_line, r.text) for r in rows if r.path in ("e.ts", "n.ts")] == [(1, 1, "")] * 2
