import ast
import json
import random

import pytest

from siftwell.llm.syntax.grammars import LEX, accepts, diagnose, grammar, recognised
from siftwell.llm.syntax.lexers import lex_json
from siftwell.llm.syntax.machine import END, cheapest, repair, takes, walk
from siftwell.llm.syntax.spans import Spans

VALID = {
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\ntype I interface {\n\tM(a int) (b error)\n\t~int | string\n}\n\nfunc (t *T[K, V]) F(a, b int, c ...string) (n int, err error) {\n\tfor i, x := range c {\n\t\tif v, ok := m[x]; ok && v > 1 {\n\t\t\tcontinue\n\t\t} else if i == 2 {\n\t\t\tbreak\n\t\t}\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T[K, V]:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\tgo func() { ch <- 1 }()\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\ts := []map[string]T{{\"a\": {A: 1}}, nil}\n\tx := a[1:2:3]\n\tr := '\\''\nouter:\n\tfor {\n\t\tgoto outer\n\t}\n}\n",
        "package a\n\nvar f = func(x int) int { return x }(3)\nconst (\n\tA = iota\n\tB\n)\n",
    ],
    "js": [
        "const a = 1\nlet b = a\n++b\nfoo()\nvar x = /[/}]\"'/g, y = a / b / c\n",
        "export default class A extends B { static #p = 1; get x() { return `a${b ? `c${d}` : {e: 1}.e}` } async *g() { yield* h } static { f() } }\n",
        "import d, { e as f, g } from 'm'; for (const [k, v] of Object.entries(o)) if (k) { continue } else throw new E(`x`)\nconst fn = async ({a, ...b}, [c = 1]) => ({ a, [b]: c, d() {} })\nx?.y?.[0]?.(1) ?? z\nlabel: while (1) break label\n",
        "if (a) return_(b)\ndo x++; while (x < 5)\n!function(e){e.a=b}(c);a&&b({c:!0})\n", "",
    ],
    "ts": [
        "interface A<T extends B = C> extends D, E<T> { readonly a?: string; [k: string]: any; m<U>(x: U): x is string; new (a: number): A }\ntype U = { [K in keyof T]?: T[K] } | ((a: number) => void)[] | `a${string}`\nabstract class X<T> implements A { private readonly a: number = 1; constructor(private b?: string) { super(); } protected abstract f(): void; get v(): T { return this.a as unknown as T } }\nenum E { A = 1, B }\ndeclare module 'x' { }\nfunction f<T>(this: Window, a: T, ...r: string[]): asserts a is T { const g = <U,>(x: U): U => x!; return g<number>(1) satisfies number }\nlet z = <any>y; export type { Q } from './q'\n",
    ],
    "java": [
        "package a.b;\nimport static x.y.*;\n@Ann(a = 1, b = {\"x\"}) public final class A<T extends B & C> extends D<T> implements E, F<?> {\n  private static final int[] X = {1, 2}; int a = 1, b[];\n  static { x(); }\n  public <U> A(final int a, String... b) throws E { this.<U>f(a); }\n  enum K { P(1) { void f() {} }, Q; int z; }\n  record R(int a) { R { } }\n  int f(List<? extends Map<String, int[]>> l) { for (int i = 0, j = 1; i < 3; i++, j--) ; for (var x : l) { } int y = (int) z >> 2; Runnable r = () -> { }; F g = (a, b) -> a + b; x = A::new; y = c ? d : e -> f; List<String>[] q = new List[3]; switch (a) { case 1, 2 -> x(); default -> { } } switch (b) { case 1: break; default: } if (o instanceof String s && s.length() > 1) return switch (k) { case P -> 1; default -> 2; }; try (var r = x(); y) { } catch (A | B e) { } finally { } label: do { continue label; } while (true); String t = \"\"\"\n   a \"b\"\n   \"\"\"; return 'c' + 0x1FL; } }\n",
    ],
    "rs": [
        "#![allow(dead_code)]\nuse a::{b, c::*, d as e};\n#[derive(Debug)]\npub struct S<'a, T: Tr + ?Sized, const N: usize> where T: 'a { pub a: &'a mut [T; N], b: Box<dyn Fn(i32) -> i32 + 'a> }\nstruct U; struct V(pub i32, String);\nenum E { A(i32), B { x: u8 }, C = 3 }\nimpl<'a, T> S<'a, T> { const X: i32 = 1; pub async unsafe fn f(&mut self, (a, _): (i32, i32)) -> Result<Vec<Vec<T>>, E> where T: Copy { let x = if a < 1 { 2 } else { 3 }; let Some(y) = z else { return Err(E::A(1)) }; match x { 0 | 1 => {} 2..=5 if y > 1 => g(), E::B { x, .. } => (), ref n @ 3 => { } _ => unreachable!(\"{}\", 1), } for i in 0..n { v.push(i as u8 as char); } let c = move |a: i32, b| a + b; let s = S { a: 1, ..Default::default() }; loop { break 'o; } 'o: while let Some(q) = it.next() { continue 'o } let r = r#\"a\"b\"#; let t = &&x[1..]; x.0.1 += Vec::<i32>::new().iter().map(|x| x * 2).collect::<Vec<_>>()?; a >>= 2; unsafe { *p } } }\nmacro_rules! m { ($a:expr) => { $a }; }\nextern \"C\" { fn g(a: *const u8, ...) -> ::std::os::raw::c_int; }\ntrait Q: A + B { type T: C; fn d(self: Box<Self>) {} }\n",
    ],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"], "b": {}}', "3"],
    "py": ["def f(a, /, *, b: int = 1) -> str:\n    match a:\n        case [1, *x] if x:\n            return f'{b!r:>{1}}'\n    print(x := 1)\n", "type A[T] = list[T]\n", ""],
}
BROKEN = {
    "go": ["package a\n\nfunc f() {\n", "package a\n\nfucn f() {\n}\n", "package a\n\nfunc f() {\n\tx := g(1))\n}\n", "x := 1\n", "package a\n\nvar s = \"abc\n", "package a\n<<<<<<< HEAD\n=======\n>>>>>>> x\n", ""],
    "js": ["function f( {\n", "const x;\n", "var a = [1, 2\n", "cosnt a = 1\n", "let s = 'abc\n", "{\"a\": 1}\n", "id,name here,3\n", "const x: number = 1\n", "<!DOCTYPE html>\n", "foo(1));\n", "if (a) {\n}}\n"],
    "ts": ["const x: = 1\n", "interface A { a: string\n", "def f(a):\n  pass\n", "let a = `x${b`\n"],
    "java": ["class A { void f() { int x = ; } }", "class A {", "import os\nimport sys\n", "pubilc class A { }", "class A { String s = \"a; }"],
    "rs": ["fn f( {}", "fun f() {}", "fn f() { let x = 1 }}", "pub fn f() -> {}", "package a;"],
    "json": ["{'a': 1}", '{"a": 1,}', "{a: 1}", '{"a": 1} {"b": 2}', '{"a": NaN}', "// c\n{}", "", '{"a": "x'],
    "py": ["def f(:\n", "print 'x'\n", "if a:\nb\n", "dfe f():\n    pass\n", "x = (1\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert diagnose(language, text) == (0, "valid", [], True)


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken(language, text):
    cost, damage, lines, _ = diagnose(language, text)
    assert cost > 0 and damage != "valid" and lines


def test_kinds_of_damage():
    body = "package a\n\n" + "".join(f"func F{i}(a int) int {{\n\tif a > {i} {{\n\t\treturn a\n\t}}\n\treturn {i}\n}}\n\n" for i in range(8))
    assert diagnose("go", body)[0] == 0
    assert diagnose("go", body[: body.rindex("return 7")])[1] == "truncation"
    cost, damage, lines, _ = diagnose("go", body.replace("func F3", "fucn F3"))
    assert (cost, damage) == (1, "local") and lines == [body[: body.index("func F3")].count("\n") + 1]
    assert diagnose("go", body.replace("\treturn 3\n", "<<<<<<< ours\n\treturn 3\n=======\n\treturn 4\n>>>>>>> theirs\n"))[:2] == (3, "conflict")
    assert diagnose("go", "import os\nclass A:\n    def f(self):\n        pass\n" * 5)[1] == "mismatch"


def test_one_token_dropped_costs_one():
    text = "package a\n\nfunc f(a int) int {\n\treturn g(a, 1) + h(a)\n}\n"
    assert diagnose("go", text.replace("g(a, 1)", "g(a, 1"))[0] == 1
    assert accepts("js", "a = b\n(c)") and not accepts("js", "a b")


def least_edits(language, kinds, made, most):
    """The least cost by trying every edited text, ``most + 1`` where none of at most ``most`` edits does."""
    g = grammar(language)
    valid = lambda k: (lambda n, c: n == len(k) and c[END] is not g.dead)(*walk(g, list(k)))
    layer = {tuple(kinds)}
    for cost in range(most + 1):
        if any(map(valid, layer)):
            return cost
        if cost < most:
            layer = {e for k in layer for i in range(len(k) + 1) for e in ([k[:i] + (t,) + k[i:] for t in made] + ([k[:i] + k[i + 1 :]] + [k[:i] + (t,) + k[i + 1 :] for t in made] if i < len(k) else []))}
    return most + 1


def test_costs_are_the_least_of_all_edits():
    rng = random.Random(4)
    made = "{ } [ ] , : STR NUM".split()
    whole = lex_json('{"a": 1, "b": [1, {"c": 2}], "d": []}')[0]
    cases = [lex_json(t)[0] for t in ('{"a": 1, "b": [1, 2}', '{"a" 1,}', "[1, 2", "]", '{"a": [}', "1 2 3", "{,}", "")]
    for _ in range(40):
        k = whole[rng.randrange(8) :][: rng.randint(1, 7)]
        for _ in range(rng.randint(1, 2)):
            k[rng.randrange(len(k))] = rng.choice(made)
        cases.append(k)
    for kinds in cases:
        cost, edits, least = repair(grammar("json", "repair"), kinds)
        want = least_edits("json", kinds, made, 2)
        assert least and (cost == want or want == 3 <= cost) and len(edits) == cost, (kinds, cost, want)


def test_costs_of_code():
    head = "".join(f"def f{i}(a):\n    return a\n" for i in range(10))
    assert diagnose("py", head + "def f(\n")[0] <= 4 and diagnose("py", "def f(\n")[::3] == (2, True)
    assert diagnose("json", '{"a": 1, "b": [1, 2}')[:2] == (1, "truncation")
    assert diagnose("js", "function f() { return 1")[0] == 1 and diagnose("go", "package a\n\nfunc f() {\n")[0] == 1
    assert diagnose("py", head + "f() = 1\n") == (1, "local", [21], False)


@pytest.mark.parametrize("language,text", [(k, t) for k in ("py", "json") for t in VALID[k] + BROKEN[k]])
def test_chart_agrees_with_the_parsers(language, text):
    try:
        ast.parse(text) if language == "py" else json.loads(text, parse_constant=lambda x: 1 / 0)
        valid = True
    except (SyntaxError, ValueError, ZeroDivisionError):
        valid = False
    assert recognised(language, text) == valid


def test_every_fault_of_a_long_file_is_priced():
    body = "package a\n\n" + "".join(f"func F{i}(a int) int {{\n\tif a > {i} {{\n\t\treturn a\n\t}}\n\treturn {i}\n}}\n\n" for i in range(60))
    text = body
    for i in range(0, 60, 3):
        text = text.replace(f"func F{i}(", f"fucn F{i}(")
    cost, damage, lines, _ = diagnose("go", text)
    assert (cost, damage) == (20, "local")
    assert lines == [i + 1 for i, x in enumerate(text.split("\n")) if x.startswith("fucn")]


@pytest.mark.parametrize("language", VALID)
def test_costs_from_spans_are_the_least_of_all_edits(language):
    rng, g = random.Random(7), grammar(language, "repair")
    spans, tokens, compared = Spans(g), [LEX[language](t)[0] for t in VALID[language] + BROKEN[language]], 0
    for _ in range(12):
        whole = rng.choice([k for k in tokens if k])
        k = whole[(at := rng.randrange(len(whole))) : at + rng.randint(1, 8)]
        k[rng.randrange(len(k))] = rng.choice(sorted(g.literals - g.free))
        g.bound()
        edits, complete = cheapest(g, k, 2, 20_000)
        found = spans.repair(k)
        if complete and takes(g, k, found):
            compared += 1
            assert len(found) == len(edits) if edits is not None else len(found) > 2, (k, found, edits)
    assert compared > 4


@pytest.mark.parametrize("language,text,most", [("py", VALID["js"][1] + VALID["rs"][0], 160), ("js", VALID["py"][0] * 2, 40), ("go", "import os\nclass A:\n    def f(self):\n        pass\n" * 5, 60)])
def test_texts_of_another_language_cost_the_least(language, text, most):
    kinds = LEX[language](text)[0]
    cost, edits, least = repair(grammar(language, "repair"), kinds)
    assert least and 5 < cost == len(edits) <= most and takes(grammar(language, "repair"), kinds, edits)
    assert repair(grammar(language, "repair"), kinds, budget=1)[0] == cost and diagnose(language, text)[::3] == (cost, True)


def test_a_made_brace_ends_a_statement():
    assert repair(grammar("js", "repair"), ["{", "STR", "*="])[0] == 1


def test_large_tables_are_files(monkeypatch):
    kinds = LEX["go"]("package a\nfunc f( {\n}}\n")[0]
    want = Spans(grammar("go", "repair")).repair(kinds)
    monkeypatch.setattr("siftwell.llm.syntax.spans.HELD", 0)
    assert Spans(grammar("go", "repair")).repair(kinds) == want and want
