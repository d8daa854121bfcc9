import pytest

from codelode.llm.parsing import check, parsed, rates

VALID = {
    "python": ["", "x = 1\n", "def f(a, /, b=1, *, c, **k) -> int:\n    return (a if b else c)\n", "match x:\n    case {'a': [1, *r]} if r:\n        pass\n",
               "f'{a!r:>{w}} {b[\"c\"]}'\n", "async def f():\n    async with a as b, c:\n        await d\n", "x: int = 3; y = [i async for i in z if i]\n", "type A[T] = list[T]\n"],
    "javascript": ["", "import a, { b as c } from 'd';\nexport default class { #x = 1; static async *f() {} get y() { return 1 } }\n", "const f = async ({ a = 1, ...r }) => `x${a}y`;\n",
                   "for (const [k, v] of m) if (/[/]x/.test(k)) continue\nlet a = b\n++c\n", "a?.b?.[c]?.(d) ?? e;"],
    "typescript": ["export function f<T extends object = {}>(this: X, a?: T, ...b: string[]): a is T { return a! as unknown as T }\n",
                   "type A = { readonly [K in keyof B]?: B[K] extends infer U ? U : never };\nenum E { A = 1, B }\ndeclare module 'x' { export const y: number; }\n",
                   "abstract class A<T> implements B<T> { constructor(private readonly x: number) { super() } abstract f(): void; [k: string]: any }\n"],
    "go": ["package a\n", "package a\n\nimport (\n\t\"b\"\n\tc \"d\"\n)\n\nfunc (t *T[K]) f(x ...int) (r map[string][]int, err error) {\n\tfor i, v := range x {\n\t\tif v, ok := m[i]; ok {\n\t\t\tgo func() { ch <- v }()\n\t\t}\n\t}\n\tswitch y := x.(type) {\n\tcase []int:\n\tdefault:\n\t}\n\treturn T{a: 1}, nil\n}\n"],
    "java": ["", "package a.b;\nimport java.util.*;\npublic sealed interface A<T extends B & C> permits D {\n  default int f(int... x) throws E { return switch (x.length) { case 0 -> 1; default -> { yield 2; } }; }\n}\nrecord P(int x, List<? super String> y) {}\n",
             "class A { int[] a = {1, 2}; Map<String, List<int[]>> m = new HashMap<>(); void f() { for (var x : a) { r = (b) -> c::d; } Object o = (String) x; label: while (true) break label; } }"],
    "json": ['{"a": [1, -2.5e3, null, "\\u00e9"]}', "3"],
    "yaml": ["", "a: 1\nb:\n- x\n- y: 2\n  z: [1, {c: d}]\nt: |\n  text: here\n   more\nu: 'it''s'\n", "- a\n-\n  - b\n--- \nk: &x v\nl: *x\n"],
    "toml": ["", 'a = 1\n[b.c]\nd = ["x", 1979-05-27,\n  2.5, # c\n]\n[[e]]\nf = {g = true}\n[[e]]\nf = 2\n'],
    "xml": ["<?xml version=\"1.0\"?>\n<a b='1'>t &amp; <c/><!-- x --></a>"],
}
INVALID = {
    "python": ["def f(:\n", "if x:\npass\n", "x = (1,\n", "f(a=1, b)\n", "f() = 1\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "print 'x'\n", "a = “b”\n"],
    "javascript": ["const a;", "let x = ;", "function f( {", "{\"a\": 1, \"b\": 2}", "if (x { }", "`abc"],
    "typescript": ["let x: = 1", "interface A { b: }", "package a\n"],
    "go": ["", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n\tx := \n}\n", "import \"a\"\n"],
    "java": ["class A {", "class A { int f() { return 1 } }", "int x;;)"],
    "json": ["", "{'a': 1}", "[1,]", "{\"a\": NaN}", "{\"a\" 1}"],
    "yaml": ["a: [1, 2\n", "a: b: c\n", "a: 1\n  b: 2\n", "a: \"x\n", "\ta: 1\n"],
    "toml": ["a = \n", "a = 1\na = 2\n", "[a\n", "a = 'x\n"],
    "xml": ["", "<a>", "<a></b>", "<a>&nbsp;</a>", "<a/><b/>"],
}


@pytest.mark.parametrize("language", VALID)
def test_grammars(language):
    for text in VALID[language]:
        assert check(language, text)[0], text
    for text in INVALID[language]:
        assert not check(language, text)[0], text


def test_causes():
    assert check("python", "x = 1\n<<<<<<< HEAD\ny = 2\n=======\n>>>>>>> b\n")[2] == "conflict"
    assert check("go", "package a\nfunc f() {\n\tx := 1")[2] == "truncated"
    assert check("json", '{"a": 1,\n "b" 2}') == (False, 14, "unexpected")


def test_rows(spark):
    df = spark.createDataFrame(
        [("1", "r", "a.py", "x = 1\n", 1), ("1", "r", "a.py", "x = 1\n", 2), ("2", "r", "b.py", "x = (", 1), ("3", "r", "c.txt", "x = (", 1), ("4", "r", "d.json", None, 1), ("5", "r", None, "x", 1), ("6", "q", "E.PY", "x = (", 1)],
        "file_id string, root_id string, rel_path string, content string, language int")
    got = parsed(df)
    assert {(r.file_id, r.valid, r.cause) for r in got.collect()} == {("1", True, ""), ("2", False, "truncated"), ("6", False, "truncated")}
    assert {(r.root_id, r.language, r.files, r.invalid, r.rate) for r in rates(got).collect()} == {("r", "python", 2, 1, 0.5), ("q", "python", 1, 1, 1.0)}
    assert parsed(df.limit(0)).count() == 0
