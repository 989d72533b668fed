import ast
import json
import random
import tomllib

import pytest

from tarnwork.llm.derivatives import Grammar
from tarnwork.llm.syntax import check_syntax, failure_rates, parser
from tests.conftest import rows

GOOD = {
    "python": ['async def f(a, *, b: int = 1, **k) -> int:\n    """x\n<<<<<<< a\n"""\n    return [i for i in a if i] or {**k, "a": (yield)}\n', "if x:\n\tpass\nelse: y = lambda *a: a[1:2, ::3]\n", "x = (1 +\n 2)  # (\n", "", "@a.b(1)\nclass A(B, c=d):\n    x: int\n\n    def f(self): ...\n", "match a:\n    case [1, *b] if b:\n        pass\n", "with a as b, c as d:\n    del b, d\n"],
    "javascript": ["export default async function* f({a, b = 1}, ...c) {\n  for (const x of a) { yield x }\n}\nconst g = async (x) => ({ ...x, [y]: 1 })\n", "!function(e,t){var a=1;if(b)c();else d=null}(1,2)", "a\n  .b()\n  .c(`x ${y}`)\nlet r = /[/\"]/g.test(s)\n", "class A extends B { #p = 1; static get x() { return this.#p } }", "label: for (;;) { break label }"],
    "typescript": ["export interface A<T extends B> { readonly x?: string; f(a: number): void }\ntype U = 'a' | 'b'\nconst f = <T,>(x: T): x is T => true\n", "enum E { A = 1, B }\nabstract class C implements D { private x: Map<string, number[]> = new Map(); constructor(public y: string) { super() } }\nlet z = x as unknown as Foo<Bar>\n"],
    "go": ['package a\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tA int `json:"a"`\n}\n\nfunc (t *T) F(x ...int) (int, error) {\n\tif v, ok := m[x]; ok {\n\t\treturn v, nil\n\t}\n\tfor i := range x {\n\t\tgo func() { fmt.Println(i) }()\n\t}\n\treturn T{A: 1}.A, nil\n}\n'],
    "java": ['package a.b;\nimport java.util.*;\n@A("x")\npublic class T<K extends L> implements M {\n  private final Map<String, List<int[]>> m = new HashMap<>();\n  int record = 1;\n  T(int... a) throws E { super(a); }\n  <X> X f(X x) { for (var y : m.keySet()) { x = (X) y; } return x -> x + 1 > 2 ? a : b::c; }\n}\n'],
    "c": ["#include <a.h>\n#define X(a) \\\n  (a)\nstatic const char *s[] = { \"a\" \"b\", NULL };\ntypedef struct a { int x : 3; } a_t;\nint main(int argc, char **argv) { for (int i = 0; i < 3; i++) { p->x[i] = (int) sizeof(a_t); } return 0; }\n"],
    "rust": ["use std::{fmt, io::{self, Read}};\n#[derive(Debug)]\npub struct A<'a, T: B + 'a> { x: &'a T }\nimpl<'a, T> A<'a, T> where T: B { pub fn f(&mut self) -> Result<(), E> { let y = match self.x { Some(1..=3) | None => r#\"a\"b\"#, _ => return Ok(()) }; println!(\"{}\", y); Ok(()) } }\n"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "[]", " 1 "],
    "toml": ['a.b = [1,\n 2, # x\n]\n[c."d"]\nx = {y = 1}\nt = 2024-01-01T00:00:00Z\ns = """\na"b\n"""\n', ""],
    "bash": ['f() {\n  case "$1" in\n    a|b) echo "x" ;;\n    *) for i in 1 2; do echo $i; done ;;\n  esac\n}\nif [ "$a" = b ] && ! c; then d | e > f 2>&1; fi\n', "cat <<'E' > x\n<<<<<<< a\nif (\nE\n"],
    "sql": ["CREATE TABLE IF NOT EXISTS a (b INT PRIMARY KEY, c VARCHAR(10) DEFAULT 'x', UNIQUE (b, c));\nINSERT INTO a (b) VALUES (1), (2);\nWITH q AS (SELECT count(*) AS n FROM a GROUP BY b HAVING n > 1) SELECT t.*, CASE WHEN x IS NOT NULL THEN 1 END FROM q AS t LEFT JOIN u ON t.a = u.b WHERE NOT (x BETWEEN 1 AND 2) ORDER BY 1 DESC LIMIT 3;\n"],
    "yaml": ["a: 1\nb:\n  - x: [1, {y: z}]\n    w: |\n      <<<<<<< x\n  - 'q'\nc:\n- d # e\n---\nplain text\n more\n", ""],
}
BAD = {
    "python": ["def f(:\n    pass\n", "for i in x\n    y\n", "if a:\nb\n", "x = [1\n", "class A:\n    def f(self):\n", "a b\n", "if x:\n    a\n   b\n", "if x:\n        a\n\tb\n", "<<<<<<< a\nx = 1\n=======\n", "package a\n", 'x = "a\n'],
    "javascript": ["function f( {", "a b", "if (x) { y", "let x = ;", "import os\nimport re\n", "f(a;", "x = 'a\n", "}", "<<<<<<< a\n"], "typescript": ["let x: = 1", "function f(a: number { }", "interface A { x: }", "const a = (1;"],
    "go": ["func f() {}", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\nx := 1\n", "import x\n"], "java": ["class A { int f( { } }", "class A { void f() { x = ; } }", "class A {", "package a\nclass A {}", "int f() { return 1; }}"],
    "c": ["int f( { }", "int main() { return 0", "int x = ;", "use std::x;", "<<<<<<< a\nint x;\n", "def f(x):\n"], "rust": ["fn f( {}", "fn f() { let = 1; }", "fn f() {", "import x\n", "pub fn f() -> { }"],
    "json": ["{'a': 1}", "[1,]", '{"a": 1', '{"a" 1}', "", "[1] [2]"], "toml": ["a = ", "[a", 'a = "x', "a b = 1", "{}", "a = x"], "bash": ["if x; then y", "f() {", "for i in a; do", "case x in a) b", "echo )", "<<<<<<< HEAD\na\n=======\n"],
    "sql": ["SELECT FROM;", "CREATE TABLE a (b INT;", "INSERT INTO a VALUES (1;", "import x\nimport y\n", "SELECT 1;\n((;"], "yaml": ["a: [1, 2\nb: 3\n", "a: 1\n  b: 2\n", "a: b: c\n", "\ta: 1\n", "a: 1\n: [} :\n", "a: 1\n<<<<<<< x\nb: 2\n", "a: 'x\n"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in GOOD.items() for t in ts])
def test_valid(language, text):
    assert parser(language).judge(text) == (True, None, None)


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_invalid(language, text):
    assert not parser(language).judge(text)[0]


def test_failing_line_and_truncation():
    assert parser("python").judge('x = """\n\n"""\ny = 1\nz z\n') == (False, 5, "token")
    assert parser("c").judge("int f() {\n  /* a\n b */\n  return 1\n}\n") == (False, 5, "token")
    assert parser("java").judge("class A {\n void f() {\n") == (False, None, "truncated")


def test_mutations_agree_with_the_library_parsers():
    random.seed(4)
    check = {"python": ast.parse, "json": json.loads, "toml": tomllib.loads}
    for language, ref in check.items():
        for _ in range(200):
            t = random.choice(GOOD[language])
            if not t:
                continue
            i = random.randrange(len(t))
            u = random.choice([t[:i], t[:i] + t[i + 1 :], t[:i] + t[i] + t[i:]])
            try:
                ref(u)
            except Exception:
                continue
            if language == "python" and ("match" in t or "\t" in u):
                continue
            assert parser(language).judge(u)[0], u


def test_derivatives_against_a_small_grammar():
    g = Grammar("file = s ;\ns = ( '(' s ')' | A )* ;")

    def ok(text):
        state = g.start
        for c in text:
            state = g.derive(state, c)
        return g.nullable(state)

    for text in ("", "A", "(A)", "()()", "((A)A)"):
        assert ok(text)
    for text in ("(", ")", "(A))", "B"):
        assert not ok(text)
    assert g.derive(g.start, ")") == g.empty


def test_memory_is_bounded():
    p = parser("json")
    p.grammar.reset()
    p.known.clear()
    assert p.judge("[" * 2000 + "]" * 2000)[0] and not p.judge("[" * 3000)[0]


F_ = "project_id string, path string, language string, content_hash string, chunk_count bigint, text int"
C_ = "project_id string, path string, file_hash string, chunk_id string, start_line int, text string, language int"


def test_operator(spark):
    files = [("p", "a.py", "python", "h", 2, 0), ("p", "a.py", "python", "h", 2, 0), ("p", "b.go", "go", "h", 1, 0), ("p", "short.py", "python", "h", 3, 0), ("p", "x.md", "markdown", "h", 1, 0), ("p", "n", None, "h", 1, 0), ("p", "z.json", "JSON", "h", 1, 0), ("p", "nil.json", "json", "h", 1, 0), (None, "q.py", "python", "h", 1, 0), ("p", "big.py", "python", "h", 1, 0)]
    chunks = [("p", "a.py", "h", "1", 1, "def f():\n", 0), ("p", "a.py", "h", "2", 2, "    return (1\n", 0), ("p", "a.py", "h", "2", 2, "    return (1\n", 0), ("p", "a.py", "old", "0", 1, ")", 0), ("p", "b.go", "h", "3", None, "package a\n", 0), ("p", "short.py", "h", "4", 1, "(", 0), ("p", "z.json", "h", "5", 1, "{", 0), ("p", "nil.json", "h", "6", 1, None, 0), ("p", "big.py", "h", "7", 1, "x = 1\n" * 100_000, 0)]
    v = check_syntax(spark.createDataFrame(files, F_), spark.createDataFrame(chunks, C_))
    assert rows(v, "path", "ok", "reason") == [("a.py", False, "truncated"), ("b.go", True, None), ("big.py", True, None), ("nil.json", False, "truncated"), ("z.json", False, "truncated")]
    assert rows(failure_rates(v).where("language = 'json'"), "judged", "failing", "rate") == [(2, 2, 1.0)]
    assert check_syntax(spark.createDataFrame([], F_), spark.createDataFrame([], C_)).count() == 0


def test_flow_collections_of_any_length():
    n = 50_000
    numbers = "[\n" + "  1, # x\n" * n + "]"
    assert parser("yaml").judge(f"a: {numbers}\nb: 1\n") == (True, None, None)
    assert parser("yaml").judge("{\n" + "".join(f'  "k{i}": [{i}, "a\n  b"],\n' for i in range(n)) + "}\n")[0]
    assert parser("yaml").judge(f"a: {numbers}]\n") == (False, n + 2, "token")
    assert not parser("yaml").judge(f"a: {numbers[:-1]}")[0]
    assert parser("yaml").judge("a: [1, # x\n  'b\n  c' ]  # d\nb: [] \n- c\n")[1] == 5


SHELL_GOOD = ["echo it\\'s \\\" a\n", "x=$'it\\'s'\n", 'a="$(echo "b $(c "d")")"\n', "# don't `\necho ${x#*\"}\"} \"${y:-'}'}\"\n", "x=$(case $1 in a) echo \")\" ;; (b) c ;; esac)\n", "a=(1 \"b c\" [3]=x # don't (\n  $(d)\n)\nlocal -a b=()\n", "[[ $a =~ ^(x|y)+$ && ! ( -f b || c < d ) ]] || e\n", "while ! [[ -n $a &&\n  $b == *.@(c|d) ]]; do :; done < <(cat <<E\nit's $(\nE\n)\n", "for ((i = 0; i < $(n); i++)); do ((i > 1)) && echo $((i << 1)) $#; done\n", "((a) ; (b))\n", "x=`echo \\`a\\` \"b\"`\n", "find . -exec rm {} \\;\n", "cat <<-'A' <<B\n\tit's\n\tA\n$(\nB\n"]
SHELL_BAD = ["echo \"${y:-it's}\"\n", "echo \"batch flu", "echo 'a\n", "echo $'a\\'\n", "echo `date\n", 'x="$(echo "a)"\n', "x=$(\n<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n)\n", 'echo "$(if a; then b)"\n', "x=`for i in; do`\n", "a=(1\n<<<<<<< HEAD\n2\n>>>>>>> x\n)\n", "[[ a == b\n<<<<<<< HEAD\n]]\n", "[[ a && ]]\n", "[[ ( a ]]\n", "((i = 1)\n", "echo ${a\n", "cat <(echo |)\n"]


@pytest.mark.parametrize("text", SHELL_GOOD)
def test_shell_quotes_and_nested_commands(text):
    assert parser("bash").judge(text) == (True, None, None)


@pytest.mark.parametrize("text", SHELL_BAD)
def test_shell_open_quotes_and_broken_nested_commands(text):
    assert not parser("bash").judge(text)[0]


def test_shell_lines_and_depth():
    assert parser("bash").judge('a="\n\n"\nx=$(\n  b\n  if; c\n)\n') == (False, 6, "token")
    assert parser("bash").judge('a\necho "b') == (False, None, "truncated")
    assert parser("bash").judge("x=" + "$(a " * 3000 + ")" * 3000)[0] and not parser("bash").judge("x=" + "$(a " * 3000)[0]


@pytest.mark.parametrize(
    "text",
    [
        "1 = x", "f() = 3", "f(a=1, 2)", "def f(a=1, b): pass", "def f(*): pass", "x = 08", "x = 5x", 'f"{a"', '"a" = 1', 'x = f"{}"', 'x = f"a}"', "del f()", "for 1 in x: pass", "x = {1: 2, 3}", "f(**k, 2)", 'x = f"{a!z}"', "from import x",
        "f(x for x in y, 1)", "lambda a=1, b: 2", "try:\n a\nexcept A, B:\n b", 'x = f"{a b}"', 'print "x"', "x = 1__0",
    ],
)
def test_python_refused(text):
    assert not parser("python").judge(text + "\n")[0]


@pytest.mark.parametrize(
    "text",
    [
        "x = y = f(a, *b, c=1, **d)", "f(a=1, *b)", "def f(a, b=1, /, c=2, *, d, e=3, **k): pass", "def f(*a: int, b): pass", "x: int = 3", "a.b[1] += 2", "(a, b), *c = d", "f(a)[0].b = 1", 'x = f"{a!r:>{w}}" "b" f\'{d["k"]}\'',
        'x = f"{d["a"]} {{x}} {y=} {z:%Y-%m}"', 'x = f"""a\n{b}\n"""\ny = 1', 'x = rf"\\d{n}"', "with (open(a) as b, c as d): pass", 'x = {**a, "b": 1}', "x = 0x_ff + 0b1 + 0o7 + 1_000.5e-3j + .5 + 1. + 00 + 1e5", "x = lambda *a, b=1, **k: (a, b)",
        "match x:\n  case 1: pass\n  case Point(x=0, y=[a, *b]) if b: pass", "case = 1\ncase.x = 2", "x[1:2, ::3] = 4", "type X = int",
    ],
)
def test_python_accepted(text):
    assert parser("python").judge(text + "\n") == (True, None, None)


def test_lines_of_failing_tokens_behind_fields():
    assert parser("python").judge('x = f"""\n{a}\n\n"""\ny = 1\nz = = 2\n') == (False, 6, "token")


@pytest.mark.parametrize("n", [300, 10_000])
@pytest.mark.parametrize("language", ["python", "javascript", "typescript", "go", "java", "c", "rust", "json", "toml", "sql", "bash", "yaml"])
def test_deep_nesting(language, n):
    o, c = "(" * n, ")" * n
    code = {
        "python": f"x = {o}1{c}\n", "go": f"package a\nvar x = {o}1{c}\n", "java": f"class A {{ int x = {o}1{c}; }}\n", "c": f"int x = {o}1{c};\n", "rust": f"fn f() {{ let x = {o}1{c}; }}\n", "json": "[" * n + "]" * n, "toml": "x = " + "[" * n + "]" * n,
        "sql": f"select {o}1{c};", "bash": f"{'( ' * n}ls{' )' * n}\n", "yaml": "[" * n + "]" * n,
    }.get(language, f"x = {o}1{c};\n")
    assert parser(language).judge(code) == (True, None, None)
    assert not parser(language).judge(code[: len(code) // 2])[0]
