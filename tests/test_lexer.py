"""Masks and bodies of scripts and Go, on code that a bracket counter alone gets wrong."""

import pytest

from sparkloom.sources import lexer
from sparkloom.sources.parsers import parse_go, parse_script


def functions(parse, text):
    return [(f["name"], f["start_line"], f["end_line"]) for f in parse(text)["functions"]]


def test_masks_keep_their_shape():
    for text in ("a = `x ${ f({b: `}`}) } /` / 2", "x = /[/]}/.test('}') // }", "if (x) /}/.exec(y)\nz = (a) / b / c", "`open ${", "'it", "a++ / 2 / b", "</div>{'", "/* open", "x = {a: 1} / 2 / {"):
        assert len(lexer.mask_script(text)) == len(text)
        assert [i for i, c in enumerate(lexer.mask_script(text)) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert lexer.mask_go("x := `C:\\` + \"{\" + '{'") == "x := `   ` + \" \" + ' '"


@pytest.mark.parametrize(
    ("text", "brackets"),
    [
        ("a(/\\/\\//)", "()"),
        ("return /}/", ""),
        ("x / y / {}", "{}"),
        ("(a) / '{' / b", "()"),
        ("if (a) /{/.test(b)", "()()"),
        ("`${ {a: `}`} }`", "{{}}"),
        ("`{`", ""),
        ("i++ / 2 /* { */ / 3", ""),
        ("a = b\n/{/g", "{"),
        ("x => /{/", ""),
        ("[1] / [2] / {}", "[][]{}"),
        ("y = {} / {} / 1", "{}{}"),
        ("this.return / {} / 2", "{}"),
        ("<p>{a}</p>", "{}"),
    ],
)
def test_what_is_code(text, brackets):
    assert "".join(c for c in lexer.mask_script(text) if c in "(){}[]") == brackets


def test_script_functions():
    text = """function a(s) { return /\\/\\//.test(s) }
function b() {
  return `x ${ [1].map((y) => { return `}` }) } }`
}
const c = (x: number): { a: number } => {
  return { a: x }
}
function d(): Promise<{ a: { b: number } }> { return e() / 2 }
const f = (x: number): number => x / 2
class K<T> {
  private g(x?: () => void): (y: string) => void { return (y) => {} }
  static async *h(): AsyncGenerator<{ x: 1 }> {
  }
}
function over(a: string): void
function over(a: any): void {
}
function guard(x: any): x is { a: 1 } {
}
"""
    assert functions(parse_script, text) == [("a", 1, 1), ("b", 2, 4), ("c", 5, 7), ("d", 8, 8), ("g", 11, 11), ("h", 12, 13), ("over", 16, 17), ("guard", 18, 19)]


def test_go_functions():
    text = """package p

func A() int {
	return 1
}

func B() interface{} {
	return nil
}

func C() map[string]interface{} {
	return nil
}

func D() (chan struct{}, error) {
	return nil, nil
}

func (r *T[K]) E(f func(int) struct{}) func() interface{ X() } {
	s := `}\\`
	return nil
}

func F[K comparable, V []int](k K) *p.Set[K] {
	c := '}'
	return nil
}

func G(x int) <-chan struct{ a int }

func H() [2]map[int]chan<- *q.T {
}

func I() struct {
	a int
} {
	return x
}
"""
    assert functions(parse_go, text) == [("A", 3, 5), ("B", 7, 9), ("C", 11, 13), ("D", 15, 17), ("E", 19, 22), ("F", 24, 27), ("H", 31, 32), ("I", 34, 38)]
    bodies = {f["name"]: f["body"] for f in parse_go(text)["functions"]}
    assert "return nil" in bodies["B"] and len(set(bodies.values())) == 7  # B and C are alike in body


def test_odd_text_ends():
    for text in ("func (", "func A(", "func A() map[", "func A() func", "func", "function f(", "class K {", "const a = (", "func A() [", "const a: () => void = (b): () => {"):
        parse_go(text)
        parse_script(text)
