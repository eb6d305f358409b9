"""Declarations of each language against hand-written lists, on code where braces, quotes and keywords mislead."""

import random

import pytest

from recall_spark.operators import chunking, lexing
from recall_spark.operators.declarations import declarations

CASES = {
    "java": ('''class A { String s = """
 { "x } \\""" y
"""; int f() { return 1; } public A(int x) {} A(int y) {} record R(int a) { R { } int g() { return a; } }
@Override(x = "}") public <T extends B> List<T> m(int[] a) throws E { new Foo() { void anon() {} }; Runnable r = () -> { int z; }; int[] q = {1, 2}; }
enum E { P(1) { int x() { return 1; } }, Q; int v() { return 2; } } static { int k; } char c = '}';
interface I { void k(); default int d() { return 1; } int CONST = f(2); } int h() { if (x) { y(); } else { z(); } } }
@interface N { int value() default 3; }''',
        ["class A", "method f", "method g", "method m", "method anon", "method x", "method v", "class I", "method k", "method d", "method h"]),
    "csharp": ('''#if X }
using System;
namespace M { [Attr("}")] public class A<T> : B where T : class { public A(int x) : base(x) { } ~A() { } string s = $"{a["}"]} {{", t = @"c:\\", u = $@"{f("""x""")} ""}";
public record R(int a); record struct P(int X) { int InP() => X; } public int Prop { get; set; } = 3; int Arrow => 4; Func<int> g = () => { return 1; };
public async Task<int> Run<U>(int x) where U : new() { var f = new Foo { A = 1 }; int Local() { return 2; } return 1; } int E() => new B { X = 1 }.X;
public static A operator +(A a, A b) { return a; } (int, string) T() { } int I.K() { } delegate int D(int x); event Action Ev; var q = """ { """;
public int this[int i] { get { return 1; } } } interface I { void K(); } struct S { public int InS() { } } enum C { A, B } }''',
        ["class A", "method InP", "method Run", "method E", "method T", "method K", "class I", "method K", "method InS"]),
    "rust": ('''/* { /* } */ */
fn f() -> &'static str { r#"a } " b"# }
#[derive(Debug)]
pub(crate) struct G<'a>(&'a str);
fn g() { let c = '}'; let d = b'{'; let x = S { a: 1 }; fn inner() {} }
macro_rules! m { () => { fn no() {} } }
mod tests { use super::*; #[test] fn t() { assert!(x, "{}"); vec![ { fn hidden() {} } ]; } }
pub unsafe trait T: A { fn sig(&self); fn dflt(&self) { } }
impl<T: Clone> Foo<T> where T: B { pub const unsafe fn k<'b>(self) {} }
struct U; enum E { A { x: i32 } }
extern "C" fn e() {}
const F: fn(i32) -> i32 = g;''',
        ["function f", "class G", "function g", "function inner", "function t", "class T", "function dflt", "class impl", "function k", "class U", "function e"]),
    "go": ('''package a
type ( A struct { x int }; B interface {
  M() int
}
  C = int
  D map[string]struct{}
)
type E struct {
	F func(int) error `json:"}"`
}
type Alias = int
func (a *A) M[T any](x func() int) struct{ y int } { type L struct{ z int }; s := []B{{1}, {2}}; r := '}'; return s }
func Map[T, U any](s []T, f func(T) U) []U {
	if x := (A{1}); x == y { }
	go func() { }()
	return nil
}
func external(int)
var v = `}`
type Last []int''',
        ["class A", "class B", "class D", "class E", "method M", "class L", "function Map", "class Last"]),
    "javascript": ('''export default class A extends mixin({}) {
  x = 5
  run(a = {b: 1}) { return { m() { return 1 }, n: function() {}, o: () => { } } }
  static async *gen(x) { const r = /[}/]'/g, q = `a ${ `}` + (() => { return "}" })() } {`; }
  get v() { return 1 } set v(x) { }
  static { init() }
  'quoted-name'() { } [Symbol.iterator]() { } #priv() { }
  arrow = (a) => { if (a) { b() } }
}
const o = { run2() { }, async b() { }, c: 1 }
foo(function named() { }, class { inside() { } })
const C = class D2 { z() { } }
if (a) { function cond() { } } else if (b) { while (c) { } }
x = y / 2; z = "}" / 3
async function last() { return a / b / c }''',
        ["class A", "method run", "method m", "method gen", "method v", "method v", "method quoted-name", "method [Symbol.iterator]", "method #priv", "method run2", "method b", "method inside", "method z", "function cond", "function last"]),
    "typescript": ('''@Component({ template: `<b>{{ x }}</b>` })
export abstract class A<T extends { x: number }> extends B<C> implements D {
  private async gen<U>(x: U): Promise<{ q: U }> { return null }
  @Input() dec(a?: string): a is string { }
  abstract nobody(): void
  over(a: string): void
  over(a: any): void { }
  constructor(private x: number) { super() }
}
export default async function go<T>(x: T): { a: T } { function inner() { } return x }
export interface I { a(): void; b: { c: string } }
enum E { A = 1 }
namespace N { export function nf() { } }
type X = { q: string }
declare module "m" { interface J { } }''',
        ["class A", "method gen", "method dec", "method over", "method constructor", "function go", "function inner", "class I", "function nf", "class J"]),
    "c": ('''#define X { \\
  {
typedef struct Node { struct Node *next; int v; } Node;
static inline int f(int a) { return a; }
int proto(int); struct Node *make(struct Node *n) { return n; }
struct __attribute__((packed)) S { int a; };
int (*fp)(int) = g; char q = '"'; int arr[] = { 1, 2 }; enum E { A };
int k(void)
{
  struct Local { int z; };
  if (a) { } for (;;) { }
}''',
        ["class Node", "function f", "function make", "class S", "function k", "class Local"]),
    "cpp": ('''namespace n { template <typename T> class A : public B<T> { public: A(int x) : a{x}, b(1) { } ~A() { } int f() const override { return 1'000; }
bool operator==(const A& o) const { return true; } static int g(); enum class E { X }; struct In { int q; }; }; }
std::vector<int> n::A<int>::run(int x) { auto l = [](int y) { return y; }; for (;;) { } return {1, 2}; }
const char* s = R"x( } )" )x"; extern "C" { int c(void) { return 0; } }
TEST(Suite, Name) { } struct P { int x; } p = { 1 }; struct P make(struct P q) { return q; }
unsigned long long *ptr(int a[3], void (*cb)(int)) { if (a) { b(); } }''',
        ["class A", "method A", "method ~A", "method f", "method operator==", "class In", "method n::A<int>::run", "function c", "class P", "function make", "function ptr"]),
    "svelte": ('''<script lang="ts" context="module">
export function a(x: { y: number }) { return x }
</script>
<div on:click={() => { b() }}>it's } function no() { }</div>
<script>
  class Q { m() { } }
</script>
<style> p { color: red } </style>''',
        ["function a", "class Q", "method m"]),
}


@pytest.mark.parametrize("language", CASES)
def test_declarations(language):
    text, want = CASES[language]
    found = declarations(text, language)
    assert [f"{kind} {name}" for _, _, kind, name in found] == want
    for a, b, _, _ in found:
        assert text[b - 1] in "};)" or language == "go"
    # Windows line ends, and no line end at the end of the text.
    assert [f[2:] for f in declarations(text.replace("\n", "\r\n"), language)] == [f[2:] for f in found]


def test_spans():
    """What belongs to a declaration: modifiers and annotations, not what is before."""
    cases = [
        ("java", 'class A { @Test(a = 1)\n  public int f() { return 1; } }', "f", "@Test(a = 1)\n  public int f() { return 1; }"),
        ("java", 'class A { String s = """}"""; }\nclass B { }', "A", 'class A { String s = """}"""; }'),
        ("csharp", "class A { int E() => new B { X = 1 }.X; int g; }", "E", "int E() => new B { X = 1 }.X;"),
        ("rust", 'fn f() { r#"a } " b"#; }\nfn g() {}', "f", 'fn f() { r#"a } " b"#; }'),
        ("rust", "#[inline] pub async fn f() { }", "f", "pub async fn f() { }"),
        ("go", "type (\n  A struct {\n    x int\n  }\n  B int\n)\n", "A", "A struct {\n    x int\n  }"),
        ("go", "type A interface {\n  M()\n}\nvar x int", "A", "type A interface {\n  M()\n}"),
        ("typescript", "export default class A { private get x(): number { return 1 } }", "x", "private get x(): number { return 1 }"),
        ("javascript", "const t = `${ x ? `{` : '}' }`; function f() { }", "f", "function f() { }"),
        ("cpp", "template <class T> static T f(T x) { return x; }", "f", "static T f(T x) { return x; }"),
        ("svelte", "<p>\n<script>function f() { }</script>", "f", "function f() { }"),
    ]
    for language, text, name, want in cases:
        assert [text[a:b] for a, b, _, n in declarations(text, language) if n == name] == [want], text


def test_broken_code():
    """Whatever the text is, each declaration lies within it and has a name; unclosed bodies end with the text."""
    assert [(k, n) for _, _, k, n in declarations("fn f() { if (x { } ] fn g() {", "rust")] == [("function", "f"), ("function", "g")]
    assert declarations("", "go") == [] and declarations("}}}) ;", "java") == []
    rng = random.Random(3)
    bits = ["{", "}", "(", ")", "[", "]", ";", ",", '"', "'", "`", "${", "\n", " ", "class ", "function ", "fn ", "func ", "type ", "struct ", "impl ", "x", "A ", "=", "=>", ":", "<", ">", "//", "/*", "*/", 'r#"', '"#', '"""', '$"', "@", "#", "new ", "enum ", "record ", "if ", "/", "~", "::", "operator", "template", "\\"]
    for _ in range(1_500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        for language in (*lexing.LANGUAGES, "svelte"):
            assert all(0 <= a < b <= len(text) and name for a, b, _, name in declarations(text, language))


def test_long_code_takes_linear_time():
    """A minified file is one long statement."""
    import time

    def seconds(n):
        began = time.process_time()
        declarations("a={b:[1,2,{c:f(x,function(){return{}})}]}," * n, "javascript")
        return time.process_time() - began

    seconds(500)
    assert seconds(8_000) < 12 * seconds(2_000)


def test_lines_and_fallback():
    text = "package a\n\nfunc F(x int) int {\n  return 2\n}\n"
    assert [c[1:5] for c in chunking.chunks_of(text, "go")] == [(3, 5, "function", "F")]
    assert [c[3] for c in chunking.chunks_of("<p>no script</p>", "svelte")] == ["text"]
    deep = "`${" * 20_000
    assert chunking.chunks_of(deep, "javascript")[0][3] == "text"  # holes within holes, too deep: cut as text
