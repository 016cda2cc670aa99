from marklight.functions import ctok


def fns(src):
    return [f[3] for f in ctok.function_tokens(src.encode())]


def test_names_comments_and_space_do_not_matter():
    a = fns("int f(int a) { return a + 1; }")
    b = fns("int  g(int zz)\n{ /* x */ return zz + 22; } // y")
    assert a == b == [["int", "@1", "int", "@2", "return", "@2", "@ARITH", "@NUM"]]


def test_operator_classes_and_extra_identifier():
    assert fns("int f(int a) { return a + 1; }") != fns("int f(int a) { return a < 1; }")
    one, two = fns("int f(int a, int b) { a = b; }")[0], fns("int f(int q, int a, int b) { a = b; }")[0]
    assert one[-3:] == ["@2", "@ASSIGN", "@3"] and two[-3:] == ["@3", "@ASSIGN", "@4"]  # numbering is per function
    assert fns('void f(void) { g("a", \'b\', p->q, c ? 1 : 2); }')[0][-9:] == ["@STR", "@CHAR", "@3", "->", "@4", "@5", "@TERNARY", "@NUM", "@TERNARY", "@NUM"][-9:]


def test_what_is_a_function():
    src = """#include <x.h>
int table[] = {1, 2};
struct s { int (*cb)(int); } v;
int proto(int a);
#define M(x) { x }
int old(a, b) int a; char *b; { return a; }
static int cut(void) { if (1) { return"""
    got = ctok.function_tokens(src.encode())
    assert [src[a:b][:8] for _, a, b, *_ in got] == ["int old(", "static i"]


def test_never_raises():
    for bad in (None, b"", b"}}}{{{", b'"', b"/*", b"'", b"\xff\xfe(){", b"f(" * 50, b"int f(){" * 20):
        ctok.function_tokens(bad), ctok.calls(bad)


def test_calls():
    src = 'int f(void) { g(h(1), o.m(2), p->q(3)); /* no(1) */ puts("x(1)"); if (1) return sizeof(int); }\nint z(int a) { return f(); }'
    got = ctok.calls(src.encode())
    assert [c for c, _ in got] == ["g", "h", "m", "q", "puts", "f"]
    at = dict(got)
    assert src[at["m"]] == "o" and src[at["q"]] == "p"
