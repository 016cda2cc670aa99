"""A tolerant tokenizer for C: tokens with byte spans, top-level functions, calls. Never raises on broken input."""

from __future__ import annotations

import re

# The punctuation and operators of C, longest first.
TOKEN = re.compile(
    rb"""(?P<comment>//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z))
    |(?P<directive>(?:(?<=\n)|\A)[ \t]*\#(?:[^\n\\]|\\\r?\n|\\.)*)
    |(?P<string>(?:u8|[LuU])?"(?:[^"\\\n]|\\.|\\\n)*(?:"|(?=\n)|\Z))
    |(?P<char>[LuU]?'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))
    |(?P<number>\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*)
    |(?P<word>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)
    |(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&^|]=|[-+*/%&^|~!<>=?:.,;(){}\[\]\#\\@`$])""",
    re.X | re.S,
)
# The keywords of C, and names of types that count like them.
KEYWORDS = set(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed "
    "sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Imaginary _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local".split()
)
PRIMITIVES = set("bool char int8_t uint8_t int16_t uint16_t int32_t uint32_t int64_t uint64_t size_t ssize_t intptr_t uintptr_t ptrdiff_t void int long float double".split())
# Words before a parenthesis that are no callees.
NOT_CALLS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "_Alignof", "_Generic", "_Static_assert", "goto"}
# Punctuation that is dropped, and the class that stands for each operator.
PUNCTUATION = set("( ) { } [ ] ; , .".split())
CLASSES = {
    "@ASSIGN": "= += -= *= /= %= &= |= ^= <<= >>=".split(),
    "@INCDEC": "++ --".split(),
    "@ARITH": "+ - * / %".split(),
    "@CMP": "== != < > <= >=".split(),
    "@LOGIC": "&& || !".split(),
    "@BIT": "& | ^ ~ << >>".split(),
    "@TERNARY": "? :".split(),
}
CLASS_OF = {op: c for c, ops in CLASSES.items() for op in ops}


def tokens(content: bytes) -> list[tuple[str, bytes, int, int]]:
    """``(kind, raw, start, end)`` of everything but comments and preprocessor lines."""
    out = []
    for m in TOKEN.finditer(content):
        kind = m.lastgroup
        if kind not in ("comment", "directive"):
            out.append((kind, m.group(), m.start(), m.end()))
    return out


def functions(toks: list[tuple[str, bytes, int, int]]) -> list[tuple[int, int]]:
    """Token ranges ``[from, to)`` of function definitions at brace depth 0, from the first token of the declaration.

    A body is a brace that follows a closing parenthesis, or the parameter declarations of an old-style definition. An
    unterminated body ends with the file. A body never nests another function.
    """
    out, i, begin, n = [], 0, 0, len(toks)
    parens_at, closed = -1, False
    while i < n:
        raw = toks[i][1]
        if raw == b"(" and parens_at < 0:
            depth, j = 1, i + 1
            while j < n and depth:
                depth += (toks[j][1] == b"(") - (toks[j][1] == b")")
                if depth and toks[j][1] in (b"{", b"}"):
                    break
                j += 1
            named = i > begin and toks[i - 1][0] == "word"
            if not depth and named:
                parens_at, closed = i, True
            i = max(j, i + 1)
            continue
        if raw == b"{":
            depth, j = 1, i + 1
            while j < n and depth:
                depth += (toks[j][1] == b"{") - (toks[j][1] == b"}")
                j += 1
            if closed and not any(toks[k][1] == b"=" for k in range(begin, i)):
                out.append((begin, j))
                begin = j
            elif j < n and toks[j][1] not in (b";", b",", b"=") and toks[j][0] != "word" and toks[j][1] != b"*":
                begin = j
            i, parens_at, closed = j, -1, False
            if begin < i and out and out[-1][1] == begin:
                begin = i
            continue
        if raw == b";":
            old_style = closed and parens_at >= 0 and toks[parens_at + 1 : i] and i + 1 < n and _old_style(toks, parens_at, i)
            if not old_style:
                begin, parens_at, closed = i + 1, -1, False
        elif raw == b"}":
            begin, parens_at, closed = i + 1, -1, False
        i += 1
    return out


def _old_style(toks: list, at: int, end: int) -> bool:
    """Whether declarations stand between the parameter list that opens at ``at`` and the semicolon at ``end``."""
    depth, j = 0, at
    while j < end:
        depth += (toks[j][1] == b"(") - (toks[j][1] == b")")
        j += 1
        if not depth:
            break
    return j < end and toks[j][0] == "word" and toks[j][1] != b"__attribute__"


def normal(kind: str, raw: bytes, ordinals: dict[bytes, int]) -> str | None:
    """One token of a function as its fingerprint sees it; null if it is dropped. ``ordinals`` number the identifiers of
    the function by first occurrence."""
    text = raw.decode("latin-1")
    if kind == "word":
        if text in KEYWORDS or text in PRIMITIVES:
            return text
        return f"@{ordinals.setdefault(raw, len(ordinals) + 1)}"
    if kind == "op":
        return None if text in PUNCTUATION else CLASS_OF.get(text, text)
    return {"number": "@NUM", "string": "@STR", "char": "@CHAR"}[kind]


def function_tokens(content: bytes | None) -> list[tuple[int, int, int, list[str], list[int], list[int]]]:
    """``(number, start, end, tokens, starts, ends)`` of every function definition; none for null or empty content."""
    toks = tokens(content or b"")
    out = []
    for k, (a, b) in enumerate(functions(toks)):
        ordinals: dict[bytes, int] = {}
        kept = [(t, s, e) for kind, raw, s, e in toks[a:b] if (t := normal(kind, raw, ordinals)) is not None]
        out.append((k, toks[a][2], toks[b - 1][3], [x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept]))
    return out


def calls(content: bytes | None) -> list[tuple[str, int]]:
    """``(callee, start of the callee expression)`` of every call in a function body, outer calls before inner ones.

    The callee is a name or the last member of ``a.b`` or ``a->b``; calls in strings, comments and macros don't exist.
    """
    return [(name, start) for name, start, _ in call_spans(content)]


def call_spans(content: bytes | None) -> list[tuple[str, int, int]]:
    """The same with the end of the call, behind its closing parenthesis; an unclosed call ends with the function."""
    toks = tokens(content or b"")
    out = []
    for a, b in functions(toks):
        body = next((i for i in range(a, b) if toks[i][1] == b"{"), b)
        # where each parenthesis ends, found once for the function: nested calls cost nothing more
        ends, opened = {}, []
        for i in range(body, b):
            if toks[i][1] == b"(":
                opened.append(i)
            elif toks[i][1] == b")" and opened:
                ends[opened.pop()] = toks[i][3]
        for i in range(body + 1, b - 1):
            kind, raw, start, _ = toks[i]
            if kind != "word" or toks[i + 1][1] != b"(" or raw.decode("latin-1") in NOT_CALLS | KEYWORDS:
                continue
            if toks[i - 1][0] == "word" and toks[i - 1][1].decode("latin-1") not in ("return", "else", "do", "case", "sizeof", "goto"):
                continue  # a declaration
            j = i
            while j - 2 >= body and toks[j - 1][1] in (b".", b"->"):
                j -= 2
                depth = 0
                while j > body and toks[j][1] in (b"]", b")") or depth:  # a[i].f(), g().f()
                    depth += (toks[j][1] in (b"]", b")")) - (toks[j][1] in (b"[", b"("))
                    j -= 1
                    if not depth and toks[j][1] not in (b"]", b")"):
                        break
            out.append((raw.decode("latin-1"), toks[j][2], ends.get(i + 1, toks[b - 1][3])))
    return out
