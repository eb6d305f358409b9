"""Where functions, methods and types are declared in program text: one pass over its tokens with a stack of open brackets.

Each bracket that is open keeps the tokens of the statement that it is in; a closed pair counts as one token of it. When a
body opens, or a statement ends, the tokens before it tell what is declared. Bodies know what they are: methods are looked
for in bodies of types only, and nothing in macros.
"""

from __future__ import annotations

import re

from recall_spark.operators.lexing import Token, tokens

_JS_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "declare", "accessor", "*"}
_CONTROL = {"if", "for", "while", "switch", "catch", "function", "return", "with", "do", "else", "new", "typeof", "await", "throw", "case", "goto", "sizeof", "lock", "using", "foreach", "fixed"}
_MODIFIERS = {
    "public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "partial", "async", "override", "virtual", "default",
    "synchronized", "native", "readonly", "extern", "unsafe", "new", "strictfp", "non", "-", "transient", "volatile", "file", "required", "ref",
}
_EXPRESSION = {"=", "(", ",", ":", "?", "[", "&&", "||", "return", "=>", "yield", "default", "->", "+="}
#: Tokens of a statement that are kept.
LONGEST = 1_000
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)


class _Body:
    """An open bracket: what it is, the declaration that it is the body of, whether its statement goes on after it, and the
    tokens of the statement within it."""

    __slots__ = ("sign", "begin", "first", "what", "declared", "goes_on", "items")

    def __init__(self, sign: str, at: Token | None, what: str, declared: tuple[int, str, str] | None = None, goes_on: bool = False):
        self.sign, self.begin, self.first, self.what, self.declared, self.goes_on = sign, at.begin if at else 0, at.first if at else True, what, declared, goes_on
        self.items: list[Token] = []


def _texts(items: list[Token]) -> list[str]:
    return [t.text for t in items]


def _before_generics(items: list[Token], at: int) -> int:
    """The index before <...> if that is what ends at an index; the index itself if not."""
    if at < 0 or items[at].text != ">":
        return at
    depth = 0
    for i in range(at, -1, -1):
        depth += {">": 1, "<": -1}.get(items[i].text, 0)
        if not depth:
            return i - 1
    return -1


def _after_generics(items: list[Token], at: int) -> int:
    """The index after <...> if that is what begins at an index; the index itself if not."""
    if at >= len(items) or items[at].text != "<":
        return at
    depth = 0
    for i in range(at, len(items)):
        depth += {"<": 1, ">": -1}.get(items[i].text, 0)
        if not depth:
            return i + 1
    return len(items)


def _named(items: list[Token], at: int) -> str | None:
    return items[at].text if 0 <= at < len(items) and items[at].kind == "word" else None


def _starts(items: list[Token], at: int) -> bool:
    """Whether a statement begins at an index: nothing before it, or a new line that what is before doesn't go on to."""
    before = items[at - 1] if at else None
    return before is None or (items[at].first and not (before.kind == "sign" and before.text not in ("++", "--", ">")))


def _script(body: _Body, typed: bool):
    items = body.items
    last = items[-1].text if items else ""
    words = [i for i, t in enumerate(items) if t.text in ("function", "class", "interface", "enum", "namespace", "module") and not (i and items[i - 1].text == ".")]
    key = words[-1] if words else None
    if key is not None and key + 1 < len(items) or last in ("class", "function"):
        word, head = items[key].text, items[key + 1 :]
        open_generics = sum({"<": 1, ">": -1}.get(t.text, 0) for t in head) > 0
        if open_generics or (last == ":" and any(t.kind == "()" for t in head)):
            return "object", None, True  # a type in a head
        at = key
        while at and not items[at].first and items[at - 1].text in ("export", "default", "async", "declare", "abstract"):
            at -= 1
        stands = body.sign != "(" and (_starts(items, at) or any(t.text == "@" for t in items[:at]))
        own = key - 1 if key and items[key - 1].text == "async" else key
        name = _named(items, key + 1 + (word == "function" and key + 1 < len(items) and items[key + 1].text == "*"))
        if word == "function" and any(t.kind == "()" for t in head):
            return "block", (items[own].begin, "function", name) if stands and name else None, not stands
        if word == "class" or (word == "interface" and typed and name):
            # What extends something is named by the word after class; a class without a name isn't declared.
            return "class" if word == "class" else "types", (items[key].begin, "class", name) if stands and name and name != "extends" else None, not stands
        if word in ("enum", "namespace", "module") and stands and name:
            return "types" if word == "enum" else "block", None, False
    if body.what in ("class", "object"):
        for k, t in enumerate(items):
            rest = _texts(items[k + 1 :])
            if t.kind != "()" or (rest and (rest[0] != ":" or "=" in rest or any(_starts(items, i) for i in range(k + 1, len(items))))):
                continue
            at = n = _before_generics(items, k - 1)
            if n < 0 or not (items[n].kind in ("word", "string", "[]")) or items[n].text in _CONTROL:
                continue
            if rest and rest[-1] in (":", "|", "&", "<", ","):
                return "object", None, True  # a type in a head
            while at and not items[at].first and items[at - 1].text in _JS_MODIFIERS:
                at -= 1
            if _starts(items, at) or (items[at - 1].kind == "()" and any(x.text == "@" for x in items[:at])) or items[at - 1].kind == "{}":
                return "block", (items[at].begin, "method", items[n].text.strip("'\"")), False
    if (body.sign in "([" and not items) or (last in _EXPRESSION and last not in ("=>", "->")):
        return "object", None, True
    return "block", None, body.sign == "(" or any(t.text in ("=", "return", ":", "=>") for t in items)


def _go(body: _Body):
    items = body.items
    if items and items[-1].text in ("struct", "interface"):
        return "types", None, True
    if items and items[0].text == "func" and body.what == "top":
        if name := _named(items, 1):
            return "block", (items[0].begin, "function", name), False
        if len(items) > 3 and items[1].kind == "()" and (name := _named(items, 2)):
            return "block", (items[0].begin, "method", name), False
    return "block", None, bool(items) and items[0].text not in ("if", "for", "switch", "select", "else")


def _rust_head(items: list[Token]) -> tuple[int, int]:
    """Where a declaration begins, after its attributes, and its first word after the modifiers."""
    at = 0
    while at + 1 < len(items) and items[at].text == "#":
        at += 2 + (items[at + 1].text == "!")
    begin = at
    if at < len(items) and items[at].text == "pub":
        at += 1 + (at + 1 < len(items) and items[at + 1].kind == "()")
    while at < len(items) and (items[at].text in ("const", "async", "unsafe", "extern", "default", "auto") or (items[at].kind == "string" and items[at - 1].text == "extern")):
        at += 1
    return begin, at


def _rust(body: _Body, ends: bool = False):
    items = body.items
    if not ends and len(items) > 1 and ("!" in (items[-1].text, items[-2].text)) and body.what != "none":
        return "none", None, False
    begin, at = _rust_head(items)
    word, name = _named(items, at), _named(items, at + 1)
    if word == "struct" and name:
        return "types", (items[begin].begin, "class", name), False
    if not ends and word == "fn" and name:
        return "block", (items[begin].begin, "function", name), False
    if not ends and word in ("trait", "impl"):
        return "block", (items[begin].begin, "class", "impl" if word == "impl" else name), False
    return "block", None, any(t.text == "=" for t in items)


def _typed_head(items: list[Token], language: str) -> int:
    """The index after annotations or attributes, and modifiers."""
    at = 0
    while at < len(items):
        if language == "java" and items[at].text == "@" and _named(items, at + 1) not in (None, "interface"):
            at += 2
            while at + 1 < len(items) and items[at].text == ".":
                at += 2
            at += at < len(items) and items[at].kind == "()"
        elif (language == "csharp" and items[at].kind == "[]") or items[at].text in _MODIFIERS:
            at += 1
        else:
            break
    return at


def _typed_method(items: list[Token], language: str) -> tuple[int, str, str] | None:
    """A method with a type: (type) name (parameters); constructors and operators have no type of their own."""
    arrow = next((i for i, t in enumerate(items) if t.text == "=>"), len(items))
    items = items[:arrow]
    start = _typed_head(items, language)
    at = _after_generics(items, start)
    if at < len(items) and items[at].kind not in ("word", "()"):
        return None
    for k in range(at + 1, len(items)):
        if items[k].kind != "()":
            continue
        n = _before_generics(items, k - 1)
        kind = _texts(items[at:n])
        if n > at and items[n].kind == "word" and items[n].text not in _CONTROL and kind[0] != "record" and kind[0] not in _CONTROL and not {"operator", "delegate", "=", "event"} & set(_texts(items[:k])):
            return items[0].begin, "method", items[n].text.removeprefix("@")
        if n >= at and items[k - 1].kind == "word":
            return None
    return None


def _typed(body: _Body, language: str):
    items = body.items
    texts = _texts(items)
    at = _typed_head(items, language)
    word, name = _named(items, at), _named(items, at + 1)
    if word in ("class", "interface") and name:
        return "class", (items[0].begin, "class", name), False
    if word == "record" and name and ("()" in [t.kind for t in items[at:]] or language == "csharp"):
        return "class", None, False
    if word == "struct" and name and language == "csharp":
        return "class", None, False
    if word == "enum" and name:
        return "enum" if language == "java" else "types", None, False
    if texts[at : at + 2] == ["@", "interface"]:
        return "types", None, False
    if language == "java" and "new" in texts and items[-1].kind == "()":
        return "class", None, True  # a class without a name
    if body.what in ("class", "enum") and "=" not in texts:
        if "=>" not in texts and (declared := _typed_method(items, language)):
            return "block", declared, False
        if body.what == "enum" and word:
            return "class", None, False
    return "block", None, body.sign != "{" and body.what != "top" or any(t in ("=", "=>", "return") for t in texts)


def _c(body: _Body, language: str):
    items = body.items
    while len(items) > 1 and (items[1].text == ":" and items[0].text in ("public", "private", "protected")):
        items = items[2:]
    if items and items[0].text == "template":
        items = items[_after_generics(items, 1) :]
    if len(items) > 1 and items[0].text == "extern" and items[1].kind == "string":
        items = items[2:]
    texts = _texts(items)
    if not items or texts[0] == "namespace" or texts[:2] == ["inline", "namespace"]:
        return "outer" if body.what in ("top", "outer") else "block", None, False
    if "=" in texts or texts[-1] in _EXPRESSION and texts[-1] != ":" and texts[-1] != "->":
        return "block", None, True
    types = [i for i, t in enumerate(texts) if t in (("class", "struct") if language == "cpp" else ("struct",)) and not (i and texts[i - 1] == "enum")]
    first = next((k for k, t in enumerate(items) if t.kind == "()" and k and (items[k - 1].kind == "word" and not items[k - 1].text.startswith(("__", "alignas", "decltype", "noexcept", "throw")) or "operator" in texts[:k])), None)
    if types and (first is None or types[-1] > first):
        at = types[-1] + 1
        while at + 1 < len(items) and items[at].text.startswith(("__", "alignas")) and items[at + 1].kind == "()":
            at += 2
        if name := _named(items, at):
            return "class", (items[types[-1]].begin, "class", name), False
    if (types and first is None) or texts[0] in ("enum", "union", "typedef"):
        return ("class" if "union" in texts or types else "types"), None, False
    if first is None or body.what not in ("top", "outer", "class") or body.sign == "(":
        return "block", None, body.sign == "("
    if ":" in texts[first:] and items[-1].kind == "word":
        return "block", None, True  # a member that is set in braces, before the body
    start = texts.index("operator") if "operator" in texts[:first] else first - 1
    name, lead = "".join(texts[start:first]), start
    while lead and texts[lead - 1] in ("::", "~"):
        begin = lead - 1 if texts[lead - 1] == "~" else max(0, _before_generics(items, lead - 2))
        name, lead = "".join(texts[begin:lead]) + name, begin
    own = body.what == "class" or "::" in name
    if texts[start] in _CONTROL or (not lead and not own):
        return "block", None, False
    return "block", (items[0].begin, "method" if own else "function", name), False


def _opened(body: _Body, language: str):
    """What a brace begins: the kind of its body, what is declared (begin, kind, name), and whether the statement goes on."""
    if body.what == "none":
        return "none", None, False
    if language in ("javascript", "typescript"):
        return _script(body, language == "typescript")
    if language in ("java", "csharp"):
        return _typed(body, language)
    return _go(body) if language == "go" else _rust(body) if language == "rust" else _c(body, language)


def _ended(body: _Body, language: str) -> tuple[int, str, str] | None:
    """What a statement without a body declares, when it ends."""
    items = body.items
    if language == "go":
        if body.what == "group" and _named(items, 0) and len(items) > 1 and items[1].text != "=":
            return items[0].begin, "class", items[0].text
        if items and items[0].text == "type" and _named(items, 1) and len(items) > 2 and items[2].text != "=":
            return items[0].begin, "class", items[1].text
    if language == "rust" and items and body.what != "none":
        return _rust(body, True)[1]
    if language in ("java", "csharp") and body.what in ("class", "enum"):
        arrow = next((i for i, t in enumerate(items) if t.text == "=>"), len(items))
        if "=" not in _texts(items[:arrow]):
            return _typed_method(items, language)
    return None


def declarations(text: str, language: str) -> list[tuple[int, int, str, str]]:
    """begin, end, kind (function, method or class) and name of each declaration, by begin, then end.

    Interfaces, structs, traits and types are classes; an impl block is a class named impl. Of Go's grouped types each is
    one. In a svelte file the scripts are read."""
    if language == "svelte":
        found = []
        for m in _SCRIPT.finditer(text):
            inner = "typescript" if re.search(r"lang\s*=\s*[\"']?(?:ts|typescript)\b", m.group(1)) else "javascript"
            found += [(a + m.start(2), b + m.start(2), kind, name) for a, b, kind, name in declarations(m.group(2), inner)]
        return found
    found: dict[tuple[int, int], tuple[str, str]] = {}
    stack = [_Body("", None, "top")]

    def emit(declared: tuple[int, str, str] | None, end: int) -> None:
        if declared:
            found.setdefault((declared[0], end), declared[1:])

    def close(end: int, pair: str) -> None:
        body, outer = stack.pop(), stack[-1]
        if body.items and language == "go":
            emit(_ended(body, language), body.items[-1].end)
        emit(body.declared, end)
        if body.sign == "{" and not body.goes_on:
            outer.items.clear()
        else:
            outer.items.append(Token(pair, text[body.begin : end] if pair == "[]" and end - body.begin < 100 else pair, body.begin, end, body.first))

    for token in tokens(text, language):
        body = stack[-1]
        if token.kind != "sign":
            sign = ""
        else:
            sign = token.text
        if language == "go" and token.first and body.items and body.sign != "[" and (body.sign != "(" or body.what == "group") and (body.items[-1].kind != "sign" or body.items[-1].text in ("++", "--")) and body.items[-1].text != "func":
            emit(_ended(body, language), body.items[-1].end)
            body.items.clear()
        if sign in ("(", "["):
            what = "group" if language == "go" and sign == "(" and _texts(body.items) == ["type"] else "none" if body.what == "none" or language == "rust" and body.items and body.items[-1].text == "!" else "inner"
            stack.append(_Body(sign, token, what))
        elif sign == "{":
            what, declared, goes_on = _opened(body, language)
            stack.append(_Body("{", token, what, declared, goes_on))
        elif sign in (")", "]", "}"):
            opener = {")": "(", "]": "[", "}": "{"}[sign]
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].sign == opener), 0)
            if depth and (sign == "}" or all(b.sign != "{" for b in stack[depth + 1 :])):
                while len(stack) - 1 > depth:
                    close(token.begin, "")
                close(token.end, opener + sign)
        elif sign == ";" and (body.sign not in ("(", "[") or body.what == "group"):
            emit(_ended(body, language), body.items[-1].end if language == "go" and body.items else token.end)
            body.items.clear()
        elif sign == "," and (body.sign in ("(", "[") and body.what != "group" or body.what in ("object", "enum")):
            body.items.clear()
        else:
            body.items.append(token)
        if len(body.items) > LONGEST:  # no head is so long, and each brace looks at what is before it
            body.items[: LONGEST // 2] = [Token("sign", "…", token.begin, token.begin, False)]
    while len(stack) > 1:
        close(len(text), "")
    if language == "go":
        emit(_ended(stack[0], language), stack[0].items[-1].end if stack[0].items else len(text))
    return [(a, b, kind, name) for (a, b), (kind, name) in sorted(found.items())]
