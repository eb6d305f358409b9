"""Tokens of program text: words, strings and signs, without comments, each with its place.

Only what decides where declarations begin and end is told apart: strings of every form a language has, also those with
code in them, comments, nested ones too, characters, regular expressions and preprocessor lines.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LANGUAGES = ("javascript", "typescript", "go", "rust", "java", "csharp", "c", "cpp")
_LINE, _BLOCK, _WORD, _NUMBER = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"[^\W\d]\w*", r"\d[\w.]*"
_PLAIN = r'"(?:\\.|[^"\\\n])*"?'
_CHARACTER = r"'(?:\\[^\n]|[^'\\\n])[^'\n]{0,9}'"
_SIGN = r"=>|->|::|[=!<>]=|&&|\|\||\+\+|--|[-+*/%&|^]=|\S"
#: What is passed over, strings and words of a language, in the order in which they are tried; signs come last.
FORMS = {
    "javascript": (f"{_LINE}|{_BLOCK}", rf"{_PLAIN}|'(?:\\.|[^'\\\n])*'?", rf"\#?[\w$]+|{_NUMBER}"),
    "go": (f"{_LINE}|{_BLOCK}", rf"{_PLAIN}|`[^`]*`?|{_CHARACTER}", f"{_WORD}|{_NUMBER}"),
    "rust": (_LINE, rf'b?r(?P<hashes>\#*)".*?(?:"(?P=hashes)|\Z)|b?"(?:\\.|[^"\\])*"?|b?\'(?:\\[^\n][^\'\n]{{0,9}}|[^\'\\\n])\'', rf"'?(?:r\#)?{_WORD}|{_NUMBER}"),
    "java": (f"{_LINE}|{_BLOCK}", rf'"""(?:\\.|[^\\])*?(?:"""|\Z)|{_PLAIN}|{_CHARACTER}', f"{_WORD}|{_NUMBER}"),
    "csharp": (f"{_LINE}|{_BLOCK}", rf'\$*(?P<quotes>"{{3,}}).*?(?:(?P=quotes)|\Z)|@"(?:""|[^"])*"?|{_PLAIN}|{_CHARACTER}', f"@?{_WORD}|{_NUMBER}"),
    "c": (f"{_LINE}|{_BLOCK}", f"{_PLAIN}|{_CHARACTER}", rf"{_WORD}|\d[\w.']*"),
    "cpp": (f"{_LINE}|{_BLOCK}", rf'(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{{0,16}})\(.*?(?:\)(?P=mark)"|\Z)|{_PLAIN}|{_CHARACTER}', rf"{_WORD}|\d[\w.']*"),
}
FORMS["typescript"] = FORMS["javascript"]
_MATCH = {name: re.compile(rf"(?P<skip>{skip})|(?P<string>{string})|(?P<word>{word})|(?P<sign>{_SIGN})", re.S | re.M) for name, (skip, string, word) in FORMS.items()}
_DIRECTIVE = re.compile(r"#(?:\\\r?\n|[^\n])*")
_INTERPOLATED = re.compile(r'(\$@|@\$|\$)"(?!"")')
_SPACE = re.compile(r"\s*")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_NESTED = re.compile(r"/\*|\*/")
#: Words after which a / begins a regular expression in JavaScript; after other words it divides.
_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "do", "else", "yield", "await")


class Token(NamedTuple):
    """kind is word, string, sign or a pair of brackets that closed; first: whether it is the first in its line."""

    kind: str
    text: str
    begin: int
    end: int
    first: bool


def _filled(text: str, at: int, language: str, close: str, hole: str, escape: str = r"\\.") -> int:
    """The end of a string whose content begins at a place and may hold code, also strings, in holes."""
    step = re.compile(rf"{escape}|\{{\{{|{re.escape(close)}|{re.escape(hole)}" if hole == "{" else rf"{escape}|{re.escape(close)}|{re.escape(hole)}", re.S)
    while m := step.search(text, at):
        at = m.end()
        if m.group() == close:
            return at
        if m.group() == hole:
            depth = 1
            for token in tokens(text, language, at):
                depth += {"{": 1, "}": -1}.get(token.text, 0) if token.kind == "sign" else 0
                at = token.end
                if not depth:
                    break
    return len(text)


def _special(text: str, at: int, language: str, last: Token | None) -> int | None:
    """The end of a string that one pattern doesn't describe: with holes, or a regular expression."""
    if language in ("javascript", "typescript"):
        if text[at] == "`":
            return _filled(text, at + 1, language, "`", "${")
        if text[at] == "/" and not text.startswith(("//", "/*"), at) and (last is None or (last.kind == "sign" and last.text not in (")", "]", "}")) or last.text in _BEFORE_REGEX):
            m = _REGEX.match(text, at)
            return m.end() if m else None
    if language == "csharp" and (m := _INTERPOLATED.match(text, at)):
        return _filled(text, m.end(), language, '"', "{", r"\\." if m.group(1) == "$" else '""')
    return None


def _past_comment(text: str, at: int) -> int:
    """The end of a comment that may hold comments."""
    depth = 0
    while m := _NESTED.search(text, at):
        depth, at = depth + (1 if m.group() == "/*" else -1), m.end()
        if not depth:
            return at
    return len(text)


def tokens(text: str, language: str, at: int = 0):
    """The tokens of text from a place on."""
    match, last, size = _MATCH[language].match, None, len(text)
    script, directives, holes = language in ("javascript", "typescript"), language in ("c", "cpp", "csharp"), language == "csharp"
    while (at := _SPACE.match(text, at).end()) < size:
        first, sign = last is None or text.find("\n", last.end, at) >= 0, text[at]
        if sign == "#" and first and directives:
            at = _DIRECTIVE.match(text, at).end()
        elif sign == "/" and text.startswith("/*", at):  # found as a whole, not sign by sign
            at = _past_comment(text, at) if language == "rust" else text.find("*/", at + 2) + 2
            if at == 1:
                return
        elif (script and sign in "`/" or holes and sign in "$@") and (end := _special(text, at, language, last)):
            last = Token("string", text[at:end], at, end, first)
            yield last
            at = end
        else:
            m = match(text, at)
            at = m.end()
            kind = m.lastgroup
            if kind != "skip":
                last = Token(kind, m.group(), m.start(), at, first)
                yield last
