"""Cutting files into chunks: Python by its syntax, other languages by declarations and braces, text by sentences."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.operators import declarations, lexing

SCHEMA = "path string, language string, chunk_text string, line_start int, line_end int, kind string, name string, parent string, docstring string, decorators array<string>"
MAX_TOKENS, OVERLAP_TOKENS = 500, 50

#: Languages that are cut by their declarations.
STRUCTURED = (*lexing.LANGUAGES, "svelte")


def tokens(text: str) -> int:
    return (len(text) + 3) // 4


def python_chunks(text: str):
    """Functions, methods and classes, nested ones too; a class comes whole, and its methods again."""
    lines = text.split("\n")
    level = [ast.parse(text)]
    while level:
        inner = []
        for node in level:
            inner += ast.iter_child_nodes(node)
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                names = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
                decorators = [n.id if isinstance(n, ast.Name) else n.attr for n in names if isinstance(n, (ast.Name, ast.Attribute))]
                parent = None
                if isinstance(node, ast.ClassDef):
                    kind = "class"
                    parent = next((b.id for b in node.bases if isinstance(b, ast.Name)), None)
                else:
                    kind = "method" if node.args.args and node.args.args[0].arg in ("self", "cls") else "function"
                yield "\n".join(lines[node.lineno - 1 : node.end_lineno]), node.lineno, node.end_lineno, kind, node.name, parent, ast.get_docstring(node), decorators
        level = inner


def brace_chunks(text: str, language: str):
    """Declarations, also those within others, by where they begin."""
    newlines = [m.start() for m in re.finditer("\n", text)]
    for begin, end, kind, name in declarations.declarations(text, language):
        yield text[begin:end], bisect_right(newlines, begin - 1) + 1, bisect_right(newlines, end - 1) + 1, kind, name, None, None, []


def text_chunks(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS):
    """Sentences packed up to most tokens; the last two are repeated in the next chunk if they are short.

    A sentence of more tokens ends the chunk before it and is cut by lines, which are packed on their own."""
    pack: list[str] = []
    used = 0
    first = line = 1
    made = False

    def chunk(body: str):
        nonlocal made
        made = True
        return body, first, line, "text", None, None, None, []

    for sentence in re.findall(r".*?[.!?]\s+|.+\Z", text, re.S):
        size = tokens(sentence)
        if size > most:
            if pack:
                yield chunk("".join(pack))
                pack, used, first = [], 0, line + 1
            part: list[str] = []
            taken = 0
            for row in sentence.split("\n"):
                if part and taken + tokens(row) > most:
                    yield chunk("\n".join(part))
                    part, taken, first = [], 0, line + 1
                part.append(row)
                taken += tokens(row)
                line += 1
            yield chunk("\n".join(part))
            first = line + 1
            continue
        if pack and used + size > most:
            yield chunk("".join(pack))
            kept = tokens("".join(pack[-2:]))
            pack, used = (pack[-2:], kept) if 0 < overlap >= kept else ([], 0)
            first = line
        pack.append(sentence)
        used += size
        line += sentence.count("\n")
    if pack or not made:
        yield chunk("".join(pack) or text)


def chunks_of(text: str, language: str | None) -> list[tuple]:
    """By language; whatever can't be cut that way is cut as text."""
    found = []
    try:
        if language == "python":
            found = list(python_chunks(text))
        elif language in STRUCTURED:
            found = list(brace_chunks(text, language))
    except (SyntaxError, ValueError, RecursionError):
        found = []
    return found or list(text_chunks(text))


def chunked(files: DataFrame) -> DataFrame:
    """A row for each chunk of files (path, text, language); a file is cut within its task."""

    def run(frames):
        for frame in frames:
            rows = [(p, lang, *c[:-1], list(c[-1])) for p, text,
                lang in zip(frame["path"], frame["text"], frame["language"]) if isinstance(text, str) for c in chunks_of(text,
                lang if isinstance(lang, str) else None)]
            yield pd.DataFrame(rows,
                columns=["path", "language", "chunk_text", "line_start", "line_end", "kind", "name", "parent", "docstring", "decorators"])

    return files.select("path", "text", F.col("language")).mapInPandas(run, SCHEMA)
