"""Text functions: checksums, token estimates, summaries, file languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffix to language.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".pyx": "python", ".pyi": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h++": "cpp",
    ".cs": "csharp", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".rb": "ruby", ".php": "php",
    ".swift": "swift", ".svelte": "svelte", ".vue": "vue", ".md": "markdown", ".markdown": "markdown",
}
#: Languages that are cut by their structure, and how; all others are cut as text.
CHUNKERS = {
    "python": "python_ast", "javascript": "tree_sitter", "typescript": "tree_sitter", "go": "tree_sitter", "rust": "tree_sitter",
    "java": "tree_sitter", "c": "tree_sitter", "cpp": "tree_sitter", "csharp": "tree_sitter", "svelte": "tree_sitter",
}


def stripped(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def path_id(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(16))


def scope_folder(repo_path: Column, file_path: Column) -> Column:
    """Where a memory's repository is looked for: the path given, else the folder of an absolute file path, else null."""
    return F.coalesce(F.nullif(repo_path, F.lit("")),
        F.when(file_path.startswith("/"), F.nullif(F.regexp_replace(file_path, "/[^/]*$", ""), F.lit(""))),
        F.when(file_path.rlike("^/[^/]*$"), F.lit("/")))


def tokens(text: Column) -> Column:
    """Estimated tokens (a fixed rule): a token for each four characters begun."""
    return F.floor((F.length(text) + 3) / 4).cast("int")


def fits(text: Column, budget: int) -> Column:
    return tokens(text) <= budget


def truncated(text: Column, budget: int) -> Column:
    """At most budget tokens; the cut text ends with its last whole sentence, if it has one."""
    parts = F.split(F.left(text, F.lit(4 * budget)), r"[.!?]\s+", -1)
    whole = F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), ". "), F.lit("."))
    return F.when(tokens(text) <= budget, text).when(F.size(parts) > 1, whole).otherwise(F.left(text, F.lit(4 * budget)))


def one_line(text: Column) -> Column:
    sentence = stripped(F.regexp_extract(text, r"^[^.!?]+[.!?]", 0))
    short = stripped(text)
    return F.when(F.length(sentence).between(1, 100), sentence).when(F.length(short) <= 100,
        short).otherwise(F.concat(stripped(F.left(text, F.lit(97))), F.lit("...")))


def detailed(text: Column, least: int = 200, budget: int = 500) -> Column:
    """The first paragraph within a budget, for texts of more than least tokens; else null."""
    return F.when(tokens(text) > least, truncated(F.element_at(F.split(text, "\n\n"), 1), budget))


def chunk_type(function_name: Column, class_name: Column) -> Column:
    return F.when(F.coalesce(function_name, F.lit("")) != "", "function").when(F.coalesce(class_name, F.lit("")) != "", "class").otherwise("text")


def language(path: Column) -> Column:
    """Language of a file by its last suffix; null if unknown."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[suffix]


def chunker(language: Column) -> Column:
    """How files of a language are cut: python_ast, tree_sitter (by declarations) or text."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in CHUNKERS.items() for x in pair])[language], F.lit("text"))


def is_code(path: Column) -> Column:
    """Whether a file's language is known."""
    return language(path).isNotNull()


def supported(files):
    """suffix, language, chunker, files: all suffixes that are known, and how many of files (path) have each."""
    rows = files.sparkSession.createDataFrame(sorted(LANGUAGES.items()), "suffix string, language string")
    suffix = F.lower(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1))
    counts = files.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("files"))
    return rows.join(counts, "suffix", "left").select("suffix", "language", chunker(F.col("language")).alias("chunker"), F.coalesce("files", F.lit(0)).alias("files"))


# The templates of decisions and of session notes.
def decision(problem: Column, alternatives: Column, chosen: Column, rationale: Column, outcome: Column) -> Column:
    bullets = F.array_join(F.transform(alternatives, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("## Problem\n"), problem, F.lit("\n\n## Alternatives\n"), bullets, F.lit("\n\n## Chosen\n"), chosen,
        F.lit("\n\n## Rationale\n"), rationale, F.lit("\n\n## Outcome\n"), F.coalesce(outcome, F.lit("TBD")))


def session_note(branch: Column, summary: Column, at: Column) -> Column:
    return F.concat(F.lit("## Session — "), F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" ["), F.coalesce(branch, F.lit("unknown")), F.lit("]\n\n"),
        summary)


#: What counts as a secret: name and pattern.
SECRETS = (
    ("assignment", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\s*[:=]\s*["'][^"'\s]{8,}["']"""),
    ("access key", r"AKIA[0-9A-Z]{16}"),
    ("private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("bearer", r"(?i)bearer\s+[A-Za-z0-9._-]{20,}"),
)


def has_secrets(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for _, p in SECRETS))


def sanitised(text: Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, rule[1], "[REDACTED]"), SECRETS, text)


def findings(text: Column) -> Column:
    """rule, begin, end (in characters, end exclusive) of all secrets, by begin; a place that several rules find is given for each."""

    def places(rule: str, pattern: str) -> Column:
        # What lies between two matches, and the matches: their lengths, added up, are the places.
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("all"))
        step = lambda done, x: F.struct((done["at"] + x["gap"] + x["own"]).alias("at"), F.concat(done["all"],
            F.array(F.struct((done["at"] + x["gap"]).alias("begin"), (done["at"] + x["gap"] + x["own"]).alias("end")))).alias("all"))
        spans = F.aggregate(sizes, start, step, lambda done: done["all"])
        return F.transform(spans, lambda p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), F.lit(rule).alias("rule")))

    return F.array_sort(F.concat(*(places(*rule) for rule in SECRETS)))


#: What a transcript loses before its code fences are cut, and after.
NOISE = (r"(?s)(?:assistant:\s*)?<tool_use>.*?</tool_use>|<tool_result>.*?</tool_result>",
    r"Relevant memories from previous sessions:\n(?:- \[.*\].*\n?)+", r"(?s)<system-reminder>.*?</system-reminder>")
PROGRESS = r"[▓░█▌▐]{3,}|\.{6,}|={5,}>?"


def compressed(text: Column) -> Column:
    """A transcript without tool blocks, injected context, reminders, progress bars and runs of empty lines; long fences keep both ends."""
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(fences_cut(text), PROGRESS, "")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def fences_cut(text: Column, most: int = 30, ends: int = 5) -> Column:
    """Code fences of more than most lines keep their first and last lines."""
    parts = F.split(text, "```", -1)

    def cut(part: Column, i: Column) -> Column:
        lines = F.split(F.regexp_replace(part, r"^[^\n]*\n|\n$", ""), "\n", -1)
        short = F.concat_ws("\n", F.lit(""), F.slice(lines, 1, ends),
            F.concat(F.lit("... "), (F.size(lines) - 2 * ends).cast("string"), F.lit(" lines omitted ...")),
            F.slice(lines, F.size(lines) - ends + 1, ends), F.lit(""))
        closed = (i % 2 == 1) & (i < F.size(parts) - 1)
        return F.when(closed & (F.size(lines) > most), short).otherwise(part)

    return F.array_join(F.transform(parts, cut), "```")
