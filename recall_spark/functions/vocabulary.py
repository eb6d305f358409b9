"""Token counts by a vocabulary, and texts cut to a number of its tokens; without a vocabulary, by the estimate of four characters."""

from __future__ import annotations

import base64
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from recall_spark.functions import text as tx

#: How byte-level vocabularies of this kind split a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in Unicode, as the pattern has it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space longer than that are encoded as what they are, one piece: the pattern's look ahead would need too much stack.
LONGEST = 10_000
#: Token ends beyond the budget that are tried within one word.
AHEAD = 2_000
_loaded: dict[str, Vocabulary] = {}


class Vocabulary:
    """A file of ranks (base64 bytes, rank), loaded once in a process."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces, self.long = regex.compile(PATTERN), regex.compile(f"[{BLANK}]{{{LONGEST + 1},}}")

    @staticmethod
    def at(path: str) -> Vocabulary:
        if path not in _loaded:
            _loaded[path] = Vocabulary(path)
        return _loaded[path]

    def encoded(self, text: str) -> list[int]:
        """The tokens of a text. A run of white space is a piece but for its last character, if something follows."""
        out: list[int] = []
        at = 0
        for m in self.long.finditer(text) if len(text) > LONGEST else ():
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end].encode()) if end > m.start() else []
            at = end
        return out + self.encoding.encode_ordinary(text[at:])

    def truncated(self, text: str, budget: int) -> str:
        """The longest beginning of a text that ends where one of its tokens does and has at most budget tokens itself.

        A beginning can have fewer tokens than the whole text has up to there, as its last word is cut. A word of more than
        AHEAD tokens beyond the budget is only tried so far."""
        if budget <= 0 or not text:
            return ""
        if 4 * len(text) <= budget:  # a character has four bytes at most, and a token one at least
            return text
        tokens = self.encoded(text)
        if len(tokens) <= budget:
            return text
        ends = list(accumulate(len(self.encoding.decode_single_token_bytes(t)) for t in tokens))
        data = text.encode()
        # A word that begins after more than budget tokens can't be reached; the one before may join with blanks that are cut.
        last, at = len(tokens), 0
        for m in self.pieces.finditer(text[: len(data[: ends[min(len(ends), budget + AHEAD) - 1]].decode(errors="ignore")) + LONGEST]):
            begins = bisect_right(ends, at)
            if begins > budget:
                last = begins
                break
            at += len(m.group().encode())
        for j in range(min(last, budget + AHEAD, len(tokens)) - 1, -1, -1):
            end = ends[j]
            if end < len(data) and data[end] & 0xC0 == 0x80:  # within a character
                continue
            prefix = data[:end].decode()
            if j + 1 <= budget // 2 or len(self.encoded(prefix)) <= budget:
                return prefix
        return ""


def counted(text: Column, path: str | None = None) -> Column:
    """The number of tokens of a text by the vocabulary at a path that executors can open, or by the estimate."""
    if path is None:
        return tx.tokens(text)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        vocabulary = Vocabulary.at(path)
        return texts.map(lambda t: None if t is None else len(vocabulary.encoded(t))).astype("Int32")

    return count(text)


def truncated(text: Column, budget: int, path: str | None = None) -> Column:
    """At most budget tokens of a text, by the vocabulary or by the estimate (which ends with a whole sentence)."""
    if path is None:
        return tx.truncated(text, budget)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        vocabulary = Vocabulary.at(path)
        return texts.map(lambda t: None if t is None else vocabulary.truncated(t, budget))

    return cut(text)
