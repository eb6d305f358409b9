"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is cut greedily into the longest phrases that
occur in a language's training text (Ziv and Merhav's cross-parsing): one step of the automaton a character, and
a new phrase wherever the automaton has no way on. Phrases, times the bits that point to one phrase of the
training text, over characters estimate the cross entropy; the language needing fewest such bits wins.

Texts are parsed whole, blocks of BLOCK characters at once without effect on the phrases; letters are lower-cased
and runs of other characters count as one space. At most TRAIN_CHARS characters a language are learned, from about TRAIN_DOCS
documents, at least one, with the smallest hashes of id and text. Those that fit are learned whole, and the others
share the room left with their beginnings: a bound on what is learned only. Of more than LANGUAGES languages those with the
most rows are learned. The automata are hence of bounded size: an automaton whose table of states and letters would pass
CELLS is kept as its edges, and with many letters each language numbers its own.

A null text and a text without a letter get `und` and score 0, as does any text if no label was learned. Ties go
to the alphabetically first language. One row per input row; null ids and extra columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.llm import textarrays as ta
from recall_spark.llm.common import only

TRAIN_CHARS = 40_000
TRAIN_DOCS = 100
LANGUAGES = 1_000
#: Cells of a table of states and letters at most, and letters of all languages that all of them number alike.
CELLS, ALIKE = 1 << 23, 250
BLOCK = 512
#: So few blocks take their steps one by one, and bytes of text that are parsed side by side.
FEW, SLICE_BYTES = 32, 4 << 20
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("has_letter", pa.bool_())])


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new, p = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Table:
    """An automaton as a table of states and codes. A negative entry ends a phrase and holds the state after its first character."""

    def __init__(self, step: list[dict[int, int]], width: int):
        # The last row: a phrase of one character that the language doesn't have.
        begin = np.full(width, len(step) * width, np.int32)
        for c, s in step[0].items():
            begin[c] = s * width
        table = np.tile(~begin, (len(step) + 1, 1))
        table[0] = begin
        for i, edges in enumerate(step[1:], 1):
            for c, s in edges.items():
                table[i, c] = s * width
        self.table = table.ravel()

    def __getitem__(self, at):
        """The entry at a state plus a code."""
        return self.table[at]

    def to(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.table[state + code]

    def one(self):
        """The same for one state and code."""
        steps = memoryview(self.table)
        return lambda s, c: steps[s + c]


class Edges:
    """The same as its edges only: a state is a number of its own, at which (plus the code) its edges lie among those of others.

    Room grows with the edges, not with states times letters. What isn't an edge of a state ends a phrase."""

    def __init__(self, step: list[dict[int, int]], width: int):
        order = sorted(range(1, len(step)), key=lambda i: -len(step[i]))
        room = sum(map(len, step)) + len(step) + 4 * width
        owner, base, used, free = [-1] * room, [0] * (len(step) + 1), {0}, width
        owner[:width] = [0] * width  # the first state has an edge for each code
        tried: dict[int, int] = {}  # where the last state with so many edges found room: before that there is hardly any
        for i in order:
            codes = sorted(step[i]) or [0]
            at = max(free, tried.get(len(codes), 0))
            while True:
                if at + width >= len(owner):
                    owner += [-1] * (len(owner) + width)
                if owner[at] < 0:
                    here = at - codes[0]
                    if here > 0 and here not in used and all(owner[here + c] < 0 for c in step[i]):
                        break
                at += 1
            used.add(here)
            tried[len(codes)] = at
            base[i] = here
            for c in step[i]:
                owner[here + c] = here
        base[-1] = next(b for b in range(1, len(used) + 2) if b not in used)  # a phrase that the language doesn't have
        self.owner = np.array([*owner, *[-1] * (max(base) + width - len(owner))], np.int32)
        self.next = np.zeros(len(self.owner), np.int32)
        self.begin = np.full(width, base[-1], np.int32)
        for c, s in step[0].items():
            self.begin[c] = base[s]
        self.next[:width] = self.begin
        for i in order:
            for c, s in step[i].items():
                self.next[base[i] + c] = base[s]

    def to(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        at = state + code
        return np.where(self.owner[at] == state, self.next[at], ~self.begin[code])

    def one(self):
        owner, following, begin = memoryview(self.owner), memoryview(self.next), memoryview(self.begin)
        return lambda s, c: following[s + c] if owner[s + c] == s else ~begin[c]


class Languages:
    """Automata of the languages, and the codes of letters."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        joined = {lang: [t.lower() for t in texts[lang]] for lang in self.names}
        letters = sorted({c for ts in joined.values() for t in ts for c in set(t) if c.isalpha()})
        self.width = len(letters) + 3
        # 0: other than letters, 1...: letters seen in training, then letters not seen, then what parts documents.
        self.codes = np.fromiter((len(letters) + 1 if chr(i).isalpha() else 0 for i in range(0x110000)), np.int32, 0x110000)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.tables, self.bits, self.own = [], [], []
        for lang in self.names:
            all_codes: list[int] = []
            for t in joined[lang]:
                all_codes += self.encode([t])[0].tolist() + [len(letters) + 2]
            width, own = self.width, None
            if len(letters) > ALIKE:
                # Letters of this language from 1 on; all others are one letter that it doesn't have.
                seen = sorted(set(all_codes) - {0, len(letters) + 1, len(letters) + 2})
                width, own = len(seen) + 3, np.full(self.width, len(seen) + 1, np.int32)
                own[seen] = np.arange(1, len(seen) + 1)
                own[[0, len(letters) + 2]] = 0, len(seen) + 2
                all_codes = own[all_codes].tolist() if all_codes else []
            step = suffix_automaton(all_codes)
            self.tables.append((Table if (len(step) + 1) * width <= CELLS else Edges)(step, width))
            self.bits.append(np.log2(max(2, len(all_codes))))
            self.own.append(own)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of lower-cased texts in a row, codes a text, and whether a text has a letter."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum(n)
        kept = codes != 0
        seen = np.concatenate([[0], np.cumsum(kept)])
        has_letter = seen[ends] > seen[ends - n]
        kept[1:] |= codes[:-1] != 0
        begins = (ends - n)[n > 0]
        kept[begins] = True
        total = np.concatenate([[0], np.cumsum(kept)])
        return codes[kept], total[ends] - total[ends - n], has_letter

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text (row) in each language (column).

        Blocks of all texts take their steps side by side, as if each began a text. Then each takes up the state in
        which the block before it ends, until it meets the state of its own first run: from there on the two are the
        same. A block that never meets it ends otherwise, so the next one is run again. What comes out is the parse
        of the whole text, wherever blocks end."""
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        out = np.zeros((len(sizes), len(self.tables)))
        if not len(owner):
            return out
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        lane = np.empty(len(order), np.int64)  # of each block: longer ones first
        lane[order] = np.arange(len(order))
        length, begin = length[order], ((np.cumsum(sizes) - sizes)[owner] + nth * BLOCK)[order]
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), "left")
        read = np.zeros((steps, len(order)), np.int32)
        for t, n in enumerate(active):
            read[t, :n] = codes[begin[:n] + t]
        last = np.append(nth[1:] == 0, True)
        texts = np.flatnonzero(sizes)
        firsts = np.flatnonzero(nth == 0)
        after, opens = np.empty((steps, len(order)), np.int32), np.empty((steps, len(order)), np.int8)
        all_read = read
        for k, table in enumerate(self.tables):
            read = all_read if self.own[k] is None else self.own[k][all_read]
            opens[:] = 0
            state = np.zeros(len(order), np.int32)
            for t, n in enumerate(active):
                to = table.to(state[:n], read[t, :n])
                ended = to >> 31
                np.bitwise_xor(to, ended, out=state[:n])
                after[t, :n] = state[:n]
                opens[t, :n] = ended
            again = np.flatnonzero(nth > 0)
            while len(again):
                again = self._taken_up(table, again, lane, length, read, after, opens, last)
            out[texts, k] = np.add.reduceat(-opens.sum(axis=0, dtype=np.int64)[lane], firsts) + 1
        return out

    @staticmethod
    def _taken_up(table, again, lane, length, read, after, opens, last) -> np.ndarray:
        """Run blocks from where those before them end; which blocks have to be run again, because these end otherwise."""
        lanes, before = lane[again], lane[again - 1]
        state, changed, t = after[length[before] - 1, before], [], 0
        while len(lanes) > FEW:
            to = table.to(state, read[t, lanes])
            ended = to >> 31
            state = to ^ ended
            opens[t, lanes] = ended
            apart = after[t, lanes] != state
            after[t, lanes] = state
            t += 1
            done = length[lanes] == t
            changed += again[apart & done & ~last[again]].tolist()
            left = apart & ~done
            again, lanes, state = again[left], lanes[left], state[left]
        step = table.one()
        for block, i, s in zip(again.tolist(), lanes.tolist(), state.tolist()):
            end = int(length[i])
            states, flags = [], []
            for c, known in zip(read[t:end, i].tolist(), after[t:end, i].tolist()):
                s = step(s, c)
                flags.append(-1 if s < 0 else 0)
                s = ~s if s < 0 else s
                states.append(s)
                if s == known:
                    break
            else:
                if not last[block]:
                    changed.append(block)
            after[t : t + len(states), i], opens[t : t + len(states), i] = states, flags
        return np.array(sorted(changed), np.int64) + 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether it has a letter."""
        codes, sizes, has_letter = self.encode([(t or "").lower() for t in texts])
        if not self.names or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts)), has_letter
        bits = self.phrases(codes, sizes) * np.array(self.bits) / np.maximum(sizes, 1)[:, None]
        best = bits.argmin(axis=1)
        ordered = np.sort(bits, axis=1)
        second = ordered[:, 1] if len(self.names) > 1 else ordered[:, 0] * np.inf
        score = np.where(has_letter, 1 - np.divide(ordered[:, 0], second, out=np.ones(len(texts)), where=second > 0), 0.0)
        return [self.names[b] if ok else "und" for b, ok in zip(best, has_letter)], score, has_letter


def learn(docs: DataFrame, usable: Column, train_chars: int = TRAIN_CHARS, train_docs: int = TRAIN_DOCS) -> Languages:
    """Automata from the rows of docs (text, lang, doc_id) where usable holds."""
    rows = docs.where(usable).where("lang is not null and text is not null").select("doc_id", "lang", "text")
    order = F.xxhash64("doc_id", "text", F.lit(17))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(order).alias("least")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Languages({})
    # The smallest hash is drawn however small the share is.
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]),
        F.lit(max(r["least"], min((1 << 63) - 1, (1 << 64) * train_docs // r["n"] - (1 << 63)))))])
    excerpt = F.substring("text", 1, train_chars + 1).alias("text")
    drawn = rows.where(order <= limit[F.col("lang")]).select("lang", excerpt, order.alias("at")).dropDuplicates(["lang", "at"]).collect()
    texts: dict[str, list[str]] = {}
    longer: dict[str, list[str]] = {}
    room = {r["lang"]: train_chars for r in sizes}
    for r in sorted(drawn, key=lambda r: r["at"]):
        if len(r["text"]) <= room[r["lang"]]:
            room[r["lang"]] -= len(r["text"])
            texts.setdefault(r["lang"], []).append(r["text"])
        else:
            longer.setdefault(r["lang"], []).append(r["text"])
    for lang, those in longer.items():
        each = max(BLOCK, room[lang] // len(those))
        for text in those[: -(-room[lang] // each)]:
            texts.setdefault(lang, []).append(text[: min(each, room[lang])])
            room[lang] -= len(texts[lang][-1])
    return Languages(texts)


def _predicted(sent):
    def run(batches):
        model = sent.value
        for batch in batches:
            names, scores, letters = [], [], []
            for _, part in ta.slices(batch.column("text"), lower=False, size=SLICE_BYTES):
                found, score, has_letter = model.predict(part.to_pylist())
                names += found
                scores.append(score)
                letters.append(has_letter)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(names, pa.string()),
                pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(letters) if letters else [], pa.bool_())],
                schema=_OUT)

    return run


def examined(docs: DataFrame, held_out: Column, **bounds: int) -> DataFrame:
    """identify() and whether a document has a letter."""
    rows = only(docs, "doc_id", "text", "lang").withColumn("held_out", held_out)
    sent = docs.sparkSession.sparkContext.broadcast(learn(rows, ~F.col("held_out"), **bounds))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predicted(sent),
        "doc_id long, held_out boolean, lang_pred string, score double, has_letter boolean")


def identify(docs: DataFrame, held_out: Column, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learned from the rows that are not held out."""
    return examined(docs, held_out, **bounds).drop("has_letter")
