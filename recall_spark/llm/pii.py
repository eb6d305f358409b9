"""Personal data: candidates from high-recall generators, selected by gradient-boosted trees.

Rules find the base spans (e-mail and IP addresses, card and phone numbers), which are always redacted. Wider
generators propose spans that may overlap them and each other: address-like runs, also with `at` and `dot` written
out, and number-like runs. A candidate is described by yes/no features of its format and context. Boosted trees of
depth two learn, for each generator, which candidates are personal data; a threshold, calibrated on the half of the
documents that they were not fitted on, selects further spans at the wanted precision.

What the trees learn from is not among what they see. A candidate counts as personal data if a rule confirms it, if
it does so with its `at` and `dot` written as signs and ends in letters, or if it is a number of 9 to 19 digits next
to a word such as `phone` or `card`. Features say nothing of those words, of plus signs, of checksums, of the size of
an address' parts or of how `at` is written, so that written-out addresses and numbers without a plus are selected by
their shape and surroundings, with such a word or not.

Everything runs as built-in functions in the JVM. All candidates of all documents are counted by feature pattern;
the trees are fitted to those counts, of which there are at most 2 * 2 * 2 ** 11 for a generator whatever the
input, and are applied as an expression.

Null counts as empty; texts without matches give empty lists. Spans keep code points, end exclusive. One row per
input row, null ids and repeated rows included; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import keyed, only, save
from recall_spark.llm.spans import SPAN, joined, let, located, number_of, spans

# Possessive and anchored forms of the rules, so that long runs cost linear time; they match the same spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT, _DOT = r"\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?", r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\.)"
_LABEL = "[A-Za-z0-9-]++"
#: An address, one with its signs written out, or a name at a host.
ADDRESS_LIKE = rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@{_LABEL}(?:\.{_LABEL})++|{_AT}{_LABEL}(?:{_DOT}{_LABEL})++|\x20at\x20{_LABEL}(?:\x20dot\x20{_LABEL})++|@{_LABEL})"
NUMBER_LIKE = r"(?<![0-9])\+?\(?[0-9][0-9().\x20-]{5,}[0-9]"
#: Words that tell what a number is; what is learned from, not a feature.
HINT = r"(?:phone|tel|call|fax|mobile|cell|card|visa|contact|ip|address|number)[:.#=]?\x20*$"
KINDS = ("email", "ip", "card", "phone")
GENERATORS = ("address", "number")
#: The features of each generator's candidates.
FEATURES = (
    ("long name", "short name", "name with marks", "name with digits", "long host", "host with digits", "several labels", "upper case",
        "after a mark", "before a mark", "after a letter"),
    ("dotted groups", "nine digits", "twelve digits", "sixteen digits", "spaces", "hyphens", "dots", "brackets", "groups of four", "ends in four",
        "short first group"),
)
PRECISION = 0.9
TREES, RATE = 24, 0.5


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit counts double, less 9 above 9."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    places = F.transform(F.split(F.reverse(number), ""), value)
    return F.aggregate(places, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def parts_fit(ip: Column) -> Column:
    """Whether every part is at most 255; leading zeros don't count."""

    def fits(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))

    return F.forall(F.split(ip, r"\."), fits)


def base_spans(text: Column) -> Column:
    """The spans of the four rules, unsorted."""
    email = located(text, EMAIL, text.contains("@"))
    ip = F.filter(located(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda m: parts_fit(m["match"]))
    card = F.filter(located(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        lambda m: F.length(digits(m["match"])).between(12, 19) & luhn(digits(m["match"])))
    phone = F.filter(located(text, PHONE, text.contains("+")), lambda m: F.length(digits(m["match"])).between(9, 15))
    return F.concat(*(spans(m, kind, i) for i, (kind, m) in enumerate(zip(KINDS, (email, ip, card, phone)))))


def plain_form(address: Column) -> Column:
    """An address-like run with its signs as signs."""
    return F.regexp_replace(F.regexp_replace(address, rf"{_AT}|\x20at\x20", "@"), rf"{_DOT}|\x20dot\x20", ".")


def _bits(flags: tuple) -> Column:
    return reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)))


def _address(m: Column) -> tuple[Column, Column]:
    """The features of an address-like candidate as bits of a number, and whether it counts as personal data unless a rule says so."""
    own = plain_form(m["match"])
    name, host = F.substring_index(own, "@", 1), F.substring_index(own, "@", -1)
    flags = (
        F.length(name) >= 3, F.length(name) < 2, name.rlike("[._%+-]"), name.rlike("[0-9]"), F.length(host) >= 8, host.rlike("[0-9]"),
            host.rlike(r"\..*\."), own.rlike("[A-Z]"),
        m["before"].rlike(r"[:<(\[,;]\x20?$"), m["after"].rlike(r"^[>)\].,;!?]"), m["before"].rlike(r"\p{L}$"),
    )
    return _bits(flags), (own != m["match"]) & own.rlike(f"^(?:{EMAIL})$") & host.rlike(r"\.[A-Za-z]{2,}$")


def _number(m: Column) -> tuple[Column, Column]:
    own = F.regexp_replace(m["match"], r"^\+", "")
    n = F.length(digits(own))
    flags = (
        own.rlike(r"^[0-9]+(\.[0-9]+){3}$"), n >= 9, n >= 12, n >= 16, own.contains(" "), own.contains("-"), own.contains("."), own.rlike("[()]"),
        own.rlike(r"^[0-9]{4}([\x20-][0-9]{4})+"), own.rlike(r"(?<![0-9])[0-9]{4}$"), own.rlike(r"^\(?[0-9]{1,3}(?![0-9])"),
    )
    return _bits(flags), n.between(9, 19) & F.lower(m["before"]).rlike(HINT)


def candidates(text: Column, base: Column) -> Column:
    """Spans of the generators: begin, end, generator, pattern of features, whether a rule confirms just this span, and
    whether it counts as personal data."""
    found = [(located(text, ADDRESS_LIKE, text.rlike(r"@|\(at\)|\[at\]|\{at\}|\x20at\x20")), _address),
        (located(text, NUMBER_LIKE, text.rlike("[0-9]")), _number)]

    def described(g: int, describe):
        def run(x: Column) -> Column:
            pattern, likely = describe(x)
            return F.struct(x["begin"].alias("begin"), x["end"].alias("end"), F.lit(g).alias("generator"), pattern.alias("pattern"),
                likely.alias("likely"))

        return run

    def judged(both: Column) -> Column:
        # Sorted by place, a span that a rule confirms follows it.
        def judge(x: Column, i: Column) -> Column:
            before = F.get(both, i - 1)
            confirmed = F.coalesce((before["begin"] == x["begin"]) & (before["end"] == x["end"]) & (before["generator"] < 0), F.lit(False))
            return F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["generator"].alias("generator"), x["pattern"].alias("pattern"),
                confirmed.alias("confirmed"), (confirmed | x["likely"]).alias("personal"))

        return F.filter(F.transform(both, judge), lambda x: x["generator"] >= 0)

    rules = F.transform(base,
        lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), F.lit(-1).alias("generator"), F.lit(0).alias("pattern"),
        F.lit(False).alias("likely")))
    return let(F.sort_array(F.concat(rules, *(F.transform(m, described(g, describe)) for g, (m, describe) in enumerate(found)))), judged)


class Boosted:
    """Trees of depth two over yes/no features, (first, second, values for no/no, no/yes, yes/no, yes/yes), and a threshold."""

    def __init__(self):
        self.trees: list[tuple[int, int, list[float]]] = []
        self.threshold = math.inf

    def raw(self, patterns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(patterns))
        for a, b, values in self.trees:
            out += np.array(values)[((patterns >> a) & 1) * 2 + ((patterns >> b) & 1)]
        return out

    def fit(self, patterns: np.ndarray, yes: np.ndarray, no: np.ndarray, features: int) -> None:
        """Newton steps on the logistic loss of patterns with so many personal and other candidates."""
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-self.raw(patterns)))
            slope, bend = yes * (1 - p) - no * p, (yes + no) * p * (1 - p)
            best = None
            for a in range(features):
                for b in range(a + 1, features):
                    leaf = ((patterns >> a) & 1) * 2 + ((patterns >> b) & 1)
                    g, h = np.bincount(leaf, slope, 4), np.bincount(leaf, bend, 4)
                    gain = float((g * g / (h + 1.0)).sum())
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, a, b, (RATE * g / (h + 1.0)).tolist()
            self.trees.append(best[1:])

    def calibrate(self, patterns: np.ndarray, yes: np.ndarray, no: np.ndarray, precision: float) -> None:
        """The lowest score above which, whatever lies higher, the share of personal candidates reaches the precision."""
        score = self.raw(patterns)
        for t in np.unique(score)[::-1]:
            at = score >= t - 1e-9
            if yes[at].sum() < precision * (yes[at].sum() + no[at].sum()):
                break
            self.threshold = float(t) - 1e-9

    def selects(self, pattern: Column) -> Column:
        """Whether the score of a pattern reaches the threshold, as an expression."""

        def bit(i: int) -> Column:
            return pattern.bitwiseAND(F.lit(1 << i)) != 0

        if math.isinf(self.threshold):
            return F.lit(False)
        score = reduce(lambda x, y: x + y,
            (F.when(bit(a), F.when(bit(b), v[3]).otherwise(v[2])).otherwise(F.when(bit(b), v[1]).otherwise(v[0])) for a, b, v in self.trees),
            F.lit(0.0))
        return score >= self.threshold


def fitted(found: DataFrame, precision: float = PRECISION) -> list[Boosted]:
    """Trees and a threshold for each generator, from a table with columns doc_id and candidates."""
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")
    counts = found.select(half, F.explode("candidates").alias("c")).groupBy("half", "c.generator",
        "c.pattern").agg(F.count_if(F.col("c.personal")).alias("yes"), F.count_if(~F.col("c.personal")).alias("no"))
    rows = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 5)  # bounded by the number of patterns
    rows = rows[np.lexsort(rows.T)]
    models = []
    for g, names in enumerate(FEATURES):
        model, own = Boosted(), rows[rows[:, 1] == g]
        fit, rest = own[own[:, 0] == 0], own[own[:, 0] == 1]
        if len(fit) and len(rest):
            model.fit(fit[:, 2], fit[:, 3].astype(float), fit[:, 4].astype(float), len(names))
            model.calibrate(rest[:, 2], rest[:, 3], rest[:, 4], precision)
        models.append(model)
    return models


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, base and added (arrays of spans) of each document."""
    text = F.coalesce("text", F.lit(""))
    found = only(docs, "doc_id", "text").select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = save(found.withColumn("candidates", candidates(F.col("text"), F.col("base"))).drop("text"), "candidates")
    models = fitted(found, precision)
    more = F.filter("candidates",
        lambda c: ~c["confirmed"] & reduce(lambda a, b: a | b, ((c["generator"] == g) & m.selects(c["pattern"]) for g, m in enumerate(models))))
    added = F.transform(more,
        lambda c: F.struct(c["begin"].alias("begin"), (c["generator"] + len(KINDS)).alias("place"),
        F.when(c["generator"] == 0, F.lit(GENERATORS[0])).otherwise(F.lit(GENERATORS[1])).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", "base", added.cast(SPAN).alias("added"))


def redacted(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, text with every span, base or added, replaced by its kind in brackets. Overlapping spans are one.

    Each row has the spans of its own text replaced, also where rows share a doc_id or have none."""
    rows = keyed(only(docs, "doc_id", "text"))
    found = find(rows.select(F.col("_row").alias("doc_id"), "text"), precision).select(F.col("doc_id").alias("_of"),
        F.array_sort(F.concat("base", "added")).alias("spans")).where("size(spans) > 0")
    rows = rows.join(found, F.col("_row") == F.col("_of"), "left")

    def step(done: Column, s: Column) -> Column:
        begin, end = F.greatest(s["begin"], done["at"]), F.greatest(s["end"], done["at"])
        kept = F.substring(F.col("text"), done["at"] + 1, begin - done["at"])
        mark = F.when(s["begin"] >= done["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(end.alias("at"), F.concat(done["out"], kept, mark).alias("out"))

    folded = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(folded).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the check: counts and a hash of the base spans, and all spans as text."""
    return found.select("doc_id", *(number_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
