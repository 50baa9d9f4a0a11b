"""Secret scans: patterns and sliding-window Shannon entropy, as column expressions.

Three patterns (assignments to password-like names, access keys, long lower-case hex)
find the obvious secrets.  Beside them each character class looks at its candidate
strings, the longest runs of its characters of at least one window, and slides a window
over them.  The window's counts of each character are kept up to date: one character
enters, one leaves, and the sum of c * log2(c) over the counts c changes by four table
entries.  The window's entropy is log2(W) - sum / W bits a character, so the window is hot
when that sum is at most W * (log2(W) - least bits).  Touching hot windows make one span.
Candidates that an allow pattern matches whole (words, slugs, plain numbers, UUIDs,
documentation keys ...) are left alone; the allow list never suppresses a pattern's span.

Everything is Spark SQL expressions over one row: no shuffle, no Python.  Long candidates
are scored in blocks of windows and long match lists are summed in blocks, so the time
for a text grows with its length.  Sums are integers (c * log2(c) in millionths), so
verdicts do not hang on the order of additions.

Defined results: a null or empty text has no spans; null ids and repeated rows each give
a row; positions are code points from 0, ends exclusive; spans of different kinds may
overlap, those of one kind do not; spans sort by start, then kind as listed, then end; an
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import let, text_of

NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}     # characters: of an assignment its value, else the whole match
BLOCK = 128                                         # windows (or matches) handled in one piece
SCALE = 1_000_000


class CharClass(NamedTuple):
    """A character class: the kind of its spans, its characters, the window's length and least bits a character."""
    kind: str
    chars: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return "[" + "".join(f"\\{c}" if c in "-+/_" else c for c in self.chars) + f"]{{{self.window},}}"

    @property
    def table(self) -> list[int]:
        """c * log2(c) in millionths, for counts 0 to window."""
        return [round(SCALE * c * math.log2(c)) if c else 0 for c in range(self.window + 1)]

    @property
    def limit(self) -> int:
        """The greatest sum of table entries that a hot window has."""
        return math.floor(SCALE * self.window * (math.log2(self.window) - self.bits))


DIGITS, UPPERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("entropy_hex", DIGITS + "ABCDEF", 16, 2.75),
    CharClass("entropy_base36", DIGITS + UPPERS.lower(), 20, 3.4),
    CharClass("entropy_base64", UPPERS + UPPERS.lower() + DIGITS + "+/-_", 20, 3.75),
)
#: Candidates matched whole by one of these are not secrets.
ALLOW = (
    "[A-Za-z]?[a-z]+", "[A-Z]+", "[0-9]+",                                # words, numbers
    "[A-Za-z]?[a-z]+([-_/+][A-Za-z]?[a-z]+)*[-_/]?",                      # slugs and paths of words
    "[a-z]+[0-9]{1,4}",                                                   # words with a number
    "[0-9a-f]+",                                                          # lower-case hex has a pattern of its own
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "([0-9]+[-/_])+[0-9]+",                                               # dates, phone and account numbers
    "AKIA[A-Z0-9]+", "[-_/+]+",                                           # keys found by their pattern; rules of signs
    ".*(EXAMPLE|example|0123456789|abcdefghijklmnop|ABCDEFGHIJKLMNOP).*",  # documentation values and alphabets
)


def prefix_sums(steps: Column) -> Column:
    """Inclusive running totals of an array of longs, block by block."""
    def block(s: Column, b: Column) -> Column:
        return F.slice(s, b * BLOCK + 1, BLOCK)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def running(part: Column, at: Column) -> Column:
        start = F.struct(at.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"] + x).alias("out")),
                           lambda a: a["out"])

    def whole(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: total(block(s, b)))
        before = let(totals, lambda t: running(t, F.lit(0).cast("long")))
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda b: running(
            block(s, b), F.when(b == 0, F.lit(0).cast("long")).otherwise(F.get(at, b - 1))))))

    return F.when(F.size(steps) <= BLOCK, running(steps, F.lit(0).cast("long"))).otherwise(let(steps, whole))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, none empty: array of (start, body)."""
    def place(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.char_length(F.get(gaps, i)) + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0)).cast("long"))
        return F.zip_with(prefix_sums(steps), found, lambda s, m: F.struct(s.alias("start"), m.alias("body")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(
        "array<struct<start: bigint, body: string>>")).otherwise(let(F.split(text, pattern, -1), lambda gaps: place(found, gaps))))


def none() -> Column:
    return F.array().cast("array<struct<start: bigint, rank: int, end: bigint>>")


def _span(start: Column, rank: int, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"))


def pattern_spans(text: Column, kind: str, rank: int) -> Column:
    """Spans of one of the three patterns."""
    pattern, hint = {"assign": (ASSIGN, NAMES), "access": (ACCESS, "AKIA"), "hex": (HEX, f"[0-9a-f]{{{LEAST['hex']}}}")}[kind]
    if kind == "hex":       # a run that is long enough is matched whole, so the short ones need not be listed
        pattern = f"[0-9a-f]{{{LEAST['hex']},}}"
    size = (lambda m: F.char_length(F.regexp_extract(m["body"], ASSIGN, 2))) if kind == "assign" else (lambda m: F.char_length(m["body"]))
    found = F.filter(matches(text, pattern), lambda m: size(m) >= LEAST[kind])
    return F.when(text.rlike(hint), F.transform(found, lambda m: _span(m["start"], rank, m["start"] + F.char_length(m["body"])))).otherwise(none())


def hot_windows(run: Column, kind: CharClass) -> Column:
    """Starts of the hot windows of a string of the class's characters, in order."""
    w, table = kind.window, F.array(*[F.lit(x).cast("long") for x in kind.table])

    def scored(piece: Column) -> Column:
        codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(kind.chars), c) - 1)

        def slide(code: Column, f: Column) -> Column:
            first = F.slice(code, 1, w)
            counts = F.transform(F.sequence(F.lit(0), F.lit(len(kind.chars) - 1)), lambda c: F.size(F.filter(first, lambda x: x == c)))

            def state(counts: Column, total: Column, hits: Column, at: Column) -> Column:
                return F.struct(counts.alias("counts"), total.alias("total"),
                                F.when(total <= kind.limit, F.array_append(hits, at)).otherwise(hits).alias("hits"))

            def step(a: Column, i: Column) -> Column:
                leaves, enters, c = F.get(code, i - 1), F.get(code, i + w - 1), a["counts"]
                moved = F.transform(c, lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int"))
                n, m = F.get(c, leaves), F.get(c, enters)
                total = a["total"] - F.get(f, n) + F.get(f, n - 1) - F.get(f, m) + F.get(f, m + 1)
                same = leaves == enters
                return state(F.when(same, c).otherwise(moved), F.when(same, a["total"]).otherwise(total), a["hits"], i)

            total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, n: a + F.get(f, n))
            start = let(counts, lambda c: state(c, total(c), F.array().cast("array<int>"), F.lit(0)))
            later = F.when(F.size(code) > w, F.sequence(F.lit(1), F.size(code) - w)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(later, start, step, lambda a: a["hits"])

        return let(codes, lambda code: let(table, lambda f: slide(code, f)))

    blocks = F.sequence(F.lit(0), F.floor((F.char_length(run) - w) / BLOCK).cast("int"))
    return F.flatten(F.transform(blocks, lambda b: F.transform(scored(F.substring(run, b * BLOCK + 1, F.lit(BLOCK + w - 1))), lambda i: i + b * BLOCK)))


def entropy_spans(text: Column, kind: CharClass, rank: int, allow: Sequence[str]) -> Column:
    """Spans of touching hot windows in the candidates that the allow list does not cover."""
    w, allowed = kind.window, "^(" + "|".join(allow) + ")$"

    def joined(m: Column, hits: Column) -> Column:
        firsts = F.filter(hits, lambda x, i: (i == 0) | (x - F.get(hits, i - 1) > w))
        lasts = F.filter(hits, lambda x, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1) - x > w))
        return F.zip_with(firsts, lasts, lambda a, b: _span(m["start"] + a, rank, m["start"] + b + w))

    candidates = matches(text, kind.pattern)
    if allow:
        candidates = F.filter(candidates, lambda m: ~m["body"].rlike(allowed))
    spans = F.flatten(F.transform(candidates, lambda m: let(hot_windows(m["body"], kind), lambda hits: joined(m, hits))))
    return F.when(text.rlike(kind.pattern), spans).otherwise(none())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: Sequence[CharClass] = CLASSES,
         allow: Sequence[str] = ALLOW) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end)."""
    for c in classes:
        if c.window < 2 or len(set(c.chars)) != len(c.chars) or not c.chars.isascii() or set(c.chars) & set("]\\^[&"):
            raise ValueError(f"class {c.kind}: a window of 2 or more, distinct ASCII characters, none of ] [ ^ & or a backslash")
    kinds = [*LEAST, *[c.kind for c in classes]]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    t = F.col("text")
    found = [*[pattern_spans(t, k, i) for i, k in enumerate(LEAST)],
             *[entropy_spans(t, c, len(LEAST) + i, allow) for i, c in enumerate(classes)]]
    rows = rows.select("doc_id", F.sort_array(F.concat(*found)).alias("found"))
    names = F.array(*[F.lit(k) for k in kinds])
    return rows.select("doc_id", F.transform("found", lambda s: F.struct(
        F.get(names, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def shown(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
