"""Secret scan: base patterns, and sliding-window entropy over candidate strings.

Base spans are assignments to password-like names, access keys and long hexadecimal runs. On top
of them every candidate string (a run of `MIN_RUN` or more letters, digits and joining signs) is searched per character class: within each of its runs of the class, a window of
the class's width slides over the characters, its Shannon entropy kept up to date by the counts
of the character that enters and the one that leaves. Windows at or above the class's threshold
that mix letters with two digits or more merge into spans of kind `entropy_<class>`; so do windows
with fewer digits at `MIXED_BITS` with `MIXED_CASE` letters of either case, unless their run reads
as joined words (`WORDS`). The allow list suppresses spans, not their neighbours: a span is left out
if one allowed string, standing between signs that are neither letters nor digits, covers it. So are
spans within a base span or an earlier class's span; base spans always stay.

Positions are code points, ends exclusive. Null texts count as empty; texts are read whole. A text
without secrets has an empty list of spans. Other columns pass through, but one with the output's
name is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of base spans, their patterns, and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: Character classes, the window over each, and the entropy in bits that marks a secret.
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]+"), 20, 3.0), ("base64", re.compile(r"[0-9A-Za-z+/=]+"), 20, 3.6), ("url", re.compile(r"[0-9A-Za-z_-]+"), 20, 3.6))
#: What marks a window without two digits (not of the class hex), and runs that are words.
MIXED_BITS, MIXED_CASE = 3.7, 5
WORDS = re.compile(r"[A-Z]*+(?:[a-z]{2,}+[A-Z]*+)++|(?:[A-Z]*+[a-z]*+[_/=+-]++)++[A-Z]*+[a-z]*+")  # possessive: linear
KINDS = ("assign", "access", "hex", *(f"entropy_{name}" for name, *_ in CLASSES))
#: Strings that look random but are no secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-]?[0-9:.Z+-]*",  # date and time
    r"[0-9]+(?:[.=_/+-][0-9]+)*",  # numbers and versions
    r"(?:[A-Za-z]+[_/.=-]+)*[A-Za-z0-9+]*(?:EXAMPLE|example|XXXX|xxxx|0123456789|abcdefgh)[A-Za-z0-9+]*",  # placeholders, with words in front
    r"(?:[A-Za-z]+[_/.=-]+)*[A-Za-z]+[0-9]{1,4}",  # a name with a number behind it
)
MIN_RUN = 20

_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
_NAMES = ("passw", "secret", "token", "api")

Span = tuple[str, int, int]


def _base(text: str, runs: list[tuple[int, str]]) -> list[Span]:
    low = text.lower()
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH] if any(x in low for x in _NAMES) else []
    # An access key or a hexadecimal span is so long that it lies within one run.
    for at, run in runs:
        if "AKIA" in run:
            spans += [("access", at + m.start(), at + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= ACCESS_LENGTH]
        spans += [("hex", at + m.start(), at + m.end()) for m in HEX.finditer(run) if len(m[0]) >= HEX_LENGTH]
    return spans


def _windows(s: str, width: int, bits: float, mixed: float = math.inf) -> Iterator[tuple[int, int]]:
    """Merged windows of `s` whose entropy reaches `bits` and that hold both letters and digits.

    With fewer than two digits a window counts from `mixed` bits on, if both cases are frequent.

    With counts c of the characters in a window of w, the entropy is log2 w minus the mean of
    c log2 c, so one character in and one out change four terms.
    """
    if len(s) < width:
        return
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    counts: dict[str, int] = {}
    total, digits, whole, start, end = 0.0, 0, math.log2(width), -1, -1
    upper = lower = 0
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += term[c + 1] - term[c]
        counts[ch] = c + 1
        digits += ch.isdigit()
        upper += ch.isupper()
        lower += ch.islower()
        if i >= width:
            old = s[i - width]
            c = counts[old]
            total += term[c - 1] - term[c]
            counts[old] = c - 1
            digits -= old.isdigit()
            upper -= old.isupper()
            lower -= old.islower()
        at = i - width + 1
        least = bits if 2 <= digits < width else mixed if digits < 2 and min(upper, lower) >= MIXED_CASE else math.inf
        if at >= 0 and whole - total / width >= least - 1e-9:
            if start < 0:
                start = at
            elif at > end:
                yield start, end
                start = at
            end = i + 1
    if start >= 0:
        yield start, end


def allowed_pattern(allow: tuple[str, ...] = ALLOWED) -> str:
    """One pattern of all allowed strings, each between signs that are neither letters nor digits."""
    return r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})(?![A-Za-z0-9])" for p in allow) + ")" if allow else r"(?!)"


def _covers(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether one of `spans` holds (start, end): of those that start no later, the farthest end decides."""
    starts, reach = [], []
    for a, b in sorted(spans):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    return lambda lo, hi: (i := bisect_right(starts, lo)) > 0 and reach[i - 1] >= hi


def scan_text(text: str | None, allowed: re.Pattern, classes: tuple = CLASSES) -> list[Span]:
    """All spans of one text, by start and then by kind as listed."""
    if not text:
        return []
    runs = [(m.start(), m[0]) for m in _RUN.finditer(text)]
    spans = _base(text, runs)
    looked = []
    for at, run in runs:
        if any(c.isdigit() for c in run) or min(sum(map(str.isupper, run)), sum(map(str.islower, run))) >= MIXED_CASE:
            looked.append((at, run, _covers(m.span() for m in allowed.finditer(run))))
    # Spans of one class never hold each other, so a class asks the base and the classes before it only.
    for name, chars, width, bits in classes:
        taken = _covers((a, b) for _, a, b in spans)
        for at, run, fine in looked:
            for m in chars.finditer(run):
                if len(m[0]) < width or fine(*m.span()):
                    continue
                mixed = math.inf if name == "hex" or WORDS.fullmatch(m[0]) else MIXED_BITS
                for lo, hi in _windows(m[0], width, bits, mixed):
                    lo, hi = m.start() + lo, m.start() + hi
                    if not fine(lo, hi) and not taken(at + lo, at + hi):
                        spans.append((f"entropy_{name}", at + lo, at + hi))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def redact_text(text: str, spans: list[Span], mark: str) -> str:
    """`text` with `mark` in place of every span (sorted by start); what overlaps is replaced as one."""
    slices, at = [], 0
    for _, a, b in spans:
        if a >= at:
            slices += [text[at:a], mark]
        at = max(at, b)
    return "".join([*slices, text[at:]])


def scan(df: DataFrame, text_col: str = "text", out_col: str = "secrets", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Adds `out_col`: the spans of each text as an array of (kind, start, end)."""
    pattern = allowed_pattern(allow)

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        allowed = re.compile(pattern)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, allowed)] for t in texts], dtype=object)

    return df.withColumn(out_col, scanned(F.col(text_col)))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`df` with every secret in its text replaced; overlapping spans are replaced as one. Null stays null."""
    pattern = allowed_pattern()

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        allowed = re.compile(pattern)
        for texts in batches:
            yield pd.Series([t and redact_text(t, scan_text(t, allowed), mark) for t in texts], dtype=object)

    return df.withColumn(text_col, redacted(F.col(text_col)))
