"""Secret scans: fixed patterns, and a password guess-cost model over values in a credential context.

The guess cost of a value is the least total, in powers of ten, over all ways to cut it into known
words, dates, repeats, keyboard walks and brute-force spans (dynamic programming over positions).
Words come from a ranked list: a short one of common passwords and, where a tokenizer's vocabulary
file is given, its words of four letters or more in the order of their ids.
A value that follows an identifier with a credential word and costs ``min_cost`` or more is a ``guess`` span; the
fixed patterns' spans stay whatever they cost.

Null and empty texts have no spans; bytes that aren't UTF-8 count as U+FFFD. Positions are code
points. Repeated rows are scanned each on its own; other columns aren't looked at; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from obsmill.llm.common import parts, tidy

KINDS = ("assign", "access", "hex", "guess")
#: The patterns that must be found, as given.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A value in a credential context: an identifier with a credential word, a sign, the value up to white space or a quote.
NAME = re.compile(r"""(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)["']?\x20*(?:[:=]|=>)""", re.ASCII)
#: Long words count anywhere in the identifier, short ones where no letters touch them or case tells them apart.
CREDENTIAL = re.compile(
    r"""password|passwd|passphrase|passcode|secret(?!ar[iy])|token|credential|(?:api|access|private)[_.-]?key|(?<![A-Za-z])(?:pass|pwd|auth|authorization|bearer)(?![A-Za-z])|(?-i:(?<=[a-z0-9])(?:Pass|Pwd|Auth|Authorization|Bearer)(?![a-z])|(?<![A-Za-z])(?:pass|pwd|auth|authorization|bearer)(?=[A-Z]))""",
    re.ASCII | re.IGNORECASE,
)
VALUE = re.compile(r"""["']?\x20*(?:[:=]|=>)\x20*(?:bearer\x20+)?["']?([^\s"'<>,;]{6,})""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINTS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"credential", b"bearer")
#: Least guess cost of a secret, in powers of ten.
MIN_COST = 12.0

#: Common passwords and the words that stand for a value without being one, most common first.
WORDS = (
    "password pass admin user root login welcome letmein qwerty abc monkey dragon master hello freedom whatever shadow sunshine "
    "princess football baseball superman batman iloveyou trustno secret token key test testing demo sample example changeme default "
    "guest public private none null true false your my the here value string some placeholder insert replace redacted hidden xxx "
    "foo bar baz server client access database data system service email name host local localhost production staging development "
    "summer winter spring autumn january february march april may june july august september october november december monday "
    "tuesday wednesday thursday friday saturday sunday love money star angel charlie jordan michael thomas hunter killer soccer "
    "summer computer internet samsung google apple orange banana cookie flower purple silver golden tiger eagle"
).split()


class Ranked:
    """Words and their ranks; of a repeated word the first counts."""

    def __init__(self, words: Iterable[str]):
        self.rank = {w: k + 1 for k, w in enumerate(dict.fromkeys(words))}
        self.longest = max(map(len, self.rank), default=0)


COMMON = Ranked(WORDS)


@cache
def ranked(vocabulary: str | None) -> Ranked:
    """The common passwords, then the words of a vocabulary (a ``tokenizers`` file)."""
    if vocabulary is None:
        return COMMON
    with open(vocabulary, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    plain = (t.lstrip("\u0120\u2581").lower() for t in sorted(ids, key=ids.get))
    return Ranked([*WORDS, *(t for t in plain if len(t) >= 4 and t.isascii() and t.isalpha())])


_LEET = str.maketrans("4@831!0$57", "aabeiiosst")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {(a, b) for row in _ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]} | {p for up, down in zip(_ROWS, _ROWS[1:]) for a, b in zip(up[1:], down) for p in ((a, b), (b, a))}
_DATE = re.compile(r"(?:(?:19|20)\d\d)(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
#: Each further segment costs a guess at where it begins.
_CUT = 0.5


def _pool(text: str) -> float:
    n = 26 * any("a" <= c <= "z" for c in text) + 26 * any("A" <= c <= "Z" for c in text) + 10 * any("0" <= c <= "9" for c in text)
    return math.log10(max(10, n + 33 * any(not c.isascii() or not c.isalnum() for c in text)))


def segments(text: str, words: Ranked = COMMON) -> Iterator[tuple[int, int, float]]:
    """Start, end and cost of every segment that isn't brute force."""
    yield from _short(text, words)
    low, n = text.lower(), len(text)
    for i in range(n):
        walk = i + 1
        while walk < n and (low[walk - 1], low[walk]) in _NEXT:
            walk += 1
        for j in range(i + 3, walk + 1):
            yield i, j, _walk(j - i)


def _walk(n: int) -> float:
    return math.log10(47 * 4 * n)


def _short(text: str, words: Ranked) -> Iterator[tuple[int, int, float]]:
    """The segments but walks: a bounded number for each start."""
    low = text.lower()
    plain = low.translate(_LEET)
    n = len(text)
    same = {size: [0] * (n + 1) for size in (1, 2, 3, 4)}  # of each start: characters that equal those `size` later
    for size, run in same.items():
        for i in range(n - size - 1, -1, -1):
            run[i] = run[i + 1] + 1 if text[i] == text[i + size] else 0
    for i in range(n):
        for j in range(i + 3, min(n, i + words.longest) + 1):
            if rank := words.rank.get(low[i:j]) or words.rank.get(plain[i:j]):
                part = text[i:j]
                yield i, j, math.log10(rank) + 0.3 * (low[i:j] not in words.rank) + 0.3 * (part != low[i:j]) + 0.3
        for m in (_DATE.match(text, i),):
            if m:
                yield i, m.end(), math.log10(365 * 120)
        for size in (1, 2, 3, 4):
            unit, j = text[i : i + size], i + size + same[size][i] // size * size
            if len(unit) == size and j - i >= max(3, 2 * size):
                yield i, j, size * _pool(unit) + math.log10((j - i) // size)


def guess_cost(text: str, words: Ranked = COMMON) -> float:
    """Powers of ten of the guesses that the cheapest segmentation takes."""
    if not text:
        return 0.0
    n, each = len(text), _pool(text)
    to: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _short(text, words):
        to[j].append((i, cost))
    # starts of the walk that ends here: one that an earlier start has caught up with stays behind for good
    low, walk, starts = text.lower(), 0, []
    # best[j][0]: the last segment is known; best[j][1]: it is a brute-force span, which goes on at no further cut
    known, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], known[j - 1] + (_CUT if j > 1 else 0)) + each
        known[j] = min((min(known[i], brute[i]) + cost + (_CUT if i else 0) for i, cost in to[j]), default=math.inf)
        if j > 1 and (low[j - 2], low[j - 1]) not in _NEXT:
            walk, starts = j - 1, []
        if j - 3 >= walk:
            i = j - 3
            cost = min(known[i], brute[i]) + (_CUT if i else 0)
            while starts and starts[-1][1] >= cost:
                starts.pop()
            starts.append((i, cost))
            ahead, left = math.inf, []
            for i, cost in starts:
                if cost + _walk(j - i) < ahead:
                    ahead = cost + _walk(j - i)
                    left.append((i, cost))
            starts = left
            known[j] = min(known[j], ahead)
    return min(known[n], brute[n])


def contexts(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the values in a credential context."""
    at = 0
    for name in NAME.finditer(text):
        if name.start() >= at and CREDENTIAL.search(name[1]) and (m := VALUE.match(text, name.end(1))):
            at = m.end()
            yield m.span(1)


def scan(text: str, min_cost: float = MIN_COST, words: Ranked = COMMON) -> list[tuple[str, int, int]]:
    """Spans as (kind, start, end), by start, then kind as listed."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found: list[tuple[str, int, int]] = []
    if any(x in low for x in _ASSIGN_HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if any(x in low for x in _CONTEXT_HINTS):
        found += [("guess", a, b) for a, b in contexts(text) if guess_cost(text[a:b], words) >= min_cost]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for a, b in _merged(spans):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, *, min_cost: float = MIN_COST, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_assign, n_access, n_hex, n_guess, base_sha256, spans."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        words = ranked(vocabulary)
        for b in batches:
            for i, some in parts(b.column(1)):
                rows = [scan(x, min_cost, words) for x in some]
                counts = [pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
                base = [hashlib.sha256(_line([s for s in r if s[0] != "guess"]).encode()).hexdigest() for r in rows]
                yield pa.record_batch([b.column(0).slice(i, len(some)), *counts, pa.array(base, pa.string()), pa.array([_line(r) for r in rows], pa.string())], list("iabcdes"))

    out = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(tidy(run), f"i {kind.simpleString()}, a long, b long, c long, d long, e string, s string")
    return out.toDF(id_col, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans")


def redact_documents(docs: DataFrame, *, min_cost: float = MIN_COST, vocabulary: str | None = None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with secrets replaced in the text and its length counted anew; a null text stays null."""
    where = [docs.columns.index(text_col), *([docs.columns.index(chars_col)] if chars_col in docs.columns else [])]

    def run(batches):
        words = ranked(vocabulary)
        for b in batches:
            old = b.column(where[0])
            for i, some in parts(old):
                new = [redact(x, scan(x, min_cost, words)) if old[k].is_valid else None for k, x in enumerate(some, i)]
                columns = list(b.slice(i, len(some)).columns)
                columns[where[0]] = pa.array(new, old.type)
                for k in where[1:]:
                    columns[k] = pa.array([None if x is None else len(x) for x in new], columns[k].type)
                yield pa.record_batch(columns, names=b.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
