"""Secret scans: fixed patterns, and strings in a sensitive context that compress badly against what surrounds them."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.common import map_rows, map_texts

#: The base kinds, in their order, with the length that the last group must have.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
#: The same as hex, quicker: a run of too few characters can't hold a longer one.
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Words before a string that make its context sensitive.
SENSITIVE = re.compile(r"auth|bearer|credential|passphrase|passw|passcode|(?<![a-z])pwd|secret|token|private|access|api|signing|session|client|license.?key|(?<![a-z0-9])key(?![a-z0-9])|(?<![a-z0-9])pin(?![a-z0-9])", re.I | re.A)
#: What can be a secret, of LEAST characters or more; signs of equality within it end a name.
CANDIDATE, LEAST = re.compile(r"[A-Za-z0-9+/_=.-]{16,}"), 16
_ASSIGNED = re.compile(r"=+(?=[^=])")
#: Identifiers that code and configuration are full of: the dictionary that a compressor starts with.
IDENTIFIERS = (
    "import from class return function const static public private void string number boolean object array default export require module "
    "self this None True False null undefined try except catch finally raise throw async await yield lambda print format join split replace "
    "username user_name password passwd secret token api_key apikey api-key access_key access_token refresh_token client_id client_secret "
    "authorization Authorization: Bearer Basic credential credentials private_key public_key session_id cookie header request response "
    "http:// https:// www. .com .org .net localhost 127.0.0.1 config settings environment database connection host port path file folder "
    "AWS_ACCESS_KEY_ID AWS_SECRET_ACCESS_KEY GITHUB_TOKEN example placeholder changeme your_token_here xxxxxxxxxxxxxxxx 0123456789abcdef "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 1234567890 version timestamp 2020-01-01T00:00:00 index value values key keys items "
)
#: Characters on each side of a candidate that it is measured against, and before it that must hold a sensitive word.
AROUND, BEFORE = 512, 48
#: Marginal bytes for each character from which on a candidate is reported.
NOVEL = 0.6

ORDER = {"assign": 0, "access": 1, "hex": 2, "novel": 3}


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value): leftmost matches of each base kind that do not overlap, without those
    whose value is too short."""
    found = []
    for kind, pattern, group, least in BASE:
        for m in (_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end(), m.start(group)))
    return found


class Novelty:
    """Measures what a string adds to a compressed text."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def of(self, text: str, start: int, end: int, since: int | None = None) -> float:
        """Marginal compressed bytes for each character of text[start:end], after the code around it, from which the
        other occurrences of the string are taken out that begin at `since` or later."""
        word, n = text[start:end], end - start
        since = start if since is None else since
        low = max(0, start - AROUND - n)
        left = text[low : max(low, since)] + text[max(low, since) : start].replace(word, "")
        around = left[-AROUND:] + " " + text[end : end + AROUND + n].replace(word, "")[:AROUND]
        return (self.size(around + word) - self.size(around)) / n


def mixed(word: str) -> bool:
    """If a string has letters, and digits or two letters of each case: long words are as novel as letters at random."""
    return any(c.isalpha() for c in word) and (any(c.isdigit() for c in word) or min(sum(c.isupper() for c in word), sum(c.islower() for c in word)) > 1)


def candidates(text: str) -> list[tuple[int, int]]:
    """Where the strings are that can be a secret: what stands on either side of a sign of equality that is no padding is
    a string of its own, so that a name is context."""
    found = []
    for m in CANDIDATE.finditer(text):
        at = m.start()
        for cut in [*_ASSIGNED.finditer(m[0]), None]:
            s, e = at, m.end() if cut is None else m.start() + cut.start()
            if e - s >= LEAST and mixed(text[s:e]):
                found.append((s, e))
            at = m.end() if cut is None else m.start() + cut.end()
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def uncovered(text: str, start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of text[start:end] outside the spans `taken`, which are merged, that have a letter or digit."""
    parts, at = [], start
    for k in range(bisect_left(taken, start, key=lambda x: x[1]), len(taken)):
        a, b = taken[k]
        if a >= end:
            break
        if a > at:
            parts.append((at, a))
        at = max(at, b)
    parts.append((at, end))
    return [(a, b) for a, b in parts if any(c.isalnum() for c in text[a:b])]


def spans_of(text: str | None, novelty: Novelty, novel: float = NOVEL) -> list[tuple[str, int, int, int, float | None]]:
    """All spans of a text (kind, start, end, start of the value, novelty), by start, then kind."""
    if not text:
        return []
    found = [(*s, None) for s in base_spans(text)]
    taken = merged([(s[1], s[2]) for s in found])
    places: dict[str, list[tuple[int, int]]] = {}
    for s, e in candidates(text):
        places.setdefault(text[s:e], []).append((s, e))
    for at in places.values():
        open_ = [(s, e) for s, e in at if uncovered(text, s, e, taken)]
        named = [(s, e) for s, e in open_ if SENSITIVE.search(text[max(0, s - BEFORE) : s])]
        costs = (novelty.of(text, s, e, named[0][0]) for s, e in named)
        if cost := next((c for c in costs if c >= novel), None):
            found += [("novel", a, b, a, cost) for s, e in open_ for a, b in uncovered(text, s, e, taken)]
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def find_secrets(docs: DataFrame, novel: float = NOVEL, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each whole text: kind, start and end in code points (end exclusive), where the value starts,
    and for the kind novel its marginal compressed bytes for each character.

    A candidate is a string of 16 or more characters, letters and digits or letters of both cases, with a sensitive word up to
    BEFORE characters before it, as in NAME=value or on the line above. zstandard, primed with a dictionary of identifiers, compresses the
    text around it with and without it; at `novel` or more bytes a character it is reported, save what a base kind covers.
    Its other occurrences are not measured against, and are reported too. Only a string that stands in plain text before
    its first sensitive word counts as known from there.

    Null and empty texts have no spans. Rows that repeat come back each; an empty table gives no rows; other columns
    are ignored.
    """
    names = ("kind", "start", "end", "value_start", "novelty")

    def start():
        measure = Novelty()
        return lambda texts: [[[dict(zip(names, s, strict=True)) for s in spans_of(t, measure, novel)] for t in texts]]

    return map_texts(docs, id_col, text_col, {"spans": "array<span>"}, start)


def redact_text(text: str, spans: list[tuple[str, int, int, int, float | None]]) -> str:
    """The text with each secret's value replaced by its kind in brackets; overlapping values become one."""
    out, at, values = [], 0, sorted((v, e, k) for k, _, e, v, _ in spans)
    for start, end, kind in values:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, novel: float = NOVEL, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The same columns with secrets redacted from each whole text, and the count of characters brought up to date.
    Null texts stay null."""
    at = docs.columns.index(text_col)

    count_at = docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        measure, new = Novelty(), []
        counts = b.column(count_at).to_pylist() if count_at >= 0 else []
        for i, t in enumerate(b.column(at).to_pylist()):
            spans = spans_of(t, measure, novel)
            new.append(redact_text(t, spans) if spans else t)
            if spans and counts:
                counts[i] = len(new[-1])
        b = b.set_column(at, b.schema.field(at), pa.array(new, type=b.schema.field(at).type))
        return b.set_column(count_at, b.schema.field(count_at), pa.array(counts, type=b.schema.field(count_at).type)) if counts else b

    return map_rows(docs, text_col, work)
