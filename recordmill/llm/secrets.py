"""Secret scans: one pass over a text's bytes with the heads of all rules tells which occur; each of these scans the text for its spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recordmill.llm.automaton import compile_rules
from recordmill.llm.tables import texts

# A private key goes on to its END line, over what such a block holds; without one, over its header and base64 lines and the
# shorter one after them. Line breaks may be written as escapes.
_BREAK = r"([\x0a\x0d]|\x5c[nr])"
_SPACE = r"([\x09\x0a\x0d\x20]|\x5c[nr])"
_KEY_END = r"""([A-Za-z0-9+/=:,.;_\x09\x0a\x0d\x20\x5c"'>#*]|-[A-Za-z0-9])*-----END ([A-Z]+ )*PRIVATE KEY-----"""
_KEY_LINES = (rf"({_SPACE}+(Proc-Type|DEK-Info):\x20*[A-Za-z0-9,.-]+)*({_SPACE}+[A-Za-z0-9+/]{{16,}}={{0,2}})+"
              rf"({_BREAK}{_SPACE}*[A-Za-z0-9+/]+={{0,2}})?")

# Kind, pattern, letters in either case, least length of an assignment's value (0: of nothing), and the head that
# the common automaton looks for. Every match holds its head. Open-ended tails would multiply the automaton's states, so the
# rule's own automaton reads them. Base rules first.
RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6,
     r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]{16,}", False, 0, r"AKIA[A-Z0-9]"),
    ("hex", r"[0-9a-f]{24,}", False, 0, r"[0-9a-f]{24}"),
    ("private_key", rf"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----({_KEY_END}|{_KEY_LINES})?", False, 0, r"-----BEGIN "),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", False, 0, r"gh[pousr]_[A-Za-z0-9]"),
    ("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}", False, 0, r"xox[abprs]-[0-9A-Za-z-]"),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False, 0, r"\.eyJ[A-Za-z0-9_-]"),
    ("map_key", r"AIza[0-9A-Za-z_-]{35}", False, 0, r"AIza[0-9A-Za-z_-]"),
    ("url_login", r"[a-z]{3,10}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+=-]+@", False, 0, r"[a-z]://[A-Za-z0-9._~%-]"),
)
KINDS = tuple(r[0] for r in RULES)
BASE = 3
LONG_RUN = 64  # bytes of a failed run that may be read again from its next byte
_VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


@cache
def _scanner() -> tuple[list[list[int]], int, list[int]]:
    """Next state by state and byte, the first state in which a rule's head ends, and the rules whose heads end in those states.

    States where rules end come last, so that one comparison tells.
    """
    table, mask = compile_rules([(head, fold) for _, _, fold, _, head in RULES], restart=True)
    order = np.argsort(mask != 0, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    calm = int((mask == 0).sum())
    rows = [row.tolist() for row in place[table[order]]]
    return [rows, calm, mask[order].tolist(), int(place[0])]


@cache
def _anchored(rule: int) -> tuple[list[list[int]], list[int]]:
    """The table of one rule from a given first byte on."""
    table, mask = compile_rules([RULES[rule][1:3]], restart=False)
    return table.tolist(), mask.tolist()


def ends(data: bytes) -> dict[int, int]:
    """For every rule whose head ends somewhere in ``data``, where it first does: the one pass."""
    rows, calm, mask, state = _scanner()
    found: dict[int, int] = {}
    seen = 0
    for i, byte in enumerate(data):
        state = rows[state][byte]
        if state >= calm and mask[state] & ~seen:
            new = mask[state] & ~seen
            seen |= new
            found.update((r, i) for r in range(len(RULES)) if new >> r & 1)
    return found


@cache
def _dead(rule: int) -> int | None:
    """The state of one rule's table that no match can follow, if any."""
    table, mask = _anchored(rule)
    return next((s for s, row in enumerate(table) if set(row) == {s} and not mask[s]), None)


@cache
def _first_bytes(rule: int) -> frozenset[int]:
    row, dead = _anchored(rule)[0][0], _dead(rule)
    return frozenset(b for b in range(256) if row[b] != dead)


def spans(data: bytes, rule: int, since: int = 0) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of one rule, as byte ranges; too short values are passed over.

    A run that fails within LONG_RUN bytes is begun anew one byte on. After a longer one the search goes on with all starts at
    once (``_first_match``), so a run of any length is not read again for each of its bytes.
    """
    table, mask = _anchored(rule)
    dead, begin, least = _dead(rule), _first_bytes(rule), RULES[rule][3]
    out, at, n = [], since, len(data)
    while at < n:
        if data[at] not in begin:
            at += 1
            continue
        state, end, i = 0, -1, at
        for i in range(at, n):
            state = table[state][data[i]]
            if state == dead:
                break
            if mask[state]:
                end = i + 1
        if end < 0:
            at += 1
            if i - at < LONG_RUN:
                continue
            found = _first_match(data, rule, at)
            if found is None:
                break
            at, end = found
        if not least or _value_length(data, at, end) >= least:
            out.append((at, end))
        at = end
    return out


def _first_match(data: bytes, rule: int, since: int) -> tuple[int, int] | None:
    """The leftmost, then longest match, in one pass: for every state that some start has led to, the earliest such start.

    Starts in one state have the same future, so the earliest stands for them all, and a byte costs at most a step for each state.
    """
    table, mask = _anchored(rule)
    dead, begin = _dead(rule), _first_bytes(rule)
    starts: dict[int, int] = {}
    best = None
    for i in range(since, len(data)):
        byte = data[i]
        moved: dict[int, int] = {}
        for state, start in starts.items():
            to = table[state][byte]
            if to != dead and start <= moved.get(to, start):
                moved[to] = start
        if best is None and byte in begin:
            moved.setdefault(table[0][byte], i)
        for state, start in moved.items():
            if mask[state] and (best is None or start <= best[0]):
                best = (start, i + 1)
        if best:
            moved = {state: start for state, start in moved.items() if start <= best[0]}
            if not moved:
                break
        starts = moved
    return best


def _value_length(data: bytes, start: int, end: int) -> int:
    """Length of an assignment's value: what stands after its first sign, blanks and a quote."""
    at = start
    while data[at] not in b":=":
        at += 1
    at += 1
    while data[at] == 0x20:
        at += 1
    return end - at - (data[at] in b"\"'")


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then in the rules' order."""
    data = text.encode()
    seen = ends(data)
    if not seen:
        return []
    found = sorted((a, r, b) for r in seen for a, b in spans(data, r))
    if len(data) != len(text):
        chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        place = np.concatenate([[0], chars])
        found = [(int(place[a]), r, int(place[b])) for a, r, b in found]
    return [(KINDS[r], a, b) for a, r, b in found]


def redact(text: str) -> str:
    """The text with every span found replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in find(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets in every whole text.

    Returns doc_id, the counts n_assign, n_access and n_hex, base_sha256 (of the base rules' spans) and spans (of all rules, as
    kind:start:end in code points, end exclusive, by start and then rule, comma-joined). Null and empty texts have none: counts
    0, spans ''. Rows are independent, so repeated rows give repeated results; other columns are ignored. Time is linear in
    the text's length, also over runs that look like a secret and fail; spans of different kinds may overlap.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) if t else [] for t in batch.column(1).to_pylist()]
            base = [[x for x in f if x[0] in KINDS[:BASE]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([sum(x[0] == k for x in f) for f in base], pa.int64()) for k in KINDS[:BASE]]
                + [pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string()),
                   pa.array([_joined(f) for f in found], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (and ``n_chars`` counted anew); all other columns stay. Null texts stay null."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = pa.array([t and redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, plain.names[at], masked)

    # Columns pass by place: a name may hold a dot.
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    out = docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
