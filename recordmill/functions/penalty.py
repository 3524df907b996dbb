"""Legal basis and penalty sentences found in free notice text.

Written as SQL text over a column name or lambda variable: the expressions are long, and one
parsed string builds far faster than a call per node. A pattern is only searched for in texts
that hold all its anchor words; a byte search for a word costs far less than the pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions.text import BLANK

_EDGE = f"^[{fixed.SENTENCE_EDGE}]+|[{fixed.SENTENCE_EDGE}]+$"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, r'^{BLANK}+|{BLANK}+$', '')"


def clean_sql(x: str) -> str:
    """The steps run only on a text that holds a blank or an entity's '&': one search for both costs far less than the steps."""
    out = f"trim(regexp_replace(coalesce({x}, ''), r'{BLANK}+', ' '))"
    for entity, char in fixed.ENTITIES:
        out = f"replace({out}, '{entity}', '{char}')"
    return f"CASE WHEN {x} rlike r'{BLANK[:-1]}&]' THEN {strip_sql(out)} ELSE coalesce({x}, '') END"


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _matches(text: str, pattern: str, group: int, anchors: tuple[str, ...]) -> str:
    """A group of every match; the pattern is not run where one of its anchor words is missing."""
    held = " AND ".join(f"contains({text}, '{w}')" for w in anchors)
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN {held} THEN regexp_extract_all({text}, r'{pattern}', {group}) ELSE cast(array() AS array<string>) END"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def basis_sql(text: str) -> str:
    found = ", ".join(_matches(text, p, 1, words) for p, words in zip(fixed.BASIS_PATTERNS, fixed.BASIS_ANCHORS, strict=True))
    raw = f"filter(concat({found}), m -> length({strip_sql('m')}) > {fixed.BASIS_MIN_RAW})"
    clean = f"filter(transform({raw}, m -> {clean_sql('m')}), m -> length(m) > {fixed.BASIS_MIN_CLEAN})"
    return f"array_join(array_distinct({clean}), '{fixed.JOINER}')"


def _person_sql(text: str, pattern: str, anchors: tuple[str, ...]) -> str:
    """'对' + person + penalty for every match that has both."""
    pairs = f"zip_with({_matches(text, pattern, 1, anchors)}, {_matches(text, pattern, 2, anchors)}"
    both = f"struct({clean_sql('w')} AS who, {clean_sql('p')} AS what)"
    return f"transform(filter({pairs}, (w, p) -> {both}), s -> s.who <> '' AND s.what <> ''), s -> concat('对', s.who, s.what))"


def _summary_sql(text: str, pattern: str, anchors: tuple[str, ...]) -> str:
    return f"filter(transform({_matches(text, pattern, 1, anchors)}, m -> {clean_sql('m')}), m -> length(m) > {fixed.SENTENCE_MIN})"


def sentences_sql(text: str) -> str:
    """Person penalties, summaries, then every clause not among them."""
    persons = zip(fixed.PERSON_PENALTY_PATTERNS, fixed.PERSON_PENALTY_ANCHORS, strict=True)
    summaries = zip(fixed.SUMMARY_PATTERNS, fixed.SUMMARY_ANCHORS, strict=True)
    patterned = ", ".join([_person_sql(text, *p) for p in persons] + [_summary_sql(text, *p) for p in summaries])
    lines = f"filter(split({text}, r'\n'), l -> {any_sql('l', fixed.CLAUSE_WORDS)})"
    clauses = f"transform(flatten(transform({lines}, l -> split({strip_sql('l')}, r'{fixed.CLAUSE_START}'))), c -> {strip_sql('c')})"
    wanted = f"filter({clauses}, c -> length(c) > {fixed.SENTENCE_MIN} AND {any_sql('c', fixed.PENALTY_WORDS)})"
    cleaned = f"transform({wanted}, c -> {clean_sql('c')})"
    return _let(f"concat({patterned})", "found", f"concat(found, array_except({cleaned}, found))")


def dedup_sql(sentences: str) -> str:
    """Left fold: the first kept sentence that contains, or is contained in, the next decides."""
    usable = f"transform(filter({sentences}, s -> length(s) > {fixed.SENTENCE_MIN}), s -> regexp_replace(s, '{_EDGE}', ''))"
    related = "get(filter(kept, k -> contains(k, s) OR contains(s, k)), 0)"
    at = "int(array_position(kept, old))"
    without = f"concat(slice(kept, 1, {at} - 1), slice(kept, {at} + 1, size(kept)))"
    placed = (
        "CASE WHEN old IS NULL THEN concat(kept, array(s))"
        f" WHEN length(s) > length(old) THEN concat({without}, array(s)) ELSE kept END"
    )
    return f"aggregate({usable}, cast(array() AS array<string>), (kept, s) -> {_let(related, 'old', placed)})"


def content_sql(text: str) -> str:
    """'' at once where no sentence can be found: each holds a penalty word or a summary's words. A null text stays null."""
    summary = fixed.SUMMARY_ANCHORS[-1]
    possible = f"{any_sql(text, fixed.PENALTY_WORDS)} OR {' AND '.join(any_sql(text, [w]) for w in summary)}"
    found = f"array_join({dedup_sql(sentences_sql(text))}, '{fixed.JOINER}')"
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN {possible} THEN {found} ELSE '' END"


def extract_basis(text: str) -> Column:
    """Distinct law references in pattern order, joined; '' when there are none."""
    return F.expr(basis_sql(text))


def containment_dedup(sentences: str) -> Column:
    """Sentences, of related ones the longer, in order."""
    return F.expr(dedup_sql(sentences))


def extract_content(text: str) -> Column:
    """Penalty sentences of the text without contained repeats, joined; '' when there are none."""
    return F.expr(content_sql(text))
