"""Pieces of DuckDB SQL that the queries' oracles share."""

from __future__ import annotations

from inkwell.functions import lexicons as lx


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '\\S+')"


def alphabetic(t: str) -> str:
    return f"list_filter({tokens(t)}, lambda w: regexp_matches(w, '\\p{{L}}'))"


def stripped_lower(words: str) -> str:
    return f"list_filter(list_transform({words}, lambda w: lower(trim(w, '.,;:!?\"''()'))), lambda w: w <> '')"


def trimmed(t: str) -> str:
    return f"trim({t}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def rounded(x: str, places: int = 6) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def sentences(t: str) -> str:
    """A list of sentences: a mark at each boundary, taken out again after abbreviations."""
    short = "|".join(lx.ABBREVIATIONS)
    starts = lx.SENTENCE_STARTS.replace("'", "''")
    marked = f"regexp_replace({t}, '([.!?])([\"'')\\]]*\\s+[{starts}])', '\\1␟\\2', 'g')"
    merged = f"regexp_replace({marked}, '(^|[^A-Za-z])((?i:{short})\\.)␟', '\\1\\2', 'g')"
    return f"list_filter(list_transform(string_split({merged}, '␟'), lambda s: {trimmed('s')}), lambda s: s <> '')"


def paragraphs(t: str) -> str:
    lines = f"list_filter(list_transform(string_split(p, chr(10)), lambda s: {trimmed('s')}), lambda s: s <> '')"
    one = f"trim(regexp_replace(array_to_string({lines}, ' '), '[ \\t]+', ' ', 'g'))"
    return f"list_filter(list_transform(regexp_split_to_array({t}, '\\n\\s*\\n'), lambda p: {one}), lambda p: p <> '')"


def occurrences(t: str, literal: str) -> str:
    one = literal.replace("'", "''")
    return f"((length({t}) - length(replace({t}, '{one}', ''))) // {len(literal)})"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
