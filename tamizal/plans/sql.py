"""Fragments of the SQL that checks the queries, written independently of the column expressions where SQL has its own way."""

from __future__ import annotations

from tamizal.functions import text as T

_WIDE = [(a, b) for a, b in zip(T.FOLD_FROM, T.FOLD_TO) if ord(a) > 0xFF00 or a in "ªº" or 0x2070 <= ord(a) < 0x208A or a in "²³¹"]
WIDE_FROM, WIDE_TO = ("".join(x).replace("'", "''") for x in zip(*_WIDE))


def fold(x: str) -> str:
    return f"translate(strip_accents(replace(lower({x}), 'ß', 'ss')), '{WIDE_FROM}', '{WIDE_TO}')"


def norm(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def tokens(x: str) -> str:
    signs = T.EDGE_SIGNS.replace("'", "''")
    stop = ", ".join(f"'{s}'" for s in T.STOPWORDS)
    return f"list_filter(list_transform(string_split(trim(regexp_replace(lower({x}), '\\s+', ' ', 'g')), ' '), lambda t: trim(t, '{signs}')), lambda t: length(t) > 1 AND NOT list_contains([{stop}], t))"


def number_tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '[0-9]+(?:[./,][0-9]+)*'), lambda n: replace(n, ',', '.'))))"


def lines(table: str, keys: str, text: str = "text") -> str:
    """A subquery of keys, line_no (from 1) and line."""
    return f"(SELECT {keys}, unnest(string_split({text}, chr(10))) AS line, unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS line_no FROM {table} WHERE {text} IS NOT NULL)"
