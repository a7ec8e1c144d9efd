"""Free-text and URL-component search, folded into one predicate for the scan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill.functions.text import like_contains

# Search prefixes and the columns they look at.
PART_COLUMNS = {"host": "domain", "path": "url_path", "search": "url_query", "hash": "url_hash"}
FREE_TEXT_COLUMNS = ["original_url", "normalized_url", "domain", "title"]

_TERM = re.compile(r"^(host|path|search|hash):(.+)$", re.IGNORECASE | re.DOTALL)


def split_terms(query: str) -> tuple[dict[str, list[str]], list[str]]:
    """Terms with a known prefix and a value, by prefix, and all other tokens."""
    prefixed: dict[str, list[str]] = {}
    bare: list[str] = []
    for token in query.split():
        hit = _TERM.match(token)
        if hit:
            prefixed.setdefault(hit.group(1).lower(), []).append(hit.group(2))
        else:
            bare.append(token)
    return prefixed, bare


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def search_condition(query: str, parts: list[str] | None = None, literal: bool = False) -> Column | None:
    """Predicate of a search, or None where it filters nothing.

    Without a prefix and without a narrowed selection of parts the whole query is one substring of
    any text column. Otherwise terms look at URL parts only: values of one prefix are alternatives,
    everything else must hold together. A malformed URL has no parts and is matched by its text.
    """
    prefixed, bare = split_terms(query)
    narrowed = parts is not None and 0 < len(set(parts)) < len(PART_COLUMNS)
    if not prefixed and not narrowed:
        if query == "":
            return None
        columns = [F.col(c) for c in FREE_TEXT_COLUMNS] + [F.to_json("tags")]
        return _any([like_contains(c, query, literal) for c in columns])

    def hit(names: list[str], values: list[str]) -> Column:
        malformed = F.col("url_path").isNull()
        return _any(
            [like_contains(F.col(PART_COLUMNS[n]), v, literal) for n in names for v in values]
            + [malformed & like_contains(F.col("original_url"), v, literal) for v in values]
        )

    selected = [p for p in PART_COLUMNS if p in (parts or [])] or list(PART_COLUMNS)
    clauses = [hit([p], prefixed[p]) for p in PART_COLUMNS if p in prefixed]
    clauses += [hit(selected, [term]) for term in bare]
    return reduce(lambda a, b: a & b, clauses) if clauses else None


def search_links(
    links: DataFrame,
    query: str,
    parts: list[str] | None = None,
    status: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Links that match; order and cut them with ``listing.page``."""
    hits = links if status is None else links.filter(F.col("status") == status)
    condition = search_condition(query, parts, literal)
    return hits if condition is None else hits.filter(condition)


def search_count(links: DataFrame, query: str, parts: list[str] | None = None, status: str | None = None) -> DataFrame:
    return search_links(links, query, parts, status).agg(F.count(F.lit(1)).alias("total"))
