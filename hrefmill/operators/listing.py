"""Scans, filters, pages and samples of the link table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill import schemas
from hrefmill.plans.skew import semi_by_key

# Lists up to this long become part of the scan's filter.
MAX_INLINE = 1000
SAMPLE_ROWS = 10


def is_active(status: Column) -> Column:
    return ~status.isin(schemas.REMOVED_STATUSES)


def scan_active_links(links: DataFrame) -> DataFrame:
    """The columns analysis needs of links not yet removed."""
    return links.filter(is_active(F.col("status"))).select("id", "seq", "original_url", "normalized_url", "domain")


def pick(df: DataFrame, column: str, wanted: Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``wanted``: a short list goes into the scan, a long one or a DataFrame is joined.

    The join is safe for a value that owns many rows.
    """
    values = None if isinstance(wanted, DataFrame) else list(wanted)
    if values is None or len(values) > MAX_INLINE:
        keys = wanted if values is None else df.sparkSession.createDataFrame([(v,) for v in values], "v string")
        return semi_by_key(df, keys.select(keys.columns[0]).distinct(), column, F.col("id")).select(*df.columns)
    return df.filter(F.col(column).isin(values)) if values else df.filter(F.lit(False))


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("seq"))


def links_by_status(links: DataFrame, status: str) -> DataFrame:
    return newest_first(links.filter(F.col("status") == status))


def links_by_ids(links: DataFrame, ids: Iterable[str] | DataFrame) -> DataFrame:
    return newest_first(pick(links, "id", ids))


def links_by_domains(links: DataFrame, domains: Iterable[str] | DataFrame) -> DataFrame:
    return pick(links, "domain", domains)


def duplicate_links(links: DataFrame) -> DataFrame:
    return links.filter(F.col("duplicate_of").isNotNull())


def internal_links(links: DataFrame) -> DataFrame:
    return links.filter("is_internal")


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first. For deep pages use ``page_after``: an offset sorts all it skips."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    return newest_first(df).offset(offset).limit(limit)


def page_with_total(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """``page``, each row with the ``total`` of the selection. An empty page tells none: ask ``stats.count_rows``."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return newest_first(page(df, limit, offset).join(F.broadcast(total)))


def sample_of(df: DataFrame, newest: str, columns: list[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """The newest rows of any table by one of its columns, ties by the first of ``columns``."""
    return df.orderBy(F.desc(newest), F.desc(columns[0])).limit(limit).select(*columns)


def page_after(df: DataFrame, created_at: Column, seq: int, limit: int = 50) -> DataFrame:
    """The page that follows a row, found by its key."""
    at = F.col("created_at")
    return newest_first(df.filter((at < created_at) | ((at == created_at) & (F.col("seq") < seq)))).limit(limit)


def sample(df: DataFrame, columns: list[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """The newest rows of a selection, as a dry run shows them."""
    return newest_first(df).limit(limit).select(*columns)


def sorted_by(links: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Order by a field's text in locale order, NULL as empty, ``seq`` last."""
    text = F.collate(F.coalesce(_as_text(links, field), F.lit("")), "UNICODE")
    return links.orderBy(text.desc() if descending else text.asc(), F.asc("seq"))


def _as_text(df: DataFrame, field: str) -> Column:
    kind = dict(df.dtypes)[field]
    return F.to_json(field) if kind.startswith(("array", "map", "struct")) else F.col(field).cast("string")


def resolved_urls(links: DataFrame) -> DataFrame:
    """Distinct original URLs of links that survived cleaning, sorted."""
    return links.filter(is_active(F.col("status"))).select(F.col("original_url").alias("url")).distinct().orderBy("url")


def resolved_page(links: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return resolved_urls(links).offset(offset).limit(limit)
