"""URL decomposition, canonical form and normalisation as staged column expressions.

Each stage is its own projection: a regex result used by several later expressions is computed
once, and Catalyst keeps everything inside generated code apart from the rare-case rewrites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrefmill.functions.hosts import resolve_hosts

# A control character that a cleaned URL cannot contain.
SEP = "\u0001"

# Fixed values of the URL standard: characters that stay as they are in each component.
PATH_SAFE = r"\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E"
QUERY_SAFE = r"\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E"
HASH_SAFE = r"\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E"
USER_SAFE = r"\x21\x24-\x2E\x30-\x39\x41-\x5A\x5F\x61-\x7A\x7E"

_SPECIAL = r"(?is)^(https?|ftp|wss?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_GENERIC = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_PLAIN_HOST = r"^[^\x00-\x20\x7f#/:<>?@\[\\\]^|%\u0080-\x{10ffff}]+$"
_NUMERIC_TAIL = r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)\.?$"
_DOTTED_QUAD = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"

PARTS = ["scheme", "userinfo", "host", "port", "path", "search", "hash"]


@dataclass(frozen=True)
class NormalizeConfig:
    """Six independent switches, applied in this order."""

    force_https: bool = False
    remove_www: bool = False
    remove_trailing_slash: bool = False
    remove_default_port: bool = False
    sort_query_params: bool = False
    remove_fragment: bool = False


# ``None`` keeps the raw URL. The two "normalized" presets differ: importing strips www and leaves
# the query alone, deduplication keeps www and sorts the query.
PRESETS: dict[str, NormalizeConfig | None] = {
    "strict": None,
    "smart": NormalizeConfig(remove_www=True, remove_trailing_slash=True),
    "import_normalized": NormalizeConfig(
        remove_www=True, remove_trailing_slash=True, remove_default_port=True, remove_fragment=True
    ),
    "dedup_normalized": NormalizeConfig(
        remove_trailing_slash=True, remove_default_port=True, sort_query_params=True, remove_fragment=True
    ),
}


def import_preset(strategy: str) -> str:
    return "import_normalized" if strategy == "normalized" else strategy


def dedup_preset(strategy: str | NormalizeConfig) -> str | NormalizeConfig:
    """Name of a preset for deduplication; a config of one's own is taken as it is."""
    return "dedup_normalized" if strategy == "normalized" else strategy


# The stages below are SQL text: a stage is then one call into the JVM however long its expression.


def _escape(c: str, safe: str) -> str:
    """Percent-encode whatever lies outside the safe class; the common clean value is untouched."""
    runs = f"regexp_extract_all({c}, r'([{safe}]+|[^{safe}]+)', 1)"
    fix = f"CASE WHEN t RLIKE r'[^{safe}]' THEN replace(url_encode(t), '+', '%20') ELSE t END"
    return f"CASE WHEN {c} RLIKE r'[^{safe}]' THEN array_join(transform({runs}, t -> {fix}), '') ELSE {c} END"


def _fold_dots(path: str) -> str:
    """Resolve ``.`` and ``..`` segments, plain or percent-encoded."""
    dot, dots = r"r'(?i)^(?:\.|%2e)$'", r"r'(?i)^(?:\.|%2e){2}$'"
    kept = f"""aggregate(split(substr({path}, 2), '/'), CAST(array() AS array<string>), (kept, s) ->
        CASE WHEN s RLIKE {dots} THEN slice(kept, 1, greatest(size(kept) - 1, 0))
             WHEN s RLIKE {dot} THEN kept ELSE array_append(kept, s) END)"""
    tail = rf"CASE WHEN {path} RLIKE r'(?i)/(?:\.|%2e){{1,2}}$' THEN array('') ELSE CAST(array() AS array<string>) END"
    joined = f"'/' || array_join(concat({kept}, {tail}), '/')"
    return rf"CASE WHEN {path} RLIKE r'(?i)/(?:\.|%2e){{1,2}}(?:/|$)' THEN {joined} ELSE {path} END"


def _default_port(scheme: str) -> str:
    return f"CASE WHEN {scheme} IN ('http', 'ws') THEN '80' WHEN {scheme} IN ('https', 'wss') THEN '443' WHEN {scheme} = 'ftp' THEN '21' ELSE '' END"


def _lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _pieces(text: str, pattern: str) -> str:
    """The five groups of a pattern as an array; the whole text as one entry where it does not match."""
    groups = SEP.join(["$1", "$2", "$3", "$4", "$5"])
    return f"split(regexp_replace({text}, r'{pattern}', '{groups}'), '{SEP}')"


def _stage(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def _split_special(df: DataFrame, url: str, p: str) -> DataFrame:
    """Add ``{p}m``: scheme, authority, path, ?query and #hash of an http-like URL (5 entries)."""
    clean = rf"regexp_replace(`{url}`, r'^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]', '')"
    cleaned = _stage(df, {f"{p}c": f"replace({clean}, '{SEP}', '%01')"})
    return _stage(cleaned, {f"{p}m": _pieces(f"{p}c", _SPECIAL)})


def _userinfo(text: str) -> dict[str, str]:
    """User and password of an authority, encoded, as two expressions over its text before ``@``."""
    return {
        "user": _escape(f"regexp_extract({text}, r'(?s)^([^:]*)', 1)", USER_SAFE),
        "secret": _escape(f"regexp_extract({text}, r'(?s)^[^:]*:(.+)$', 1)", USER_SAFE),
    }


def with_url_parts(df: DataFrame, url: str, prefix: str = "u_", resolve: bool = True) -> DataFrame:
    """Add ``scheme userinfo host port path search hash`` of ``url``; all NULL where it is no URL.

    ``search`` and ``hash`` keep their ``?`` / ``#`` so that an empty query differs from none.
    With ``resolve=False`` the URL must already be in canonical form (a stored normalised URL), and
    no Python stage is planned.
    """
    p = f"__{prefix}"
    m, g, h, at = f"{p}m", f"{p}g", f"{p}h", f"{p}at"
    work = _split_special(df, url, p)
    generic = f"CASE WHEN NOT {p}c RLIKE r'(?i)^(?:https?|ftp|wss?):' THEN {_pieces(f'{p}c', _GENERIC)} END"
    work = _stage(work, {g: f"CASE WHEN size({m}) = 5 THEN {m} ELSE {generic} END", f"{p}s": f"size({m}) = 5"})
    work = _stage(
        work,
        {
            f"{p}scheme": f"CASE WHEN size({g}) = 5 THEN {_lower(f'get({g}, 0)')} END",
            f"{p}hp": f"regexp_extract(get({g}, 1), r'(?s)([^@]*)$', 1)",
            at: f"CASE WHEN contains(get({g}, 1), '@') THEN regexp_extract(get({g}, 1), r'(?s)^(.*)@', 1) ELSE '' END",
        },
    )
    work = _stage(
        work,
        {
            h: _lower(rf"regexp_extract({p}hp, r'(?s)^(\[[^\]]*\]|[^:\[]*)(?::[0-9]*)?$', 1)"),
            f"{p}digits": rf"regexp_extract({p}hp, r'^(?:\[[^\]]*\]|[^:\[]*):([0-9]+)$', 1)",
        },
    )
    plain = f"({h} RLIKE r'{_PLAIN_HOST}' AND (NOT {h} RLIKE r'{_NUMERIC_TAIL}' OR {h} RLIKE r'{_DOTTED_QUAD}'))"
    work = _stage(
        work,
        {
            f"{p}plain": plain if resolve else rf"{plain} OR {h} RLIKE r'^\[[0-9a-f:]+\]$'",
            f"{p}port": f"CASE WHEN {p}digits = '' THEN -1 ELSE TRY_CAST({p}digits AS INT) END",
        },
    )
    known = f"CASE WHEN NOT {p}s THEN CASE WHEN {p}scheme IS NOT NULL THEN {h} END WHEN {p}plain THEN {h} END"
    work = _stage(work, {f"{p}host": known})
    if resolve:
        odd = F.expr(f"CASE WHEN {p}s AND NOT {p}plain AND {h} != '' THEN {h} END")
        work = work.withColumn(f"{p}host", F.coalesce(F.col(f"{p}host"), resolve_hosts(odd)))
    raw_path = f"CASE WHEN NOT {p}s THEN get({g}, 2) WHEN get({g}, 2) = '' THEN '/' ELSE replace(get({g}, 2), r'\\', '/') END"
    info = _userinfo(at) if resolve else {
        "user": f"regexp_extract({at}, r'(?s)^([^:]*)', 1)",
        "secret": f"regexp_extract({at}, r'(?s)^[^:]*:(.+)$', 1)",
    }
    work = _stage(work, {f"{p}raw": raw_path, f"{p}user": info["user"], f"{p}secret": info["secret"]})
    if resolve:
        work = _stage(work, {f"{p}raw": f"CASE WHEN {p}s THEN {_escape(f'{p}raw', PATH_SAFE)} ELSE {p}raw END"})
    valid = f"{p}scheme IS NOT NULL AND {p}host IS NOT NULL AND {p}port BETWEEN -1 AND 65535"
    port = f"CASE WHEN {p}port >= 0 AND CAST({p}port AS STRING) != {_default_port(f'{p}scheme')} THEN CAST({p}port AS STRING) END"
    secret = f"CASE WHEN {p}secret != '' THEN ':' || {p}secret ELSE '' END"
    out = {
        "scheme": f"{p}scheme",
        "userinfo": f"CASE WHEN {p}user = '' AND {p}secret = '' THEN '' ELSE {p}user || {secret} || '@' END",
        "host": f"{p}host",
        "port": port,
        "path": f"CASE WHEN {p}s THEN {_fold_dots(f'{p}raw')} ELSE {p}raw END" if resolve else f"{p}raw",
        "search": _escape(f"get({g}, 3)", QUERY_SAFE) if resolve else f"get({g}, 3)",
        "hash": _escape(f"get({g}, 4)", HASH_SAFE) if resolve else f"get({g}, 4)",
    }
    work = _stage(work, {f"{prefix}{k}": f"CASE WHEN {valid} THEN {v} END" for k, v in out.items()})
    return work.drop(*[c for c in work.columns if c.startswith(p)])


def _sort_query(search: str) -> str:
    """Stable sort of query parameters by decoded key in locale order, re-encoded as a form."""
    key, value = "substring_index(x, '=', 1)", "CASE WHEN contains(x, '=') THEN regexp_extract(x, r'(?s)=(.*)$', 1) ELSE '' END"
    pairs = f"""transform(filter(split(substr({search}, 2), '&'), x -> x != ''), (x, i) -> named_struct(
        'rank', collate(coalesce(try_url_decode({key}), {key}), 'UNICODE'), 'i', i,
        'k', coalesce(try_url_decode({key}), {key}), 'v', coalesce(try_url_decode({value}), {value})))"""
    joined = f"array_join(transform(array_sort({pairs}), t -> url_encode(t.k) || '=' || url_encode(t.v)), '&')"
    # Only separators in the query leave nothing to sort.
    return f"CASE WHEN {search} RLIKE '[^?&]' THEN '?' || {joined} ELSE '' END"


def normalized(prefix: str, config: NormalizeConfig, raw: Column) -> Column:
    """Rewrite the parts added by ``with_url_parts`` under a config; no URL keeps the raw text."""
    c = {k: f"`{prefix}{k}`" for k in PARTS}
    scheme, host, path = c["scheme"], c["host"], c["path"]
    if config.force_https:
        scheme = f"CASE WHEN {scheme} = 'http' THEN 'https' ELSE {scheme} END"
    if config.remove_www:
        host = rf"regexp_replace({host}, r'^www\.(?=.)', '')"
    if config.remove_trailing_slash:
        path = f"CASE WHEN {path} = '/' THEN '/' ELSE regexp_replace({path}, '/$', '') END"
    search = _sort_query(c["search"]) if config.sort_query_params else c["search"]
    frag = "''" if config.remove_fragment else c["hash"]
    slashes = f"CASE WHEN {host} != '' THEN '://' ELSE ':' END"
    # A default port never survives parsing; forcing https can make 443 the default.
    port = f"CASE WHEN {c['port']} != {_default_port(scheme)} THEN ':' || {c['port']} ELSE '' END"
    text = f"concat({scheme}, {slashes}, {c['userinfo']}, {host}, {port}, {path}, {search}, {frag})"
    return F.coalesce(F.expr(text), raw)


def with_normalized(df: DataFrame, url: str, out: str, preset: str, resolve: bool = True) -> DataFrame:
    """Add the normalised form of ``url`` under a named preset."""
    config = PRESETS[preset]
    if config is None:
        return df.withColumn(out, F.col(url))
    parsed = with_url_parts(df, url, "n__", resolve)
    return parsed.withColumn(out, normalized("n__", config, F.col(url))).drop(*[f"n__{k}" for k in PARTS])


def with_dedup_key(links: DataFrame, preset: str | NormalizeConfig, out: str = "dedup_key") -> DataFrame:
    """Normalise ``original_url`` of stored links from their stored parts.

    Ingest has already resolved host, path, query and hash, so only scheme, user and port are read
    from the raw text and no Python stage is needed. The key is never NULL, so a join on it adds no
    NULL test for Catalyst to push below the projections that build it.
    """
    config = preset if isinstance(preset, NormalizeConfig) else PRESETS[preset]
    if config is None:
        return links.withColumn(out, F.coalesce("original_url", F.lit("")))
    p = "__k_"
    m, at = f"{p}m", f"regexp_extract(get({p}m, 1), r'(?s)^(.*)@', 1)"
    work = _split_special(links, "original_url", p)
    info = _userinfo(at)
    work = _stage(
        work,
        {
            f"{p}ok": f"size({m}) = 5 AND url_path IS NOT NULL",
            f"{p}user": f"CASE WHEN contains(get({m}, 1), '@') THEN {info['user']} ELSE '' END",
            f"{p}secret": f"CASE WHEN contains(get({m}, 1), '@') THEN {info['secret']} ELSE '' END",
            f"{p}scheme": _lower(f"get({m}, 0)"),
            f"{p}port": f"nullif(regexp_extract(get({m}, 1), r':0*([0-9]+)$', 1), '')",
        },
    )
    secret = f"CASE WHEN {p}secret != '' THEN ':' || {p}secret ELSE '' END"
    work = _stage(
        work,
        {
            f"{p}userinfo": f"CASE WHEN {p}user = '' AND {p}secret = '' THEN '' ELSE {p}user || {secret} || '@' END",
            f"{p}host": "domain",
            f"{p}path": "url_path",
            f"{p}search": f"CASE WHEN get({m}, 3) = '' THEN '' ELSE '?' || coalesce(url_query, '') END",
            f"{p}hash": f"CASE WHEN get({m}, 4) = '' THEN '' ELSE '#' || coalesce(url_hash, '') END",
        },
    )
    key = F.when(F.col(f"{p}ok"), normalized(p, config, F.col("original_url"))).otherwise(F.col("original_url"))
    work = work.withColumn(out, F.coalesce(key, F.lit("")))
    return work.drop(*[c for c in work.columns if c.startswith(p)])


# Host names and prefixes that count as private.
PRIVATE_HOSTS = ["localhost", "127.0.0.1", "::1"]
PRIVATE_PREFIX = r"^(?:10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"


def is_private_host(host: Column, strict_cidr: bool = False) -> Column:
    """Text test on the host; ``strict_cidr`` asks for real addresses and all of 127.0.0.0/8."""
    if strict_cidr:
        quad = host.rlike(_DOTTED_QUAD)
        hit = (host.isin("localhost", "[::1]", "::1")) | (
            quad & (host.rlike(PRIVATE_PREFIX) | host.startswith("127."))
        )
    else:
        hit = host.isin(PRIVATE_HOSTS) | host.rlike(PRIVATE_PREFIX)
    return F.coalesce(hit, F.lit(False))


def path_prefix_key(host: Column, path: Column, depth: int) -> Column:
    """Host plus the first ``depth`` non-empty path segments; NULL where the URL is malformed."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, depth), "/"))
