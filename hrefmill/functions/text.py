"""String column helpers shared by the readers and the search predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white space that String.trim() removes in a browser, as a regex class body.
JS_SPACE = (
    r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)

# Named entities decoded in bookmark titles.
NAMED_ENTITIES = {
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "apos": "'",
    "nbsp": "\u00a0",
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{JS_SPACE}]")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, the folding that LIKE and host names use."""
    return F.translate(c, _UPPER, _UPPER.lower())


def like_contains(c: Column, value: str, literal: bool = False) -> Column:
    """ASCII case-insensitive LIKE %value%; NULL counts as no match.

    ``%`` and ``_`` inside the value stay wildcards and a backslash is an ordinary character,
    unless ``literal`` asks for plain substring matching.
    """
    folded = "".join(ch.lower() if ch in _UPPER else ch for ch in value)
    if literal:
        hit = F.contains(ascii_lower(c), F.lit(folded))
    else:
        hit = F.like(ascii_lower(c), F.lit(f"%{folded}%"), F.lit("\u0001"))
    return F.coalesce(hit, F.lit(False))


def code_point(cp: Column) -> Column:
    """Character of a code point given as a number."""
    return F.decode(F.unhex(F.lpad(F.hex(cp.cast("bigint")), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Decode the entities of bookmark titles; anything unknown or out of range stays as it is."""
    token = r"(&(?:[a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);|[^&]+|&)"

    def decode_one(t: Column) -> Column:
        named = F.create_map(*[F.lit(x) for kv in NAMED_ENTITIES.items() for x in kv])
        dec = F.regexp_extract(t, "^&#0*([0-9]{1,7});$", 1)
        hexa = F.regexp_extract(t, "^&#x0*([0-9a-fA-F]{1,6});$", 1)
        point = F.when(dec != "", dec.try_cast("bigint")).when(
            hexa != "", F.conv(hexa, 16, 10).try_cast("bigint")
        )
        return F.coalesce(
            F.when(point <= 0x10FFFF, code_point(point)),
            F.try_element_at(named, F.regexp_extract(t, "^&([a-zA-Z]+);$", 1)),
            t,
        )

    parts = F.transform(F.regexp_extract_all(c, F.lit(token), F.lit(1)), decode_one)
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line as an array.

    A quote toggles quoting anywhere in a field, a doubled quote inside quotes is one quote, and a
    missing closing quote runs to the end of the line. A spare empty field may follow the last one.
    """
    field = r'((?:[^",]++|"[^"]*+(?:""[^"]*+)*+(?:"|$))*+)(?:,|$)'
    piece = r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)|([^"]++)'

    def unquote(f: Column) -> Column:
        quoted = F.regexp_extract_all(f, F.lit(piece), F.lit(1))
        bare = F.regexp_extract_all(f, F.lit(piece), F.lit(2))
        return F.array_join(
            F.zip_with(quoted, bare, lambda q, b: F.concat(F.replace(q, F.lit('""'), F.lit('"')), b)), ""
        )

    raw = F.regexp_extract_all(line, F.lit(field), F.lit(1))
    return F.transform(raw, lambda f: F.when(f.contains('"'), unquote(f)).otherwise(f))
