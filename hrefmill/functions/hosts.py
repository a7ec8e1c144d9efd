"""Host names that need more than lower-casing: IDN, percent escapes, odd IPv4 and IPv6 forms.

This is the only Python code that runs per value. Callers pass NULL for plain hosts, so a batch
carries work only for the odd ones.
"""

from __future__ import annotations

import ipaddress
import re
import sys
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Executors need not have this package installed: its task code travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FORBIDDEN = re.compile("[\x00-\x20\x7f#/:<>?@\\[\\\\\\]^|%\ufffd]")
_NUMBER = re.compile(r"^(?:[0-9]+|0[xX][0-9a-fA-F]*)$")


def _ipv6(text: str) -> str | None:
    if "%" in text:
        return None
    try:
        digits = format(int(ipaddress.IPv6Address(text)), "032x")
    except ValueError:
        return None
    groups = [format(int(digits[i : i + 4], 16), "x") for i in range(0, 32, 4)]
    runs = [m.span() for m in re.finditer(r"(?:\b0(?::|$)){2,}", ":".join(groups))]
    joined = ":".join(groups)
    if runs:
        start, end = max(runs, key=lambda r: r[1] - r[0] + (r[1] == len(joined)))
        joined = joined[:start].rstrip(":") + "::" + joined[end:].lstrip(":")
    return f"[{joined}]"


def _ipv4(labels: list[str]) -> str | None:
    if len(labels) > 4:
        return None
    numbers = []
    for label in labels:
        if not _NUMBER.match(label):
            return None
        if label[:2].lower() == "0x":
            numbers.append(int(label[2:] or "0", 16))
        elif len(label) > 1 and label[0] == "0":
            if re.search("[89]", label):
                return None
            numbers.append(int(label, 8))
        else:
            numbers.append(int(label))
    tail_limit = 256 ** (5 - len(numbers))
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= tail_limit:
        return None
    value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def canonical_host(host: str | None) -> str | None:
    """ASCII form of a host, or None where a browser would refuse the URL."""
    if host is None:
        return None
    if host.startswith("["):
        return _ipv6(host[1:-1]) if host.endswith("]") else None
    mapped = unicodedata.normalize("NFKC", unquote(host)).lower().replace("\u00ad", "")
    labels = re.split("[.\u3002]", mapped)
    try:
        ascii_labels = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    except UnicodeError:
        return None
    name = ".".join(ascii_labels)
    if not name or _FORBIDDEN.search(name):
        return None
    significant = ascii_labels[:-1] if len(ascii_labels) > 1 and ascii_labels[-1] == "" else ascii_labels
    if _NUMBER.match(significant[-1]):
        return _ipv4(significant)
    return name


@F.pandas_udf(StringType())
def resolve_hosts(hosts: pd.Series) -> pd.Series:
    return hosts.map(canonical_host, na_action="ignore")
