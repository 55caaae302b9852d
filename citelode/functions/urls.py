"""Address columns: hosts, authority, DOIs, document links and safety."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Multipliers by host, the first suffix that fits.
TLD_AUTHORITY = ((".gov", 1.40), (".edu", 1.30))
PUBLISHERS = (
    ("nature.com", 1.30), ("science.org", 1.30), ("cell.com", 1.30), ("nejm.org", 1.30), ("ieeexplore.ieee.org", 1.25), ("ieee.org", 1.25),
    ("acm.org", 1.25), ("springer.com", 1.20), ("sciencedirect.com", 1.20), ("wiley.com", 1.20), ("oup.com", 1.20), ("cambridge.org", 1.20),
    ("jstor.org", 1.20), ("plos.org", 1.20), ("frontiersin.org", 1.15), ("mdpi.com", 1.10), ("biorxiv.org", 1.15), ("medrxiv.org", 1.15),
    ("arxiv.org", 1.20), ("semanticscholar.org", 1.15), ("openalex.org", 1.15), ("doaj.org", 1.10), ("archive.org", 1.10), ("gutenberg.org", 1.10),
)
# Hosts that only redirect.
REDIRECTORS = ("hdl.handle.net", "doi.org", "dx.doi.org", "purl.org")
# Address blocks that aren't publicly routable.
PRIVATE_V4 = (
    "0.0.0.0/32", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "255.255.255.255/32",
)
PRIVATE_V6 = ("::/128", "::1/128", "ff00::/8", "fc00::/7", "fe80::/10")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def any_of(x: Column, needles: tuple[str, ...] | list[str]) -> Column:
    """Whether the text contains one of some strings."""
    out = F.lit(False)
    for n in needles:
        out = out | x.contains(n)
    return out


def host(url: Column) -> Column:
    """Lower-case host; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def authority_multiplier(url: Column) -> Column:
    """Boost of a result's address by its host, 1.0 for unknown hosts and malformed addresses."""
    h = host(url)
    out = F.when(F.lit(False), F.lit(1.0))
    for tld, boost in TLD_AUTHORITY:
        out = out.when(h.endswith(tld), F.lit(boost))
    for suffix, boost in PUBLISHERS:
        out = out.when((h == suffix) | h.endswith("." + suffix), F.lit(boost))
    return out.otherwise(F.lit(1.0))


def extract_doi(x: Column) -> Column:
    """First DOI in a text, lower case, without the suffixes that links add to it; null if none."""
    # The form of a DOI and the suffixes.
    raw = F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(raw, r"[.,);]+$", ""), r"(?:\.(?:full|abstract|pdf|html|xml)|\.)+$", "")
    return F.when(raw != "", bare)


def url_key(url: Column) -> Column:
    """The address without fragment and trailing slashes, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "/+$", ""))


def looks_like_doc(url: Column) -> Column:
    """Whether an address plausibly leads to a document, or to a page that one is linked from."""
    u = F.lower(url)
    strong = any_of(u, (".pdf", ".epub", "/pdf/", "/pdf?", "download=pdf", "filetype=pdf", "/bitstream/", "/download/", "getfile", "/abs/", "/article/"))
    path = F.regexp_replace(u, r"(?s)[?#].*$", "")
    return strong | ~(path.endswith(".html") | path.endswith(".htm"))


def is_likely_pdf_url(url: Column) -> Column:
    """Whether an open-access address is worth trying as a PDF: no redirector, no page."""
    u = F.lower(url)
    good = any_of(u, (".pdf", "/pdf/", "/pdf?", "download=pdf", "/bitstream/", "/download/", "getfile"))
    return ~any_of(u, REDIRECTORS) & (good | ~(u.endswith(".html") | u.endswith(".htm") | u.contains("/abs/")))


def canonicalize_doc_url(url: Column) -> Column:
    """arXiv abstract pages as their PDF address."""
    return F.replace(url, F.lit("arxiv.org/abs/"), F.lit("arxiv.org/pdf/"))


def referer_for(url: Column) -> Column:
    """``scheme://host/``; null without scheme or host."""
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?://[^/]+)", 1)
    return F.when(at != "", F.concat(at, F.lit("/")))


def host_needs_honest_ua(url: Column) -> Column:
    """Whether the host serves plain clients only."""
    return any_of(F.lower(url), ("://zenodo.org/", ".zenodo.org/"))


def unwrap_redirect(href: Column) -> Column:
    """The target of a search engine's ``uddg=`` redirect, else the address itself."""
    wrapped = F.regexp_extract(href, r"[?&]uddg=([^&#]+)", 1)
    return F.when(wrapped != "", F.try_url_decode(wrapped)).otherwise(F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href))


def _absolute(base: str | None, href: str | None) -> str | None:
    """A link made absolute against its page's address; None where it can't be."""
    if not base or href is None:
        return None
    try:
        out = urljoin(base, href.strip())
        return out if urlsplit(out).scheme else None
    except ValueError:
        return None


def _host(url: str) -> str:
    found = re.match(_HOST, url)
    return found[1].lower() if found else ""


@F.pandas_udf(StringType())
def resolve_href(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link made absolute against its page's address; null where it can't be."""
    return pd.Series([_absolute(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def first_link(base: pd.Series, trusted: pd.Series, local: pd.Series) -> pd.Series:
    """The first of a page's links made absolute: trusted ones on any host, then local ones on its own."""

    def one(b: str | None, anywhere, here) -> str | None:
        for h in anywhere if anywhere is not None else ():
            if (found := _absolute(b, h)) is not None:
                return found
        for h in here if here is not None else ():
            if (found := _absolute(b, h)) is not None and _host(found) == _host(b):
                return found
        return None

    return pd.Series([one(*row) for row in zip(base, trusted, local, strict=True)], dtype=object)


def ipv4_number(ip: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).cast("long")
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def is_private_ipv4(ip: Column) -> Column:
    """Whether a dotted address isn't publicly routable; null if it isn't one."""
    blocks = [ipaddress.ip_network(net) for net in PRIVATE_V4]

    def inside(n: Column) -> Column:
        out = F.lit(False)
        for block in blocks:
            out = out | n.between(int(block[0]), int(block[-1]))
        return out

    # inside the lambda the number is a variable, so its expression stands in the plan once
    n = ipv4_number(ip)
    return F.when(n.isNotNull(), F.get(F.transform(F.array(n), inside), F.lit(0)))


def _embedded(ip: ipaddress.IPv6Address) -> ipaddress.IPv4Address | None:
    if ip.ipv4_mapped:
        return ip.ipv4_mapped
    low = ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)
    nat64 = ip in ipaddress.ip_network("64:ff9b::/96")
    return low if nat64 or (int(ip) >> 32 == 0 and int(ip) > 1) else None


@F.pandas_udf(BooleanType())
def is_private_ip(s: pd.Series) -> pd.Series:
    """The same for addresses of either version, IPv4 ones inside IPv6 included."""
    v4, v6 = [ipaddress.ip_network(n) for n in PRIVATE_V4], [ipaddress.ip_network(n) for n in PRIVATE_V6]

    def one(t: str | None) -> bool | None:
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            return None
        if ip.version == 6:
            if inner := _embedded(ip):
                return any(inner in n for n in v4)
            return any(ip in n for n in v6)
        return any(ip in n for n in v4)

    return s.map(one)


def has_safe_shape(url: Column) -> Column:
    """Scheme http or https, a host, no credentials, no private literal address."""
    h = host(url)
    plain = url.rlike(r"(?i)^https?://") & ~url.rlike(r"^[^/?#]*//[^/?#]*@") & (h != "") & (h != "localhost")
    return plain & ~F.coalesce(is_private_ipv4(h), F.lit(False))


def file_uri(path: Column) -> Column:
    """``file://`` address of a path, all but unreserved bytes and slashes escaped."""
    parts = F.transform(F.split(path, "/"), lambda p: F.replace(F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
    return F.concat(F.lit("file://"), F.array_join(parts, "/"))
