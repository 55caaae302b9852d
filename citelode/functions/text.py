"""Text columns: tokens, titles, entities and mark-up."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What separates tokens: everything but letters and numbers of any script.
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"
# Entities that titles and bodies decode.
TITLE_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "copy": "©", "reg": "®", "trade": "™",
    "deg": "°", "times": "×", "divide": "÷", "plusmn": "±", "frac12": "½", "middot": "·", "bull": "•",
}
BODY_ENTITIES = ("amp", "lt", "gt", "quot", "nbsp", "apos")
_REFERENCE = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);")


def trimmed(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def pieces(x: Column) -> Column:
    """What ``tokenize`` chooses from: also shorter and empty ones, for counts of tokens that are known."""
    return F.split(F.lower(F.coalesce(x, F.lit(""))), NOT_ALNUM)


def tokenize(x: Column) -> Column:
    """Lower-case runs of letters and digits of at least two characters, repeats kept; null gives none."""
    return F.filter(pieces(x), lambda t: F.char_length(t) >= 2)


def has_searchable_token(x: Column) -> Column:
    """Whether some run of letters and digits has two characters."""
    return F.coalesce(x, F.lit("")).rlike(r"[\p{IsAlphabetic}\p{N}]{2,}")


def normalize_title(x: Column) -> Column:
    """Lower case, punctuation as spaces, single spaces, the first 200 characters."""
    return F.substring(collapsed(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"(?U)[^\w\s]", " ")), 1, 200)


def is_sentinel_title(norm: Column) -> Column:
    """Whether a normalised title stands for a missing one."""
    return norm.isin("", "untitled")


def first_author_surname(authors: Column) -> Column:
    """Lower-case surname of the first author, from "Doe, Jane" or "Jane Doe"; null if there is none."""
    first = F.get(authors, F.lit(0))
    name = F.when(first.contains(","), trimmed(F.get(F.split(first, ","), F.lit(0)))).otherwise(F.element_at(F.split(collapsed(first), " "), -1))
    return F.when(F.lower(name) != "", F.lower(name))


def author_year_fingerprint(authors: Column, year: Column, title: Column) -> Column:
    """``surname|year|first three title tokens``; null where a part is missing."""
    # three tokens, what follows them, and an empty one if the title begins with something else
    words = F.filter(F.split(F.coalesce(title, F.lit("")), NOT_ALNUM, 5), lambda t: t != "")
    head = F.lower(F.array_join(F.slice(words, 1, 3), " "))
    surname = first_author_surname(authors)
    return F.when(surname.isNotNull() & (F.octet_length(year) == 4) & (head != ""), F.concat_ws("|", surname, year, head))


def titles_corroborate(a: Column, b: Column) -> Column:
    """Whether one of two normalised titles starts with the other, both given."""
    return (a != "") & (b != "") & (a.startswith(b) | b.startswith(a))


def weak_corroborates(year_a: Column, authors_a: Column, year_b: Column, authors_b: Column) -> Column:
    """Same four-character year, or same surname of the first author."""
    year = (F.octet_length(year_a) == 4) & (year_a == year_b)
    return F.coalesce(year, F.lit(False)) | F.coalesce(first_author_surname(authors_a) == first_author_surname(authors_b), F.lit(False))


def _decode(text: str, named: dict[str, str], keep_unknown: bool) -> str:
    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return named.get(body, m[0])
        digits = body[2:] if body[1] in "xX" else body[1:]
        code = int(digits, 16 if body[1] in "xX" else 10) if len(digits) < 12 else 1 << 40
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            return m[0] if keep_unknown else ""
        return "" if not code and not keep_unknown else chr(code)

    return _REFERENCE.sub(one, text)


@F.pandas_udf(StringType())
def _decode_title(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _decode(t, TITLE_ENTITIES, True))


@F.pandas_udf(StringType())
def _decode_body(s: pd.Series) -> pd.Series:
    named = {k: TITLE_ENTITIES[k] for k in BODY_ENTITIES}
    return s.map(lambda t: None if t is None else _decode(t, named, False))


def _decode_native(x: Column, names: tuple[str, ...]) -> Column:
    """Named references by replacement, the ampersand last: exact where no numeric ones occur."""
    for name in sorted(names, key=lambda n: n == "amp"):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(TITLE_ENTITIES[name]))
    return x


def clean_title(x: Column, native: bool = False) -> Column:
    """Tags stripped, references decoded in one pass (unknown ones stay), white space collapsed.

    ``native`` stays in the JVM and is exact unless references are numeric or an encoded
    ampersand starts another reference.
    """
    bare = F.regexp_replace(x, "<[^>]*>", "")
    return collapsed(_decode_native(bare, tuple(TITLE_ENTITIES)) if native else _decode_title(bare))


def strip_html(x: Column, native: bool = False) -> Column:
    """Text of a page: scripts and styles out, block tags as line feeds, references decoded."""
    out = x
    # The tags that go with their content, and those that begin or end a line.
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<\s*{tag}\b[^>]*>.*?<\s*/\s*{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?i)<\s*(p|div|br|h[1-6]|li|tr|section|article|header|footer|hr|blockquote)\b[^>]*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)<\s*/\s*(p|div|h[1-6]|li|tr|section|article|header|footer|blockquote)\s*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", "")
    return _decode_native(out, BODY_ENTITIES) if native else _decode_body(out)


def reconstruct_abstract(inverted: Column) -> Column:
    """The text of a word → positions map; null if it has none or a position exceeds 100,000."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")
    return F.when((F.size(pairs) > 0) & (F.array_max(F.transform(pairs, lambda s: s["p"])) <= 100_000) & (trimmed(text) != ""), text)


def safe_folder(query: Column, stamp: Column) -> Column:
    """Folder name of a query: a slug of at most 48 characters and a time stamp given as text."""
    slug = F.substring(F.regexp_replace(F.lower(trimmed(F.regexp_replace(query, r"(?U)[^\w\s-]", ""))), r"(?U)[-\s]+", "-"), 1, 48)
    return F.concat(F.when(slug == "", "library").otherwise(slug), F.lit("-"), stamp)


def slug(title: Column, url: Column) -> Column:
    """File stem of a document: at most 80 characters of its title and six of its address's md5."""
    base = F.substring(F.regexp_replace(trimmed(F.regexp_replace(title, r"(?U)[^\w\s-]", "")), r"(?U)[-\s]+", "-"), 1, 80)
    return F.concat(F.when(base == "", "doc").otherwise(base), F.lit("-"), F.substring(F.md5(url), 1, 6))


def truncated(x: Column, limit: int = 64 * 1024 * 1024) -> Column:
    """The longest prefix of at most ``limit`` bytes of UTF-8 that cuts no character."""
    raw = x.cast("binary")

    def inside(at: int) -> Column:
        """Whether the byte there, counted from 1, goes on a character."""
        return F.hex(F.substring(raw, at, 1)).between("80", "BF")

    # a character has at most four bytes: the first byte left out is its first, or up to three back
    cut = F.lit(max(0, limit - 3))
    for back in (2, 1, 0):
        if limit >= back:
            cut = F.when(~inside(limit + 1 - back), F.lit(limit - back)).otherwise(cut)
    return F.when(F.octet_length(x) <= limit, x).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))
