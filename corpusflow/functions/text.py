"""Text cleaning as Column expressions (T1-T6), all JVM-side.

Regexes use ``(?U)`` so Java's ``\\w`` and ``\\s`` are Unicode-aware, like
Python's ``re`` on ``str``.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# one character reference: decimal, hexadecimal, or a name of up to 32 characters
REFERENCE_RE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# the names met most, looked up before the whole table (2,231 names of HTML 5, from the standard library)
COMMON_NAMES = ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;", "hellip;", "mdash;", "ndash;", "rsquo;"]
REPLACEMENT = "\ufffd"

TAG_RE = r"<[^>]+>"
# Python's \s on str also covers \x1c-\x1f; its \w is letters, numbers, underscore
URL_RE = r"http[^\s\x{1c}-\x{1f}]+|www.[^\s\x{1c}-\x{1f}]+"
USER_RE = r"@[\p{L}\p{N}_]+"
# Python's str.split() also splits on \x1c-\x1f, which Unicode \s does not include
WS_RE = r"(?U)[\s\x{1c}-\x{1f}]+"
WORD_RE = r"[\p{L}\p{N}_]+"
NONSPACE_RE = r"[^ \t\n\r]+"


def _names(names) -> Column:
    """A constant name -> text map (one folded literal)."""
    return F.from_json(F.lit(json.dumps({n: html5[n] for n in names})), "map<string, string>")


def _windows_1252(n: int) -> str:
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def _code_point(cp: Column) -> Column:
    """Text of a numeric reference by the HTML 5 rules: the Windows characters at
    128-159, a replacement character for null, surrogates and numbers beyond
    Unicode (null here), nothing for other control and non-characters."""
    old = F.from_json(F.lit(json.dumps({str(n): _windows_1252(n) for n in range(0x80, 0xA0)})), "map<string, string>")
    nothing = ((cp.between(0x1, 0x8) | (cp == 0xB) | cp.between(0xE, 0x1F) | (cp == 0x7F) | cp.between(0xFDD0, 0xFDEF))
               | (cp.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    text = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return (F.when(cp.isNull() | (cp == 0) | cp.between(0xD800, 0xDFFF) | (cp > 0x10FFFF), F.lit(REPLACEMENT))
             .when(cp.between(0x80, 0x9F), F.element_at(old, cp.cast("string")))
             .when(nothing, F.lit("")).otherwise(text))


def _decode_reference(ref: Column) -> Column:
    """Text of one reference; a name that is not known stays as it is, or gives
    the longest known name in front of it (names that need no semicolon)."""
    body = F.substring(ref, 2, 1 << 30)
    hexa = F.ltrim(F.regexp_replace(body, "^#[xX]|;$", ""), F.lit("0"))
    deci = F.ltrim(F.regexp_replace(body, "^#|;$", ""), F.lit("0"))
    # more digits than any code point has: beyond Unicode
    from_hex = F.when(F.length(hexa) <= 7, F.conv(F.when(hexa == "", F.lit("0")).otherwise(hexa), 16, 10).cast("bigint"))
    from_dec = F.when(F.length(deci) <= 8, F.when(deci == "", F.lit("0")).otherwise(deci).cast("bigint"))
    bare = _names([n for n in html5 if not n.endswith(";")])
    longest = max(len(n) for n in html5 if not n.endswith(";"))
    front = [F.when(F.length(body) > k, F.concat(F.element_at(bare, F.substring(body, 1, k)), F.substring(body, k + 1, 1 << 30)))
             for k in range(longest, 1, -1)]
    named = F.coalesce(F.element_at(_names(COMMON_NAMES), body), F.element_at(_names(html5), body), *front, ref)
    return (F.when(body.rlike("^#[xX]"), _code_point(from_hex)).when(body.startswith("#"), _code_point(from_dec))
             .otherwise(named))


def html_unescape(c: Column) -> Column:
    """Decode every HTML 5 character reference in one pass (T1), natively: the
    text is divided at its references, each is decoded, and the parts are put
    together again, so nothing is decoded twice."""
    between = F.split(c, REFERENCE_RE, -1)
    refs = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE_RE), 0), _decode_reference)
    pairs = F.zip_with(between, refs, lambda t, r: F.concat(t, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pairs, "")).otherwise(c)


def html_unescape_full(c: Column | str) -> Column:
    """Full HTML5 entity table and numeric references (T1): ``html_unescape`` for a column or its name."""
    return html_unescape(F.col(c) if isinstance(c, str) else c)


def strip_tags(c: Column) -> Column:
    """Remove ``<...>`` tags."""
    return F.regexp_replace(c, TAG_RE, "")


def mask_urls(c: Column) -> Column:
    """``http\\S+`` or ``www.\\S+`` -> ``[URL]`` (T3; the dot is any character;
    ``\\S`` with Python's whitespace set)."""
    return F.regexp_replace(c, "(?U)" + URL_RE, "[URL]")


def mask_users(c: Column) -> Column:
    """``@`` mentions -> ``[USER]`` with Python's word characters (T4)."""
    return F.regexp_replace(c, USER_RE, "[USER]")


def squash_ws(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim (T5)."""
    return F.trim(F.regexp_replace(c, WS_RE, " "))


def clean_text(c: Column) -> Column:
    """T1 -> T2 -> T3 -> T4 -> T5 in that order (T6); one codegen'd projection."""
    return squash_ws(mask_users(mask_urls(strip_tags(html_unescape(c)))))


def words(c: Column) -> Column:
    """Lower-cased word tokens (letters, digits, underscore) in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD_RE), 0)


def n_words(c: Column) -> Column:
    """Number of ``words`` without building them; null for null."""
    return F.regexp_count(F.lower(c), F.lit(WORD_RE))


def nonspace_tokens(c: Column) -> Column:
    """Whitespace-separated tokens (punctuation kept), in text order."""
    return F.regexp_extract_all(c, F.lit(NONSPACE_RE), 0)
