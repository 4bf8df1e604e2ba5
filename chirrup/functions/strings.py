"""String expressions both text jobs share."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# white space as Python's str.strip() understands it: code points, characters, and the body of
# a regular-expression class
SPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACES = "".join(map(chr, SPACE_POINTS))
SPACE = "".join(f"\\x{{{c:x}}}" for c in SPACE_POINTS)
# bytes that every space outside ASCII starts with, and the four ASCII separators Java's \\s lacks
RARE_SPACE_BYTES = ("C285", "C2A0", "E19A80", "E280", "E2819F", "E38080", "1C", "1D", "1E", "1F")


def has_bytes(text: Column, *sequences: str) -> Column:
    """Does the UTF-8 form hold one of the byte sequences? A scan far cheaper than a regular expression."""
    raw = text.cast("binary")
    found = F.lit(False)
    for sequence in sequences:
        found = found | F.contains(raw, F.unhex(F.lit(sequence)))
    return found


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """White-space runs become one space; ends are stripped."""

    def squeezed(t: Column) -> Column:
        rare = F.regexp_replace(t, f"[{SPACE}]+", " ")
        plain = F.regexp_replace(t, r"\s+", " ")
        return F.trim(F.when(has_bytes(t, *RARE_SPACE_BYTES), rare).otherwise(plain))

    return let(text, squeezed)


def contains_any(text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once.

    Without this, a column used several times in a step is written out several times when Spark
    moves a filter below the steps, and a chain of steps grows exponentially.
    """
    return F.transform(F.array(value), body)[0]


#: A reference as HTML5 reads it: decimal, hexadecimal, or a name that may run on.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Longest and shortest of the names that need no semicolon.
_OPEN_NAMES = [len(n) for n in html5 if not n.endswith(";")]
#: What the numbers below 160 stand for: control characters vanish, 128 to 159 are read as Windows-1252.
_SMALL = [html.unescape(f"&#{n};") for n in range(160)]


def _numbered(digits: Column, base: int) -> Column:
    """The character of a code point written in digits; what is no character vanishes or becomes U+FFFD."""
    bare = F.ltrim(digits, F.lit("0"))
    number = F.when(F.length(bare) > 7, 1 << 24).otherwise(F.conv(F.concat(F.lit("0"), bare), base, 10).cast("int"))

    def char(n: Column) -> Column:
        wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return (
            F.when(n < len(_SMALL), F.element_at(F.array(*map(F.lit, _SMALL)), n + 1))
            .when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd")
            .when(n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE), "")
            .otherwise(wide)
        )

    return let(number, char)


def _named(name: Column) -> Column:
    """The characters of a name, or of its longest beginning that needs no semicolon; others stay."""
    known = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    starts = [F.substring(name, 1, n) for n in range(max(_OPEN_NAMES), min(_OPEN_NAMES) - 1, -1)]
    begun = F.coalesce(*[F.concat(F.try_element_at(known, s), F.substring(name, F.length(s) + 1, F.length(name))) for s in starts])
    return F.coalesce(F.try_element_at(known, name), begun, F.concat(F.lit("&"), name))


def _reference(ref: Column) -> Column:
    digits = F.rtrim(ref, F.lit(";"))
    return (
        F.when(F.lower(ref).startswith("#x"), _numbered(F.substring(digits, 3, F.length(digits)), 16))
        .when(ref.startswith("#"), _numbered(F.substring(digits, 2, F.length(digits)), 10))
        .otherwise(_named(ref))
    )


def _all_references(text: Column) -> Column:
    """The text cut at its references, each of them looked up, and put together again."""
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), _reference)
    between = F.split(text, REFERENCE, -1)
    return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), found), between, lambda r, b: F.concat(r, b)), "")


CORE_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _core_entities(text: Column) -> Column:
    for entity, char in CORE_ENTITIES.items():  # the ampersand last: one level only
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def unescape_html(text: Column, levels: int = 1) -> Column:
    """HTML entities to characters, one level or two (texts that were encoded twice).

    Texts without an ampersand stay as they are, the five core entities are plain replacements;
    only a text that holds another reference is cut at its references.
    """
    other = "&(?!(?:amp|lt|gt|quot|#39);)[^\t\n\f <&;]"

    def once(t: Column) -> Column:
        decoded = F.when(t.rlike(other), _all_references(t)).otherwise(_core_entities(t))
        return F.when(F.contains(t, F.lit("&")), decoded).otherwise(t)

    for _ in range(levels):
        text = let(text, once)
    return text


def strip_tags(fragment: Column) -> Column:
    """Tags become spaces, white space is squeezed."""
    return squeeze(F.regexp_replace(F.coalesce(fragment, F.lit("")), "<[^>]+>", " "))


def strip_embed(fragment: Column) -> Column:
    """Embed markup: a line break becomes a space, other tags vanish, entities are decoded."""
    broken = F.regexp_replace(fragment, r"<br\s*/?>", " ")
    return squeeze(unescape_html(F.regexp_replace(broken, "<[^>]+>", "")))


def shorten(text: Column, limit: int) -> Column:
    """Cut for display, with an ellipsis inside the limit."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def has_devanagari(text: Column) -> Column:
    return text.rlike(r"[\x{0900}-\x{097f}]")


def url_key(url: Column) -> Column:
    """First 16 hex digits of the version-5 UUID of a URL."""
    from chirrup.constants import URL_NAMESPACE

    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(url, "UTF-8")))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3))
