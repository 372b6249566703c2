"""Text columns: collation-like matching, SKU groups and HTML to text."""

import html
import json
import re
import zlib
from html import entities

from pyspark.sql import Column, functions as F


def matches(column: Column, pattern: str) -> Column:
    """Case-insensitive LIKE. ``%`` and ``_`` are wildcards, ``[`` and ``\\`` are literal."""
    return column.ilike(pattern.replace("\\", "\\\\"))


def matches_any(column: Column, patterns: list[str]) -> Column:
    """Any of several such patterns. Several become one expression, so the column is read
    once however long its own expression is."""
    if len(patterns) == 1:
        return matches(column, patterns[0])
    wild = {"%": ".*", "_": "."}
    parts = ["".join(wild.get(c, re.escape(c)) for c in pattern) for pattern in patterns]
    return column.rlike("(?isu)^(?:" + "|".join(parts) + ")$")


def same_text(column: Column, value: str) -> Column:
    """Equality that ignores case, as the ERP collation does."""
    return F.lower(column) == value.lower()


def present(column: Column) -> Column:
    """The trimmed text, NULL when blank."""
    return F.nullif(F.trim(column), F.lit(""))


def full_name(first: Column, last: Column) -> Column:
    """First and last name, blanks skipped, NULL when both are blank."""
    return F.nullif(F.concat_ws(" ", present(first), present(last)), F.lit(""))


def listed_name(last: Column, first: Column) -> Column:
    """'last first' with NULL read as an empty part."""
    return F.trim(F.concat(F.coalesce(last, F.lit("")), F.lit(" "), F.coalesce(first, F.lit(""))))


def sku_group(column: Column) -> Column:
    """The leading letters of a SKU, or the whole SKU when it has none."""
    prefix = F.regexp_extract(column, r"^([A-Za-z]+)", 1)
    return F.when(prefix == "", column).otherwise(prefix)


_BREAK = "\u0001"
# Quoted attribute values may hold ">"; the last alternative takes tags with an open quote.
_NOT_TEXT = (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>"
             r"""|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-z][^>]*>""")


# A reference as HTML reads it: a number, or up to 32 characters that may be or begin with a name.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


#: Slots of the index of names.
SLOTS = 4096


def _index(values: dict[str, str]) -> Column:
    """A literal index: by the checksum of a name, a slot with the few names that have it. Written as JSON,
    it is one constant of the plan; a look-up reads one slot instead of all names."""
    slots: list[dict] = [{} for _ in range(SLOTS)]
    for name, characters in values.items():
        slots[zlib.crc32(name.encode()) % SLOTS][name] = characters
    return F.from_json(F.lit(json.dumps([s or None for s in slots])), "array<map<string,string>>")


def _look_up(index: Column, name: Column) -> Column:
    """What the index has for the name, else NULL."""
    return F.try_element_at(F.get(index, (F.crc32(name.cast("binary")) % SLOTS).cast("int")), name)


def _numbers() -> list[str]:
    """What the numbers below 160 stand for: controls and the Windows characters among them."""
    return [html.unescape(f"&#{code};") for code in range(160)]


def _number(reference: Column) -> Column:
    """The character of a numeric reference."""
    sixteen = reference.rlike("^&#[xX]")
    digits = F.ltrim(F.regexp_extract(reference, "([0-9a-fA-F]+);?$", 1), F.lit("0"))
    # Seven digits hold every code point; whatever is longer is none.
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(F.coalesce(F.when(
        sixteen, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int"), F.lit(0)))
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    nothing = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (F.when(code < 160, F.get(F.array(*map(F.lit, _numbers())), code))
            .when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), "\ufffd").when(nothing, "").otherwise(character))


def _named(reference: Column) -> Column:
    """The characters of a named reference. Old names need no semicolon, so the longest one that the
    text begins with counts; a text without any stays."""
    old = {n: c for n, c in entities.html5.items() if not n.endswith(";")}
    name, known = F.substring(reference, 2, 64), _index(old)

    def begins(n: int) -> Column:
        found = _look_up(known, F.substring(name, 1, n))
        return F.when(F.length(name) >= n, F.concat(found, F.substring(name, n + 1, 64)))

    sizes = sorted({len(n) for n in old}, reverse=True)
    whole = F.when(name.endswith(";"), _look_up(_index(entities.html5), name))
    return F.coalesce(whole, *map(begins, sizes), reference)


def unescape(column: Column) -> Column:
    """Decode HTML references as HTML does: every name, with or without semicolon where it may be
    missing, and numbers. One pass over the text: its references are decoded and put between the
    parts around them, so nothing is decoded twice."""
    found = F.regexp_extract_all(column, F.lit(_REFERENCE), F.lit(0))
    decoded = F.transform(found, lambda r: F.when(r.startswith("&#"), _number(r)).otherwise(_named(r)))
    parts = F.zip_with(F.split(column, _REFERENCE), decoded, lambda part, d: F.concat(part, F.coalesce(d, F.lit(""))))
    return F.when(column.contains("&"), F.array_join(parts, "")).otherwise(column)


def html_text(column: Column) -> Column:
    """The text runs of an HTML document, one per line, trimmed, blanks dropped, decoded."""
    runs = F.split(F.regexp_replace(column, _NOT_TEXT, _BREAK), _BREAK)
    clean = F.transform(runs, lambda r: F.regexp_replace(
        unescape(r), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.array_join(F.filter(clean, lambda r: r != ""), "\n")


def draft_text(column: Column) -> Column:
    """A stored draft as shown to the editor: entities decoded, ``<br />`` as a line break."""
    return F.replace(unescape(column), F.lit("<br />"), F.lit("\n"))
