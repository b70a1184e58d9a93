"""HTML to text, in a few passes of column functions whose work grows with the text alone."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLOCK_TAGS, HIDDEN_TAGS
from .text import let, squeeze

# Rest of a tag. A quote opens a value only behind '='; the repeats never give back what they
# took, so they run as loops however many attributes there are.
_ATTRIBUTES = r"""(?:[\s/](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)?+"""
_TAG_REST = _ATTRIBUTES + ">"
_OPENING_REST = _ATTRIBUTES + "(?<!/)>"
# Noncharacters stand for a hidden element's start and end and for removed markup. Text that
# holds them itself loses them.
_OPEN, _CLOSE, _GONE = "\ufdd0", "\ufdd1", "\ufdd2"
# What may follow an ampersand.
_REFERENCE = r"\A(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"


def _lookup(table: dict[str, str]) -> Column:
    """A constant map. One string literal builds it, so the plan stays small."""
    pairs = "\u0002".join(f"{name}\u0001{value}" for name, value in table.items())
    return F.str_to_map(F.lit(pairs), F.lit("\u0002"), F.lit("\u0001"))


def _odd_code_points() -> dict[str, str]:
    """Numeric references that do not mean their own number: of the 8-bit controls, and none."""
    numbers = [*range(0x01, 0x09), 0x0B, 0x0D, *range(0x0E, 0x20), *range(0x7F, 0xA0),
               *range(0xFDD0, 0xFDF0),
               *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF))]
    return {str(n): html.unescape(f"&#{n};") for n in numbers}


def _code_point(number: Column) -> Column:
    """The character of a numeric reference. Invalid numbers become U+FFFD."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    hexed = F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0")
    odd = (number < 0xA0) | number.between(0xFDD0, 0xFDEF) | ((number % 0x10000) >= 0xFFFE)
    plain = F.decode(F.unhex(hexed), "UTF-32")
    return F.when(valid & odd, F.coalesce(
        F.try_element_at(_lookup(_odd_code_points()), number.cast("string")), plain)).otherwise(plain)


def _named(name: Column) -> Column:
    """Text of a named reference, by the longest name it starts with; null if there is none."""
    table = html.entities.html5
    closed = _lookup({n: v for n, v in table.items() if n.endswith(";")})
    opened = {n: v for n, v in table.items() if not n.endswith(";")}
    prefix = F.regexp_extract(
        name, r"\A(?:" + "|".join(sorted(opened, key=len, reverse=True)) + ")", 0)
    by_prefix = F.concat(
        F.try_element_at(_lookup(opened), prefix), F.substr(name, F.length(prefix) + 1))
    return (
        F.when(name == "amp;", "&").when(name == "nbsp;", "\xa0").when(name == "lt;", "<")
        .when(name == "gt;", ">").when(name == "quot;", '"')
        .otherwise(F.coalesce(F.try_element_at(closed, name), by_prefix)))


def unescape_entities(text: Column) -> Column:
    """Decode HTML entities.

    The text is split at its ampersands once, the start of each part decoded and the parts
    joined again, so nothing is decoded twice and each reference costs the same. An ampersand
    without a known reference stays. The commonest references, which stand for no letter, digit,
    ``;``, ``#`` or ``&`` and so can make no other, are replaced before.
    """
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        text = F.replace(text, F.lit(name), F.lit(char))

    def decoded(reference: Column) -> Column:
        number = F.when(
            reference.rlike(r"\A#[xX]"),
            F.conv(F.regexp_extract(reference, r"\A#[xX]0*([0-9a-fA-F]{1,12});?\z", 1), 16, 10)
            .try_cast("bigint"),
        ).otherwise(F.regexp_extract(reference, "([0-9]+)", 1).try_cast("bigint"))
        return (
            F.when(reference == "", "&")
            .when(reference.startswith("#"), _code_point(F.coalesce(number, F.lit(0x110000))))
            .otherwise(F.coalesce(_named(reference), F.concat(F.lit("&"), reference))))

    def part(piece: Column, at: Column) -> Column:
        return F.when(at == 0, piece).when(
            piece.startswith("amp;"), F.concat(F.lit("&"), F.substr(piece, F.lit(5)))).otherwise(let(
            F.regexp_extract(piece, _REFERENCE, 0),
            lambda head: F.concat(decoded(head), F.substr(piece, F.length(head) + 1))))

    return let(text, lambda t: F.when(
        F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&", -1), part), "")
    ).otherwise(t))


def _outside_hidden(text: Column) -> Column:
    """The text outside hidden elements, which may hold one another: a fold over their tags.

    Elements that hold no other go first, then those that held only such, in a pass each; the
    fold, whose steps copy its text, sees what is nested deeper or unbalanced.
    """
    for _ in range(2):
        text = F.regexp_replace(text, f"{_OPEN}[^{_OPEN}{_CLOSE}]*+{_CLOSE}", _GONE)

    def step(state: Column, piece: Column) -> Column:
        depth = (
            F.when(piece.startswith(_OPEN), state["depth"] + 1)
            .when(piece.startswith(_CLOSE), F.greatest(state["depth"] - 1, F.lit(0)))
            .otherwise(state["depth"]))
        return let(depth, lambda d: F.struct(
            d.alias("depth"),
            F.when(d == 0, F.concat(state["text"], piece)).otherwise(state["text"]).alias("text")))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    return let(text, lambda t: F.when(
        t.rlike(f"[{_OPEN}{_CLOSE}]"),
        F.aggregate(F.split(t, f"(?=[{_OPEN}{_CLOSE}])"), start, step, lambda s: s["text"])
    ).otherwise(t))


def html_to_text(raw: Column, unescape_first: bool = True) -> Column:
    """Visible text of HTML markup.

    Hidden elements go with their content, block tags become a blank, other tags and comments
    vanish, entities are decoded and white space is collapsed. An unclosed comment or script
    reaches to the end. Set ``unescape_first`` for payloads whose tags are themselves
    entity-escaped.
    """
    text = unescape_entities(raw) if unescape_first else raw
    # Raw-text elements and comments first: what they hold is no markup.
    text = F.regexp_replace(
        text, rf"(?is)<(script|style){_OPENING_REST}.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)", _GONE)
    containers = "|".join(t for t in HIDDEN_TAGS if t not in ("script", "style"))
    text = F.regexp_replace(text, rf"(?i)<(?:{containers}){_OPENING_REST}", _OPEN)
    text = F.regexp_replace(text, rf"(?i)</(?:{'|'.join(HIDDEN_TAGS)}){_TAG_REST}", _CLOSE)
    text = _outside_hidden(text)
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)}){_TAG_REST}", " ")
    text = F.regexp_replace(
        text, rf"</?[a-zA-Z][^\s/>]*+{_TAG_REST}|<[!?][^>]*+>|</[^a-zA-Z>]?[^>]*+>", _GONE)
    return squeeze(F.translate(unescape_entities(text), _OPEN + _CLOSE + _GONE, ""))
