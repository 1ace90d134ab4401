"""Text functions of the rule language and of name handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_at(text: Column, at: Column | int) -> Column:
    return F.substring(text, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(1))


def index_of(text: Column, part: str) -> Column:
    """Zero-based place of the first occurrence, -1 if there is none."""
    return F.instr(text, part) - 1


def last_index_of(text: Column, part: str) -> Column:
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(text) - back - len(part) + 1)


def part_of(text: Column, start: int, end: int) -> Column:
    """Characters from ``start`` to before ``end``."""
    return F.substring(text, start + 1, end - start)


def replace_first(text: Column, old: str, new: str, times: int) -> Column:
    """The first ``times`` occurrences replaced."""
    parts = F.split(text, _quoted(old), times + 1)
    head = F.array_join(F.slice(parts, F.lit(1), F.size(parts)), new)
    return head


def _quoted(literal: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in literal)


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# fixed values: what brackets may hold when they count as empty (space to full stop), and what is cut off both ends
_FILLING = "".join(map(chr, range(0x20, 0x2F)))
_EDGES = " \t\n\r\f\v./-"


def _without(text: Column, letters: str) -> Column:
    return F.regexp_replace(text, letters, "")


def only_latin(text: Column) -> Column:
    """Whether all letters are Latin ones; other characters do not matter, an empty or null text is not."""
    foreign = _without(_without(text, r"\P{L}"), r"\p{IsLatin}")
    return F.coalesce((foreign == "") & (text != ""), F.lit(False))


def without_latin(text: Column) -> Column:
    """The name without Latin letters and the brackets and dashes left over; null if nothing stays."""
    left = _without(text, r"(?=\p{L})\p{IsLatin}")
    for opening, closing in ("()", "[]"):
        left = _without(left, f"{_quoted(opening)}[{_quoted(_FILLING)}]*{_quoted(closing)}")
    words = F.filter(F.split(F.btrim(left, F.lit(_EDGES)), r"\s+"), lambda w: w != "")
    return F.when(left == text, F.trim(text)).otherwise(F.nullif(F.array_join(words, " "), F.lit("")))


def language_tag(text: Column) -> Column:
    """A well-formed BCP 47 tag that opens with a lower-case language of two or three letters."""
    return F.coalesce(text.rlike(r"^(?=[a-z])[A-Za-z]{2,3}(?:-[A-Za-z]{3}){0,3}(?:-[A-Za-z]{4})?(?:-(?:[A-Za-z]{2}|\d{3}))?(?:-(?:[A-Za-z0-9]{5,8}|\d[A-Za-z0-9]{3}))*(?:-[A-WY-Za-wy-z0-9](?:-[A-Za-z0-9]{2,8})+)*(?:-[xX](?:-[A-Za-z0-9]{1,8})+)?$"), F.lit(False))


def name_tag(key: Column) -> Column:
    return F.coalesce(key.startswith("name:") & language_tag(F.substring(key, 6, 1_000)), F.lit(False))


def storage(size: Column) -> Column:
    """Bytes in short form: 1.2k, 3.4M."""
    steps = [(1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "k")]
    shown = F.when(size < 1000, size.cast("bigint").cast("string"))
    for factor, letter in reversed(steps):
        shown = shown.when(size < factor * 1000, F.concat(F.regexp_replace(F.format_number(size / factor, 1), r"\.0$|,", ""), F.lit(letter)))
    return shown


def percent(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("int").cast("string"), F.lit("%"))
