"""String columns: accent folding, snippets, labels and formatting."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_SPAN = 110
#: Number words.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


@cache
def _folding() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character and combining marks U+0300 to U+036F, and their bases."""
    pairs = []
    for code in range(0xC0, 0x1F000):
        char = chr(code)
        if 0xAC00 <= code < 0xD7B0:
            continue
        apart = unicodedata.normalize("NFD", char)
        base = "".join(c for c in apart if not "̀" <= c <= "ͯ")
        if base != char and len(base) == 1 and apart != char:
            pairs.append((char, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents, curly apostrophes straight; null becomes empty. Letters such as o with stroke stay themselves.

    A character becomes one other, so that places in the text stay; those that decompose to several bases (Hangul syllables, a few ligatures of Indic
    scripts) stay composed, and match texts in which they are composed.
    """
    source, target = _folding()
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), source + "’‘", target + "''")
    return F.regexp_replace(plain, "[\\u0300-\\u036f]", "")


def contains_folded(text: Column, query: str) -> Column:
    """Whether the folded text holds the (folded) query."""
    return F.contains(fold(text), fold(F.lit(query)))


def snippet(text: Column, query: str, span: int = SNIPPET_SPAN) -> Column:
    """A window of `span` characters that starts a third before the first folded hit, with ellipses where it cuts."""
    text = F.coalesce(text, F.lit(""))
    at = F.locate(query, fold(text)) - 1
    start = F.greatest(F.lit(0), at - span // 3)
    end = F.least(F.length(text), start + span)
    cut = F.trim(F.substring(text, start + 1, end - start))
    whole = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at < 0, F.substring(text, 1, span)).otherwise(whole)


def highlight(text: Column, query: str) -> Column:
    """The text with its first folded hit in a mark element."""
    at = F.locate(query, fold(text))
    n = len(query)
    marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("<mark>"), F.substring(text, at, F.lit(n)), F.lit("</mark>"), F.substring(text, at + n, F.length(text)))
    return F.when(at > 0, marked).otherwise(text)


def escape_html(text: Column) -> Column:
    """The five reserved characters as entities; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def byte_size(n: Column) -> Column:
    """Bytes as 'n B', 'n KB' (rounded) or 'n.n MB'."""
    kb = F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))
    mb = F.concat((F.floor(n / (1024.0 * 1024) * 10 + 0.5) / 10).cast("decimal(20,1)").cast("string"), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, kb).otherwise(mb)


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space in any script; blank and null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?U)\\S+"))


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit("(?U)\\S"))


def number_word(n: Column) -> Column:
    """zero to twelve in words, other numbers in digits."""
    words = F.array(*map(F.lit, NUMBER_WORDS))
    return F.coalesce(F.when((n >= 0) & (n <= 12), F.get(words, n.cast("int"))), n.cast("string"))


def truncated(text: Column, most: int = 190) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def mean_line_length(lines: Column) -> Column:
    """Mean length of an array of lines (0 lines: null)."""
    total = F.aggregate(lines, F.lit(0).cast("double"), lambda acc, x: acc + F.length(x))
    return F.when(F.size(lines) > 0, total / F.size(lines))


def build_reference(kind: str, *keys: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *keys)


def _long_date(key: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(key, F.lit("yyyy-MM-dd")), "EEEE, MMMM d, yyyy"), key)


#: What references are called, and where they lead; a caller may have other words.
LABELS = {"day": "Morning, ", "examen": "Evening, ", "voice": "Voice of ", "voice?": "A voice", "passage": "Passage: ", "passage?": "A passage", "": "Some note"}
LINKS = {"passage": "/plans/", "voice": "/kept", "": "/day"}


def reference_label(ref: Column, words: dict[str, str] = LABELS) -> Column:
    """What a 'kind:key:...' reference is about: a day, its examen, a voice of a month-day, a passage, or any note."""
    part = F.split(ref, ":")
    kind, first, last = part[0], F.get(part, F.lit(1)), F.get(part, F.lit(2))
    month_day = F.split(last, "-")
    month = F.get(month_day, F.lit(0)).try_cast("int")
    named = F.date_format(F.make_date(F.lit(2000), F.when(month.between(1, 12), month), F.lit(1)), "MMMM")
    voice = F.concat(F.lit(words["voice"]), named, F.lit(" "), F.get(month_day, F.lit(1)))
    passage = F.concat(F.lit(words["passage"]), first, F.lit(", "), last)
    told = F.when(kind == "voice", F.coalesce(voice, F.lit(words["voice?"]))).when(kind == "passage", F.coalesce(passage, F.lit(words["passage?"])))
    for of_day in ("day", "examen"):
        told = told.when(kind == of_day, F.concat(F.lit(words[of_day]), _long_date(first)))
    return told.otherwise(words[""])


def reference_link(ref: Column, places: dict[str, str] = LINKS) -> Column:
    part = F.split(ref, ":")
    return F.when(part[0] == "passage", F.concat(F.lit(places["passage"]), F.get(part, F.lit(1)))).when(part[0] == "voice", places["voice"]).otherwise(places[""])
