"""Text functions for bilingual (Persian and Latin) catalogs and queries, as Column expressions.

Null texts count as empty unless a docstring says otherwise.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: what normalization removes, unifies and folds ------------------------------------
ZERO_WIDTH = "​‍﻿‎‏‪‫‬‭‮⁦⁧⁨⁩"
DIACRITICS = "ًٌٍَُِّْٰٓٔـ"
LETTERS = {
    "ي": "ی", "ى": "ی", "ئ": "ی", "ك": "ک", "ة": "ه", "ۀ": "ه", "آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ؤ": "و",
}
DIGITS = {"۰۱۲۳۴۵۶۷۸۹": "0123456789", "٠١٢٣٤٥٦٧٨٩": "0123456789"}
SPACES = "‌\t\n\x0b\x0c\r\xa0                　"
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
#: Keys of the Latin layout and the Persian letters on them.
KEYS = {
    "q": "ض", "w": "ص", "e": "ث", "r": "ق", "t": "ف", "y": "غ", "u": "ع", "i": "ه", "o": "خ", "p": "ح", "a": "ش", "s": "س",
    "d": "ی", "f": "ب", "g": "ل", "h": "ا", "j": "ت", "k": "ن", "l": "م", "z": "ظ", "x": "ط", "c": "ز", "v": "ر", "b": "ذ",
    "n": "د", "m": "ئ", ";": "ک", "'": "گ", ",": "و", "[": "ج", "]": "چ", "\\": "پ", "C": "ژ",
}
SUSPICIOUS = r"(?i)extractvalue|concat\s*\(\s*0x|union\s+(?:all\s+)?select|sleep\s*\("
#: What entities leave of themselves without ampersand and semicolon, and what they stood for.
REMAINS = ((r"(?<=\p{L})#0?39(?=s\b)", "'"), ("(?i)ampquot", '"'), ("(?i)ampamp", "&"))
# ----------------------------------------------------------------------------------------------------

WORD_BREAK = r"[^\p{L}\p{N}]+"
WHITE = r"\s\x1c-\x1f\x85\p{Z}"  # inside brackets


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def canonical(c) -> Column:
    """Letters, digits and spaces unified; lower case; no separators inside model names; single spaces."""
    source = "".join(LETTERS) + "".join(DIGITS) + SPACES
    target = "".join(LETTERS.values()) + "".join(DIGITS.values()) + " " * len(SPACES)
    # characters beyond the target's length are deleted
    folded = F.lower(F.translate(_text(c), source + ZERO_WIDTH + DIACRITICS, target))
    joined = F.regexp_replace(folded, r"(?<=[0-9a-z])[-_./]+(?=[0-9a-z])", "")
    return F.trim(F.regexp_replace(joined, " +", " "))


def normalize(c) -> Column:
    """Canonical, and Roman numerals ii to ix right after a token with a letter become digits."""
    shape = r"^([^\p{L}\p{N}]*)(viii|vii|iii|iv|vi|ix|ii)([^\p{L}\p{N}]*)$"
    digits = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))

    def one(before: Column, token: Column) -> Column:
        # the token before it decides in its own form, so that two numerals in a row both become digits
        digit = F.concat(F.regexp_extract(token, shape, 1), F.element_at(digits, F.regexp_extract(token, shape, 2)), F.regexp_extract(token, shape, 3))
        return F.when(before.rlike(r"\p{L}") & token.rlike(shape), digit).otherwise(token)

    def whole(text: Column) -> Column:
        # each token beside the one before it; the last pair has no token and is skipped
        tokens = F.split(text, " ")
        pairs = F.zip_with(F.concat(F.array(F.lit("")), tokens), tokens, one)
        some = text.rlike(r" [^\p{L}\p{N}]*(viii|vii|iii|iv|vi|ix|ii)[^\p{L}\p{N}]*( |$)")
        return F.when(some, F.array_join(pairs, " ")).otherwise(text)

    return once(canonical(c), whole)


def normalize_sku(c) -> Column:
    """A code without anything but letters and digits."""
    return F.regexp_replace(canonical(c), WORD_BREAK, "")


def collapse(c) -> Column:
    """T4: normalized without anything but letters and digits."""
    return F.regexp_replace(normalize(c), WORD_BREAK, "")


def tokenize(c) -> Column:
    """T5: the runs of letters and digits."""
    return F.filter(F.split(_text(c), WORD_BREAK), lambda t: t != "")


def collapsed_identity(*parts, limit: int = 700) -> Column:
    """The collapsed parts that aren't empty, joined, cut to ``limit`` characters."""
    return F.substring(F.concat_ws(" ", *(F.nullif(collapse(p), F.lit("")) for p in parts)), 1, limit)


def unescape(c, passes: int) -> Column:
    """HTML entities decoded up to ``passes`` times, in one call. There's no such expression in Spark, hence a pandas UDF."""

    def decoded(text: str) -> str:
        for _ in range(passes):
            if "&" not in text:
                break
            text = html.unescape(text)
        return text

    @F.pandas_udf("string")  # made here, since workers that import this module have no session
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(decoded, na_action="ignore")

    return run(_text(c))


def clean_text(c) -> Column:
    """Entities decoded, tags replaced by spaces, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(unescape(c, 3), "<[^>]*>", " "), r"\s+", " "), r"^\s+|\s+$", "")


def strip_markup(c) -> Column:
    """T7 without the entities: expressions only."""
    return F.trim(F.regexp_replace(F.regexp_replace(_text(c), "<[^>]*>", " "), r"\s+", " "))


def clean_tags(c) -> Column:
    """Words of a tag list, cleaned, without one-character ones, unless digits; a bare NULL is empty."""
    clean = clean_text(c)
    words = F.filter(F.split(clean, " "), lambda t: (F.length(t) > 1) | t.rlike(r"^\p{Nd}+$"))
    return F.when(F.upper(clean) == "NULL", "").otherwise(F.array_join(words, " "))


def index_description(c, limit: int) -> Column:
    """Cut at ``limit`` characters, back to white space if inside a word (one longer than that goes), without
    white space at the end; all of it for 0 or less, or if it's no longer."""
    text = _text(c)
    if limit <= 0:
        return text
    cut = F.substring(text, 1, limit)
    inside = ~F.substring(text, limit + 1, 1).rlike(f"[{WHITE}]")
    # a line feed may follow the word that is cut away, as it goes with the white space before it
    back = F.when(inside, F.regexp_replace(cut, rf"[^{WHITE}]+\n?\z", "")).otherwise(cut)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(back, rf"[{WHITE}]+\z", ""))


def attribute_pairs(c) -> Column:
    """array<struct<name, value>> of ``name: value | name: value``, cleaned; a bare value has an empty name."""

    def one(part: Column) -> Column:
        p = F.concat(strip_markup(part), F.lit(" "))  # a name with an empty value is a pair
        at = F.instr(p, ": ")
        name = F.when(at > 0, F.trim(F.substring(p, F.lit(1), at - 1))).otherwise("")
        value = F.when(at > 0, F.trim(F.substring(p, at + 2, F.length(p)))).otherwise(F.trim(p))
        return F.struct(name.alias("name"), value.alias("value"))

    return F.filter(F.transform(F.split(unescape(c, 3), r" \| "), one), lambda x: x["value"] != "")


def compose_specs(pairs: Column, titles: Column) -> Column:
    """``name: value`` pairs, then titles, joined by bars."""
    named = F.transform(pairs, lambda x: F.when(x["name"] == "", x["value"]).otherwise(F.concat(x["name"], F.lit(": "), x["value"])))
    return F.array_join(F.concat(named, F.coalesce(titles, F.array().cast("array<string>"))), " | ")


def compose_passage(parts: list, description, limit: int) -> Column:
    """The parts that aren't empty, then as much of the description as the limit leaves."""
    head = F.concat_ws(" ", *(F.nullif(F.trim(_text(p)), F.lit("")) for p in parts))
    room = F.greatest(F.lit(limit) - F.length(head) - 1, F.lit(0))
    tail = F.rtrim(F.substring(_text(description), F.lit(1), room))
    return F.substring(F.when((room > 0) & (tail != ""), F.concat_ws(" ", F.nullif(head, F.lit("")), tail)).otherwise(head), 1, limit)


def query_clean(c) -> Column:
    """Entities decoded twice; their remains without ampersand and semicolon repaired."""
    text = unescape(c, 2)
    for pattern, meant in REMAINS:
        text = F.regexp_replace(text, pattern, meant)
    return text


def is_suspicious(c) -> Column:
    """An SQL probe; two dashes only count together with a quote."""
    text = _text(c)
    return text.rlike(SUSPICIOUS) | (F.contains(text, F.lit("--")) & text.rlike("['\"`]"))


def cap(c, max_chars: int = 100, max_tokens: int = 8) -> Column:
    """struct<text, was_cut>: at most so many words and characters."""
    words = F.filter(F.split(_text(c), r"\s+"), lambda w: w != "")
    text = F.trim(F.substring(F.array_join(F.slice(words, 1, max(1, max_tokens)), " "), 1, max(1, max_chars)))
    return F.struct(text.alias("text"), (text != F.array_join(words, " ")).alias("was_cut"))


def layout(mapping: dict[str, str]) -> tuple[str, str]:
    """The characters of a key mapping and what they become, in the same order."""
    full = dict(mapping)
    for k in mapping:  # a letter without a key of its own goes by its lower case
        if k.isalpha() and k.upper() != k and len(k.upper()) == 1:
            full.setdefault(k.upper(), mapping[k])
    return "".join(full), "".join(full.values())


def _remap(c, mapping: dict[str, str]) -> Column:
    punctuation = "".join("\\" + k for k in mapping if not k.isalpha())
    shape = rf"^[\p{{L}}{punctuation}]*\p{{L}}[\p{{L}}{punctuation}]*\p{{N}}*$"
    source, target = layout(mapping)
    unified = F.translate(_text(c), "يك", "یک")
    words = F.regexp_extract_all(unified, F.lit(r"\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.when(w.rlike(shape), F.translate(w, source, target)).otherwise(w)), "")


def en_to_fa(c) -> Column:
    """Latin keys pressed for Persian ones."""
    return _remap(c, KEYS)


def fa_to_en(c) -> Column:
    """Persian keys pressed for Latin ones."""
    return _remap(c, {fa: en for en, fa in KEYS.items()})


def mask_digits(c) -> Column:
    """Runs of seven or more digits become #; a text that is longer than 80 characters then, [long query]."""
    masked = F.regexp_replace(_text(c), r"\p{Nd}{7,}", "#")
    return F.when(F.length(masked) > 80, "[long query]").otherwise(masked)


def word_prefix_match(tokens: Column, token: Column) -> Column:
    """Some word starts with ``token``."""
    return F.exists(tokens, lambda w: F.startswith(w, token))


def phrase_match(c, tokens: Column) -> Column:
    """The tokens in a row, whole words but for the last, which may be a prefix."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.array_join(tokens, r"[^\p{L}\p{N}]+"))
    return F.regexp_like(_text(c), pattern)


def contiguous_run(tokens: Column, phrase: Column) -> Column:
    """``phrase`` (tokens) as a run of whole tokens."""
    around = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return F.contains(around(tokens), around(phrase))


def length_bucket(c) -> Column:
    """Words, at most 5."""
    text = _text(c)
    return F.least(F.lit(5), 1 + F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))))


def transpositions(c: Column) -> Column:
    """The texts with two neighbouring characters swapped."""
    swap = lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, F.length(c)))
    return F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), swap)).otherwise(F.array().cast("array<string>"))


def keeps_digits(before: Column, after: Column) -> Column:
    """Every digit of ``before`` is in ``after`` at least as often."""
    count = lambda text, d: F.length(text) - F.length(F.replace(text, d, F.lit("")))
    return F.forall(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: count(before, d) <= count(after, d))


def name_and_digits(c: Column) -> Column:
    """struct<word, digits> of a word with digits behind it; else the text and no digits."""
    shape = r"^(\p{L}+)(\d+)$"
    fits = c.rlike(shape)
    return F.struct(F.when(fits, F.regexp_extract(c, shape, 1)).otherwise(c).alias("word"), F.when(fits, F.regexp_extract(c, shape, 2)).otherwise("").alias("digits"))


def resolve_url(c, base: str) -> Column:
    """Relative addresses under ``base``; those with a scheme or two slashes stay, empty ones too."""
    text = F.trim(_text(c))
    absolute = text.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//")
    return F.when((text == "") | absolute, text).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(text, "^/+", "")))


def server_timing(c) -> Column:
    """Map of name to milliseconds of a ``name;dur=1.5, name;dur=2`` header."""
    shape = r"([A-Za-z_]+)\s*;\s*dur=([0-9.]+)"
    names, values = (F.regexp_extract_all(_text(c), F.lit(shape), F.lit(i)) for i in (1, 2))
    return F.map_from_entries(F.array_distinct(F.arrays_zip(names.alias("name"), F.transform(values, lambda v: v.cast("double")).alias("ms"))))


def outcome(reason) -> Column:
    """The class of a failure's reason."""
    r = F.lower(_text(reason))
    rules = (("ok", r == ""), ("timeout", r.rlike("timed? ?out")), ("dns", r.rlike("resolve|dns")), ("connect", r.rlike("connect|refused")), ("http", r.rlike("http [0-9]{3}|status")), ("malformed", r.rlike("json|malformed|invalid")))
    out = F.lit("error")
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def cache_key(*columns) -> Column:
    """SHA-1 over the JSON of the inputs."""
    return F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def hash_prefix(c) -> Column:
    """The first eight digits of a text's SHA-1."""
    return F.substring(F.sha1(_text(c)), 1, 8)


def feature_titles_udf():
    """Every ``title`` of a PHP-serialized map, as array<string>; empty for an empty text, null if malformed."""

    @F.pandas_udf("array<string>")
    def titles(blobs: pd.Series) -> pd.Series:
        return blobs.map(serialized_titles)

    return titles


class _Serialized:
    """Reader of PHP's serialization: lengths count bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def until(self, mark: bytes) -> bytes:
        end = self.data.index(mark, self.at)
        out, self.at = self.data[self.at : end], end + len(mark)
        return out

    def value(self):
        kind = self.until(b";" if self.data[self.at : self.at + 1] == b"N" else b":")
        if kind == b"N":
            return None
        if kind in (b"i", b"b", b"d"):
            return float(self.until(b";")) if kind == b"d" else int(self.until(b";"))
        if kind == b"s":
            size = int(self.until(b":"))
            out, close = self.data[self.at + 1 : self.at + 1 + size], self.data[self.at + 1 + size : self.at + 3 + size]
            if close != b'";':
                raise ValueError("wrong length")
            self.at += size + 3
            return out.decode()
        if kind == b"a":
            count = int(self.until(b":"))
            self.until(b"{")
            out = [(self.value(), self.value()) for _ in range(count)]
            self.until(b"}")
            return dict(out)
        raise ValueError("unknown kind")


def serialized_titles(blob: str | None) -> list[str] | None:
    text = (blob or "").strip()
    if not text:
        return []
    for attempt in (text, html.unescape(text)):
        try:
            return list(_titles(_Serialized(attempt.encode()).value()))
        except (ValueError, IndexError, UnicodeDecodeError, RecursionError):
            continue
    return None


def _titles(node) -> Iterator[str]:
    if isinstance(node, dict):
        for key, value in node.items():
            if key == "title" and isinstance(value, str) and value.strip():
                yield value.strip()
            else:
                yield from _titles(value)


def like_escape(c, escape: str = "\\") -> Column:
    """A text as it stands inside a LIKE pattern: the escape character, ``%`` and ``_`` escaped."""
    out = F.replace(_text(c), F.lit(escape), F.lit(escape * 2))
    for special in "%_":
        out = F.replace(out, F.lit(special), F.lit(escape + special))
    return out


def rest_of(tokens: Column, taken: Column) -> Column:
    """SET3: the tokens that aren't among those taken, in their order, repeated ones included."""
    return F.filter(tokens, lambda t: ~F.array_contains(taken, t))
