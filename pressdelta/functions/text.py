"""Text helpers as Column builders, one definition each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from pressdelta import constants as K

# White space as browsers understand it, including the no-break and other Unicode spaces.
# The rare ones stand behind one range test: other characters pass with two comparisons instead of a dozen.
_WS_ODD = "\\t-\\r\\u00A0[\\u1680-\\uFEFF&&[\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]]"
WS = "\\x20" + _WS_ODD
# Neither letter nor digit; ASCII ones are told by ranges before categories are looked up.
_ALNUM = r"a-zA-Z0-9\p{L}\p{N}"
# ASCII word boundary: Java's \b treats umlauts as letters in some versions and not in others.
BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def rx(pattern: str, ignore_case: bool = True) -> str:
    """A pattern of the constants module in Java form."""
    return ("(?iu)" if ignore_case else "") + pattern.replace(r"\b", BOUNDARY)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value for an expression.  A column that is used inside the lambda of an array function would be computed
    again for every element once Spark merges the projections; a bound value is computed once per row."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def collapse_ws(c: Column) -> Column:
    """White space runs to one blank, trimmed."""
    # single blanks stay as they are: only what changes is matched
    return F.trim(F.regexp_replace(c, f"[{_WS_ODD}][{WS}]*|\\x20[{WS}]+", " "))


norm_txt = collapse_ws


def para_key(c: Column) -> Column:
    """Key of a paragraph across versions: the first 120 normalised characters."""
    return F.substring(F.lower(norm_txt(c)), 1, 120)


def decode_entities(c: Column, collapse: bool = True) -> Column:
    """HTML entities to characters.  The capture form ignores case and collapses white space; the view form keeps it."""
    if collapse:
        forms, flag = (("&nbsp;|&#160;|&#xa0;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")), "(?i)"
    else:
        forms, flag = (("&(?:nbsp|#160);", " "), ("&(?:quot|#34);", '"'), ("&(?:apos|#39);", "'"), ("&(?:lt|#60);", "<"), ("&(?:gt|#62);", ">"), ("&(?:amp|#38);", "&")), ""
    plain = c
    for pattern, text in forms:
        plain = F.regexp_replace(plain, flag + pattern, text)
    # most texts have no entity at all: one search instead of six
    plain = F.when(c.contains("&"), plain).otherwise(c)
    return collapse_ws(plain) if collapse else plain


def split_words(c: Column) -> Column:
    """Non-empty white-space separated words, in order."""
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def strip_punct(c: Column) -> Column:
    return F.regexp_replace(c, f"^[^{_ALNUM}]+|[^{_ALNUM}]+$", "")


def norm_token(c: Column, inner: bool = False) -> Column:
    """Comparable form of a word: outer punctuation off (or all of it with `inner`), lower case."""
    return F.lower(F.regexp_replace(c, f"[^{_ALNUM}]", "")) if inner else F.lower(strip_punct(c))


def letter_tokens(c: Column) -> Column:
    """Distinct letter runs and digit runs, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\p{N}+)"), 1))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays, 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / (F.size(a) + F.size(b) - inter))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(letter_tokens(a), letter_tokens(b))


def norm_words(c: Column) -> Column:
    """Normalised non-empty words, with repeats.

    As `norm_token` of each word, but on the whole text before it is cut: what is neither letter nor digit goes at both ends of words."""
    mark = f"[^{_ALNUM}{WS}]"
    bare = F.regexp_replace(c, f"(?={mark})(?:{mark}++(?![^{WS}])|(?<![^{WS}]){mark}++)", "")
    return F.transform(split_words(bare), lambda w: F.lower(w))


def occurrences(words: Column, wanted: Column) -> Column:
    """The words of a list, repeats included, that are in a (small) set; both already bound."""
    return F.filter(words, lambda w: F.array_contains(wanted, w))


def word_overlap(a: Column, b: Column) -> Column:
    """Occurrences in a of words that b has, over the size of the union set.  Repeats can push it above 1."""
    def ratio(s: Column) -> Column:
        x, y = s["x"], s["y"]
        missing = let(F.array_except(x, y), lambda d: F.size(occurrences(x, d)))
        return (F.size(x) - missing).cast("double") / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return let(F.struct(norm_words(a).alias("x"), norm_words(b).alias("y")), ratio)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, n))


def number_tokens(c: Column) -> Column:
    """Numbers with their inner separators; one trailing separator is cut."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d[\d.,:]*)"), 1), lambda x: F.regexp_replace(x, "[.,:]$", ""))


def simple_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d+[.,]?\d*)"), 1)


def is_name(c: Column) -> Column:
    """A capitalised word of at least two characters."""
    w = strip_punct(c)
    return w.rlike(r"^[A-ZÄÖÜ][\p{L}.-]+$") & (F.length(w) > 1)


def is_person(c: Column) -> Column:
    """Two capitalised words next to each other."""
    return c.rlike(r"\p{Lu}[\p{Ll}.'-]+[" + WS + r"]+\p{Lu}[\p{Ll}.'-]+")


# Latin letters with marks and their base letters, position by position.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def strip_accents(c: Column) -> Column:
    """Base letters of marked Latin letters (lower and upper case); combining marks dropped."""
    c = F.translate(c, _MARKED + _MARKED.upper(), _PLAIN + _PLAIN.upper())
    return F.regexp_replace(c, "[\\u0300-\\u036F]", "")


def pretty(c: Column) -> Column:
    """Label of a path segment: separators to blanks, each ASCII word capitalised."""
    words = F.regexp_replace(c, "[-_]+", " ")
    # a letter starts a word when no ASCII word character stands before it
    parts = F.regexp_extract_all(words, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), 1)
    cap = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[a-z]"), cap(p)).otherwise(p)), "")


def fingerprint(c: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the lower-cased text."""
    return F.substring(F.sha1(F.lower(c)), 1, 12)


def cut_head(c: Column, n: int) -> Column:
    """Last n characters, starting at a word."""
    return F.regexp_replace(F.when(F.length(c) > n, F.substr(c, F.length(c) - F.lit(n - 1))).otherwise(c), f"^[^{WS}]*[{WS}]+", "")


def cut_tail(c: Column, n: int) -> Column:
    """First n characters, ending at a word."""
    return F.regexp_replace(F.substring(c, 1, n), f"[{WS}]+[^{WS}]*\\z", "")


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(" …"))).otherwise(c)


def contains_ci(c: Column, q: str) -> Column:
    """LIKE '%q%' ignoring case; wildcards inside q stay active."""
    return c.ilike("%" + q + "%")


def split_paragraphs(body: Column) -> Column:
    """Lines of a text as normalised paragraphs: decoded, 60 characters or more, no boilerplate."""
    lines = F.transform(F.split(body, "\\n+"), lambda p: decode_entities(p))
    return F.filter(lines, lambda p: (F.length(p) >= K.PARA_MIN_CHARS) & ~is_boilerplate(p))


def is_boilerplate(p: Column) -> Column:
    """The pattern of boilerplate, behind plain searches for a part of each of its forms.  Letters that the pattern takes for s, i or k in
    spite of their lower case go to the pattern."""
    near = F.exists(F.array(F.lower(p)), lambda low: reduce(or_, [low.contains(x) for x in K.BOILERPLATE_PARTS]))
    odd = reduce(or_, [p.contains(x) for x in "\u017f\u0130\u0131"])
    return F.when(near | odd, p.rlike(rx(K.BOILERPLATE))).otherwise(F.when(p.isNotNull(), F.lit(False)))


def short_name(c: Column) -> Column:
    return F.replace(c, F.lit(" Online"), F.lit(""))
