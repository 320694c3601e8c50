"""SQL forms of the text helpers, for the oracle."""

from pressdelta import constants as K

WS = r"\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def decode(e):
    for p, t in (("&nbsp;|&#160;|&#xa0;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "''"), ("&lt;", "<"), ("&gt;", ">")):
        e = f"regexp_replace({e}, '{p}', '{t}', 'gi')"
    return collapse(e)


def collapse(e):
    return f"trim(regexp_replace({e}, '[{WS}]+', ' ', 'g'))"


def paras(e):
    return f"list_filter(list_transform(regexp_split_to_array({e}, '\\n+'), lambda p: {decode('p')}), lambda p: length(p) >= 60 AND NOT regexp_matches(p, '{K.BOILERPLATE}', 'i'))"


def fp(e):
    return f"substr(sha1(lower({e})), 1, 12)"


def fps(e):
    return f"list_transform({e}, lambda p: {fp('p')})"


def words(e):
    return f"list_filter(regexp_split_to_array({e}, '[{WS}]+'), lambda w: w <> '')"


def norm(e, inner=False):
    p = r"[^\p{L}\p{N}]" if inner else r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    return f"lower(regexp_replace({e}, '{p}', '', 'g'))"


def norm_words(e):
    return f"list_filter(list_transform({words(e)}, lambda w: {norm('w')}), lambda w: w <> '')"


def tokens(e):
    return f"list_distinct(regexp_extract_all(lower({e}), '\\p{{L}}+|\\p{{N}}+'))"


def trim_ws(e):
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def except_(a, b):
    return f"list_filter({a}, lambda q: NOT list_contains({b}, q))"


def in_list(words_):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words_) + ")"
