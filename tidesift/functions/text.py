"""Text expressions, Column -> Column, all evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidesift.functions import fixed_values as fixed

# Letters, digits and underscore; spelled out so Java and RE2 agree on it.
WORD = r"[\p{L}\p{N}_]"

# Unicode white space, spelled out for the same reason.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

NON_WS = "[^" + WS[1:]

# What collapsing changes: two or more blanks, or one other than a space. Printable ASCII is ruled out
# first, as a class of many ranges is dear for every character.
_UNEVEN_WS = rf"(?: (?=[[^!-~]&&{WS}])|[[^ -~]&&{WS}])[[^!-~]&&{WS}]*+"

# Alternatives are tried in order: plain word, URL, emoticon, tag, arrow, handle, hashtag,
# mail address, word with inner apostrophe or hyphen, number, word, dots, symbol.
_EYES = r"[:;=8xX]"
_MOUTH = r"[\)\]\(\[dDpPoOcC3/\}\{@\|\\<>]"
SOCIAL_TOKEN = "|".join(
    [
        # most tokens: a word whose next character cannot make it part of anything longer
        r"\p{L}{2,}+(?![\p{L}\p{N}_'\-:/.@])",
        r"(?i:https?://|www\.)[^\s<>]*[^\s<>.,;:!?…\"')\]]",
        rf"(?<!\w)[<>O]?[:;=8][\-o\*']?{_MOUTH}(?!\w)",
        r"</?3(?!\w)",
        r"<[^>\s]+>",
        r"-+>|<-+",
        r"@\w+",
        r"(?U:#+\w[\w'\-]*\w|#\w)",
        r"[\w.+\-]+@[\w\-]+\.(?:[\w\-]\.?)+[\w\-]",
        r"\p{L}(?:[\p{L}]|['\-_])+\p{L}",
        r"[+\-]?\d+[,/.:\-]\d+[+\-]?",
        WORD + "+",
        r"\.(?:\s*\.)+",
        r"[☀-➿\x{1F300}-\x{1FAFF}]️?",
        r"\S",
    ]
)


def norm_ws(text: Column) -> Column:
    """Null to empty, lower case, outer blanks off, inner blanks collapsed."""
    return collapse_ws(F.lower(F.coalesce(text, F.lit(""))))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _UNEVEN_WS, " "))


def words(text: Column) -> Column:
    """Whitespace tokens; the empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS + "+"), lambda w: w != "")


def at_least_words(n: int) -> str:
    """Pattern found in texts of at least n (one or more) whitespace tokens."""
    return rf"\A{WS}*+(?:{NON_WS}++{WS}++){{{n - 1}}}{NON_WS}"


def char_shingles(text: Column, k: int = 5) -> Column:
    """Distinct k-character grams; a text of at most k characters is its own gram.

    One zero-width match per position keeps this linear in the text length.
    """
    grams = F.regexp_extract_all(text, F.lit(rf"(?s)(?=([^\uDC00-\uDFFF].{{{k - 1}}}))"), F.lit(1))
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= k, F.array(text))
        .otherwise(F.array_distinct(grams))
    )


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """The shingle set as 64-bit hashes, for set sizes and intersections."""
    return F.array_distinct(F.transform(char_shingles(text, k), lambda s: F.xxhash64(s)))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD + "{2,}+"), F.lit(0))


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use at several places of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_two_grams(text: Column) -> Column:
    """Word tokens followed by the pairs of neighbouring tokens, with repeats."""

    def grams(tokens: Column) -> Column:
        n = F.size(tokens)
        pairs = F.zip_with(
            F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.concat_ws(" ", a, b),
        )
        return F.concat(tokens, F.when(n > 1, pairs).otherwise(F.array().cast("array<string>")))

    return _let(word_tokens(text), grams)


def gram_profile(text: Column) -> Column:
    """Struct (n_distinct, n_grams, most, lowest) of a text's word tokens and pairs, counted inside the row."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def step(seen: Column, gram: Column) -> Column:
        again = seen["gram"].eqNullSafe(gram)
        run = F.when(again, seen["run"] + 1).otherwise(one)
        return F.struct(
            gram.alias("gram"),
            run.alias("run"),
            F.greatest(seen["most"], run).alias("most"),
            (seen["n_distinct"] + F.when(again, none).otherwise(one)).alias("n_distinct"),
        )

    def counted(grams: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("gram"), none.alias("run"), none.alias("most"), none.alias("n_distinct"))

        def named(last: Column) -> Column:
            return F.struct(
                last["n_distinct"].alias("n_distinct"),
                F.size(grams).cast("long").alias("n_grams"),
                last["most"].alias("most"),
                F.try_element_at(grams, F.lit(1)).alias("lowest"),
            )

        return F.aggregate(grams, start, step, named)

    return _let(F.sort_array(one_two_grams(text)), counted)


def fix_typography(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("’"), F.lit("'")), F.lit("…"), F.lit("..."))


def mask_token(token: Column) -> Column:
    lowered = F.lower(token)
    return (
        F.when(token.startswith("@"), "@USER")
        .when(lowered.startswith("http") | lowered.startswith("www"), "HTTPURL")
        .otherwise(token)
    )


def mask_tokens(tokens: Column) -> Column:
    return F.transform(tokens, mask_token)


def shorten_runs(text: Column) -> Column:
    """Runs of three or more equal characters become three."""
    return F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1$1$1")


def social_tokenize(text: Column) -> Column:
    # no token begins with a blank, and a blank would fail every alternative
    return F.regexp_extract_all(shorten_runs(text), F.lit(rf"(?=\S)(?:{SOCIAL_TOKEN})"), F.lit(0))


def _class_of(chars: set[str]) -> str:
    """Character class; a range rules most characters out before the many beyond Latin are compared."""
    near, far = (sorted(c for c in chars if (c > "\xff") == beyond) for beyond in (False, True))
    beyond = f"[{far[0]}-{far[-1]}&&[{''.join(far)}]]" if far else ""
    return "[" + "".join(map(re.escape, near)) + beyond + "]"


def _any_of(keys: Sequence[str]) -> str:
    """Pattern found in texts that hold one of the keys; classes for the first characters rule out most places."""
    classes = [_class_of({key[i] for key in keys}) for i in range(min(map(len, keys)))]
    tree = {first: [key[1:] for key in keys if key[0] == first] for first in dict.fromkeys(key[0] for key in keys)}
    branches = (re.escape(first) + "(?:" + "|".join(map(re.escape, rest)) + ")" for first, rest in tree.items())
    return f"(?={''.join(classes)})(?:{'|'.join(branches)})"


def _replaced(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in this order; a text without any of the keys is scanned once instead of once a key."""

    def one_by_one(value: Column) -> Column:
        for key, new in pairs:
            value = F.replace(value, F.lit(key), F.lit(new))
        return value

    if len(pairs) < 3:
        return one_by_one(text)
    # bound once, as the text stands at three places
    return _let(text, lambda t: F.when(t.rlike(_any_of([key for key, _ in pairs])), one_by_one(t)).otherwise(t))


def replace_all(text: Column, table: Mapping[str, str], longest_first: bool = True) -> Column:
    """Literal substring replacements, one after the other."""
    keys = [key for key in table if key]
    # keys of one length together: long ones are rarely found, short ones often
    groups = groupby(sorted(keys, key=len, reverse=True), key=len) if longest_first else [(None, keys)] if keys else []
    for _, some in groups:
        text = _replaced(text, [(key, table[key]) for key in some])
    return text


def split_contractions(text: Column) -> Column:
    return _replaced(text, fixed.CONTRACTION_RULES)


def emoticons_to_emoji(text: Column) -> Column:
    return replace_all(text, fixed.EMOTICONS)


def expand_abbreviations(text: Column, mode: str = "substring") -> Column:
    """``substring`` also hits inside words; ``token`` replaces whole blank-separated tokens."""
    if mode == "substring":
        return replace_all(text, fixed.ABBREVIATIONS)
    if mode == "token":
        table = F.create_map(*[F.lit(x) for pair in fixed.ABBREVIATIONS.items() for x in pair])
        return F.array_join(
            F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " "
        )
    raise ValueError("mode must be 'substring' or 'token'")


def demojize(text: Column, names: Mapping[str, str] | None = None) -> Column:
    """Emoji to ``:name:``. Texts without any of the emojis skip the replacements."""
    table = {emoji: f":{name}:" for emoji, name in (names or fixed.EMOJI_NAMES).items()}
    return replace_all(text, table)


def _rewritten(masked: Column, style: str, names: Mapping[str, str] | None) -> Column:
    if style == "bertweet":
        masked = split_contractions(masked)
        masked = emoticons_to_emoji(masked)
        masked = expand_abbreviations(masked)
        masked = demojize(masked, names)
    return collapse_ws(masked)


def normalize_styles(text: Column, styles: Sequence[str] = ("plain", "bertweet"), names: Mapping[str, str] | None = None) -> Column:
    """Struct of ``normalize_text`` in several styles; tokens are found and masked once."""
    if set(styles) - {"plain", "bertweet"}:
        raise ValueError("style must be 'plain' or 'bertweet'")
    masked = F.array_join(mask_tokens(social_tokenize(fix_typography(text))), " ")
    return _let(masked, lambda m: F.struct(*[_rewritten(m, style, names).alias(style) for style in styles]))


def normalize_text(text: Column, style: str = "plain", names: Mapping[str, str] | None = None) -> Column:
    """Typography, tokens, masking; style ``bertweet`` adds the four rewriting steps."""
    return normalize_styles(text, (style,), names)[style]
