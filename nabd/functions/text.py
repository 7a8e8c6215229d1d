"""Text rules as column expressions. Everything here runs in the JVM."""

import re
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from nabd import fixed_values as fv
from nabd.functions.values import first_present, let


def _text(column) -> Column:
    return F.coalesce(column, F.lit(""))


def _mapped(column, table: dict, dropped: str = "") -> Column:
    """One character pass: replace the keys of `table`, remove the characters of `dropped`."""
    return F.translate(column, "".join(table) + dropped, "".join(table.values()))


@cache
def one_of(members: str) -> str:
    """The class `[members]`, so that Java looks up Latin letters in a table.

    It walks a list of ranges one by one; here only characters beyond U+00FF are sent through it.
    """
    known = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: rf"\U{int(m[1], 16):08x}", members) + "]")
    latin = "".join(rf"\x{{{i:x}}}" for i in range(256) if known.match(chr(i)))
    return rf"[{latin}[\x{{100}}-\x{{10FFFF}}&&[{members}]]]"


def strip(column) -> Column:
    space = one_of(fv.WHITESPACE)
    return F.regexp_replace(column, f"^{space}+|{space}+$", "")


def collapse_whitespace(column) -> Column:
    # Lone spaces, by far the most frequent case, are left as they are.
    # A character is tested once: a run starts with another one than a space, or is longer than one.
    space = one_of(fv.WHITESPACE)
    runs = f"{space}(?:(?<! ){space}*|{space}+)"
    return F.trim(F.regexp_replace(column, runs, " "))


def search_key(column) -> Column:
    """Light key for keyword matching: no short vowels, folded letter forms, lower case."""
    return F.lower(_mapped(_text(column), fv.SEARCH_LETTERS, fv.SEARCH_MARKS))


def remove_diacritics(column) -> Column:
    return F.translate(_text(column), fv.DIACRITICS, "")


def normalize_letters(column) -> Column:
    return _mapped(_text(column), fv.FULL_LETTERS)


def normalize_digits(column) -> Column:
    return F.translate(_text(column), fv.ARABIC_DIGITS, fv.ASCII_DIGITS)


def fold_for_search(column) -> Column:
    """Full search normalization of text that is already in NFC."""
    table = {**fv.FULL_LETTERS, **dict(zip(fv.ARABIC_DIGITS, fv.ASCII_DIGITS))}
    return F.lower(collapse_whitespace(_mapped(_text(column), table, fv.DIACRITICS)))


def _distinct_names(column, pattern: str) -> Column:
    found = F.regexp_extract_all(_text(column), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def mentions(column) -> Column:
    return _distinct_names(column, fv.MENTION)


def hashtags(column) -> Column:
    return _distinct_names(column, fv.HASHTAG)


def is_retweet(column) -> Column:
    return _text(column).rlike(fv.RETWEET_PREFIX)


def _open_hashtags(column) -> Column:
    """Drop the # of each hashtag and turn its underscores into spaces.

    The # becomes a mark that text cannot hold (a stray one is swapped for another character that
    cleaning removes as well), underscores shortly behind a mark go, then the marks go.
    """
    mark = F.lit(fv.TAG_MARK)
    s = F.replace(column, mark, F.lit(fv.STRAY_MARK))
    s = F.regexp_replace(s, fv.HASHTAG_SIGN, fv.TAG_MARK)
    s = F.regexp_replace(s, fv.UNDERSCORE_IN_TAG, " ")
    return F.replace(s, mark, F.lit(""))


def _where(column, signs: tuple[str, ...], change) -> Column:
    """`change` applied to texts that hold one of `signs`, as every text that it changes does."""
    held = lambda v: reduce(or_, (F.contains(v, F.lit(s)) for s in signs))
    return let(column, lambda v: F.when(held(v), change(v)).otherwise(v))


def remove_markup(
    column, *, remove_emojis=True, keep_hashtag_text=True, keep_mention_text=False
) -> Column:
    """Cleaning steps between entity decoding and the final NFC pass."""
    s = _where(_text(column), ("RT", "Rt", "rT", "rt"), lambda v: F.regexp_replace(v, fv.RETWEET_PREFIX, ""))
    s = _where(s, ("://", "WW.", "Ww.", "wW.", "ww."), lambda v: F.regexp_replace(v, fv.URL, " "))
    name = "$1" if keep_mention_text else " "
    s = _where(s, ("@",), lambda v: F.regexp_replace(v, fv.MENTION, name))
    if keep_hashtag_text:  # without a # only stray marks could change, and cleaning removes any
        s = _where(s, ("#",), _open_hashtags)
    else:
        s = F.regexp_replace(s, fv.HASHTAG, " ")
    if remove_emojis:
        s = F.regexp_replace(s, one_of(fv.EMOJI.removeprefix("[").removesuffix("]+")) + "+", " ")
    s = _where(s, ("!!!", "???", "...", "\u061f" * 3), lambda v: F.regexp_replace(v, fv.REPEATED_PUNCTUATION, "$1"))
    return F.regexp_replace(s, one_of(fv.OUTSIDE_KEPT_CHARS[1:-1]), " ")


def is_valid_text(column, min_chars=fv.MIN_CLEAN_CHARS, min_arabic=fv.MIN_ARABIC_CHARS) -> Column:
    if min_chars < 2:
        long_enough = F.length(strip(column)) >= min_chars
    else:  # found near the start of most texts, where stripping walks over all of it
        shown = f"[^{fv.WHITESPACE}]"
        long_enough = column.rlike(f"(?s){shown}.{{{min_chars - 2},}}?{shown}")
    return long_enough & (F.regexp_count(column, F.lit(fv.ARABIC_BLOCK)) >= min_arabic)


def analysis_text(cleaned="cleaned_text", raw="text") -> Column:
    """The cleaned text, or the raw text when cleaning left nothing."""
    return F.coalesce(first_present(F.col(cleaned), F.col(raw)), F.lit(""))


def handle_key(column) -> Column:
    """Handle without leading @ signs, lower case."""
    return F.lower(F.ltrim(column, F.lit("@")))


def handle_display(column) -> Column:
    return F.when(column.startswith("@"), column).otherwise(F.concat(F.lit("@"), column))


def words(column) -> Column:
    """Runs of two or more word characters."""
    return F.regexp_extract_all(column, F.lit(fv.WORD), F.lit(1))


def topic_document(column, normalize_stopwords=False) -> Column:
    """Space-joined topic tokens of search-normalized text, stop words removed."""
    stops = set(fv.STOP_WORDS)
    if normalize_stopwords:
        table = str.maketrans(fv.FULL_LETTERS) | {ord(c): None for c in fv.DIACRITICS}
        stops |= {w.translate(table) for w in stops}
    tokens = F.regexp_extract_all(column, F.lit(fv.TOPIC_TOKEN), F.lit(1))
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(sorted(stops))), " ")


def one_and_two_grams(word_array) -> Column:
    def grams(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        joined = F.zip_with(
            F.slice(w, 1, pairs), F.slice(w, 2, pairs), lambda a, b: F.concat_ws(" ", a, b)
        )
        return F.concat(w, joined)

    return let(word_array, grams)


def term_occurrences(terms) -> Column:
    """array<struct<term, last>> in term order; `last` is true once per distinct term.

    Counting rows gives corpus frequency and counting `last` gives document frequency, in one
    pass and without a shuffle by document.
    """

    def marked(s: Column) -> Column:
        following = F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))
        return F.zip_with(
            s,
            following,
            lambda a, b: F.struct(a.alias("term"), F.coalesce(a != b, F.lit(True)).alias("last")),
        )

    return let(F.sort_array(terms), marked)


def term_counts(terms) -> Column:
    """array<struct<term, tf>>: the distinct terms, sorted, and how often each occurs."""

    def ends(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(s))
        last = F.filter(places, lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))
        return F.when(F.size(s) > 0, last).otherwise(F.array().cast("array<int>"))

    def counted(s: Column) -> Column:
        def each(e: Column) -> Column:
            before = lambda j: F.coalesce(F.get(e, j - 1), F.lit(0))
            return F.transform(
                e,
                lambda i, j: F.struct(
                    F.get(s, i - 1).alias("term"), (i - before(j)).cast("bigint").alias("tf")
                ),
            )

        return let(ends(s), each)

    return let(F.sort_array(terms), counted)