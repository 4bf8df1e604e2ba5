"""Normalising and tokenising social text, as steps of one table job.

Everything is string and array expressions: even negation scope is decided on the token
string, one pass per position of the scope, so that a text of any length costs linear time.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, digits

from pyspark.sql import Column, DataFrame, functions as F

from chirrup.constants import CHAR_NGRAMS, CONTRACTIONS, NEGATION_WINDOW, NEGATIONS, SADS, SMILES, STOPWORDS
from chirrup.functions.strings import SPACE, contains_any, has_bytes, let, squeeze, unescape_html

EMPTY = "<empty>"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]"
NOT_SPACE = f"[^{SPACE}]"
URL = f"https?://{NOT_SPACE}+|www\\.{NOT_SPACE}+"
# runs of other characters and white space alike, which end up as single spaces; a class of single characters is looked up in
# a table, one of ranges is asked range by range, which takes eight times as long
OTHERS = f"[^{ascii_lowercase}{digits}<>]+"


def _any_of(words) -> str:
    """Alternation of literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


SMILE, SAD = _any_of(SMILES), _any_of(SADS)


def decode_unicode_escapes(text: Column) -> Column:
    r"""Literal ``\uXXXX`` and ``\UXXXXXXXX`` to characters; malformed ones stay.

    Distinct escapes are replaced one after the other, the one for the backslash last, so
    that no character decoded here becomes part of another escape.
    """
    short = r"\\u[0-9a-fA-F]{4}"
    wide = r"\\U00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4}"
    backslash = lambda e: F.lower(e).isin("\\u005c", "\\u0000005c")

    def one(acc: Column, e: Column) -> Column:
        hexes = F.substring(e, 3, 8)
        char = F.when(F.length(e) == 6, F.decode(F.unhex(hexes), "UTF-16BE")).otherwise(
            F.decode(F.unhex(hexes), "UTF-32")
        )
        return F.replace(acc, e, char)

    def decoded(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"({short}|{wide})"), F.lit(1)))
        ordered = let(found, lambda f: F.concat(F.filter(f, lambda e: ~backslash(e)), F.filter(f, backslash)))
        return F.when(t.contains("\\u") | t.contains("\\U"), F.aggregate(ordered, t, one)).otherwise(t)

    return let(text, decoded)


DECODED = "_decoded"


def with_base_clean(df: DataFrame, text: str, target: str = "clean") -> DataFrame:
    """Escapes and (double) entities decoded, quotes straightened, white space squeezed; case kept.

    The decoded text before squeezing stays as ``_decoded``: what follows does not need the
    squeezing, which is pruned where nobody reads ``clean``.
    """
    out = df.withColumn(DECODED, decode_unicode_escapes(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    # a row may be encoded twice
    whole = unescape_html(F.col(DECODED), levels=2)
    straight = let(whole, lambda t: F.when(has_bytes(t, "E280"), F.translate(t, "’‘“”", "''\"\"")).otherwise(t))
    out = out.withColumn(DECODED, straight)
    return out.withColumn(target, squeeze(F.col(DECODED)))


def with_normalised(df: DataFrame, decoded: str = DECODED, target: str = "normalised") -> DataFrame:
    """Lower case; links, users, tags, faces and emoji become markers; contractions are expanded.

    Most texts hold none of these. A plain search for a character each pattern needs decides
    whether the pattern is run at all.
    """
    marks = (
        (lambda t: contains_any(t, ("://", "www.")), ((URL, " <url> "),)),
        (lambda t: t.contains("@"), (("@([a-z0-9_]+)", " <user> "),)),
        (lambda t: t.contains("#"), (("#([a-z0-9_]+)", "$1 <hashtag> "),)),
        (lambda t: contains_any(t, (":", ";", "=)", "t_t")), ((SMILE, " <smile> "), (SAD, " <sad> "))),
        (lambda t: has_bytes(t, "F0", "E2", "EF"), ((EMOJI, " <emoji> "),)),
        *[(lambda t, p=p: t.contains(p.replace("\\b", "")), ((f"(?U){p}", words),)) for p, words in CONTRACTIONS],
    )

    def marking(needed, replacements):
        def marked(t: Column) -> Column:
            changed = t
            for pattern, mark in replacements:
                changed = F.regexp_replace(changed, pattern, mark)
            return F.when(needed(t), changed).otherwise(t)

        return marked

    text = F.lower(decoded)
    for needed, replacements in marks:
        text = let(text, marking(needed, replacements))
    stretched = r"([a-z])\1{2,}"
    shortened = lambda t: F.concat(F.regexp_replace(t, stretched, "$1$1"), F.lit(" <elong>"))
    text = let(text, lambda t: F.when(t.rlike(stretched), shortened(t)).otherwise(t))
    return df.withColumn(target, F.trim(F.regexp_replace(text, OTHERS, " ")))


def negation_scope(tokens: Column, window: int = NEGATION_WINDOW) -> Column:
    """``NOT_`` before the next ``window`` content words after a negation, on a token string.

    Markers are neither prefixed nor counted; a further negation starts a new scope.
    """
    negation = "(?:" + "|".join(NEGATIONS) + ")(?= |$)"
    marker = "(?: <[a-z]+>)*"
    content = f"(?!{negation})(?!<[a-z]+>(?: |$))(?!NOT_)([^ ]+)"
    out = tokens
    for done in range(window):
        seen = f"(?: NOT_[^ ]+{marker})" + "{" + str(done) + "}"
        out = F.regexp_replace(out, f"((?:^| ){negation}{marker}{seen}) {content}", "$1 NOT_$2")
    return out


def with_tokens(df: DataFrame, normalised: str = "normalised", target: str = "tokens") -> DataFrame:
    """Words without stopwords, negations kept and scoped; ``<empty>`` where nothing is left."""
    words = F.filter(F.split(normalised, " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return df.withColumn(target, let(words, _scoped))


def _scoped(words: Column) -> Column:
    scoped = F.split(negation_scope(F.array_join(words, " ")), " ")
    return (
        F.when(F.size(words) == 0, F.array(F.lit(EMPTY)))
        .when(F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS))), scoped)
        .otherwise(words)
    )


def with_bigrams(tokens: Column) -> Column:
    """The unigrams followed by the pairs of neighbours."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)
    )
    return F.when(n > 1, F.concat(tokens, pairs)).otherwise(tokens)


def char_ngrams(normalised: Column, low: int = CHAR_NGRAMS[0], high: int = CHAR_NGRAMS[1]) -> Column:
    """Character n-grams inside words padded with one space; a short word counts once.

    An n at least as long as the padded word yields the word itself, and only the first
    such n does.
    """

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)

        def of_length(n: int) -> Column:
            last = F.greatest(size - (n - 1), F.lit(1))
            return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(n)))

        none = F.array().cast("array<string>")
        longer = [F.when(size >= n, of_length(n)).otherwise(none) for n in range(low + 1, high + 1)]
        return F.concat(of_length(low), *longer)

    return F.when(normalised != "", F.flatten(F.transform(F.split(normalised, " "), of_word))).otherwise(
        F.array().cast("array<string>")
    )


def words(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda w: w != "")


def grams_of(word: str, low: int = CHAR_NGRAMS[0], high: int = CHAR_NGRAMS[1]) -> list[str]:
    """``char_ngrams`` of one word."""
    padded = f" {word} "
    if len(padded) <= low:
        return [padded]
    return [padded[i : i + n] for n in range(low, min(high, len(padded)) + 1) for i in range(len(padded) - n + 1)]


def with_attributes(df: DataFrame, text: str, clean: str = "clean", tokens: str = "tokens") -> DataFrame:
    """Lengths and what the raw text holds: link, mention, hashtag, emoji or face, negation, stretch."""
    raw = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(raw)
    words = F.col(tokens)
    negated = r"(?iU)\b(?:" + "|".join(NEGATIONS) + r"|can't|won't|n't)\b"
    return df.withColumns(
        {
            "n_chars": F.length(clean).cast("long"),
            "n_tokens": F.when((F.size(words) == 1) & (words[0] == EMPTY), 0).otherwise(F.size(words)).cast("long"),
            "has_url": contains_any(low, ("://", "www.")) & raw.rlike(f"(?i){URL}"),
            "has_mention": raw.contains("@") & raw.rlike("@[A-Za-z0-9_]+"),
            "has_hashtag": raw.contains("#") & raw.rlike("#[A-Za-z0-9_]+"),
            "has_emoji": (has_bytes(raw, "F0", "E2", "EF") & raw.rlike(EMOJI))
            | (contains_any(low, (":", ";", "=)", "t_t")) & (low.rlike(SMILE) | low.rlike(SAD))),
            "has_negation": raw.rlike(negated),
            "has_elong": raw.rlike(r"([a-zA-Z])\1{2,}"),
        }
    )


def normalise_corpus(df: DataFrame, text: str, *, attributes: bool = False) -> DataFrame:
    """Adds ``clean``, ``normalised``, ``tokens`` and, on request, the attributes."""
    out = with_tokens(with_normalised(with_base_clean(df, text))).drop(DECODED)
    return with_attributes(out, text) if attributes else out
