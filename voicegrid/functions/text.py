"""Text expressions: normalising, cleaning, tokens and quality flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that Java leaves out.
_SPACE = r"[\s\x1c-\x1f]"
# Letters, digits and underscore of any script.
_WORD = r"[\p{L}\p{N}_]"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind (`trim` removes blanks only)."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalize(text: Column) -> Column:
    """The form shared by training and scoring: null to empty, lower case, stripped."""
    return strip(F.lower(text_or_empty(text)))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~text_or_empty(text).rlike(r"(?U)[^\s\x1c-\x1f]")


def casefold(text: Column) -> Column:
    """Lower case plus the foldings that `lower` leaves for Latin and Greek text."""
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.translate(folded, "ſς", "sσ")


def clean_text(text: Column, stopwords: Sequence[str] = ()) -> Column:
    """Lower case without links, non-letters and stop words, single blanks between words."""
    without_links = F.regexp_replace(F.lower(text), r"(?U)http\S+", "")
    words = F.regexp_extract_all(without_links, F.lit("[a-z]+"), F.lit(0))
    if stopwords:
        words = F.filter(words, lambda word: ~word.isin(list(stopwords)))
    return F.array_join(words, " ")


def text_length(text: Column) -> Column:
    return F.char_length(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def has_reply(reply: Column) -> Column:
    return reply.isNotNull().cast("int")


def token_set(text: Column) -> Column:
    """Distinct runs of ASCII letters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit("[a-z]+"), F.lit(0)))


def has_letter(text: Column) -> Column:
    return text_or_empty(text).rlike("[A-Za-z]")


def is_interpretable(text: Column) -> Column:
    """At least two words of two or more letters; implies `has_letter`."""
    return F.regexp_count(text_or_empty(text), F.lit("[A-Za-z]{2,}")) >= 2


def vector_tokens(text: Column) -> Column:
    """Tokens of two or more word characters, in order, lower-cased."""
    return F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(_WORD + "{2,}"), F.lit(0))


def bigrams(tokens: Column) -> Column:
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), last),
        F.slice(tokens, F.lit(2), last),
        lambda left, right: F.concat_ws(" ", left, right),
    )


def once(value: Column, use) -> Column:
    """Evaluate `value` one time and hand it to `use`, for values needed inside lambdas."""
    return F.transform(F.array(value), use)[0]


def ngrams(tokens: Column) -> Column:
    """Unigrams followed by bigrams."""
    return once(tokens, lambda t: F.concat(t, bigrams(t)))


def term_counts(terms: Column) -> Column:
    """array<string> to array<struct<term, tf>> without leaving the row.

    Equal terms are adjacent after sorting, so each count is the distance between
    two run starts; no explode and no shuffle are needed.
    """

    def from_sorted(ordered):
        starts = F.filter(
            F.transform(ordered, lambda term, i: F.when(~term.eqNullSafe(F.get(ordered, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return once(
            starts,
            lambda begin: F.transform(
                begin,
                lambda at, k: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(begin, k + 1), F.size(ordered)) - at).alias("tf"),
                ),
            ),
        )

    return once(F.sort_array(terms), from_sorted)


# Latin letters with marks and their plain form, position by position.
_ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűųçćĉċčñńņňýÿŷžźżšśŝşťţďğĝģĥĵķĺļľŕŗřŵ"
_PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuucccccnnnnyyyzzzssssttdggghjklllrrrw"


def strip_accents(text: Column) -> Column:
    """Fold accented Latin letters to plain ones and drop combining marks."""
    both = F.translate(text, _ACCENTED + _ACCENTED.upper(), _PLAIN + _PLAIN.upper())
    return F.regexp_replace(both, r"\p{Mn}+", "")
