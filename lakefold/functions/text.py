"""Text normalization, tokens, and label attributes as column expressions.

Two folds are offered. native_fold is lower() and stays in generated code; it equals the exact fold on NFKC-stable text
without sharp s, final sigma or ligatures. exact_fold is NFKC and casefold in Arrow batches. The others build on either.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType

Fold = Callable[[Column], Column]

#: Words of a product name that do not identify it.
SERVICE_TOKENS = (
    "вино", "вина", "вин", "столовое", "столовый", "столовая",
    "сухое", "сухой", "сухая", "сухие",
    "полусухое", "полусухой", "полусухая", "полусухие",
    "полусладкое", "полусладкий", "полусладкая", "полусладкие",
    "сладкое", "сладкий", "сладкая", "сладкие",
    "згу", "знпм", "тз", "шт", "л", "мл",
    "игристое", "игристый", "игристая", "игристые",
    "брют", "экстра", "брю", "экстрабрют",
)
#: Patterns of years, volumes, strengths and colours.
YEAR = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
VOLUME_TOKEN = r"^(?:(?!19\d\d|20\d\d)\d{3,4})(?:л|мл|litre|литр)?$"
STRENGTH = r"(?<![\d.,])(\d{1,2}(?:[.,]\d{1,2})?)\s*%"
COLOUR = r"(?U)\b(белое|красное|розовое|оранжевое)\b"
FOUNDED = r"(?U)(?:основан\w*|since|estd?\.?|founded)\s*(?:в\s*)?$"
#: Sweetness codes by the first of these that a text has.
SWEETNESS_CODES = ("polusladkoe", "polusuhoe", "sladkoe", "suhoe", "ekstra-bryut", "bryut")
SWEETNESS_WORDS = (
    (r"(?U)\bэкстра\s*брют\b", "ekstra-bryut"), (r"(?U)\bбрют\b", "bryut"), (r"(?U)\bполусладк\w*", "polusladkoe"),
    (r"(?U)\bсладк\w*", "sladkoe"), (r"(?U)\bполусух\w*", "polusuhoe"), (r"(?U)\bсух\w*", "suhoe"),
)
#: Latin letters that look like Cyrillic ones.
LOOKALIKES = ("aceopxykmthb", "асеорхукмтнв")
WORD = r"[\p{L}\p{N}]+"


@pandas_udf(StringType())
def exact_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def native_fold(text: Column) -> Column:
    return F.lower(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, fold: Fold = exact_fold) -> Column:
    """Words of letters and digits, one space between; ё stays."""
    return F.array_join(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)), " ")


def canonical(text: Column, fold: Fold = exact_fold) -> Column:
    """Folded, ё read as е, quotes read as spaces, white space collapsed; other punctuation stays."""
    return collapse(F.translate(F.translate(fold(text), "ё", "е"), "«»\"'", "    "))


def spoken_words(text: Column) -> Column:
    """Lower-cased words, ё read as е: what error rates compare."""
    return F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(WORD), F.lit(0))


def spaced(text: Column, fold: Fold = exact_fold) -> Column:
    """Folded, ё read as е, white space collapsed."""
    return collapse(F.translate(fold(text), "ё", "е"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def year(canonical_text: Column) -> Column:
    """The first standalone 19xx or 20xx, else null."""
    return F.nullif(F.regexp_extract(canonical_text, YEAR, 0), F.lit(""))


def evidence_tokens(canonical_text: Column) -> Column:
    """Distinct words of three letters or more in order of first sight, without volumes; years stay."""
    long = F.filter(words(canonical_text), lambda t: (F.length(t) > 2) & ~F.rlike(t, F.lit(VOLUME_TOKEN)))
    return F.array_distinct(long)


def name_tokens(canonical_text: Column) -> Column:
    """Evidence tokens without service words and years: what identifies a product."""
    kept = F.filter(evidence_tokens(canonical_text), lambda t: ~F.rlike(t, F.lit(r"^(?:19|20)\d{2}$")))
    return F.array_except(kept, F.array(*(F.lit(t) for t in SERVICE_TOKENS)))


def token_f1(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two token sets; 0 where a side is empty."""
    total = F.size(a) + F.size(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / total).otherwise(F.lit(0.0))


def sweetness_code(canonical_text: Column) -> Column:
    out = F.lit(None).cast("string")
    for code in reversed(SWEETNESS_CODES):
        out = F.when(F.contains(canonical_text, F.lit(code)), code).otherwise(out)
    return out


def sweetness_word(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, code in reversed(SWEETNESS_WORDS):
        out = F.when(text.rlike(pattern), code).otherwise(out)
    return out


def repair_scripts(text: Column, fold: Fold = exact_fold) -> Column:
    """Word by word: Latin lookalikes and 0 inside Cyrillic words become Cyrillic; o inside numbers becomes 0."""
    folded = fold(text)
    pieces = F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))

    def repaired(w: Column) -> Column:
        cyrillic = F.rlike(w, F.lit(r"\p{IsCyrillic}"))
        numeric = F.rlike(w, F.lit(r"^[\doо]*\d[\doо]*$"))
        return F.when(numeric, F.translate(w, "oо", "00")).when(cyrillic, F.translate(w, LOOKALIKES[0] + "0", LOOKALIKES[1] + "о")).otherwise(w)

    return F.array_join(F.transform(pieces, repaired), "")


def only(values: Column) -> Column:
    """The value of an array with one distinct value, else null."""
    found = F.array_distinct(values)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def label_year(canonical_text: Column) -> Column:
    """The one year of a label; years introduced as foundation dates in the 32 characters before do not count."""
    with_prefix = F.regexp_extract_all(canonical_text, F.lit(r"(?s)(?<=^|(?<!\d)).{0,32}?" + YEAR), F.lit(0))
    counted = F.filter(with_prefix, lambda p: ~F.rlike(F.substring(p, F.lit(1), F.length(p) - 4), F.lit(FOUNDED)))
    return only(F.transform(counted, lambda p: F.right(p, F.lit(4))))


def label_strength(canonical_text: Column) -> Column:
    """The one alcohol content from 5 to 25 per cent, else null."""
    found = F.transform(F.regexp_extract_all(canonical_text, F.lit(STRENGTH), F.lit(1)), lambda s: F.replace(s, F.lit(","), F.lit(".")).cast("double"))
    return only(F.filter(found, lambda a: (a >= 5) & (a <= 25)))


def label_colour(canonical_text: Column) -> Column:
    return F.initcap(F.nullif(F.regexp_extract(canonical_text, COLOUR, 1), F.lit("")))


def slug_strength(slug: Column) -> Column:
    """A slug's suffix of two or three digits read as 12 or 12.5, from 5 to 25, else null."""
    digits = F.nullif(F.regexp_extract(slug, r"-(\d{2,3})$", 1), F.lit(""))
    value = F.when(F.length(digits) == 2, digits.cast("double")).otherwise(digits.cast("double") / 10)
    return F.when((value >= 5) & (value <= 25), value)


def split_list(text: Column, separators: str = "[,;/]", least: int = 1) -> Column:
    """Trimmed distinct parts of at least so many characters, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separators), collapse)
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= least))


def longest_hits(text: Column, vocabulary: list[str]) -> Column:
    """Vocabulary terms that stand as words in a text, without those inside a longer hit; longest first."""
    ordered = sorted(set(vocabulary), key=lambda v: (-len(v), v))
    padded = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    stands = {v: F.contains(padded, F.lit(f" {v} ")) for v in ordered}

    def counts(v: str) -> Column:
        inside = [stands[u] for u in ordered if u != v and v in u]
        return reduce(lambda c, longer: c & ~longer, inside, stands[v])

    return F.array_compact(F.array(*(F.when(counts(v), v) for v in ordered)))


def token_set_ratio(a: str | None, b: str | None) -> int:
    """0 to 100 by difflib over shared and unshared sorted tokens; exact containment gives 100."""
    if not a or not b:
        return 0
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    one, two = (" ".join(x for x in (shared, " ".join(sorted(d))) if x) for d in (left - right, right - left))
    pairs = [(one, two), *((shared, x) for x in (one, two) if shared)]
    return round(100 * max(SequenceMatcher(None, x, y).ratio() for x, y in pairs))


@pandas_udf(IntegerType())
def token_set_ratio_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)])


@pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib ratio of two strings, case folded; 0 where a side is missing."""
    return pd.Series([SequenceMatcher(None, x.casefold(), y.casefold()).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def word_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of words: each distinct word becomes one code point of a private plane."""
    known = F.array_distinct(F.concat(a, b))
    coded = lambda x: F.array_join(F.transform(x, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w).cast("int") + 0x4E00), 4, "0")), "UTF-16BE")), "")
    return F.levenshtein(coded(a), coded(b))


def read_server_events(chunks: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(event, data) of a server-sent-event stream that arrives in chunks; an unfinished block waits for the next chunk."""
    rest = ""
    for chunk in chunks:
        *blocks, rest = (rest + chunk).replace("\r\n", "\n").split("\n\n")
        for block in blocks:
            event, data = "message", []
            for line in block.split("\n"):
                field, _, value = line.partition(":")
                value = value.removeprefix(" ")
                if field == "event":
                    event = value
                elif field == "data":
                    data.append(value)
            if data:
                yield event, "\n".join(data)
