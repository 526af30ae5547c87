"""Text normalisation, tokens, keys and small text kernels, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter variants and digits that count as one.
DIGITS = dict(zip("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789"))
LETTERS = {
    "ي": "ی", "ى": "ی", "ئ": "ی", "ك": "ک", "ة": "ه", "ۀ": "ه", "ہ": "ه", "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ؤ": "و", "ڪ": "ک", "ۍ": "ی", "ې": "ی",
}
#: Marks and invisible characters that are dropped (first and last of each range), and joiners that become spaces.
MARKS = [(0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06ED), (0x0640, 0x0640)]
INVISIBLE = [(0x200B, 0x200B), (0x200E, 0x200F), (0xFEFF, 0xFEFF), (0x202A, 0x202E)]
JOINERS = "\u200C\u200D"
ACCENTED = "[\u00C0-\u024F\u1E00-\u1EFF]"


@lru_cache(maxsize=1)
def accent_fold() -> tuple[str, str]:
    """Precomposed Latin letters and their letters without marks, from Unicode's decompositions."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))
        if bare != c and len(bare) == 1 and "LATIN" in unicodedata.name(bare, ""):
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "".join(DIGITS), "".join(DIGITS.values()))


@lru_cache(maxsize=1)
def _table() -> tuple[str, str]:
    """All that is one character for one, or for none, as a single translation: letters, digits, accents, joiners, and marks and
    invisible characters, which stand last as nothing stands for them."""
    dropped = "".join(chr(c) for first, last in MARKS + INVISIBLE for c in range(first, last + 1))
    a, b = accent_fold()
    return "".join(LETTERS) + "".join(DIGITS) + a + JOINERS + dropped, "".join(LETTERS.values()) + "".join(DIGITS.values()) + b + " " * len(JOINERS)


def normalize(text: Column, once: bool = False) -> Column:
    """Letters and digits unified, marks and accents dropped, lower case, everything else one space; null gives ''.

    A one-letter word between two connectors (e, ye) serves both, as in the reference; with `once` only the first, as in SQL
    whose patterns cannot look around.

    One translation does all single characters; what needs a pattern is looked for by a cheaper test first."""
    raw = F.coalesce(text, F.lit(""))

    def folded(t: Column) -> Column:
        return F.when(raw.rlike(ACCENTED) & t.rlike(r"\p{Mn}"), F.regexp_replace(t, r"(?<=\p{IsLatin})\p{Mn}+", "")).otherwise(t)

    connector = (r"(\p{IsLatin}) (?:e|ye) (\p{IsLatin})", "$1 $2") if once else (r"(?<=\p{IsLatin}) (?:e|ye) (?=\p{IsLatin})", " ")

    def joined(t: Column) -> Column:
        return F.when(t.contains(" e ") | t.contains(" ye "), F.regexp_replace(t, *connector)).otherwise(t)

    words = F.regexp_replace(F.lower(let(F.translate(raw, *_table()), folded)), r"[^\p{L}\p{N}]+", " ")
    return F.trim(let(words, joined))


def compact(text: Column) -> Column:
    return F.replace(normalize(text), F.lit(" "), F.lit(""))


def tokens(normalized: Column) -> Column:
    return F.array_remove(F.split(normalized, " "), "")


def let(value: Column, body) -> Column:
    """Evaluate `value` once, however often `body(value)` uses it: a plain reference would be evaluated again in every lambda."""
    return F.transform(F.array(value), body)[0]


def trigrams(compacted: Column) -> Column:
    """Distinct three-character windows of the padded text."""
    padded = F.concat(F.lit("  "), compacted, F.lit(" "))
    return let(padded, lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, 3))))


def word_runs(words: Column, n: int) -> Column:
    """All runs of `n` words, joined by spaces."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def runs_from(words: Column, firsts: Column, lengths: Column) -> Column:
    """The distinct runs of `lengths` words, joined by spaces, that begin with one of the words `firsts`. Both sides of the test
    are hashed once for each text; texts without such a word are done with that."""

    def of(w: Column) -> Column:
        def found(hits: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(hits, F.get(w, i)))
            runs = F.transform(starts, lambda i: F.transform(F.filter(lengths, lambda n: i + n <= F.size(w)), lambda n: F.array_join(F.slice(w, i + 1, n), " ")))
            return F.when(F.size(hits) > 0, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))

        return let(F.array_intersect(w, firsts), found)

    return let(words, of)


def ngrams(words: Column, longest: int, least_chars: int = 3) -> Column:
    """All distinct runs of 1 to `longest` words with at least `least_chars` characters besides spaces."""
    every = let(words, lambda w: F.concat(*[word_runs(w, n) for n in range(1, longest + 1)]))
    return F.array_distinct(F.filter(every, lambda g: F.length(F.replace(g, F.lit(" "), F.lit(""))) >= least_chars))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.substring(F.replace(normalize(text), F.lit(" "), F.lit("-")), 1, 120), "^-+|-+$", "")
    return F.when(s == "", F.lit("item")).otherwise(s)


def script(text: Column) -> Column:
    """Arab, Latn or null, by which script has more letters; Arab on a tie."""
    arab, latn = F.regexp_count(text, F.lit(r"\p{IsArabic}")), F.regexp_count(text, F.lit(r"\p{IsLatin}"))
    return F.when((arab == 0) & (latn == 0), F.lit(None)).when(arab >= latn, F.lit("Arab")).otherwise(F.lit("Latn"))


def clean_number(text: Column) -> Column:
    """A number from text with Persian or Arabic digits and separators; null if it is none."""
    t = F.replace(F.regexp_replace(ascii_digits(F.trim(text)), "[\u066c, ]", ""), F.lit("\u066b"), F.lit("."))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t).cast("double")


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5)


def segment_label(ms: Column) -> Column:
    s = (ms / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("long"), (s / 60).cast("long") % 60, s % 60)


def markers(text: Column) -> Column:
    """The distinct numbers n of the marks [n], in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int")))
