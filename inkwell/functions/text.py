"""Column builders over whole texts; all of them stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import lexicons as lx

_WS = " \t\n\r\f\x0b"
TOKEN = r"(?U)\S+"


def rounded(x: Column, places: int = 6) -> Column:
    """x to so many places, halves up, the same way in every engine."""
    k = 10.0**places
    return F.floor(x * k + 0.5) / k


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def long_size(array: Column) -> Column:
    return F.size(array).cast("long")


def tokens(text: Column) -> Column:
    """Runs of characters other than white space."""
    return matches(text, TOKEN)


def alphabetic(words: Column) -> Column:
    """Those of words that hold a letter."""
    return F.filter(words, lambda w: w.rlike(r"\p{L}"))


def alphabetic_tokens(text: Column) -> Column:
    """The tokens that hold a letter, found in one pass: what has no letter is left at its first character."""
    return matches(text, r"(?U)(?<!\S)[^\s\p{L}]*+\p{L}\S*+")


def stripped_lower(words: Column) -> Column:
    """Words without punctuation at their ends, lower-cased; empty ones are left out."""
    return F.filter(F.transform(words, lambda w: F.lower(F.trim(w, F.lit(".,;:!?\"'()")))), lambda w: w != "")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with case and runs of white space levelled."""
    return F.sha2(F.regexp_replace(F.lower(F.trim(text, F.lit(_WS))), r"(?U)\s+", " ").cast("binary"), 256)


def shingles(words: Column, k: int, stride: int) -> Column:
    """k-word shingles each stride words; shorter texts give one of all their words, empty ones none. Repeats stay.

    words should be a column of its own: each shingle slices it.
    """
    n = F.size(words)
    at = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)), F.lit(stride))
    many = F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
    none = F.array().cast("array<string>")
    return F.when(n == 0, none).when(n < k, F.array(F.array_join(words, " "))).otherwise(many)


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_set(hashed: Column, k: int, stride: int) -> Column:
    """The sorted distinct hashes of the shingles of words whose hashes are given, so no shingle is ever put together.

    hashed should be a column of its own: each shingle slices it.
    """
    n = F.size(hashed)
    at = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)), F.lit(stride))
    many = F.transform(at, lambda i: F.xxhash64(F.slice(hashed, i, F.lit(k))))
    return F.array_sort(F.array_distinct(F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(hashed))).otherwise(many)))


def sentence_boundary() -> str:
    """Where a sentence ends: after . ! or ?, before white space and a capital or quote, and not after an abbreviation's dot."""
    short = "|".join(lx.ABBREVIATIONS)
    return rf"(?<=[.!?])(?<!(?<![A-Za-z])(?i:{short})\.)(?=[\"')\]]*\s+[{lx.SENTENCE_STARTS}])"


def sentences(text: Column) -> Column:
    """The non-blank sentences of a text, without white space at their ends."""
    return F.filter(F.transform(F.split(text, sentence_boundary()), lambda s: F.trim(s, F.lit(_WS))), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, their lines trimmed and joined by a blank; empty ones are left out."""

    def one(p):
        lines = F.filter(F.transform(F.split(p, "\n"), lambda s: F.trim(s, F.lit(_WS))), lambda s: s != "")
        return F.trim(F.regexp_replace(F.array_join(lines, " "), "[ \t]+", " "))

    return F.filter(F.transform(F.split(text, r"\n\s*\n"), one), lambda p: p != "")


def blank_line_parts(text: Column) -> Column:
    """Pieces between two line ends, trimmed, without empty ones; line ends inside stay."""
    return F.filter(F.transform(F.split(text, "\n\n"), lambda s: F.trim(s, F.lit(_WS))), lambda s: s != "")


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal stands in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def mean(values: Column) -> Column:
    """Mean of an array of numbers; null where it is empty."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def deviation(values: Column) -> Column:
    """Population standard deviation of an array; null where it is empty. values should be a column of its own."""
    m = mean(values)
    return F.sqrt(F.greatest(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(values), F.lit(0)) - m * m, F.lit(0.0)))


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


# --- Cleaning, in the order in which it applies ---------------------------------------------------------------


def body(text: Column) -> Column:
    """What stands between the start and end marks of an e-book, by whichever of its forms the text has."""
    start, end = rf"(?is)^(.*?)({lx.BODY_START})", rf"(?is)^(.*?)({lx.BODY_END})"
    head, mark = F.regexp_extract(text, start, 1), F.regexp_extract(text, start, 2)
    from_ = F.length(head) + F.length(mark)
    to = F.length(F.regexp_extract(text, end, 1))
    has_start, has_end = mark != "", F.regexp_extract(text, end, 2) != ""
    rest = F.substr(text, from_ + 1, F.length(text))
    old = lambda t: F.regexp_replace(t, rf"(?is)(?m){lx.OLD_END.removesuffix('.*$')}.*", "")
    both = has_start & has_end & (to > from_)
    plain = F.regexp_replace(text, rf"(?is){lx.SMALL_PRINT}", "")
    return F.when(both, F.substr(text, from_ + 1, to - from_)).when(has_start, old(rest)).otherwise(old(plain))


def without_boilerplate(text: Column) -> Column:
    """The lines of text that none of the boilerplate patterns matches."""
    noted = lambda s: reduce(or_, (s.rlike(f"(?i){p}") for p in lx.BOILERPLATE_LINES))
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~noted(s)), "\n")


def without_notes(text: Column) -> Column:
    text = F.regexp_replace(text, lx.FOOTNOTE_BLOCK, " ")
    return F.regexp_replace(F.regexp_replace(text, lx.EDITOR_NOTE, " "), lx.FOOTNOTE_MARK, "")


def typography(text: Column) -> Column:
    """Hyphens at line ends joined, page numbers dropped, quotes, dashes and blanks levelled. The text is taken to be NFC."""
    text = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    text = F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(r"^\s*\d{1,4}\s*$")), "\n")
    for a, b in lx.TYPOGRAPHY:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"), F.lit(_WS))


def is_heading(line: Column) -> Column:
    return line.rlike(lx.CHAPTER_HEADING)


def without_contents(lines: Column) -> Column:
    """lines without a table of contents: from its heading to the first prose line, but for the heading just above that."""
    n = F.size(lines)
    head = F.slice(lines, 1, lx.CONTENTS_WITHIN_LINES)
    toc = F.array_position(F.transform(head, lambda s: s.rlike(lx.CONTENTS)), True).cast("int")
    after = F.slice(lines, toc + 1, n)
    prose_at = F.array_position(F.transform(after, lambda s: (F.size(tokens(s)) >= lx.PROSE_WORDS) | (F.length(F.trim(s, F.lit(_WS))) >= lx.PROSE_CHARS)), True).cast("int")
    # Back from the prose over blank lines and at most one heading that is no entry of the contents.
    kind = lambda s: F.when(F.trim(s, F.lit(_WS)) == "", 0).when((is_heading(F.trim(s, F.lit(_WS))) | F.trim(s, F.lit(_WS)).rlike(lx.ROMAN_HEADING)) & ~F.trim(s, F.lit(_WS)).rlike(lx.CONTENTS_LEADER), 1).otherwise(2)
    above = F.reverse(F.slice(after, F.lit(1), F.greatest(prose_at - 1, F.lit(0))))
    start = F.struct(F.lit(0).alias("back"), F.lit(False).alias("pulled"), F.lit(True).alias("open"))

    def step(acc, s):
        k = kind(s)
        takes = acc["open"] & ((k == 0) | ((k == 1) & ~acc["pulled"]))
        return F.struct((acc["back"] + takes.cast("int")).alias("back"), (acc["pulled"] | (takes & (k == 1))).alias("pulled"), takes.alias("open"))

    back = F.aggregate(above, start, step)["back"]
    kept = F.when(prose_at > 0, F.slice(after, F.greatest(prose_at - back, F.lit(1)), n)).otherwise(after)
    return F.when(toc > 0, F.concat(F.slice(lines, F.lit(1), F.greatest(toc - 1, F.lit(0))), kept)).otherwise(lines)


def without_back_matter(lines: Column) -> Column:
    """lines up to the first back-matter heading whose remainder isn't a single chapter heading."""
    n = F.size(lines)
    hit = F.transform(lines, lambda s: F.trim(s, F.lit(_WS)).rlike(lx.BACK_MATTER))
    lone = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.element_at(hit, i) & ~((i >= n - 1) & is_heading(F.array_join(F.slice(lines, i + 1, n), "\n"))))
    at = F.array_position(lone, True).cast("int")
    return F.when((n > 0) & (at > 0), F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(lines)
