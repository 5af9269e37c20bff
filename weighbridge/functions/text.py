"""Text preparation: cleaning, capping, tokens, chunk windows, normalised matching."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from weighbridge.functions.binding import let
from weighbridge.settings import LIMITS

# Patterns of page clean-up, in the order they are applied.
FENCE = r"(?s)```.*?```"
TAG = r"<[^>]{1,200}>"
BLANKS = r"[ \t\f\x0B]+"
LINE_END = r"\r\n|[\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
LINE_EDGE = r"(?U)[^\S\n]*\n[^\S\n]*"
MANY_LINES = r"\n{3,}"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"  # what html.unescape looks at
WIDE = r"[^\x00-\x7F]+"


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends (``trim`` only knows the space)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _put_back(text: Column, pattern: str, new: Column, rest=lambda piece: piece) -> Column:
    """The text with its matches of ``pattern`` replaced by the strings of the array ``new`` in turn, and
    ``rest`` of what lies between them. NULL where ``new`` is."""
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(pieces, new, lambda p, n: F.concat(rest(p), F.coalesce(n, F.lit("")))), "")


@F.pandas_udf(ArrayType(StringType()))
def _unescape(found: pd.Series) -> pd.Series:
    return found.map(lambda refs: [html.unescape(r) for r in refs.split("\n")], na_action="ignore")


def unescape_html(text: Column) -> Column:
    """HTML entities to characters. Only the references themselves leave the JVM, not the texts around them."""
    found = let(text, lambda t: F.when(t.contains("&"), F.array_join(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), "\n")))
    return F.coalesce(_put_back(text, REFERENCE, _unescape(found)), text)


def clean_text(text: Column) -> Column:
    """Drop code fences and tags, unescape entities, tidy blanks and empty lines."""
    bare = F.regexp_replace(F.regexp_replace(text, FENCE, " "), TAG, " ")
    lines = F.regexp_replace(F.regexp_replace(unescape_html(bare), BLANKS, " "), LINE_END, "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, LINE_EDGE, "\n"), MANY_LINES, "\n\n"))


def page_text(body: Column, content_type: Column, extractor=None) -> Column:
    """Readable text of a page. ``extractor`` may be a column function (for
    instance a pandas UDF around a main-text parser); where it yields nothing,
    the body itself is cleaned."""
    if extractor is None:
        return clean_text(body)
    main = F.when(content_type.startswith("text/plain"), body).otherwise(extractor(body))
    return clean_text(F.when(F.length(main) > 0, main).otherwise(body))


def cap_chars(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space beyond 60% of it."""

    def shorten(head: Column) -> Column:
        from_end = F.instr(F.reverse(head), " ")
        space_at = F.lit(limit) - from_end
        cut = F.when((from_end > 0) & (space_at > limit * 0.6), F.left(head, space_at)).otherwise(head)
        return F.regexp_replace(cut, r"(?U)\s+\z", "")

    return let(text, lambda t: F.when(F.length(t) <= limit, t).otherwise(let(F.left(t, F.lit(limit)), shorten)))


def prepare_text(text: Column, limit: int = LIMITS.passage_max_chars) -> Column:
    return cap_chars(clean_text(F.coalesce(text, F.lit(""))), limit)


def word_tokens(text: Column) -> Column:
    """Default tokenizer: runs of non-blank characters, as an array."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def count_tokens(text: Column, tokenizer=word_tokens) -> Column:
    return F.size(tokenizer(text))


def chunk_text(
    tokens: Column,
    size: int = LIMITS.chunk_tokens,
    overlap: float = LIMITS.chunk_overlap,
    max_chunks: int | None = None,
    max_chars: int = LIMITS.passage_max_chars,
    min_tokens: int = LIMITS.min_chunk_tokens,
    glue: str = " ",
) -> Column:
    """Overlapping token windows as ``array<struct<chunk_index,n_tokens,text>>``.

    ``n_tokens`` is the window length before the character cap. A window blank
    after the cap is skipped without using up an index, and a short tail window
    is dropped once something was emitted. ``max_chunks`` is a policy of the caller;
    without it every window counts. Feed a text column through a
    tokenizer first; pass ``glue=''`` for sub-word tokens.
    """
    step = max(1, size - round(size * overlap))

    def window(words: Column, start: Column) -> Column:
        piece = F.trim(F.array_join(F.slice(words, start + 1, F.lit(size)), glue))
        return F.struct(
            F.least(F.lit(size), F.size(words) - start).alias("n_tokens"), cap_chars(piece, max_chars).alias("text")
        )

    def windows(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        reached = F.filter(starts, lambda s: (s == 0) | (s - step + size < n))
        if glue == " " and max_chunks is not None:  # words are never blank, so only the kept windows are built
            reached = F.slice(reached, 1, max_chunks + 1)
        return F.transform(reached, lambda s: window(words, s))

    written = F.filter(let(tokens, windows), lambda w: w["text"] != "")
    kept = F.filter(written, lambda w, i: (i == 0) | (w["n_tokens"] >= min_tokens))
    kept = kept if max_chunks is None else F.slice(kept, 1, max_chunks)
    return F.transform(
        kept,
        lambda w, i: F.struct(
            i.cast("int").alias("chunk_index"), w["n_tokens"].cast("int").alias("n_tokens"), w["text"].alias("text")
        ),
    )


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    def fold(value):
        parts = unicodedata.normalize("NFKD", value)
        return "".join(c for c in parts if not unicodedata.combining(c)).casefold()

    return values.map(fold, na_action="ignore")


def normalize_answer(text: Column) -> Column:
    """Accent-free, case-folded words joined by single spaces.

    ASCII stays in the JVM; only runs of other characters go through Arrow, because
    Spark has no Unicode decomposition. No character's folding depends on an ASCII neighbour.
    """
    wide = let(text, lambda t: F.when(t.rlike(WIDE), F.trim(F.regexp_replace(t, r"[\x00-\x7F]+", "\n"), F.lit("\n"))))
    new = F.split(_fold(wide), "\n", -1)  # runs and their foldings hold no line feed
    folded = F.coalesce(_put_back(text, WIDE, new, F.lower), F.lower(text), F.lit(""))
    # punctuation and white space alike become one space, so one pass does both
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def contains_gold(haystack: Column, gold: Column) -> Column:
    """Whether an already normalised gold string occurs; an empty one never does."""
    return (gold != "") & F.contains(haystack, gold)


def is_short_answer(gold: Column, limit: int = LIMITS.short_answer_chars) -> Column:
    return F.length(gold) <= limit


def clean_output(text: Column) -> Column:
    """Generated text without thought-channel spans and turn markers."""
    # Thought-channel spans and turn markers.
    bare = F.regexp_replace(text, r"(?s)<\|channel>.*?<channel\|>", "")
    return strip(F.regexp_replace(bare, r"<\|?channel\|?>|<\|?turn\|?>|<\|think\|>", ""))


def clean_query(reply: Column, limit: int = LIMITS.refined_query_chars) -> Column:
    """First usable line of a reply: label and outer quotes off, blanks collapsed."""
    lines = F.split(F.regexp_replace(F.coalesce(reply, F.lit("")), LINE_END, "\n"), "\n")

    def tidy(line: Column) -> Column:
        bare = F.regexp_replace(strip(line), r"(?iU)^\s*(?:search\s*)?query\s*[:\-]\s*", "")
        return strip(F.regexp_replace(strip(bare), "^[`\"']+|[`\"']+\\z", ""))

    first = F.get(F.filter(F.transform(lines, tidy), lambda line: line != ""), 0)
    return strip(F.left(F.regexp_replace(F.coalesce(first, F.lit("")), r"(?U)\s+", " "), F.lit(limit)))


def refined_query(reply: Column, query: Column) -> Column:
    """The cleaned reply, or the original query where nothing is left of it."""
    return F.coalesce(F.nullif(clean_query(reply), F.lit("")), query)


def same_as_original(refined: Column, query: Column) -> Column:
    return F.lower(strip(refined)) == F.lower(strip(query))
