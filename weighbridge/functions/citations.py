"""Cited answer text: citation ids, sentences, fact shapes and claim disposition.

Everything works on the arrays of one answer, so it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.functions.binding import let
from weighbridge.functions.text import strip
from weighbridge.settings import ABSTAIN_TOKEN

# The citation grammar, abbreviations and months.
CITE_ID = r"[A-Za-z0-9][A-Za-z0-9_\-]*"
CITATION = rf"(?U)\[\s*{CITE_ID}\s*(?:,\s*{CITE_ID}\s*)*\]"
LEADING_CITATION = r"\[[A-Za-z0-9_\-]+(?:\s*,\s*[A-Za-z0-9_\-]+)*\]"
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr", "st", "mt", "ft", "vs", "etc", "no", "fig",
    "vol", "inc", "ltd", "co", "corp", "gen", "col", "lt", "capt", "sgt", "rev", "hon", "gov",
    "sen", "rep", "pres", "approx", "dept", "est", "e.g", "i.e", "u.s", "u.k", "a.m", "p.m",
)
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)
MARK = "\x01"  # sentence boundary while splitting; never part of a result


def citation_ids(sentence: Column) -> Column:
    """Ids cited in a sentence, in order, repeats included."""
    groups = F.regexp_extract_all(sentence, F.lit(CITATION), F.lit(0))
    return F.flatten(
        F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(CITE_ID), F.lit(0)))
    )


def strip_citations(sentence: Column) -> Column:
    return F.regexp_replace(sentence, CITATION, "")


def plain_sentence(sentence: Column) -> Column:
    """Without citation tags, spacing repaired."""
    spaced = F.regexp_replace(strip_citations(sentence), r"(?U)\s+([.,;:!?])", "$1")
    return strip(F.regexp_replace(spaced, r"(?U)\s+", " "))


def split_sentences(text: Column) -> Column:
    """Sentences of an answer as an array.

    Boundaries are marked by three substitutions: after end punctuation, not
    after an abbreviation or initial, and behind citation tags that open the
    next sentence (they belong to the one before).
    """
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marked = F.regexp_replace(strip(text), r"(?U)(?<=[.!?])\s+(?=\S)", MARK)
    joined = F.regexp_replace(
        marked, rf"(?U)(?<=^|[\s(\"'{MARK}])((?:[A-Z]|(?i:{known}))\.){MARK}", "$1 "
    )
    tags = rf"{LEADING_CITATION}(?:\s*{LEADING_CITATION})*"
    moved = F.regexp_replace(joined, rf"(?U){MARK}({tags})\s*", f" $1{MARK}")
    whole = F.regexp_replace(moved, rf"{MARK} ", " ")
    return F.filter(F.transform(F.split(whole, MARK), strip), lambda s: s != "")


def has_fact_shape(sentence: Column) -> Column:
    """A digit, a month, or a capitalised word that does not open the sentence."""
    months = F.expr("array({})".format(", ".join(f"'{m}'" for m in MONTHS)))

    def named(words: Column) -> Column:
        later = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
        return F.exists(words, lambda w: F.array_contains(months, F.lower(w))) | F.exists(
            later, lambda w: w.rlike("^[A-Z]") & (F.lower(w) != "i")
        )

    return let(
        strip_citations(sentence),
        lambda body: body.rlike(r"(?U)\d") | let(F.regexp_extract_all(body, F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0)), named),
    )


def is_abstain(text: Column, token: str = ABSTAIN_TOKEN) -> Column:
    """The abstain token alone, with quotes and trailing punctuation tolerated."""
    return text.rlike(rf"(?U)\A\s*[`\"']*\s*{token}\s*[.!:]*\s*[`\"']*\s*\z")


def postprocess(answer: Column, evidence_ids: Column, keep_uncited: bool | Column) -> Column:
    """Turn a raw answer into ``struct<abstained, answer, claims, citations,
    uncited_claims, stripped, fabricated_citations, n_sentences, kept_sentences>``.

    A sentence citing an id outside ``evidence_ids`` is stripped and its foreign
    ids counted; a cited one is a claim; an uncited fact is kept only with
    ``keep_uncited``; any other sentence is kept.
    """
    keep = F.lit(keep_uncited) if isinstance(keep_uncited, bool) else keep_uncited

    def kept(row: Column) -> Column:
        return row["fate"].isin("claim", "prose") | ((row["fate"] == "uncited_claim") & keep)

    def judge(sentence: Column) -> Column:
        def weigh(ids: Column) -> Column:
            foreign = F.filter(ids, lambda i: ~F.array_contains(evidence_ids, i))
            fate = (
                F.when(F.exists(ids, lambda i: ~F.array_contains(evidence_ids, i)), "fabricated_citation")
                .when(F.size(ids) > 0, "claim")
                .when(has_fact_shape(sentence), "uncited_claim")
                .otherwise("prose")
            )
            return F.struct(
                sentence.alias("text"), ids.alias("ids"), foreign.alias("foreign"), fate.alias("fate")
            )

        return let(citation_ids(sentence), weigh)

    def assemble(text: Column) -> Column:
        abstained = F.coalesce(is_abstain(text), F.lit(False))
        sentences = F.when(abstained, F.array().cast("array<string>")).otherwise(split_sentences(text))
        return let(F.transform(sentences, judge), lambda rows: _record(abstained, rows, kept))

    return let(answer, assemble)


def _record(abstained: Column, rows: Column, kept) -> Column:
    claims = F.transform(
        F.filter(rows, lambda r: r["fate"] == "claim"),
        lambda r: F.struct(r["text"].alias("text"), F.array_distinct(r["ids"]).alias("citations")),
    )
    kept_sentences = F.transform(F.filter(rows, kept), lambda r: r["text"])
    return F.struct(
        abstained.alias("abstained"),
        strip(F.array_join(kept_sentences, " ")).alias("answer"),
        claims.alias("claims"),
        F.sort_array(F.array_distinct(F.flatten(F.transform(claims, lambda c: c["citations"])))).alias("citations"),
        F.transform(F.filter(rows, lambda r: r["fate"] == "uncited_claim"), lambda r: r["text"]).alias("uncited_claims"),
        F.transform(
            F.filter(rows, lambda r: ~kept(r)),
            lambda r: F.struct(r["text"].alias("sentence"), r["fate"].alias("reason"), r["foreign"].alias("ids")),
        ).alias("stripped"),
        F.aggregate(rows, F.lit(0), lambda n, r: n + F.size(r["foreign"])).alias("fabricated_citations"),
        F.size(rows).alias("n_sentences"),
        kept_sentences.alias("kept_sentences"),
    )
