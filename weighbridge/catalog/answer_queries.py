"""Cited answers: assistant turns with citation tags at their sentence ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.catalog.base import Tables, query
from weighbridge.functions import citations as C
from weighbridge.functions import policy as P
from weighbridge.operators.passages import cited_passages

M = "chr(1)"
KNOWN = "|".join(a.replace(".", "\\.") for a in C.ABBREVIATIONS)
ONE_TAG = "\\[[A-Za-z0-9_\\-]+(?:\\s*,\\s*[A-Za-z0-9_\\-]+)*\\]"
CITE = "\\[\\s*[A-Za-z0-9][A-Za-z0-9_\\-]*\\s*(?:,\\s*[A-Za-z0-9][A-Za-z0-9_\\-]*\\s*)*\\]"

# conversations whose number ends in 0 or 5 stay uncited; odd turns carry the tag
# behind the full stop, even ones before it
SQL_ANSWERS = """
answers as (
  select conv_id, turn, case when conv_id % 5 = 0 then text
    when turn % 2 = 1 then regexp_replace(text, '\\.(\\s|$)', '. [d' || (turn % 4) || ', x' || (conv_id % 3) || ']\\1', 'g')
    else regexp_replace(text, '\\.(\\s|$)', ' [d' || (turn % 4) || '][d1].\\1', 'g') end as answer
  from conversations
)"""


def _answers(t: Tables):
    tag = F.format_string("[d%d, x%d]", F.col("turn") % 4, F.col("conv_id") % 3)
    two = F.format_string("[d%d][d1]", F.col("turn") % 4)
    text = F.col("text")
    behind = F.regexp_replace(text, F.lit(r"\.(\s|$)"), F.concat(F.lit(". "), tag, F.lit("$1")))
    before = F.regexp_replace(text, F.lit(r"\.(\s|$)"), F.concat(F.lit(" "), two, F.lit(".$1")))
    answer = F.when(F.col("conv_id") % 5 == 0, text).when(F.col("turn") % 2 == 1, behind).otherwise(before)
    return t.conversations.select("conv_id", "turn", answer.alias("answer"))


def _sentences_sql() -> str:
    marked = "regexp_replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g')"
    for _ in range(4):  # each pass joins every other initial of a run
        marked = f"regexp_replace({marked}, '(^|[\\s(\"''\\x01])((?:[A-Z]|(?i:{KNOWN}))\\.)\\x01', '\\1\\2 ', 'g')"
    moved = f"replace(regexp_replace({marked}, '\\x01({ONE_TAG}(?:\\s*{ONE_TAG})*)\\s*', ' \\1' || {M}, 'g'), {M} || ' ', ' ')"
    return f"list_filter(list_transform(string_split({moved}, {M}), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


SQL_SENTENCES = f"""
lists as (select conv_id, turn, {_sentences_sql()} as ss from answers),
sentences as (select conv_id, turn, unnest(ss) as s, unnest(range(len(ss))) as pos from lists)"""
SQL_IDS = f"""
ids as (select *, flatten(list_transform(regexp_extract_all(s, '{CITE}'), lambda g: regexp_extract_all(g, '[A-Za-z0-9][A-Za-z0-9_\\-]*'))) as ids,
  regexp_replace(s, '{CITE}', '', 'g') as body from sentences)"""
MONTH_LIST = ", ".join(f"'{m}'" for m in C.MONTHS)
SQL_FACT = f"""
facts as (select *, regexp_matches(body, '\\p{{Nd}}')
    or len(list_filter(regexp_extract_all(body, '[A-Za-z][A-Za-z''\\-]*'), lambda w: lower(w) in ({MONTH_LIST}))) > 0
    or len(list_filter(regexp_extract_all(body, '[A-Za-z][A-Za-z''\\-]*')[2:], lambda w: regexp_matches(w, '^[A-Z]') and lower(w) <> 'i')) > 0 as fact from ids)"""


@query("answer_sentences", f"with {SQL_ANSWERS}, {SQL_SENTENCES} select conv_id, turn, pos, s as sentence from sentences")
def answer_sentences(spark, path):
    """Sentences with their citation tags, abbreviations and initials respected."""
    rows = _answers(Tables(spark, path))
    return rows.select("conv_id", "turn", F.posexplode(C.split_sentences(F.col("answer"))).alias("pos", "sentence"))


@query(
    "abbreviated_sentences",
    f"""with answers as (select conv_id, turn, replace(replace(text, ' la ', ' Dr. '), ' the ', ' J. R. R. ') as answer from conversations), {SQL_SENTENCES}
select conv_id, turn, pos, s as sentence from sentences""",
)
def abbreviated_sentences(spark, path):
    """The same split where titles and initials abound."""
    text = F.replace(F.replace(F.col("text"), F.lit(" la "), F.lit(" Dr. ")), F.lit(" the "), F.lit(" J. R. R. "))
    rows = Tables(spark, path).conversations.select("conv_id", "turn", F.posexplode(C.split_sentences(text)).alias("pos", "sentence"))
    return rows


@query(
    "citation_facts",
    f"""with {SQL_ANSWERS}, {SQL_SENTENCES}, {SQL_IDS}, {SQL_FACT}
select conv_id, turn, pos, array_to_string(ids, ',') as cited, md5(body) as bare,
  md5(trim(regexp_replace(regexp_replace(body, '\\s+([.,;:!?])', '\\1', 'g'), '\\s+', ' ', 'g'))) as plain, fact::int as fact from facts""",
)
def citation_facts(spark, path):
    """Cited ids, text without tags, repaired text and fact shape per sentence."""
    rows = answer_sentences(spark, path)
    s = F.col("sentence")
    return rows.select(
        "conv_id", "turn", "pos", F.array_join(C.citation_ids(s), ",").alias("cited"), F.md5(C.strip_citations(s)).alias("bare"),
        F.md5(C.plain_sentence(s)).alias("plain"), C.has_fact_shape(s).cast("int").alias("fact"),
    )


@query(
    "processed_answers",
    f"""with {SQL_ANSWERS}, {SQL_SENTENCES}, {SQL_IDS}, {SQL_FACT},
fate as (select *, list_filter(ids, lambda i: i not in ('d0', 'd1', 'd2', 'x0', 'x1')) as bad from facts),
k as (select *, case when len(bad) > 0 then 'fabricated_citation' when len(ids) > 0 then 'claim' when fact then 'uncited_claim' else 'prose' end as fate,
  conv_id % 2 = 0 as keep_uncited from fate),
f as (select *, fate in ('claim', 'prose') or (fate = 'uncited_claim' and keep_uncited) as kept from k)
select conv_id, turn, md5(trim(coalesce(string_agg(s, ' ' order by pos) filter (kept), ''))) as answer_digest,
  count(*) filter (fate = 'claim') as n_claims, count(*) filter (fate = 'uncited_claim') as n_uncited, count(*) filter (not kept) as n_stripped,
  sum(len(bad))::bigint as fabricated_citations, count(*) as n_sentences,
  coalesce(string_agg(fate, '|' order by pos) filter (not kept), '') as stripped_reasons,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(ids) filter (fate = 'claim')))), ','), '') as citations
from f group by conv_id, turn""",
)
def processed_answers(spark, path):
    """Whole answers through the citation rules."""
    ids = F.array(*[F.lit(i) for i in ("d0", "d1", "d2", "x0", "x1")])
    rows = _answers(Tables(spark, path)).withColumn("p", C.postprocess(F.col("answer"), ids, F.col("conv_id") % 2 == 0))
    p = F.col("p")
    return rows.select(
        "conv_id", "turn", F.md5(p["answer"]).alias("answer_digest"), F.size(p["claims"]).alias("n_claims"), F.size(p["uncited_claims"]).alias("n_uncited"),
        F.size(p["stripped"]).alias("n_stripped"), p["fabricated_citations"].alias("fabricated_citations"), p["n_sentences"].alias("n_sentences"),
        F.array_join(F.transform(p["stripped"], lambda x: x["reason"]), "|").alias("stripped_reasons"), F.array_join(p["citations"], ",").alias("citations"),
    )


@query(
    "abstained_answers",
    """with a as (select conv_id, turn, case turn % 4 when 0 then ' "INSUFFICIENT_EVIDENCE". ' when 1 then chr(10) || '`INSUFFICIENT_EVIDENCE.` '
   when 2 then 'INSUFFICIENT_EVIDENCE because ' || text else text end as answer from conversations)
select conv_id, turn, (turn % 4 = 1)::int as abstained from a""",
)
def abstained_answers(spark, path):
    """The abstain token alone, quoted or with a full stop, and near misses."""
    case = F.col("turn") % 4
    answer = (
        F.when(case == 0, F.lit(' "INSUFFICIENT_EVIDENCE". ')).when(case == 1, F.lit("\n`INSUFFICIENT_EVIDENCE.` "))
        .when(case == 2, F.concat(F.lit("INSUFFICIENT_EVIDENCE because "), F.col("text"))).otherwise(F.col("text"))
    )
    return Tables(spark, path).conversations.select("conv_id", "turn", C.is_abstain(answer).cast("int").alias("abstained"))


@query(
    "rebuilt_answers",
    f"""with {SQL_ANSWERS}, {SQL_SENTENCES},
d as (select conv_id, turn, list_distinct(list(s) filter ((conv_id * 31 + turn * 7 + pos) % 3 = 0)) as gone from sentences group by conv_id, turn)
select s.conv_id, s.turn, md5(trim(coalesce(string_agg(s, ' ' order by pos) filter (not list_contains(coalesce(gone, []), s)), ''))) as answer_digest
from sentences s join d using (conv_id, turn) group by s.conv_id, s.turn""",
)
def rebuilt_answers(spark, path):
    """Answers without the sentences verification removed, matched by text."""
    rows = _answers(Tables(spark, path)).select("conv_id", "turn", C.split_sentences(F.col("answer")).alias("ss"))
    gone = F.filter("ss", lambda s, i: (F.col("conv_id") * 31 + F.col("turn") * 7 + i) % 3 == 0)
    return rows.select("conv_id", "turn", F.md5(P.rebuilt_answer(F.col("ss"), gone)).alias("answer_digest"))


@query(
    "cited_evidence",
    f"""with {SQL_ANSWERS}, {SQL_SENTENCES}, {SQL_IDS},
c as (select conv_id, turn, pos, list_filter(ids, lambda i: i in ('d1', 'x1')) as known from ids where len(ids) > 0)
select conv_id, turn, pos, coalesce(array_to_string(list_transform(known, lambda i: i || '=text of ' || i), '|'), '') as cited from c""",
)
def cited_evidence(spark, path):
    """Passages a claim cites, in citation order; unknown ids left out."""
    texts = F.create_map(F.lit("d1"), F.lit("text of d1"), F.lit("x1"), F.lit("text of x1"))
    rows = answer_sentences(spark, path).withColumn("ids", C.citation_ids(F.col("sentence"))).where(F.size("ids") > 0)
    cited = F.transform(cited_passages(F.col("ids"), texts), lambda e: F.concat_ws("=", e["id"], e["text"]))
    return rows.select("conv_id", "turn", "pos", F.array_join(cited, "|").alias("cited"))


