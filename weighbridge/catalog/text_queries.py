"""URLs, ids, page text, chunks and normalised matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.catalog.base import Tables, query
from weighbridge.functions import ids as I
from weighbridge.functions import text as T
from weighbridge.functions import urls as U
from weighbridge.operators import passages as P
from weighbridge.operators import snapshot as S
from weighbridge.operators.grouped import top_rows

SQL_CANONICAL = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '')"
SQL_DOMAIN = """regexp_replace(coalesce(nullif(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//(?:[^/?#]*@)?\\[?([^/?#:\\]]*)', 1)), ''), 'unknown'), '^www\\.', '')"""


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str) -> str:
    """SQL of ``clean_text`` for the entities that occur in the pages."""
    out = f"regexp_replace({x}, '(?s)```.*?```', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]{{1,200}}>', ' ', 'g')"
    # a cut page may end an entity without its semicolon, which HTML accepts
    for entity, char in (("&quot", '"'), ("&middot", "·"), ("&copy", "©"), ("&lt", "<"), ("&gt", ">"), ("&amp", "&")):
        out = f"regexp_replace({out}, '{entity};?', '{char}', 'g')"
    out = f"regexp_replace({out}, '[ \\t\\f\\v]+', ' ', 'g')"
    out = f"regexp_replace({out}, '\\r\\n|\\r', chr(10), 'g')"
    out = f"regexp_replace({out}, '[^\\S\\n]*\\n[^\\S\\n]*', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(out)


def cap(x: str, n: int) -> str:
    head = f"left({x}, {n})"
    at = f"strpos(reverse({head}), ' ')"
    cut = f"case when {at} > 0 and {n} - {at} > {n * 0.6} then left({head}, ({n} - {at})::int) else {head} end"
    return f"case when length({x}) <= {n} then {x} else regexp_replace({cut}, '\\s+$', '') end"


def normal(x: str) -> str:
    folded = f"strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss'))"
    words = f"regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g')"
    return f"trim(regexp_replace({words}, '\\s+', ' ', 'g'))"


def _source_type_sql(domain: str, wing: str) -> str:
    def case(table):
        return " ".join(f"when '{k}' then '{v}'" for k, v in table.items())

    suffixes = sorted(U.TYPE_OF_DOMAIN, key=len, reverse=True)
    tail = " ".join(f"when host = '{s}' or ends_with(host, '.{s}') then '{U.TYPE_OF_DOMAIN[s]}'" for s in suffixes)
    return f"""case when {wing} = 'verified' then 'memory_verified'
  when {wing} in ('evidence', 'quarantine') and coalesce(nullif({domain}, ''), 'palace') = 'palace' then 'memory_evidence'
  when host in ('', 'palace') then case when coalesce({wing}, '') <> '' then 'memory_evidence' else 'unknown' end
  else coalesce(case host {case(U.EXACT_HOSTS)} end,
    case case when contains(host, '.') then split_part(host, '.', 1) end {case(U.HOST_LABELS)} end,
    case {tail} end, 'unknown') end"""


@query(
    "url_facts",
    f"""select page_id, {SQL_CANONICAL} as canonical, {SQL_DOMAIN} as domain from pages""",
)
def url_facts(spark, path):
    return Tables(spark, path).pages.select(
        "page_id", U.canonical_url(F.col("url")).alias("canonical"), U.domain_of(F.col("url")).alias("domain")
    )


HOSTS = [*U.EXACT_HOSTS, "en.wikipedia.org", "docs.oracle.com", "blog.reuters.com", "www.bbc.co.uk", "old.reddit.com", "palace", "", "a.dev.to", "notmedium.com"]


@query(
    "source_types",
    f"""with d as (select s_suppkey, case when s_suppkey % 3 = 0 then 'h' || s_suppkey || '.example.com'
    else list_extract([{", ".join(f"'{h}'" for h in HOSTS)}], (s_suppkey % {len(HOSTS)} + 1)::int) end as domain,
  list_extract([null, 'evidence', 'verified', 'quarantine', null, null], (s_suppkey % 6 + 1)::int) as wing from supplier),
h as (select *, regexp_replace(lower(trim(domain)), '^www\\.', '') as host from d)
select s_suppkey, domain, {_source_type_sql("domain", "wing")} as source_type from h""",
)
def source_types(spark, path):
    """Passage type from wing, exact host, first label and registered domain."""
    key = F.col("s_suppkey")
    listed = F.get(F.array(*[F.lit(h) for h in HOSTS]), (key % len(HOSTS)).cast("int"))
    domain = F.when(key % 3 == 0, F.format_string("h%d.example.com", key)).otherwise(listed)
    wings = [F.lit(w).cast("string") for w in (None, "evidence", "verified", "quarantine", None, None)]
    rows = Tables(spark, path).supplier.select(key, domain.alias("domain"), F.get(F.array(*wings), (key % 6).cast("int")).alias("wing"))
    return rows.select("s_suppkey", "domain", U.source_type(F.col("domain"), F.col("wing")).alias("source_type"))


@query(
    "content_ids",
    f"""select page_id, 'ev_' || substr(sha1(url || chr(10) || (page_id % 8)), 1, 16) || '_c' || (page_id % 8) as evidence_id,
  'vf_' || substr(sha1('q' || page_id || chr(10) || url), 1, 16) as verified_id, 'r' || lpad((page_id % 30)::varchar, 2, '0') || 'c' || (page_id % 8) as cite_id,
  'r' || lpad((page_id % 30)::varchar, 2, '0') || 's' as snippet_id, 'm' || lpad((page_id % 30)::varchar, 2, '0') as memory_id, sha256(html) as sha256,
  coalesce(nullif(array_to_string(list_filter(regexp_extract_all(lower(url), '[a-z0-9]+'), lambda w: w not in ({", ".join(f"'{w}'" for w in I.STOP_WORDS)}))[1:3], '_'), ''), 'general') as slug,
  sha256('grader' || chr(10) || url) as grade_key, sha256('grader' || chr(10) || 'claim_support' || chr(10) || url) as claim_grade_key
from pages""",
)
def content_ids(spark, path):
    """Content-addressed ids, id formats and grading keys."""
    page, url = F.col("page_id"), F.col("url")
    index, rank = (page % 8).cast("int"), (page % 30).cast("int")
    return Tables(spark, path).pages.select(
        page, I.evidence_drawer_id(url, index).alias("evidence_id"), I.verified_drawer_id(F.format_string("q%d", page), url).alias("verified_id"),
        I.chunk_cite_id(rank, index).alias("cite_id"), I.snippet_cite_id(rank).alias("snippet_id"), I.memory_cite_id(rank).alias("memory_id"),
        I.sha256_text(F.col("html")).alias("sha256"), I.subject_slug(url).alias("slug"),
        I.grade_key(F.lit("grader"), url).alias("grade_key"), I.claim_grade_key(F.lit("grader"), url).alias("claim_grade_key"),
    )


@query(
    "cleaned_meta",
    """select c_custkey, case when c_acctbal >= 0 then c_mktsegment end as segment, c_custkey::varchar as key, 'a,b' as tags,
  case when c_acctbal >= 0 then 3 else 2 end as entries from customer""",
)
def cleaned_meta(spark, path):
    """Metadata maps: NULLs left out, lists joined, scalars as text."""
    rows = Tables(spark, path).customer.select(
        "c_custkey", F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"),
        F.array(F.lit("a"), F.lit("b")).alias("tags"),
    )
    meta = rows.withColumn("m", I.clean_meta(rows, ["key", "segment", "tags"]))
    m = F.col("m")
    return meta.select("c_custkey", m["segment"].alias("segment"), m["key"].alias("key"), m["tags"].alias("tags"), F.size("m").alias("entries"))


SQL_STATUS = "case when page_id % 10 = 3 then 404 else 200 end"
SQL_TYPE = "case when page_id % 10 = 5 then 'application/pdf' when page_id % 10 = 6 then '' when page_id % 10 = 7 then 'text/plain' else 'text/html' end"


@query(
    "page_texts",
    f"""with c as (select page_id, {SQL_STATUS} as status, {SQL_TYPE} as ct, {clean("html")} as text from pages)
select page_id, case when status >= 400 then 'http ' || status
  when not (starts_with(ct, 'text/html') or starts_with(ct, 'text/plain')) then 'unsupported content type ' || coalesce(nullif(ct, ''), 'unknown')
  when text = '' then 'no extractable text' end as error, length(text) as n_chars, md5(text) as digest from c""",
)
def page_texts(spark, path):
    """Whole page texts after cleaning, with the fetch outcome."""
    page = F.col("page_id")
    kind = F.when(page % 10 == 5, "application/pdf").when(page % 10 == 6, "").when(page % 10 == 7, "text/plain").otherwise("text/html")
    rows = Tables(spark, path).pages.select(
        page, F.when(page % 10 == 3, 404).otherwise(200).alias("status"), kind.alias("ct"), T.page_text(F.col("html"), kind).alias("text")
    )
    outcome = U.fetch_outcome(F.col("status"), F.col("ct"), F.col("text"))
    return rows.select("page_id", outcome["error"].alias("error"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "prepared_texts",
    f"""select page_id, length(t) as n_chars, md5(t) as digest from (select page_id, {cap("c", 1800)} as t from (select page_id, {clean("html")} as c from pages))""",
)
def prepared_texts(spark, path):
    rows = Tables(spark, path).pages.select("page_id", T.prepare_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query(
    "capped_texts",
    f"""select doc_id, length(t) as n_chars, md5(t) as digest from (select doc_id, {cap("text", 700)} as t from documents)""",
)
def capped_texts(spark, path):
    rows = Tables(spark, path).documents.select("doc_id", T.cap_chars(F.col("text"), 700).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


@query("token_counts", "select doc_id, len(regexp_extract_all(text, '\\S+')) as n_tokens, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as n_words from documents")
def token_counts(spark, path):
    """Tokens under the default and under a caller's own counter."""
    def words(text):
        return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))

    text = F.col("text")
    return Tables(spark, path).documents.select("doc_id", T.count_tokens(text).alias("n_tokens"), T.count_tokens(text, words).alias("n_words"))


@query(
    "text_chunks",
    f"""with d as (select doc_id, regexp_extract_all(text, '\\S+') as tok from documents),
s as (select doc_id, tok, len(tok) as n, unnest(range(0, len(tok), 255)) as s from d),
w as (select doc_id, s // 255 as chunk_index, least(300, n - s) as n_tokens, array_to_string(tok[s + 1:s + 300], ' ') as t
  from s where (s = 0 or s - 255 + 300 < n) and (s = 0 or n - s >= 20)),
c as (select doc_id, chunk_index, n_tokens, {cap("t", 1800)} as t from w)
select doc_id, chunk_index, n_tokens, length(t) as n_chars, md5(t) as digest from c""",
)
def text_chunks(spark, path):
    """Overlapping token windows of every document."""
    chunks = Tables(spark, path).documents.select("doc_id", F.explode(T.chunk_text(T.word_tokens(F.col("text")))).alias("c"))
    return chunks.select("doc_id", "c.chunk_index", "c.n_tokens", F.length("c.text").alias("n_chars"), F.md5("c.text").alias("digest"))


@query(
    "normalized_texts",
    f"""select doc_id, length(t) as n_chars, md5(t) as digest, (length(t) <= 4)::int as short from (select doc_id, {normal("text")} as t from documents)""",
)
def normalized_texts(spark, path):
    rows = Tables(spark, path).documents.select("doc_id", T.normalize_answer(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"), T.is_short_answer(F.col("t")).cast("int").alias("short"))


@query(
    "gold_in_own_text",
    f"""select doc_id, (g <> '' and contains(t, g))::int as hit, (o <> '' and contains(t, o))::int as other_hit from (
  select d.doc_id, {normal("d.text")} as t, {normal("lower(d.lang)")} as g, {normal("b.text")} as o
  from documents d left join benchmark b on b.item_id = d.doc_id % 40)""",
)
def gold_in_own_text(spark, path):
    """Normalised containment of a short and of a long gold string."""
    t = Tables(spark, path)
    gold = t.benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("gold"))
    rows = t.documents.withColumn("item", F.col("doc_id") % 40).join(gold, "item", "left")
    norm = rows.select(
        "doc_id", T.normalize_answer(F.col("text")).alias("t"), T.normalize_answer(F.lower("lang")).alias("g"), T.normalize_answer(F.col("gold")).alias("o")
    )
    return norm.select(
        "doc_id", T.contains_gold(F.col("t"), F.col("g")).cast("int").alias("hit"), T.contains_gold(F.col("t"), F.col("o")).cast("int").alias("other_hit")
    )


@query(
    "generated_texts",
    f"""select conv_id, turn, {strip("text")} as cleaned from conversations""",
)
def generated_texts(spark, path):
    """Thought channels and turn markers removed from generated text."""
    rows = Tables(spark, path).conversations
    wrapped = F.concat(F.lit("<|channel>let me\nthink<channel|>"), F.col("text"), F.lit("<turn|>\n<|think|>"))
    return rows.select("conv_id", "turn", T.clean_output(wrapped).alias("cleaned"))


SQL_LINE = "regexp_replace(regexp_replace(trim(l), '(?i)^\\s*(?:search\\s*)?query\\s*[:\\-]\\s*', ''), '^[`\"'']+|[`\"'']+$', '', 'g')"


@query(
    "refined_queries",
    f"""with r as (select conv_id, turn, text, chr(10) || '  Search query: "' || text || '"' as reply from conversations),
l as (select *, list_filter(list_transform(string_split(reply, chr(10)), lambda l: trim({SQL_LINE})), lambda x: x <> '')[1] as first from r),
q as (select *, trim(left(regexp_replace(coalesce(first, ''), '\\s+', ' ', 'g'), 200)) as cleaned from l)
select conv_id, turn, coalesce(nullif(cleaned, ''), text) as refined, (lower({strip("coalesce(nullif(cleaned, ''), text)")}) = lower({strip("text")}))::int as same from q""",
)
def refined_queries(spark, path):
    """First usable line of a reply as the next query."""
    rows = Tables(spark, path).conversations
    reply = F.concat(F.lit('\n  Search query: "'), F.col("text"), F.lit('"'))
    refined = T.refined_query(reply, F.col("text"))
    return rows.select("conv_id", "turn", refined.alias("refined"), T.same_as_original(refined, F.col("text")).cast("int").alias("same"))


RULES = {
    "rather than": r"\brather than\b",
    "double letters": r"(?:ee|oo|ll)",
    "line start": r"^[A-Z]",
    "not only": r"\bnot (?:only|just|merely)\b",
    "the of": r"\bthe\b[^.\n]{0,40}\bof\b",
}


@query(
    "pattern_hits",
    "select doc_id, rule, hits from ("
    + " union all ".join(f"select doc_id, '{n}' as rule, len(regexp_extract_all(text, '(?im){p}')) as hits from documents" for n, p in RULES.items())
    + ") where hits > 0",
)
def pattern_hits(spark, path):
    """Named text rules counted per document in one scan."""
    return S.pattern_hits(Tables(spark, path).documents, RULES, "doc_id")


@query(
    "passage_table",
    f"""with s as (select page_id, url, 'q' || page_id % 12 as question_id, page_id % 30 as rank, {cap(clean("html"), 300)} as snippet from pages),
p as (select question_id, page_id, 'r' || lpad(rank::varchar, 2, '0') || 's' as id, {cap(clean("snippet"), 1800)} as text, 'Page ' || page_id as title,
  {SQL_DOMAIN} as domain, 'snippet' as kind from s where snippet <> ''),
t as (select *, domain as host, null::varchar as wing from p)
select question_id, id, title, domain, {_source_type_sql("domain", "wing")} as source_type, kind, md5(text) as digest,
  sha256('q' || '|' || id || '|' || title || '|' || domain || '|' || text) as state_digest from t""",
)
def passage_table(spark, path):
    """Search snippets as passages, and the five fields a judge sees."""
    pages = Tables(spark, path).pages
    page = F.col("page_id")
    results = pages.select(
        F.concat(F.lit("q"), (page % 12).cast("string")).alias("question_id"), (page % 30).cast("int").alias("rank"), "url",
        F.format_string("Page %d", page).alias("title"), T.cap_chars(T.clean_text(F.col("html")), 300).alias("snippet"),
        F.array(F.lit("e1")).alias("engines"),
    )
    rows = P.snippet_passages(results).withColumn("state", P.gate_state(F.lit("q")))
    s = F.col("state")
    seen = F.concat_ws("|", s["query"], s["passage"]["id"], s["passage"]["title"], s["passage"]["domain"], s["passage"]["text"])
    return rows.select("question_id", "id", "title", "domain", "source_type", "kind", F.md5("text").alias("digest"), F.sha2(seen, 256).alias("state_digest"))


@query(
    "evidence_prompts",
    """with r as (select *, row_number() over (partition by conv_id, role = 'user' order by turn, text) as pos from conversations),
c as (select * from r where pos <= 6),
e as (select conv_id, string_agg('[t' || turn || '] ' || text, chr(10) order by turn) filter (role <> 'user') as ev,
  string_agg('[t' || turn || '] ' || text, chr(10) order by turn) filter (role = 'user') as cf from c group by conv_id)
select conv_id, md5('EVIDENCE:' || coalesce(chr(10) || ev, '') || case when cf is not null then chr(10) || 'CONFLICTS:' || chr(10) || cf else '' end
  || chr(10) || chr(10) || 'QUESTION: What is said in ' || conv_id || '?') as digest,
  md5('Q: c' || conv_id || chr(10) || coalesce(ev, '(none)') || ' {end}') as claim_digest from e""",
)
def evidence_prompts(spark, path):
    """Prompt bodies with evidence and conflict blocks (six passages each), and a
    grader template."""
    turns = Tables(spark, path).conversations.withColumn("against", F.col("role") == "user")
    turns = top_rows(turns, ["conv_id", "against"], [F.asc("turn"), F.asc("text")], 6)
    item = F.struct("turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), "text", "role")
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def pick(keep):
        return F.transform(F.filter("items", keep), lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text")))

    evidence, conflicts = pick(lambda e: e["role"] != "user"), pick(lambda e: e["role"] == "user")
    asked = F.format_string("What is said in %d?", "conv_id")
    body = P.user_message(asked, evidence, conflicts)
    graded = P.claim_prompt("Q: {claim}\n{evidence} {{end}}", asked, F.format_string("c%d", "conv_id"), evidence)
    return lists.select("conv_id", F.md5(body).alias("digest"), F.md5(graded).alias("claim_digest"))
