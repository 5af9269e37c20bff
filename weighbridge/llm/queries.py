"""Registered queries of this package: one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.llm.ann import learned_index, search
from weighbridge.llm.bpe import bpe_digests
from weighbridge.llm import blocks, language_id, lm, quality, secret_scan, toxicity
from weighbridge.llm.common import fold, table
from weighbridge.llm.lexical_search import ranked_search
from weighbridge.llm.mixing import mix
from weighbridge.llm.ngram_join import jaccard_join, numbered
from weighbridge.llm.spelling import corpus_words, spelling_variants
from weighbridge.llm.token_counts import count_tokens
from weighbridge.llm.topk_search import voronoi_top_k, whole_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


TOPK_SQL = """
with v as (
  select vec_id, max(list_transform(embedding, lambda x: floor(64 * x::double)::bigint)) as vec
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null
  group by vec_id
), scored as (
  select q.vec_id as query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored
) where rank <= 20
"""


@query("op1_voronoi_top_k", TOPK_SQL)
def voronoi_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 rows of highest inner product for every twentieth vector, exactly."""
    vectors = whole_components(table(spark, folder, "embeddings"), "vec_id", "embedding", 64)
    return voronoi_top_k(vectors, F.col("vec_id") % 20 == 0, 20)


NEAR_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as w from documents where text is not null
), s as (
  select doc_id, list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from w where len(w) > 0
), g as (select doc_id, len(s) as n, unnest(s) as g from s),
common as (select a.doc_id as u, b.doc_id as v, a.n as nu, b.n as nv, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select u, v from common where c >= 0.8 * (nu + nv - c) - 1e-9),
sides as (select u, v from links union all select v, u from links),
""" + """reach as (
  with recursive r as (select doc_id as node, doc_id as root from documents union select sides.v, r.root from r join sides on sides.u = r.node)
  select node, min(root) as root from r group by node
)
select d.doc_id, r.root as class_id, (select count(*) from sides where sides.u = d.doc_id) as n_links
from documents d join reach r on r.node = d.doc_id
"""


@query("op2_ngram_join", NEAR_SQL)
def ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document under 5-gram Jaccard similarity 0.8."""
    rows = numbered(table(spark, folder, "documents"), ["doc_id", "text"])
    return jaccard_join(rows).join(rows.select("_row", "doc_id"), "_row").select("doc_id", "class_id", "n_links")


@query("op4_learned_partitions")
def learned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth vector, by learned partitions."""
    rows = table(spark, folder, "embeddings").where(blocks.usable("embedding"))
    vector = F.transform("embedding", lambda x: x.cast("double"))
    vectors = blocks.one_per_id(rows, "vec_id", vector).where(F.exists("vec", lambda x: x != 0))
    return search(vectors, F.col("vec_id") % 100 == 0, 10, learned_index(vectors))


TOKEN_LIMIT = 512


@query("op3_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every whole document."""
    return count_tokens(table(spark, folder, "documents"), BYTE_BPE, TOKEN_LIMIT, ["doc_id"])


MIX_SQL = r"""
with sized as (
  select doc_id, source, md5(coalesce(text, '')) as digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
), totals as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from sized group by source
), stops as (
  select *, 2.0::double * source_size as stop,
         row_number() over (order by 2.0::double * source_size / w, source nulls last) as k,
         1.5::double * sum(source_size) over () as budget
  from totals
), levels as (
  select k - 1 as stopped, (budget - coalesce(sum(stop) over (order by k rows between unbounded preceding and 1 preceding), 0))
                           / sum(w) over (order by k rows between current row and unbounded following) as level,
         stop / w as next_stop
  from stops
), chosen as (select level from levels where level < next_stop order by stopped limit 1),
targets as (
  select source, source_size, least(stop, coalesce((select level from chosen), 1e300) * w)::double as target from stops
), placed as (
  select *, row_number() over (partition by source order by m >= '8', case when m >= '8' then -size else size end, m, digest) as place
  from (select *, md5(coalesce(doc_id::varchar, '')) as m from sized)
), drawn as (
  select *, case when source_size > 0 then target / source_size else 0 end as each,
         ('0x' || substr(md5('20|' || coalesce(source, '') || case when source is null then '-' else '+' end), 1, 8))::bigint / 4294967296::double as o
  from targets
)
select p.doc_id, p.size::bigint as size, t.source_size, t.target,
       ((floor(o + each * place) - floor(o + each * (place - 1))) * p.size)::bigint as taken
from placed p join drawn t on p.source is not distinct from t.source
"""


@query("op5_source_mixture", MIX_SQL)
def source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Words each document gives to a mix of the sources."""
    mixed = mix(table(spark, folder, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of ids and of the decoded text of every document."""
    return bpe_digests(table(spark, folder, "documents"), BYTE_BPE, ["doc_id"])


@query("op7_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every whole document; every fifth fold is held out."""
    docs = table(spark, folder, "documents")
    machine = toxicity.learn(docs, table(spark, folder, "labels"), fold("doc_id", 5) != 0)
    rows = docs.withColumn("held_out", fold("doc_id", 5) == 0)
    return toxicity.score_texts(rows, machine, ["doc_id", "held_out"])


@query("op9_language_mixture")
def language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole document; every third fold is held out."""
    docs = table(spark, folder, "documents")
    model = language_id.learn(docs, fold("doc_id", 3) != 1)
    rows = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    return language_id.identify(rows, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


@query("op10_lm_scores")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram and maximum-entropy scores of every whole document; every seventh fold is held out."""
    docs = table(spark, folder, "documents")
    model, counts = lm.learn(docs, fold("doc_id", 7) != 2)
    rows = docs.withColumn("held_out", fold("doc_id", 7) == 2)
    return lm.score_texts(rows, model, counts, ["doc_id", "held_out"])


@query("op6_secret_scan")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate for a secret in every whole document, scored by the forest."""
    return secret_scan.scan(table(spark, folder, "documents"), ["doc_id"], path="source")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SQL = f"""
with d as (select doc_id, row_number() over () as r, unnest({_TERMS}) as term from documents),
q as (
  select i, item_id, term, count(*) as times
  from (select row_number() over () as i, item_id, unnest({_TERMS}) as term from benchmark) group by all
), sizes as (select r, count(*)::bigint as n from d group by r),
totals as (select count(*)::bigint as nn, sum(n)::bigint as ll from sizes),
tf as (select r, doc_id, term, count(*)::bigint as tf from d where term in (select term from q) group by all),
weights as (select term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)::double))::bigint as w from tf, totals group by term, nn),
scored as (
  select i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::bigint as score
  from q join weights using (term) join tf using (term) join sizes using (r), totals group by all
)
select item_id, rank, doc_id, score from (
  select *, (row_number() over (partition by i order by score desc, doc_id))::int as rank from scored where score > 0
) where rank <= 10
"""


@query("op11_ranked_search", LEXICAL_SQL)
def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SPELLING_SQL = f"""
with recursive tab as (
  select list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
         lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), runs as (
  select doc_id, run, count(*) as k from (
    select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) as run from documents
  ) where length(run) >= 7 group by all
), bytes as (
  select run, k, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs
), hashed as (
  select run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
         lambda c, b: xor(c >> 8, t[xor(c % 256, b) + 1])), 4294967295) as h
  from bytes, tab
), words as (
  select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(k)::bigint as n
  from hashed group by 1 having length(word) >= 7 and sum(k) >= 2
), cut as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)
), shorter as (select distinct c.word as a, c.n as a_n, w.word as b, w.n as b_n from cut c join words w on c.rest = w.word),
near as (
  select a.word as word, a.n as n, b.word as near, b.n as near_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a, a_n, b, b_n from shorter union select b, b_n, a, a_n from shorter
), best as (
  select word, count(*) as n_near, arg_min(near, (-near_n, near)) filter (near_n >= 10 * n) as form, max(near_n) filter (near_n >= 10 * n) as form_n from near group by word
), ways as (
  select word, form as at from best where form is not null
  union all select w.word, b.form from ways w join best b on b.word = w.at where b.form is not null
), roots as (select w.word, w.at as root from ways w join words x on x.word = w.at qualify row_number() over (partition by w.word order by x.n desc) = 1)
select w.word, form, coalesce(root, w.word) as root, w.n, coalesce(n_near, 0) as n_near, form_n
from words w left join best b on b.word = w.word left join roots r on r.word = w.word
"""


@query("op12_spelling_variants", SPELLING_SQL)
def variants(spark: SparkSession, folder: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling_variants(corpus_words(table(spark, folder, "documents"), drop_one_in=31))


@query("op13_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every whole document; every third fold is held out."""
    docs = table(spark, folder, "documents")
    model = quality.learn(docs, table(spark, folder, "labels"), fold("doc_id", 3) != 1, metadata=["n_chars"])
    rows = docs.withColumn("held_out", fold("doc_id", 3) == 1)
    return quality.score_texts(rows, model, ["doc_id", "held_out"])
