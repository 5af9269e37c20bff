"""Explicit schemas of everything read from files."""

from __future__ import annotations

def _nested(fields: str) -> str:
    """``a int, b array<x>`` as struct fields ``a:int,b:array<x>``."""
    out, depth, name, parts = "", 0, "", []
    for ch in fields + ",":
        if ch == "," and depth == 0:
            head, _, kind = name.strip().partition(" ")
            parts.append(f"{head}:{kind}")
            name = ""
            continue
        depth += (ch in "<(") - (ch in ">)")
        name += ch
    return ",".join(parts)


CHUNK = "cite_id string, drawer_id string, chunk_index int, n_tokens int, n_chars int, sha256 string, created boolean"
PAGE = (
    "rank int, url string, final_url string, status int, content_type string, error string, n_bytes bigint, "
    f"text_chars int, fetched_at string, elapsed_s double, chunks array<struct<{_nested(CHUNK)}>>"
)
RESULT = (
    "rank int, url string, title string, snippet string, engines array<string>, published_date string, "
    "score double, category string"
)


MANIFEST = (
    "snapshot_id string, dataset string, spec_version string, seed bigint, created_at string, updated_at string, "
    "question_ids array<string>, questions array<struct<question_id:string,query:string,category:string,"
    "time_range:string,n_results:int,n_fetched_ok:int,n_chunks:int,n_chunks_new:int,n_chunks_dedup:int,"
    f"results:array<struct<{_nested(RESULT)}>>,pages:array<struct<{_nested(PAGE)}>>>>"
)
SUPPORT = "struct<choice:string,confidence:double,probabilities:map<string,double>>"
CLAIM = f"struct<text:string,citations:array<string>,support:{SUPPORT}>"
GRADE = "struct<label:string,letter:string,model:string,cached:boolean,reply:string>"
RECORD = (
    "question_id:string,query:string,gold:string,arm:string,answer:string,answer_raw:string,abstained:boolean,"
    f"abstain_reason:string,claims:array<{CLAIM}>,citations:array<string>,"
    f"stripped:array<struct<sentence:string,reason:string,support:{SUPPORT}>>,fabricated_citations:int,"
    f"evidence_ids:array<string>,evidence_texts:map<string,string>,grade:{GRADE},claim_support:array<{GRADE}>,"
    "latency_s:double,wall_s:double,prompt_tokens:int,completion_tokens:int"
)
RESULTS_FILE = f"arm string, dataset string, snapshot string, manifest_updated_at string, records array<struct<{RECORD}>>"
JUDGE_ANSWER = (
    "struct<type:string,noul:double,choice:string,score:double,confidence:double,"
    "probabilities:map<string,double>,legend:map<string,string>>"
)
CACHE_FILE = (
    f"model string, answers map<string,{JUDGE_ANSWER}>, usage struct<input_tokens:bigint,output_tokens:bigint>, "
    "fallback boolean, request struct<model:string,state:string,questions:map<string,struct<type:string,"
    "instructions:string,criteria:string>>>, _corrupt_record string"
)
TRIPLE = (
    "family string, state_id string, question_id string, stage string, primitive string, instructions string, "
    "criteria string, state string, seq string, value double, probabilities map<string,double>, teacher_model string"
)
WORKLIST = "question_id string, confidence double, sentence string, abstained boolean, abstain_reason string"
DRAWERS = (
    "drawer_id string, room string, text string, source_file string, chunk_index int, authored_at string, "
    "filed_at string, meta map<string,string>, embedding array<float>, wing string"
)
