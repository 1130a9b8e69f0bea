"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosa.llm import chat_format, html_extract, katz, packing, quality_classifier, quality_rules, sentence_pieces, simhash, token_counts, vector_search
from prosa.llm.common import table


def op1_quality_rules(spark, sf_dir):
    return quality_rules.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark, sf_dir):
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackingOptions(packing.public_vocabulary("byte_bpe_50k.json")))


def op6_simhash(spark, sf_dir):
    named = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_katz_scores(spark, sf_dir):
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op5_vector_search(spark, sf_dir):
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


#: A fixed conversation whose texts hold the control strings of the template.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(rows.unionByName(own))


def op9_sentence_pieces(spark, sf_dir):
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), packing.public_vocabulary("piece_bpe_32k.model"))


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), packing.public_vocabulary("byte_bpe_50k.json"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_katz_scores": op4_katz_scores,
    "op5_vector_search": op5_vector_search,
    "op6_simhash": op6_simhash,
    "op7_html_extraction": op7_html_extraction,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_token_counts": op10_token_counts,
}
_VECTORS = """v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""

_TURNS = r"""t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
  r as (select *, replace(replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3a'), '#', '%23'), '\', '%5c'), '<', '%3c'), chr(10), '%0a') as name,
    case when contains(text, '</turn>') or contains(text, '\###') then regexp_replace(text, '(\\*)(###|</turn>)', '\1\\\2', 'g') else text end as body from t)"""

#: The others grow forests, fit models, pack, link or align; tests/llm holds each against a brute-force version.
ORACLE_SQL: dict[str, str] = {
    "op5_vector_search": f"""with {_VECTORS}, q as (select vec_id as query_id, e as asked from v where vec_id % 50 = 0),
  s as (select query_id, vec_id, list_dot_product(asked, e)::bigint as score from q join v on len(asked) = len(e) and query_id <> vec_id),
  r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s) select * from r where rank <= 5""",
    "op8_chat_formatting": f"""with {_TURNS} select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then len(text) end), 0)::bigint as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  sum(len('### ' || name || ': ' || body || chr(10) || '</turn>' || chr(10)))::bigint as formatted_chars from r group by 1""",
}
