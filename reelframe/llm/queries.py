"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embedding_dedup, html_extract, langid, ngram_join, packing, quality, sharding, toxicity
from .common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_trees(chat.linear_messages(rows)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.detect(docs, langid.fit_languages(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []::varchar[]) as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark where item_id is not null and text is not null),
bw as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
       from (select item_id, w, unnest(range(1, greatest(2, len(w) - 13 + 2))) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hits as (select distinct doc_id, item_id, dw.n, i from dw join bw on dw.win = bw.win and dw.n = bw.n),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id
"""

OP3_SQL = f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []::varchar[]) as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from pairs join n p on a = p.doc_id join n q on b = q.doc_id where 100 * c >= 85 * (p.n + q.n - c)),
reach as (select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on reach.b = links.a),
linked as (select a, count(*) as n from links group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.c as component_id, cast(coalesce(linked.n, 0) as bigint) as n_links
from d left join n on d.doc_id = n.doc_id join (select a, min(b) as c from reach group by a) r on d.doc_id = r.a left join linked on d.doc_id = linked.a
"""

_ESCAPED = "replace(replace({0}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')"
_SHA = "sha256(coalesce({0}, ''))"

OP5_SQL = f"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t as (select *, length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 24 + length(role) - length(replace(role, chr(10), '')) as c from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  {_SHA.format("string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant')")} as loss_sha256,
  cast(sum(c) as bigint) as formatted_chars
from t group by conv_id
"""

OP6_SQL = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as z from v where list_dot_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.z * b.z) >= 0.93),
reach as (select vec_id as a, vec_id as b from embeddings union select reach.a, links.b from reach join links on reach.b = links.a),
c as (select a, min(b) as c from reach group by a),
d as (select a, count(*) as d from links group by a)
select e.vec_id, coalesce(d.d, 0) as n_links, c.c as component_id, e.vec_id = c.c as kept
from embeddings e join c on e.vec_id = c.a left join d on e.vec_id = d.a
"""

OP9_SQL = f"""
with h as (select doc_id, coalesce(strlen(text), 0) as n_bytes, cast('0x' || substr(md5(concat_ws('|', cast(doc_id as varchar), text)), 1, {sharding.BITS // 4}) as bigint) as h from documents),
d as (select h.*, x.d, sum(n_bytes) over (partition by x.d, h >> ({sharding.BITS} - x.d)) as b from h, (select unnest(range(0, 31)) as d) x),
s as (select doc_id, n_bytes, h, min(d) as depth from d where b <= {sharding.LIMIT_BYTES} group by all)
select doc_id, cast(n_bytes as bigint) as n_bytes, cast(depth as int) as depth, h >> ({sharding.BITS} - depth) as prefix,
  case when depth = 0 then 'root' else lpad(bin(h >> ({sharding.BITS} - depth)), cast(depth as int), '0') end as shard, false as oversized
from s
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_ngram_join": op3_ngram_join,
        "op4_quality": op4_quality,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_language_id": op7_language_id,
        "op8_packing": op8_packing,
        "op9_sharding": op9_sharding,
        "op10_html_extraction": op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op3_ngram_join": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op9_sharding": OP9_SQL}
