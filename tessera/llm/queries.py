"""The queries of the training-data operators: each applies its operator to its whole table.

Each returns a row per row of its table, repeated rows too, and an empty result of an empty table, but for op4 (a row
per document and item it holds), op6 (a row per query and neighbour) and op8 (a row per call and per result without
one). Null texts and pages count as empty. Ties go to the smaller id. Other columns of a table are never read.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontaminate, html, language, lm, neighbours, quality, simhash, suffix, trie, warc, whiten
from tessera.llm._common import held_out_column


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", held_out_column().alias("held_out"), "score", "predicted")


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    # the kept bytes as text, last; what a span leaves of a character that it cuts is U+FFFD
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    return out.select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_conversations(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.withColumn("errors", F.concat_ws(",", "errors"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), learn=fold != 1, held=fold == 1)


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: For pages that mark their article, as the given ones do, with the character references that they hold.
OP3_SQL = """
with articles as (
  select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) as a from pages
), parts as (
  select page_id, url, list_transform(string_split_regex(a, '</?(?:p|h1|br)>'), lambda x:
    trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) as blocks from articles
), joined as (
  select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as text from parts
)
select page_id, url, text, cast(length(text) as bigint) as n_chars from joined
"""

OP4_SQL = """
with item_words as (
  select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from benchmark where item_id is not null
), item_shingles as (
  select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as s
  from item_words where len(w) > 0
), sizes as (
  select item_id, count(*) as n from item_shingles group by item_id
), doc_words as (
  select distinct doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where doc_id is not null
), doc_shingles as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as s
  from doc_words where len(w) > 0
), shared as (
  select doc_id, item_id, count(*) as k from doc_shingles join item_shingles using (s) group by doc_id, item_id
)
select doc_id, item_id, n as n_item_shingles, k as n_shared, k / n as containment
from shared join sizes using (item_id) where k >= 0.8 * n - 1e-9
"""


OP8_SQL = """
with calls as (
  select conv_id, turn, min(text) as text from conversations where role = 'user' and conv_id is not null and turn is not null group by conv_id, turn
), results as (
  select conv_id, turn - 1 as turn, min(text) as content from conversations
  where role = 'assistant' and conv_id is not null and turn is not null group by conv_id, turn
)
select conv_id, 'call-' || coalesce(c.turn, r.turn) as call_id, c.turn as call_turn, r.turn + 1 as result_turn,
  case when c.turn is null then 'orphan_result' when r.turn is null then 'unanswered' else 'linked' end as status,
  case when c.turn is null then null else 0 end as level,
  c.turn is not null and c.text is not null as valid,
  case when c.turn is not null and c.text is null then 'missing:text' else '' end as errors,
  '{"call":' || case when c.turn is null then 'null' else
    '{"arguments":{' || case when c.text is null then '' else '"text":' || cast(to_json(c.text) as varchar) || ',' end || '"turn":' || c.turn
      || '},"id":"call-' || c.turn || '","name":"reply"}' end
  || ',"result":' || case when r.turn is null then 'null' else
    '{"content":' || coalesce(cast(to_json(r.content) as varchar), 'null') || ',"id":"call-' || r.turn || '"}' end || '}' as message
from calls c full join results r using (conv_id, turn)
"""

OP9_SQL = """
with digests as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), firsts as (
  select hex, min(page_id) as first_id from digests group by hex
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as int), 5) as bigint) >> cast(15 - i % 4 * 5 as int)) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from digests join firsts using (hex)
"""

#: CRC-32 is done bit by bit. Subtrees are sums over the prefixes of each node's smallest member.
OP12_SQL = """
with turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null
), sizes as (
  select c, n, c - c % 5 as base, xor(list_reduce(
    list_prepend(cast(4294967295 as bigint), list_transform(range(length(cast(c as varchar))), lambda i: cast(ascii(substr(cast(c as varchar), cast(i + 1 as int), 1)) as bigint))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 as h
  from (select c, count(*) as n from turns group by c)
), per as (
  select s.c, s.base, s.h, least(s.h, coalesce(b.n, 0)) as lent, least(s.h, coalesce(b.n, 0)) + greatest(s.n - s.h, 0) as size
  from sizes s left join sizes b on b.c = s.base
), rebuilt as (
  select p.c, size, pos, role, text from per p join turns t on t.c = p.base and t.pos <= p.h
  union all
  select p.c, size, pos - h + lent, role, text from per p join turns t on t.c = p.c and t.pos > p.h
), prefixes as (
  select c, size, pos as depth, octet_length(encode(text)) as bytes,
    md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by c order by pos)) as node
  from rebuilt
), members as (
  select c, size, depth, bytes, node from prefixes union all select c, size, 0, 0, '' from per
), nodes as (
  select node, depth, min(c) as conv_id, count(*) as n_convs, max(bytes) as bytes,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where size = depth), '')) as ends_sha256
  from members group by node, depth
), kin as (
  select n.conv_id, n.depth, p.node as above, m.node as parent from nodes n
  join members p on p.c = n.conv_id and p.depth <= n.depth left join members m on m.c = n.conv_id and m.depth = n.depth - 1
  where p.depth <= n.depth
), families as (
  select parent, count(distinct (conv_id, depth)) as n_children from kin where parent is not null group by parent
), weighed as (
  select n.*, coalesce(f.n_children, 0) as n_children, cast((n_convs - 1) * bytes as bigint) as weight from nodes n left join families f on f.parent = n.node
), totals as (
  select k.above, sum(cast(n_children = 0 as int)) as n_leaves, sum(weight) as saved_tokens
  from kin k join weighed w using (conv_id, depth) group by k.above
), parents as (
  select distinct k.conv_id, k.depth, p.conv_id as parent_conv_id from kin k join nodes p on p.node = k.parent
)
select w.conv_id, cast(w.depth as bigint) as depth, q.parent_conv_id, w.n_convs, w.n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from weighed w join totals t on t.above = w.node left join parents q on q.conv_id = w.conv_id and q.depth = w.depth
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_html_extraction": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL, "op8_chat_formatting": OP8_SQL, "op9_warc": OP9_SQL, "op12_conversation_prefix_trie": OP12_SQL}
