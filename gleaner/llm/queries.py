"""The operators' queries with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import records

    path = common.new_path(spark, "records")
    records.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return records.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, seed=42, most=3)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8, least=2)


ORACLES["op4_decontaminate"] = """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null),
g as (
  select distinct item_id, list_slice(w, k, k + 7) as g from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as k from b where len(w) > 0)),
sizes as (select distinct len(g) as n from g),
p as (
  select r, k, n, list_slice(w, k, k + n - 1) as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
h as (select p.r, p.k, p.n, g.item_id from p join g using (g)),
nh as (select r, count(distinct x) as n_hit from (select r, unnest(range(k, k + n)) as x from h) group by r),
ni as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, item_id from h) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join nh using (r) left join ni using (r)
"""


@query
def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import suffix

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return suffix.dedup(docs, length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import chat

    said = "\\### Assistant: </turn> ok"
    own = spark.sql("select -7L as conv_id, posexplode(array('user', 'assistant')) as (turn, role)").withColumn("text", F.lit(said))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat.read_back(chat.formatted(chat.linear(turns)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op5_chat"] = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, t, r, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
e as (
  select *, replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t') as x,
    replace(replace(replace(replace(replace(role, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t'), ':', '\\c'), chr(10), '\\n') as y from c)
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(4 + length(y) + 2 + length(x) + 8)::bigint as formatted_chars
from e group by conv_id
"""


@query
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import sharding

    done = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


ORACLES["op8_shards"] = """
with recursive t as (
  select range as i, xor(range >> 8, 0) as z from range(256)),
bits as (
  select i, i::bigint as c, 0 as k from t
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by i) as tab from bits where k = 8),
d as (
  select doc_id, coalesce(text, '') as text, strlen(coalesce(text, ''))::bigint + 8 as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 3))::int as virtual_slot from documents),
crc as (
  select doc_id, size, virtual_slot, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(0, strlen(text)), lambda j: ('0x' || substr(hex(text), 2 * j + 1, 2))::bigint)),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from d, tab),
slots as (select virtual_slot, sum(size)::bigint as b, row_number() over (order by sum(size) desc, virtual_slot) as r from d group by 1),
deal as (
  select 0::bigint as r, list_transform(range(24), lambda x: 0::bigint) as loads, null::int as shard
  union all
  select s.r, list_transform(loads, lambda x, i: case when i = list_position(loads, list_min(loads)) then x + s.b else x end), (list_position(loads, list_min(loads)) - 1)::int
  from deal join slots s on s.r = deal.r + 1),
m as (select virtual_slot, shard from slots join deal using (r))
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by virtual_slot, doc_id nulls first, text_crc32, size) - 1 as slot,
  null::int as grown_shard, virtual_slot from crc join m using (virtual_slot)
"""


@query
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neighbours

    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


ORACLES["op2_suffix"] = """
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
w as (select doc_id, k, array_slice(b, k + 1, k + 50) as g from (select doc_id, b, unnest(range(0, n - 49)) as k from d where n >= 50)),
m as (select g, min(doc_id) as m from w group by g having min(doc_id) < max(doc_id)),
hit as (select w.doc_id, w.k from w join m using (g) where m.m < w.doc_id),
cut as (select doc_id, k, case when k <= lag(k) over (partition by doc_id order by k) + 50 then 0 else 1 end as fresh from hit),
span as (select doc_id, min(k) as a, max(k) + 50 as e from (select doc_id, k, sum(fresh) over (partition by doc_id order by k) as s from cut) group by doc_id, s),
gap as (
  select doc_id, coalesce(lag(e) over (partition by doc_id order by a), 0) as a, a as e from span
  union all select doc_id, max(e), any_value(n) from span join d using (doc_id) group by doc_id),
kept as (select doc_id, string_agg(hex(array_slice(b, gap.a + 1, gap.e)), '' order by gap.a) as h from gap join d using (doc_id) group by doc_id),
r as (select doc_id, sum(e - a)::bigint as n_removed, count(*)::bigint as n_spans from span group by doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(case when h is null then b else unhex(h) end) as kept_sha256
from d left join r using (doc_id) left join kept using (doc_id)
"""
