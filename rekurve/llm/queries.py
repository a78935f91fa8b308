"""The queries ``opN_...``: each maps the given tables to its operator's records and the results back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rekurve.llm import bpe, language, lz_fingerprints, merkle, packing, sharding, simhash, state_tree, subspace, tight_packing, token_counts, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    return lambda f: QUERIES.setdefault(name, f)


def notes(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """The documents as experiments with a description."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.col("doc_id").alias("experiment_id"), F.col("text").alias("description"), *more)


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    d = simhash.near_duplicate_notes(notes(spark, sf))
    return d.select(F.col("experiment_id").alias("doc_id"), hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op10_embedding_near_dedup")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    cells = e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("features"), F.col("label").alias("condition"))
    return subspace.near_duplicate_cells(cells).withColumnRenamed("cell_id", "vec_id")


#: Fixed by the contract: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op2_url_filters")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])
    rules = spark.range(1).select(F.inline(rows))
    return url_rules.judge_pages(spark.read.parquet(f"{sf}/pages.parquet"), rules)


ORACLES["op2_url_filters"] = """
with u as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages
), p as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from u
), r as (
  select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, x, v)
), hit as (
  select p.*, (select max_by(struct_pack(rule := h || x, verdict := v), length(h || x)) from r
               where (host = h or ends_with(host, '.' || h)) and starts_with(path, x)) as best from p
)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from hit
"""


@query("op3_sharding")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    files = d.select(F.col("doc_id").alias("file_id"), F.col("text").alias("raw_data_json"))
    return sharding.shard_files(files).withColumnsRenamed({"file_id": "doc_id", "raw_crc32": "text_crc32"})


@query("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    d = language.note_languages(notes(spark, sf, F.col("lang").alias("language")))
    return d.select(F.col("experiment_id").alias("doc_id"), "held_out", F.col("language").alias("lang_pred"), "score")


@query("op4_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    d = token_counts.count_note_tokens(notes(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return d.withColumnRenamed("experiment_id", "doc_id")


@query("op6_bpe_encoding")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    d = bpe.note_digests(notes(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return d.withColumnRenamed("experiment_id", "doc_id")


@query("op7_packing")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    d = packing.pack_notes(notes(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return d.withColumnsRenamed({"experiment_id": "doc_id", "note_tokens": "doc_tokens"})


@query("op9_lz_fingerprints")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return lz_fingerprints.note_fingerprints(notes(spark, sf)).withColumnRenamed("experiment_id", "doc_id")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("experiment_id"), "toxic")


@query("op5_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    d = toxicity.toxic_notes(notes(spark, sf, F.col("lang").alias("language")), reviews(spark, sf))
    return d.withColumnRenamed("experiment_id", "doc_id")


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return tight_packing.pack_tightly(notes(spark, sf), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("experiment_id", "doc_id")


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query("op12_merkle_manifest")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select(FIELDS)
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claim = merkle.leaf_digest(*[altered if c == "n_chars" else F.col(c) for c in FIELDS])
    m = merkle.file_manifest(d, FIELDS, "doc_id", "lang", claim)
    m = m.select(F.col("file_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), merkle.folded(F.col("claim"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of the digits of a number, a byte and its eight shifts at a time.
CRC32 = "xor(list_reduce(list_concat([4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split({0}::varchar, '')])), lambda h, x: case when x >= 0 then xor(h, x) else xor(h >> 1, 3988292384 * (h & 1)) end), 4294967295)"
_PARTS = ["coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')".format(c) for c in FIELDS]
_TREE = """
  select {by}, pos, n, digest, 0 as level from {base}
  union all
  select {by}, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' order by pos)), any_value(level) + 1
  from {name} where n > 1 group by {by}, pos // 2"""
_SIDES = """
  select {key}, t.level, case when s.pos < t.pos then s.digest end as l, case when s.pos > t.pos then s.digest end as r
  from {base} b join {name} t on {same} and t.pos = b.pos >> t.level and t.n > 1 left join {name} s on {sibling} and s.level = t.level and s.pos = xor(t.pos, 1)"""
ORACLES["op12_merkle_manifest"] = f"""
with recursive leaf as (
  select doc_id, lang, sha256({' || '.join(_PARTS)}) as digest,
         sha256({' || '.join(_PARTS).replace('n_chars', f"(n_chars + case when {CRC32.format('doc_id')} % 7 = 0 then 1 else 0 end)")}) as claim
  from documents
), base as (
  select *, row_number() over (partition by lang order by doc_id nulls first, digest) - 1 as pos, count(*) over (partition by lang) as n, row_number() over () as id from leaf
), tree as ({_TREE.format(by='lang', base='base', name='tree')}
), top as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n, 0 as one from tree where n = 1
), crown as ({_TREE.format(by='one', base='top', name='crown')}
), steps as ({_SIDES.format(key='b.id', base='base', name='tree', same='t.lang is not distinct from b.lang', sibling='s.lang is not distinct from t.lang')}
  union all
  select d.id, 1000 + c.level, c.l, c.r from base d join ({_SIDES.format(key='b.lang', base='top', name='crown', same='true', sibling='true')}) c on c.lang is not distinct from d.lang
), proof as (
  select id, list({{'l': coalesce(l, ''), 'r': coalesce(r, '')}} order by level) as s from steps group by id
), fold as (
  select b.id, b.claim as node, coalesce(p.s, []) as s from base b left join proof p using (id)
  union all
  select id, sha256(s[1].l || node || s[1].r), s[2:] from fold where len(s) > 0
)
select b.doc_id, b.digest as leaf, t.digest as subroot, c.digest as root,
       sha256(coalesce(array_to_string(list_transform(p.s, lambda x: x.l || x.r), ''), '')) as proof_sha256, f.node as folded_root, f.node = c.digest as verified
from base b join top t on t.lang is not distinct from b.lang join crown c on c.n = 1 left join proof p using (id) join fold f on f.id = b.id and len(f.s) = 0
"""


@query("op13_conversation_trie")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumnsRenamed({"conv_id": "cell_id", "turn": "frame"})
    nodes = state_tree.with_digests(*state_tree.state_tree(*state_tree.families(state_tree.states(turns, state=("role", "text")))))
    names = {"cell_id": "conv_id", "parent_cell_id": "parent_conv_id", "n_cells": "n_convs", "saved_words": "saved_tokens"}
    return nodes.drop("ending").withColumnsRenamed(names)


ORACLES["op13_conversation_trie"] = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), named as (
  select conv_id, turn, md5(strlen(role) || ':' || role || strlen(text) || ':' || text) as name, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from said
), t as (
  select *, row_number() over (partition by conv_id order by turn nulls first, name) as pos from named
), c as (
  select conv_id, conv_id - conv_id % 20 as base, {CRC32.format('conv_id')} % 4 as h from (select distinct conv_id from t)
), k as (
  select c.*, (select count(*) from t where t.conv_id = c.base and t.pos <= c.h) as k from c
), built as (
  select k.conv_id, t.pos, t.name, t.words from k join t on t.conv_id = k.base and t.pos <= k.h
  union all
  select k.conv_id, k.k + t.pos - k.h, t.name, t.words from k join t on t.conv_id = k.conv_id and t.pos > k.h
), way as (
  select conv_id, pos as depth, words, string_agg(name, '') over (partition by conv_id order by pos) as prefix from built
  union all
  select conv_id, 0, 0, '' from c
), node as (
  select prefix, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from way group by prefix
), child as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from node s where s.depth = n.depth + 1 and s.prefix[:-33] = n.prefix) as n_children
  from node n left join node p on n.depth > 0 and p.prefix = n.prefix[:-33]
), sub as (
  select w.prefix, sum(case when n.n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((n.n_convs - 1) * n.words)::bigint as saved_tokens
  from child n join way w on w.conv_id = n.conv_id and w.depth <= n.depth group by 1
), ends as (
  select prefix, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as digest from (select conv_id, max_by(prefix, depth) as prefix from way group by 1) group by 1
)
select n.conv_id, n.depth::bigint as depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, coalesce(e.digest, sha256('')) as ends_sha256
from child n join sub s using (prefix) left join ends e using (prefix)
"""
