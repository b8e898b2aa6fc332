"""One registered query per operator, on the whole of its table, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import (
    chat,
    collocations,
    decontaminate,
    jaccard,
    langid,
    lm,
    merkle,
    mixing,
    pii,
    sharding,
    tokens,
    topk,
    warc,
)
from flowloom.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LANGUAGE_FOLDS, MODEL_FOLDS = 5, 10
#: Wanted shares of tokens per domain.
SHARDS = 40
TARGETS = {"good": 0.85, "low": 0.15, "toxic": 0.0}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def crawl_records(pages: DataFrame) -> DataFrame:
    """Four visits to each page as archive records: responses, revisits and an error.

    Which visit answers what follows from the page number, so that every outcome occurs.
    """
    page, visit = F.col("page_id"), F.col("visit")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), (page % 28).cast("string"))
    full = ((visit == 0) & (page % 7 != 3)) | ((visit == 2) & (page % 4 == 1))
    error = (visit == 2) & (page % 4 == 0)
    response = F.create_map(
        F.lit("Content-Type"),
        F.lit("text/html"),
        F.lit("Content-Length"),
        F.length("html").cast("string"),
        F.lit("ETag"),
        F.when(visit == 2, F.concat(F.lit('"second-'), page.cast("string"), F.lit('"'))).otherwise(tag),
        F.lit("Last-Modified"),
        day,
        F.lit("Cache-Control"),
        F.lit("max-age=60"),
    )
    by_tag = F.create_map(
        F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("cache-control"), F.lit("max-age=120"),
        F.lit("content-length"), F.lit("0"), F.lit("Server"), F.lit("edge"),
    )
    by_date = F.create_map(
        F.lit("Last-Modified"), F.when(page % 5 == 0, F.lit("day x")).otherwise(day), F.lit("Date"), F.lit("now")
    )
    none = F.create_map(F.lit("Date"), F.lit("now"))
    headers = (
        F.when(full | error, response).when(visit == 2, by_date).when((visit == 3) & (page % 11 == 0), none).otherwise(by_tag)
    )
    return pages.withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        (page * 4 + visit).alias("record_id"),
        "url",
        (F.lit(1_500_000_000) + (page * 7919) % 1_000_000 + visit * 86_400).cast("bigint").alias("ts"),
        F.when(full | error, "response").otherwise("revisit").alias("kind"),
        F.when(full, 200).when(error, 404).otherwise(304).alias("status"),
        headers.alias("headers"),
        F.when(full, F.md5("html")).when((visit == 3) & (page % 13 == 0), F.md5(F.lit("other"))).alias("digest"),
    )


@query(
    "op1_revisits",
    r"""
with visits as (select page_id p, url, html, unnest([0, 1, 2, 3]) v from pages),
flags as (select *, (v = 0 and p % 7 <> 3) or (v = 2 and p % 4 = 1) is_full, v = 2 and p % 4 = 0 is_error,
    '"' || md5(html)[1:12] || '"' tag, 'day ' || (p % 28) d from visits),
bare as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') u from flags),
cut as (select *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^.*@', '')),
    ':(80|443)$', ''), '^(www[0-9]*|m)\.', '') host,
  regexp_replace(regexp_extract(u, '^[^/?]*(/[^?]*)', 1), '/+$', '') path,
  list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
    lambda a: a <> '' and not regexp_matches(a, '^(?i:utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) args from bare),
rec as (select p * 4 + v as record_id, host || path || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end url_key,
  1500000000 + (p * 7919) % 1000000 + v * 86400 ts, is_full, is_full or is_error as answered,
  case when is_full then md5(html) when v = 3 and p % 13 = 0 then md5('other') end digest,
  case when is_full or is_error then case when v = 2 then '"second-' || p || '"' else tag end
       when v = 2 then null when v = 3 and p % 11 = 0 then null else 'W/' || tag end etag,
  case when is_full or is_error then d when v = 2 then case when p % 5 = 0 then 'day x' else d end end modified,
  case when is_full or is_error then 'max-age=60' when v = 2 then null when v = 3 and p % 11 = 0 then null else 'max-age=120' end cache,
  case when is_full or is_error then length(html)::varchar when v = 2 then null when v = 3 and p % 11 = 0 then null else '0' end size,
  case when is_full or is_error then 'text/html' end kind,
  case when is_full or is_error then null when v = 2 then null when v = 3 and p % 11 = 0 then null else 'edge' end server,
  case when is_full or is_error then null when v = 2 or (v = 3 and p % 11 = 0) then 'now' end at_date
  from cut),
joined as (select *, last_value(case when is_full then record_id end ignore nulls) over (
    partition by url_key order by ts, record_id rows between unbounded preceding and 1 preceding) hit from rec),
paired as (select r.*, f.record_id f_id, f.ts f_ts, f.digest f_digest, f.etag f_etag, f.modified f_modified, f.cache f_cache,
    f.size f_size, f.kind f_kind
  from joined r left join rec f on f.record_id = r.hit where not r.answered),
judged as (select *, case when f_id is null then 'no_response'
    when digest <> f_digest then 'digest_differs'
    when etag is not null and f_etag is not null and regexp_replace(etag, '^W/', '') <> regexp_replace(f_etag, '^W/', '') then 'etag_differs'
    when (etag is null or f_etag is null) and modified is not null and f_modified is not null and modified <> f_modified then 'date_differs'
    when (etag is not null and f_etag is not null) or (modified is not null and f_modified is not null)
      or (digest is not null and f_digest is not null) then 'resolved'
    else 'unverified' end outcome from paired),
done as (select *, outcome in ('resolved', 'unverified') ok from judged)
select record_id, url_key, outcome, case when ok then f_id end response_id, case when ok then f_ts end response_ts,
  case when ok then f_digest end digest,
  array_to_string(list_filter([
    'cache-control=' || case when ok then coalesce(cache, f_cache) else cache end,
    'content-length=' || case when ok then f_size else size end,
    'content-type=' || case when ok then f_kind end,
    'date=' || at_date,
    'etag=' || case when ok then coalesce(etag, f_etag) else etag end,
    'last-modified=' || case when ok then coalesce(modified, f_modified) else modified end,
    'server=' || case when not ok then server end], lambda x: x is not null), ';') headers
from done""",
)
def revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    entries = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(F.sort_array(entries), ";"))


@query(
    "op2_near_duplicates",
    r"""
with recursive words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents),
places as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from words where len(w) > 0),
shingles as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') s from places),
sizes as (select doc_id, count(*) n from shingles group by 1),
common as (select a.doc_id a, b.doc_id b, count(*) c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c * 10 >= (x.n + y.n - c) * 8),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, links.b from reach join links on links.a = reach.r),
classes as (select doc_id, min(r) class_id from reach group by 1),
degree as (select a doc_id, count(*) n from links group by 1)
select c.doc_id, c.class_id, coalesce(n, 0) n_links from classes c left join degree using (doc_id)""",
)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def domains_of(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, domain) of labels with both marks."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")
    return labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select(
        "doc_id", domain.alias("domain")
    )


@query("op3_soft_mixing")
def soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = domains_of(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), labels, TARGETS)


@query("op4_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op5_bit_sliced_top_k",
    """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int "rank" from s)
select query_id, "rank", vec_id, score from r where "rank" <= 5""",
)
def bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = topk.build_index(vectors)
    return topk.top_k(vectors.filter(F.col("vec_id") % 50 == 0), index, k=5)


@query("op6_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op7_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~held_out("doc_id", LANGUAGE_FOLDS)))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", LANGUAGE_FOLDS).alias("held_out"), "lang_pred", "score")


@query("op8_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.personal_data(docs).drop("text")


@query(
    "op9_perspectives",
    r"""
with t as (select conv_id d, turn n, coalesce(role, 'unknown') s, coalesce(text, '') t, sha256(coalesce(text, '')) h
  from conversations where conv_id is not null),
p as (select distinct d, s as p from t where s <> 'system'),
l as (select d, p, n, s, h, regexp_replace(t, '<(\\*)\|', '<\\\1|', 'g') t, s = p own, case when s = 'system' then '<|system|>' || chr(10)
    when s = p then '<|assistant|>' || chr(10) else '<|user name=' || regexp_replace(regexp_replace(s, '<(\\*)\|', '<\\\1|', 'g'),
      '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) end head from t join p using (d)),
m as (select *, head || t || '<|end|>' || chr(10) line, length(head || t || '<|end|>' || chr(10)) size from l),
a as (select *, coalesce(sum(size) over (partition by d, p order by n, s, h
    rows between unbounded preceding and 1 preceding), 0)::bigint place from m),
g as (select d, p, place // 1000000 part, min(place) part_start from a group by all)
select d conv_id, p speaker, g.part, any_value(g.part_start) part_start, count(*) n_turns,
  string_agg(line, '' order by place) rendered,
  coalesce(string_agg(case when own then (place - g.part_start + length(head)) || ':' || (place - g.part_start + size - 1) end,
    ',' order by place), '') mask
from a join g using (d, p) where a.place // 1000000 = g.part group by d, p, g.part""",
)
def perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


@query("op10_language_model")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), folds=MODEL_FOLDS)


@query(
    "op11_collocations",
    r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from d),
words as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
sizes as (select lang, sum(len(w))::bigint n from words group by 1),
places as (select lang, w, unnest(range(1, len(w) + 1)) i from words),
grams as (select lang, w[i:i + k - 1] g from places, range(1, 6) t(k) where i + k - 1 <= len(w)),
counts as (select lang, g, count(*) c from grams group by 1, 2),
named as (select lang, array_to_string(g, ' ') phrase, len(g) k, g, c from counts),
found as (select * from named where k > 1 and c >= 100),
kept as (select * from found p where not exists (select 1 from found q where q.lang = p.lang and q.k > p.k
  and contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') and 100 * q.c >= 100 * p.c)),
cuts as (select p.lang, p.phrase, p.c a, j, f.c l, r.c r, n,
    ((1000::hugeint * p.c * n) // (f.c::hugeint * r.c))::bigint score
  from (select *, unnest(range(1, k)) j from kept) p
  join named f on f.lang = p.lang and f.g = p.g[1:j] join named r on r.lang = p.lang and r.g = p.g[j + 1:]
  join sizes s on s.lang = p.lang),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) "rank" from worst)
select lang, "rank", phrase, a, l, r, n, score from ranked where "rank" <= 2000""",
)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


#: Checksum of the bytes that list in hexadecimal digits, in DuckDB.
_CRC32 = """with tab as (select list(list_reduce(list_prepend(i::bigint, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) order by i) crc_of from range(256) r(i))"""
_CRC32_OF = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex({}), '..'), lambda h: ('0x' || h)::bigint)),
  lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295::bigint)"""


@query(
    "op12_merkle_manifest",
    _CRC32.replace("with", "with recursive", 1)
    + r""",
fields as (select doc_id, case when lang is null then '0' else '1' || lang end g, n_chars,
    case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
      || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end head,
    case when text is null then '-' else strlen(text) || ':' || text end tail,
    coalesce("""
    + _CRC32_OF.format("doc_id::varchar")
    + r""" % 7 = 0, false) tampered from documents, tab),
hashed as (select doc_id, g, sha256(head || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || tail) leaf,
    case when tampered and n_chars is not null
      then sha256(head || strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) || tail) end shown from fields),
leaves as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by g) n from hashed),
nodes as (select g, 0 lev, pos, n, leaf h from leaves
  union all select g, lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes where n > 1 group by all),
subs as (select g, h, row_number() over (order by g) - 1 pos, count(*) over () n from nodes where n = 1),
tops as (select 0 lev, pos, n, h from subs
  union all select lev + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from tops where n > 1 group by all),
all_nodes as (select g, lev, pos, n, h from nodes union all select '', lev, pos, n, h from tops),
step as (select x.g, x.lev, x.pos, case when y.h is null then '-' when x.pos % 2 = 0 then 'R' || y.h else 'L' || y.h end s
  from all_nodes x left join all_nodes y on x.g = y.g and x.lev = y.lev and y.pos = xor(x.pos, 1) where x.n > 1),
top_paths as (select g, list(s order by lev) filter (s is not null) path from (select subs.g, step.lev, step.s from subs
  left join step on step.g = '' and step.pos = subs.pos >> step.lev) group by 1),
leaf_paths as (select g, pos, list(s order by lev) filter (s is not null) path from (select leaves.g, leaves.pos, step.lev, step.s from leaves
  left join step on step.g = leaves.g and step.pos = leaves.pos >> step.lev) group by 1, 2),
proved as (select doc_id, leaf, shown, subs.h subroot, (select h from tops where n = 1) root,
    list_concat(coalesce(a.path, []), coalesce(b.path, [])) path
  from leaves join subs using (g) left join leaf_paths a on a.g = leaves.g and a.pos = leaves.pos left join top_paths b on b.g = leaves.g),
ends as (select *, list_reduce(list_prepend(coalesce(shown, leaf), path),
    lambda acc, s: sha256(case s[1] when 'L' then s[2:] || acc when 'R' then acc || s[2:] else acc end)) folded_root from proved)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s[2:]), '')) proof_sha256,
  folded_root, folded_root = root verified from ends""",
)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    n_chars = F.col("n_chars")
    return merkle.manifest(docs, leaf(n_chars), F.when(tampered & n_chars.isNotNull(), leaf(n_chars + 1)))


@query(
    "op13_balanced_shards",
    _CRC32
    + r""",
sized as (select doc_id, strlen(coalesce(text, ''))::bigint + 16 size, """
    + _CRC32_OF.format("coalesce(text, '')")
    + r""" text_crc32 from documents, tab),
placed as (select *, sum(size) over (order by doc_id nulls first, size, text_crc32 rows unbounded preceding) - size before,
    sum(size) over () whole from sized),
cut as (select *, ((before * 2 + size) * 40 // (whole * 2))::int shard from placed)
select doc_id, size, text_crc32, 'bytes' law, shard,
  row_number() over (partition by shard order by before, doc_id nulls first, size, text_crc32) - 1 slot, null::int grown_shard from cut""",
)
def balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)
