"""The operators' queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import embedding_dedup, filter_audit, html_extract, license_scan, mixing, packing, pieces, quality, simhash, substring_dedup, toxicity, url_filter, whitening
from stackloom.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rules_table(spark)).drop("url")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(digested(packing.token_pieces(table(spark, sf_dir, "documents"))))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fit = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", F.posexplode("whitened").alias("place", "whitened"), F.col("deviation").cast("long").alias("deviation"))
    explained = F.array(*map(F.lit, fit.explained.tolist())).cast("array<double>")
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(whitening.identity_error(rows)).cast("double").alias("identity_error"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter,
        op2_license_scan,
        op3_best_fit_packing,
        op4_source_mixing,
        op5_html_extract,
        op6_substring_dedup,
        op7_embedding_dedup,
        op8_quality_rules,
        op9_toxicity,
        op10_simhash_dedup,
        op11_filter_audit,
        op12_embedding_whitening,
        op13_sentencepiece,
    )
}

ORACLE_SQL = {
    "op1_url_filter": r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from rest),
judged as (
  select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from parts)
select page_id, host, path,
  case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
       when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
       when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule,
  case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'allow'
       when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'block'
       when (host = 'net' or ends_with(host, '.net')) and (starts_with(path, '/es/') or starts_with(path, '/fr/')) then 'block'
       else 'allow' end as verdict
from judged""",
    "op6_substring_dedup": r"""
with docs as (
  select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select k, s, array_to_string(words[s:s + 34], ' ') as w from (select k, words, unnest(range(1, len(words) - 33)) as s from docs where len(words) >= 35)),
repeated as (select w from windows group by w having count(*) > 1),
covered as (
  select distinct k, p from (select k, unnest(range(s, s + 35)) as p from windows where w in (select w from repeated))),
gone as (select k, count(*) as n, list(p) as ps from covered group by k),
kept as (
  select d.k, array_to_string(list(x.w order by x.p), ' ') as t
  from (select k, unnest(words) as w, unnest(range(1, len(words) + 1)) as p from docs) x join docs d using (k)
  where not exists (select 1 from covered c where c.k = x.k and c.p = x.p) group by d.k)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(g.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from docs d left join gone g using (k) left join kept using (k)""",
    "op11_filter_audit": r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    min(doc_id) over (partition by coalesce(text, '')) as least from documents),
marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
judged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    len(words) < 50 as fa, 100 * len(list_distinct(words)) < 65 * len(words) as fb,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as fc, regexp_matches(t, '[#$%&*|]') as fd,
    coalesce(d.doc_id > least, false) as fe from docs d left join marks m on m.doc_id = d.doc_id),
sets as (
  select part, (if(fa, 'A', '') || if(fb, 'B', '') || if(fc, 'C', '') || if(fd, 'D', '') || if(fe, 'E', '')) as failed,
    count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from judged group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, unnest(range(1, 6)) as step from orders),
outcomes as (
  select part, o as filter_order, step, substr(o, step, 1) as f, failed, n, good, toxic,
    translate(failed, substr(o, 1, step - 1), '') <> failed as before, contains(failed, substr(o, step, 1)) as fails
  from sets cross join steps),
sums as (
  select part, filter_order, step, f,
    sum(if(not before and not fails, n, 0)) as kept, sum(if(not before and fails, n, 0)) as removed,
    sum(if(before and fails, n, 0)) as redundant, sum(if(failed = f, n, 0)) as unique_fails,
    sum(if(not before and fails, good, 0)) as good_lost, sum(if(not before and fails, toxic, 0)) as toxic_lost
  from outcomes group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from sums""",
}
