"""The registered query of each operator, with its production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import ann, audit, bestfit, bpe, langid, lm, packing, pii, simhash, spelling, substring, syncmers, toxicity
from gridmill.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


#: For the registered queries only, where the session names no key of its own in ``spark.gridmill.surrogateKey``.
PUBLIC_KEY = "public demonstration key"


def surrogate_key(spark: SparkSession) -> bytes:
    return spark.conf.get("spark.gridmill.surrogateKey", PUBLIC_KEY).encode()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.byte_bpe_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"), size=13)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), radius=2, width=3)


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), surrogate_key(spark))


def pii_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.check_collisions(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, end_id=0, longest=1024, special=ADDED)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, every=199)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, end_id=0, longest=2048, special=ADDED)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_syncmers, op3_substring_dedup, op4_simhash, op5_suffix_tree_lm, op6_graph_ann, op7_pii_surrogates, op8_language_id, op9_packing, op10_toxicity, op11_filter_audit, op12_spelling_variants, op13_best_fit, pii_collisions)}
#: What SQL can say on whole tables (the crc32 of a run is made of shifts there). The others need merges by rank, XXH64, a learned model or a graph; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words)
), firsts as (select s, min(doc_id) as first from windows group by s
), gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (s) where first < doc_id
), marked as (select doc_id, list(p) as ps, count(*) as n from gone group by doc_id
) select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
  from words left join marked using (doc_id)""",
    "op11_filter_audit": r"""
with docs as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), firsts as (select t, min(doc_id) as first from docs group by t
), said as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id
), fails as (
  select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad, [x.l for x in [
    {'l': 'A', 'f': len(w) < 200}, {'l': 'B', 'f': 100 * len(list_distinct(w)) < 50 * len(w)}, {'l': 'C', 'f': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)},
    {'l': 'D', 'f': regexp_matches(t, '[#$%&*|]')}, {'l': 'E', 'f': docs.doc_id > first}] if x.f] as failed
  from docs join firsts using (t) left join said using (doc_id)
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
  select [a.l, b.l, c.l, d.l, e.l] as o from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), groups as (select part, failed, count(*) as n, sum(good) as good, sum(bad) as bad from fails group by part, failed
), steps as (
  select part, failed, n, good, bad, array_to_string(o, '') as filter_order, step, o[step] as own, list_has_any(o[:step - 1], failed) as early, list_contains(failed, o[step]) as hit
  from groups, orders, (select unnest([1, 2, 3, 4, 5]) as step)
), counts as (
  select part, filter_order, step, own, sum(case when not early and not hit then n else 0 end) as kept, sum(case when hit and not early then n else 0 end) as removed,
    sum(case when hit and early then n else 0 end) as redundant, sum(case when hit and len(failed) = 1 then n else 0 end) as unique_fails,
    sum(case when hit and not early then good else 0 end) as good_lost, sum(case when hit and not early then bad else 0 end) as toxic_lost
  from steps group by part, filter_order, step, own
) select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from counts""",
    "op12_spelling_variants": r"""
with recursive bits as (select i, 0 as k, i as c from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8
), crc as (select list(c order by i) as t from bits where k = 8
), runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents
), counted as (select doc_id, w, count(*) as n, hex(coalesce(doc_id::varchar, '') || ':' || w) as x from runs where length(w) >= 6 group by doc_id, w
), bytes as (select w, n, list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) as b from counted
), hashed as (select w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) as h from bytes, crc
), damaged as (select case when h % 199 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from hashed
), words as (select word, sum(n)::bigint as n from damaged where length(word) >= 6 group by word having sum(n) >= 5
), cuts as (select word, n, p, substr(word, 1, p - 1) as head, substr(word, p + 1) as tail from (select word, n, unnest(range(1, length(word) + 1)) as p from words)
), near as (
  select a.word, b.word as other, b.n as other_n from cuts a join cuts b using (p, head, tail) where a.word <> b.word
  union select a.word, b.word, b.n from cuts a join words b on b.word = a.head || a.tail
  union select b.word, a.word, a.n from cuts a join words b on b.word = a.head || a.tail
), best as (select word, count(*) as n_near, arg_min({'w': other, 'n': other_n}, (-other_n, other)) as top from near group by word
), formed as (select word, n, coalesce(n_near, 0) as n_near, case when top.n >= 5 * n then top.w end as form, case when top.n >= 5 * n then top.n end as form_n from words left join best using (word)
), chain as (select word, form as root, 1 as d from formed where form is not null union all select chain.word, f.form, d + 1 from chain join formed f on f.word = chain.root where f.form is not null
), roots as (select word, arg_max(root, d) as root from chain group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from formed left join roots using (word)""",
}
