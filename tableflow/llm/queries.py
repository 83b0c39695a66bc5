"""The numbered operators over their whole tables, and SQL statements where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.llm import (
    bpe, decontamination, filter_audit, jaccard_join, licenses, main_text, quality, sharding, ship, substring_dedup, suffix_dedup, topk, warc, whitening
)
from tableflow.workspace import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = " ".join(sql.split())
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    ids = bpe.encode(documents, "text", VOCABULARY, public_tokenizers.PATTERN, packed=True, decoded=True, keep=["doc_id"])
    return ids.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.shard_documents(documents, "doc_id", "text", sharding.tree(40), sharding.grown(sharding.tree(40)))


@query()
def op8_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"), "text", keep=["doc_id"])


_B32 = "list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(h), 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31), 1))"


@query(
    f"""
    with p as (select page_id, coalesce(html, '') h from pages),
    f as (select page_id, strlen(h)::bigint payload_bytes, array_to_string({_B32}, '') payload_digest, min(page_id) over (partition by h) first from p)
    select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end record_type,
        case when page_id <> first then first end refers_to from f
    """
)
def op6_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    index = warc.write_archives(pages, "page_id", "url", "html", new_folder(spark, "warc"))
    return warc.read_records(index).select(
        F.col("key").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query(
    f"""
    with d as (select doc_id, {_ITEM_WORDS} w from documents),
    b as (select item_id, {_ITEM_WORDS} w from benchmark),
    bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') k from
           (select item_id, w, least(13, len(w)) n, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)),
    dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k from
           (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from bw))),
    h as (select doc_id, i, dw.n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
    c as (select doc_id, count(*) n_hit from (select distinct doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from h)) group by 1),
    t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s from h group by 1)
    select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
        sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
    from d left join c using (doc_id) left join t using (doc_id)
    """
)
def op1_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    benchmark = table(spark, folder, "benchmark").select("item_id", "text")
    hits = decontamination.benchmark_hits(documents, "text", benchmark, "item_id", "text", keep=["doc_id"])
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


@query()
def op4_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(documents, "doc_id", "text", table(spark, folder, "labels"), "quality")
    return quality.score(documents, "text", model, keep=["doc_id"]).select(
        "doc_id", (quality.remainder("doc_id") == 1).alias("held_out"), "score", "predicted"
    )


_LOWER_WORDS = _PLAIN_WORDS.replace("coalesce(text, '')", _LOWERED)


@query(
    f"""
    with recursive d as (select doc_id, {_LOWER_WORDS} w from documents),
    s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') k from
          (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) i from d where len(w) > 0)),
    n as (select doc_id, count(*) n from s group by 1),
    o as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
    e as (select a, b from o join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 85 * (x.n + y.n - shared)),
    l as (select a, b from e union all select b, a from e),
    r as (select doc_id, doc_id as other from d union select r.doc_id, l.b from r join l on r.other = l.a)
    select d.doc_id, coalesce(n, 0)::bigint n_shingles, min(other) component_id from d left join n using (doc_id) join r using (doc_id)
    group by d.doc_id, n
    """
)
def op10_jaccard_tiles(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = jaccard_join.set_components(documents, "doc_id", "text")
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@query()
def op3_suffix_sort(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(documents, "doc_id", "text", ["doc_id"], with_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(
    f"""
    with d as (select doc_id, {_PLAIN_WORDS} w from documents),
    dw as (select doc_id, i, array_to_string(w[i:i + 12], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d)),
    m as (select doc_id, i, min(doc_id) over (partition by k) first from dw),
    g as (select distinct doc_id, unnest(range(i, i + 13)) p from m where first < doc_id),
    u as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
    k as (select u.doc_id, count(g.p) n_removed, string_agg(word, ' ' order by u.p) filter (where g.p is null) kept
          from u left join g on u.doc_id = g.doc_id and u.p = g.p group by 1)
    select d.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
    from d left join k using (doc_id)
    """
)
def op2_suffix_automata(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    cut = substring_dedup.remove_earlier(documents, "doc_id", "text", ["doc_id"], with_text=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
               where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint score
          from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
    select query_id, rank, vec_id, score from r where rank <= 5
    """
)
def op5_no_random_access(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5)


@query()
def op11_block_crf(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return main_text.extract(pages, "html", keep=["page_id", "url"])


@query()
def op12_lanczos(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")


@query(
    r"""
    with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by t) first from d),
    f as (select doc_id, part, [(len(ws) < 200)::int, (100 * len(list_distinct(ws)) < 50 * len(ws))::int,
        (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::int,
        regexp_matches(t, '[#$%&*|]')::int, coalesce(first < doc_id, false)::int] m from w),
    l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
    c as (select part, m, count(*) n, sum(coalesce(good, 0)) good, sum(coalesce(toxic, 0)) toxic from f left join l using (doc_id) group by 1, 2),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) k),
    o as (select a.k || b.k || c.k || d.k || e.k filter_order from x a join x b on b.k <> a.k join x c on c.k not in (a.k, b.k)
        join x d on d.k not in (a.k, b.k, c.k) join x e on e.k not in (a.k, b.k, c.k, d.k)),
    s as (select filter_order, unnest(range(1, 6))::int step from o),
    r as (select part, filter_order, step, n, good, toxic, list_sum(m) failing, m[instr('ABCDE', filter_order[step])] here,
        coalesce(list_sum(list_transform(range(1, step), lambda i: m[instr('ABCDE', filter_order[i])])), 0) earlier from c, s),
    g as (select part, filter_order, step, sum(case when here + earlier = 0 then n else 0 end) kept, sum(case when here = 1 and earlier = 0 then n else 0 end) removed,
        sum(case when here = 1 and earlier > 0 then n else 0 end) redundant, sum(case when here = 1 and failing = 1 then n else 0 end) unique_fails,
        sum(case when here = 1 and earlier = 0 then good else 0 end) good_lost, sum(case when here = 1 and earlier = 0 then toxic else 0 end) toxic_lost from r group by 1, 2, 3)
    select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
        good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, filter_order[step]))::bigint shapley from g
    """
)
def op13_radix_tries(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(documents, "doc_id", "text", "lang", table(spark, folder, "labels"))
