"""Queries of the corpus operators: each over its whole tables, with the operators' production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontamination, line_dedup, perplexity, quality, simhash, spelling, token_files, token_rollup, toxicity, url_filter, warc, whitening
from lodestone.llm.common import scratch, table, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.labels_of_pages(spark, pages, table(spark, sf_dir, "labels")))


def url_given_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_url_filter gives before any mined rule: host, path and the given rule of each url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame([], "url string, block boolean"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.token_digests(spark, path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the two tokenizers of op4 and op10.

    The counts of the word tokenizer are loaded without the end id that op4 writes and then revised to have it, over
    the whole table; copies are taken away by their revised counts, and the load is repeated.
    """
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "text")
    counted = token_rollup.tokenizer_counts(docs, public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    lean = written(counted, "token-counts")  # each text is encoded once
    return _rolled_up(spark, lean, {"word_bpe_49k": F.col("word"), "byte_bpe_multi_50k": F.col("byte")}, {"word_bpe_49k": F.col("word") + 1})


def rollup_of_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of op5_token_counts with counters of bytes and words, which SQL has too, in place of tokenizers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counters = {"bytes-1": F.octet_length(text), "words-1": F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))}
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lean = docs.select("doc_id", "source", "lang", F.sha2(text.cast("binary"), 256).alias("digest"), *(c.alias(k) for k, c in counters.items()), F.regexp_count(text, F.lit("[A-Za-z]+|[0-9]+")).alias("words-2"))
    return _rolled_up(spark, lean, {k: F.col(f"`{k}`") for k in counters} | {"words-2": F.col("`words-1`")}, {"words-2": F.col("`words-2`")})


def _rolled_up(spark: SparkSession, lean: DataFrame, before: dict, after: dict) -> DataFrame:
    """All rows by the counts before; those of after in their place, under the same keys; the copies taken away; the load again."""
    # A table of its own, so that the join has a shuffle of its own that Spark can split where a digest is frequent.
    first = written(lean.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-of-digest")
    copies = lean.join(first, "digest").where("doc_id > first")
    load = token_rollup.inserts(lean, before)
    revised = token_rollup.revisions(lean, {k: before[k] for k in after}, after)
    return token_rollup.replay(token_rollup.TokenRollup(spark), [("load", load), ("revised", revised), ("copies", token_rollup.deletes(copies, before | after)), ("load", load)])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), drop=97)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_url_filter, url_given_rules, op4_token_files, op5_token_counts, rollup_of_counters, op6_quality_rules, op7_warc, op8_decontamination, op9_line_dedup, op10_byte_bpe, op11_spelling, op12_toxicity, op13_whitening, pipeline)}

_A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANK = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

ORACLE_SQL = {
    "url_given_rules": rf"""
        with u as (
            select page_id, translate(regexp_extract(coalesce(url, ''), '^(.*?)://([^/?#]*)', 2, 's'), {_A_TO_Z}) as host, regexp_extract(coalesce(url, ''), '^(.*?)://[^/?#]*([^?#]*)', 2, 's') as path from pages
        ), r as (
            select * from (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) t(rule, on_host, on_path, verdict)
        ), m as (
            select page_id, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from u join r on (host = on_host or ends_with(host, '.' || on_host)) and starts_with(path, on_path) group by 1
        )
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join m using (page_id)""",
    "rollup_of_counters": r"""
        with d as (
            select doc_id, source, lang, coalesce(text, '') t, min(doc_id) over (partition by coalesce(text, '')) as first from documents
        ), c as (
            select source, lang, doc_id = first as keep, 'bytes-1' as tokenizer, strlen(t) as n from d
            union all select source, lang, doc_id = first, 'words-1', len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) from d
            union all select source, lang, doc_id = first, 'words-2', len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+')) from d
        )
        select source, lang, tokenizer, count(*)::bigint as n_docs, sum(n)::bigint as n_tokens from c where keep group by 1, 2, 3""",
    "op7_warc": """
        with p as (
            select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages
        ), q as (
            select page_id, payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as last from p
        )
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
            case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
        from q""",
    "op8_decontamination": rf"""
        with d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents
        ), b as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from benchmark
        ), win as (
            select distinct item_id, array_to_string(list_slice(w, i + 1, i + least(len(w), 10)), ' ') as win, least(len(w), 10) as size
            from (select item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
        ), sizes as (
            select distinct size from win
        ), places as (
            select doc_id, size, unnest(range(0, greatest(len(w) - size + 1, 0))) as i, w from d, sizes
        ), hit as (
            select doc_id, i, a.size, win from (select doc_id, i, size, array_to_string(list_slice(w, i + 1, i + size), ' ') as win from places) a
            semi join win using (win)
        ), covered as (
            select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + size)) as k from hit) group by 1
        ), items as (
            select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
            from (select distinct doc_id, item_id from hit join win using (win)) group by 1
        )
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
            sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join covered using (doc_id) left join items using (doc_id)""",
    "op9_line_dedup": rf"""
        with l as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
        ), k as (
            select doc_id, pos, line, translate(trim(line, {_BLANK}), {_A_TO_Z}) as key from l
        ), m as (
            select doc_id, pos, line, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as gone from k
        )
        select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op11_spelling": rf"""
        with recursive step as (
            select i, i::bigint as c, 0 as k from range(256) t(i) union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8
        ), crc as (
            select list(c order by i) as tab from step where k = 8
        ), runs as (
            select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_A_TO_Z}), '[a-z\x{{C0}}-\x{{FF}}]+')) as w from documents
        ), own as (
            select doc_id, w, count(*) as k from runs group by 1, 2
        ), codes as (
            select w, k, flatten(list_transform(string_split(doc_id::varchar || ':' || w, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)) as b from own
        ), h as (
            select w, k, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295::bigint) as h from codes, crc
        ), counts as (
            select case when h % 97 = 0 then left(w, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end as word, sum(k)::bigint as n from h group by 1
        ), words as (
            select word, n from counts where length(word) >= 5 and n >= 3
        ), dropped as (
            select word, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from words)
        ), near as (
            select a.word, b.word as other from dropped a join dropped b on a.i = b.i and a.rest = b.rest and a.word <> b.word
            union select d.word, w.word from dropped d join words w on d.rest = w.word
            union select w.word, d.word from dropped d join words w on d.rest = w.word
        ), best as (
            select near.word, count(*) as n_near, max(n) as m, min(struct_pack(less := -n, other := other)).other as other from near join words w on w.word = other group by 1
        ), forms as (
            select word, n, coalesce(n_near, 0)::bigint as n_near, case when m >= 2 * n then other end as form, case when m >= 2 * n then m end as form_n from words left join best using (word)
        ), way as (
            select word, form as goal from forms where form is not null union all select way.word, f.form from way join forms f on f.word = goal where f.form is not null
        ), last as (
            select way.word, goal from way join forms f on f.word = goal where f.form is null
        )
        select word, form, coalesce(goal, word) as root, n, n_near, form_n from forms left join last using (word)""",
}
