"""Queries of the corpus operators over the given tables, and SQL that checks those SQL can express."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylog.llm import (
    byte_bpe, chat_format, dart_minhash, decontaminate, host_rules, html_extract, kd_shards, language_id, periodic_runs, quality_gam,
    ranked_search, toxicity_crf, url_automaton,
)


RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.read_vocabulary(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return made.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_crf.score_toxicity(docs, toxicity_crf.train(docs, table(spark, sf_dir, "labels")))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_automaton.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host_rate")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decoded=True))


def token_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(table(spark, sf_dir, "documents"), shards=16)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score_quality(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def planted_periods(ids: list, counts: np.ndarray) -> np.ndarray:
    """For every word the place of the word to stand there: the tails of some texts, by their ids, get a period.

    A null id plants nothing.
    """
    begin = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(begin, counts)
    for i, (doc_id, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            tail = g % n
            p = 1 + (n - tail) // (3 + g % 8)
            place[begin[i] + tail : begin[i] + n] = tail + np.arange(n - tail) % p
    return place


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"), planted_periods)


PLANTED_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(PLANTED_TURNS, "conv_id bigint, turn bigint, role string, text string"))
    formatted = chat_format.format_turns(turns, vocabulary())
    return chat_format.conversation_digests(chat_format.read_back(formatted, vocabulary()))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_toxicity, op3_minhash_near_dedup, op4_url_filters, op5_quality_rules, op6_language_id,
        op7_byte_bpe, op8_decontamination, op9_sharding, op10_quality_classifier,
        op11_ranked_search, op12_periodic_runs, op13_chat_format,
    )
}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_OWN = "|".join(
    f"{before}{word}{after}"
    for word in ("casino", "poker", "pills", "porn", "xxx", "viagra", "warez", "torrent")
    for before, after in ((r"^([^/]*)\.", r"\.[^/]*/"), (r"^([^/]*)\.", r"-[^/]*/"), ("^[^/]*-", r"\.[^/]*/"), ("^[^/]*-", "-[^/]*/"))
)



def _escaped(column: str) -> str:
    inner = "|".join(c[1:-1] for c in chat_format.CONTROLS if c[0] == "[")
    return (
        rf"regexp_replace(regexp_replace({column}, '<(\\*/s>)', '<\\\1', 'g'), '\[(\\*(?:{inner})\])', '[\\\1', 'g')"
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = {
    "op4_url_filters": f"""
        with parts as (
            select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        named as (
            select page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from parts),
        rules(host, path, verdict) as (
            values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits as (
            select n.page_id, r.host || r.path as rule, r.verdict,
                row_number() over (partition by n.page_id order by length(r.host || r.path) desc, r.verdict desc) as place
            from named n join rules r on (n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path))
        select n.page_id, n.host, n.path, f.rule,
            coalesce(f.verdict, case when regexp_matches('.' || n.host || case when n.path = '' and n.host <> '' then '/' else n.path end, '(?s){_OWN}') then 'block' else 'allow' end) as verdict
        from named n left join fits f on f.page_id = n.page_id and f.place = 1
    """,
    "op5_quality_rules": f"""
        with split as (
            select doc_id, source as host, coalesce(text, '') as text, {_WORDS} as words,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
            from documents),
        windows as (
            select doc_id, i, row(words[i], words[i + 1], words[i + 2]) as w
            from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from split where len(words) >= 3)),
        repeated as (
            select doc_id, i, i - lag(i) over (partition by doc_id order by i) as gap
            from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
        covered as (select doc_id, sum(least(3, coalesce(gap, 3))) as n_repeat_words from repeated group by doc_id),
        counts as (
            select s.doc_id, host, len(words)::bigint as n_words,
                length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
                (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words
            from split s left join covered c using (doc_id)),
        judged as (select *, (n_words < {host_rules.MIN_WORDS} or 100 * n_repeat_words > {host_rules.REPEAT_PERCENT} * n_words) as base_failed from counts),
        rates as (select host, count(*) as n, sum(base_failed::int) as failed from judged where host is not null group by host),
        spread as (select coalesce(avg(failed / n), 0) as mean, coalesce(var_pop(failed / n), 0) as var from rates),
        prior as (
            select mean, least(greatest(case when var > 0 then mean * (1 - mean) / var - 1 else 1e6 end, 1), 1e6) as strength from spread),
        verdicts as (select host, (failed + mean * strength) / (n + strength) as rate from rates, prior)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            (not base_failed and coalesce(rate, 0) <= {host_rules.HOST_LIMIT}) as kept
        from judged left join verdicts using (host)
    """,
    "op11_ranked_search": f"""
        with asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
        texts as (select row_number() over () as row_no, doc_id, {_TERMS} as terms from documents),
        corpus as (select count(*) as n_docs, sum(len(terms)) as n_terms from texts where len(terms) > 0),
        postings as (
            select row_no, doc_id, n, term, count(*) as tf
            from (select row_no, doc_id, len(terms) as n, unnest(terms) as term from texts) group by all),
        weights as (
            select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint as w
            from (select term, count(*) as df from postings group by term), corpus),
        scores as (
            select item_id, row_no, doc_id,
                sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs::bigint) // n_terms::bigint))))::bigint as score
            from asked join postings using (term) join weights using (term), corpus group by item_id, row_no, doc_id),
        placed as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
            from scores where score > 0)
        select item_id, rank, doc_id, score from placed where rank <= 50
    """,
    "op13_chat_format": f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all values {", ".join(str(row) for row in PLANTED_TURNS)}),
        escaped as (
            select *, {_escaped("text")} as safe_text, {_escaped("role")} as safe_role, role = 'assistant' as scored from turns)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            sum(case when scored then length(text) else 0 end)::bigint as loss_chars,
            sha256(string_agg(case when scored then text else '' end, '' order by turn nulls first, role, text)) as loss_sha256,
            sum(length(safe_text) + case role
                when 'assistant' then length('</s>') when 'user' then length('[INST][/INST]') when 'system' then length('[SYS][/SYS]')
                else length('[TURN][SAYS][/TURN]') + length(safe_role) end)::bigint as formatted_chars
        from escaped group by conv_id
    """,
}
