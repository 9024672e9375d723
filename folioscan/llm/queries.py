"""The operators' queries: each over the whole of the tables that it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, html_lstm, langid, licenses, minhash, sharding, spm, substring, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_lstm.extract(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures_of(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.passages(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.intervals(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (op1_exact_dedup, op2_html_extraction, op3_sentencepiece, op4_sharding, op5_minhash_near_dedup, op6_warc, op7_language_id, op8_license_scan, op8_license_passages, op9_substring_dedup, op10_benchmark_decontamination)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"

ORACLES = {
    "op1_exact_dedup": """
        select doc_id, coalesce(min(doc_id) over w, doc_id) as keep_id, case when text is null then 1 else count(*) over w end as n_copies
        from documents window w as (partition by text)""",
    "op6_warc": """
        with bare as (
            select page_id, html, coalesce(url, '') as url, split_part(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#', 1) as rest from pages),
        cut as (select *, regexp_extract(rest, '^[^/?]*') as authority, regexp_replace(rest, '^[^/?]*', '') as path from bare),
        keyed as (
            select page_id, html, case when url = '' then '' else
                array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_replace(authority, ':[0-9]*$', ''), '^[wW]{3}[.]', '')), '.')), ',')
                || ')' || case when path = '' then '/' else path end end as url_key
            from cut)
        select page_id, url_key, count(*) over (partition by url_key) as n_captures, md5(coalesce(html, '')) as html_md5, cast(strlen(coalesce(html, '')) as bigint) as html_bytes
        from keyed""",
    "op8_license_scan": """
        with t(license, words) as (select license, string_split(words, ' ') from (values """
    + ", ".join(f"('{a}', '{b}')" for a, b in licenses.TEMPLATES)
    + """) as v(license, words)),
        tb as (select license, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as b from t),
        units as (
            select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents
            union all select doc_id, text, 0 from documents where contains(text, chr(10))),
        uw as (select doc_id, line_no, """
    + _WORDS.format("line")
    + """ as w from units),
        ub as (select doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as b from uw where len(w) >= 2),
        near as (
            select doc_id, line_no, license, 2.0 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) as dice
            from ub join tb on len(ub.b) <= len(tb.b) * 1.3 / 0.7 + 0.000001 and len(tb.b) <= len(ub.b) * 1.3 / 0.7 + 0.000001)
        select doc_id, cast(line_no as bigint) as line_no, license, round(max(dice), 6) as dice from near where dice >= 0.7 group by 1, 2, 3""",
    "op9_substring_dedup": """
        with w as (select doc_id, """
    + _WORDS.format("text")
    + """ as w from documents),
        win as (select doc_id, unnest(range(0, len(w) - 49)) as p, w from w where len(w) >= 50),
        h as (select doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) as h from win),
        again as (select h from h group by h having count(*) > 1),
        hit as (select doc_id, p from h join again using (h)),
        mark as (select *, case when p - lag(p) over (partition by doc_id order by p) <= 50 then 0 else 1 end as fresh from hit),
        isle as (select *, sum(fresh) over (partition by doc_id order by p) as g from mark)
        select doc_id, min(p) as start_token, max(p) + 50 as end_token from isle group by doc_id, g""",
}
