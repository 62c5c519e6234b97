"""The jobs as queries: each runs twice into one new folder, and the output as it then stands is the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.session import shared_folder
from jobs.bin_arrivals import bin_arrivals
from jobs.split_families import split_families


def new_folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"


def job1_bin_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents binned as they arrive, by 2-mers against the benchmark's passages; the second run finds nothing new."""
    path = new_folder(spark, "bin-arrivals")
    for _ in range(2):
        out = bin_arrivals(spark, f"{sf_dir}/{{documents.parquet}}", f"{sf_dir}/benchmark.parquet", f"{path}/output", f"{path}/checkpoint")
    return out


def job2_split_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to families by the first words of the benchmark's passages."""
    path = new_folder(spark, "split-families")
    for _ in range(2):
        out = split_families(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", path)
    return out.select("doc_id", "lang", "source", "place", "family", F.length("text").alias("letters"))


BIN_ARRIVALS = """with t as (select 'd' kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
 p as (select kind, id, unnest(a) x, generate_subscripts(a, 1) i from (select kind, id, string_split(translate(text, 'acgt', 'ACGT'), '') a from t)),
 w as (select kind, id, x || lead(x) over (partition by kind, id order by i) kmer from p),
 k as (select kind, id, kmer, count(*) n from w where regexp_full_match(kmer, '[ACGT]{2}') group by 1, 2, 3),
 f as (select kind, id, kmer, n / sum(n) over (partition by kind, id) freq from k),
 l as (select unnest(['A', 'C', 'G', 'T']) x), a as (select u.x || v.x kmer from l u, l v),
 s as (select g.kind, g.id, list(coalesce(freq, 0) order by a.kmer) v from (select distinct kind, id from f) g cross join a left join f on f.kind = g.kind and f.id = g.id and f.kmer = a.kmer group by 1, 2),
 m as (select d.id, cast(b.id as varchar) genus, round(list_sum(list_transform(list_zip(d.v, b.v), lambda z: abs(z[1] - z[2]))), 9) distance from s d, s b where d.kind = 'd' and b.kind = 'b'),
 r as (select *, row_number() over (partition by id order by distance, genus) rn, lead(distance) over (partition by id order by distance, genus) as second from m),
 y as (select id, genus, distance, distance <= 0.9 and case when distance = 0 and second = 0 then 0 else distance / second end <= 0.95 good from r where rn = 1)
 select doc_id, lang, cast(len(text) as bigint) length, round(case when len(text) > 0 then (len(text) - len(replace(replace(text, 'G', ''), 'C', ''))) / len(text) end, 9) gc, case when good then genus else 'not assigned' end genus, case when good then distance else -1.0 end distance
 from documents left join y on id = doc_id"""

SPLIT_FAMILIES = """with c as (select item_id, unnest(list_distinct(string_split(lower(array_to_string(string_split(text, ' ')[1:4], ' ')), ' '))) word, len(list_distinct(string_split(lower(array_to_string(string_split(text, ' ')[1:4], ' ')), ' '))) n from benchmark),
 x as (select doc_id, unnest(list_distinct(string_split(lower(text), ' '))) word from documents),
 m as (select doc_id, item_id from c join x on x.word = c.word group by doc_id, item_id, n having count(*) = n), f as (select doc_id, min(item_id) place from m group by 1)
 select d.doc_id, lang, source, place, 'F' || place family, cast(len(text) as int) letters from documents d join f on f.doc_id = d.doc_id"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_bin_arrivals": job1_bin_arrivals, "job2_split_families": job2_split_families}
ORACLE_SQL: dict[str, str] = {"job1_bin_arrivals": BIN_ARRIVALS, "job2_split_families": SPLIT_FAMILIES}
