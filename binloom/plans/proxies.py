"""The engine's operators on the driver's tables, with the same results in DuckDB's SQL.

There are no sequences or hits among those tables, so others stand for them: line items of
an order for the hits of a scaffold's genes, nations for genera, part types for marker
families, documents for scaffolds, embeddings for spectra, user events for the rows that
describe a gene.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.functions import arrays, names, sequences
from binloom.functions.sequences import Kmers
from binloom.operators import assign, cluster, compare, descriptions, kmercount, labelspread, matrix, neighbours, relational, report, search, sparse
from binloom.operators.catalog import Database
from binloom.plans import binning
from binloom.schema import NOT_ASSIGNED
from binloom.session import new_folder, table
from binloom.sources import files, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def database(spark: SparkSession) -> Database:
    return Database(spark, new_folder(spark))


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Genus assignment: hits of scaffolds, sums, best genus, filter.


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = lines.select("l_orderkey", "l_suppkey", "l_extendedprice").join(suppliers.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("l_orderkey").alias("scaffold"), F.col("n_name").alias("genus"), F.col("l_extendedprice").alias("bits"))


HITS = """with h as (select l_orderkey scaffold, n_name genus, l_extendedprice bits from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
 t as (select scaffold, genus, sum(bits) bits from h group by scaffold, genus),
 b as (select scaffold, genus, bits from (select *, row_number() over (partition by scaffold order by bits desc, genus) rn from t) where rn = 1)
"""


@query(HITS + "select scaffold, genus, round(bits, 2) bits from (select *, count(*) over (partition by genus) n from b) where bits > 30 and n >= 2")
def genus_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.assign_genus(hits(spark, sf_dir), 30, 2).withColumn("bits", F.round("bits", 2))


@query(HITS + "select scaffold, genus, round(bits, 2) bits from t")
def bits_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.score_sums(hits(spark, sf_dir)).withColumn("bits", F.round("bits", 2))


@query(HITS + "select scaffold, genus, round(bits, 2) bits from b")
def genus_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.best_group(assign.score_sums(hits(spark, sf_dir))).withColumn("bits", F.round("bits", 2))


@query(HITS + "select scaffold, genus, round(bits, 2) bits from (select *, count(*) over (partition by genus) n from b) where bits > 90000 and n >= 590")
def assign_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that reject scaffolds by either rule."""
    return assign.assign_genus(hits(spark, sf_dir), 90000, 590).withColumn("bits", F.round("bits", 2))


@query(HITS + ", c as (select genus, count(*) n from b group by genus) select genus, n, count(*) over () genera from c")
def genus_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.genus_counts(assign.best_group(assign.score_sums(hits(spark, sf_dir))))


# Joins, updates and sets.


@query("select l_orderkey, l_partkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_type in ('PROMO', 'SMALL'))")
def marker_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = table(spark, sf_dir, "part").filter(F.col("p_type").isin("PROMO", "SMALL")).select(F.col("p_partkey").alias("l_partkey"))
    return relational.of_markers(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), markers, "l_partkey").select("l_orderkey", "l_partkey", "l_linenumber")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def unassigned_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unassigned(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("select c_custkey, c_name, coverage from customer left join (select o_custkey, max_by(o_totalprice, o_orderkey) coverage from orders group by 1) on o_custkey = c_custkey")
def coverage_left_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("coverage"), "o_orderkey")
    return relational.updated(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), values, "c_custkey", "coverage", "o_orderkey")


@query("select o_orderkey, o_orderpriority, l_partkey from orders join (select l_orderkey, min(l_partkey) l_partkey from lineitem group by 1 having count(*) = 1) on l_orderkey = o_orderkey")
def exactly_one_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return relational.exactly_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), lines, "o_orderkey")


@query("select d.doc_id, lang, coalesce(quality, -1) quality from documents d left join labels l on l.doc_id = d.doc_id")
def label_default_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.with_label(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("""with v as (select p_brand, n_name genus, sum(l_extendedprice) bits from part join lineitem on l_partkey = p_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2),
 b as (select p_brand, genus from (select *, row_number() over (partition by p_brand order by bits desc, genus) rn from v) where rn = 1)
 select p_partkey scaffold, part.p_brand as cluster, coalesce(genus, 'not assigned') genus from part left join b on b.p_brand = part.p_brand""")
def cluster_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    found = lines.join(parts.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    found = found.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("scaffold"), F.col("n_name").alias("genus"), F.col("l_extendedprice").alias("bits"))
    return assign.cluster_votes(parts.select(F.col("p_partkey").alias("scaffold"), F.col("p_brand").alias("cluster")), found)


@query("select c_custkey, case when c_acctbal > 5000 then c_mktsegment else 'not assigned' end genus from customer")
def prob_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", assign.relabelled(F.col("c_mktsegment"), F.col("c_acctbal"), 5000).alias("genus"))


@query("select n_regionkey, genus, n from (select *, row_number() over (partition by n_regionkey order by n desc, genus) rn from (select n_regionkey, string_split(p_name, ' ')[1] genus, count(*) n from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2)) where rn = 1")
def majority_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return assign.majority(rows, "n_regionkey", F.col("p_name"))


@query("select l_orderkey, min_by(string_split(p_name, ' ')[1], {'a': l_linenumber, 'b': l_partkey}) genus from lineitem join part on p_partkey = l_partkey group by 1")
def best_hit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(names.genus(F.min(F.struct("l_linenumber", "l_partkey", "p_name"))["p_name"]).alias("genus"))


@query("""with d as (select n_nationkey, 'gi|1| x [' || n_name || ' ' || r_name || ' str. 1] y [' || r_name || ' ' || n_name || ']' title from nation join region on r_regionkey = n_regionkey)
 select n_nationkey, list_transform(regexp_extract_all(title, '\\[.+?\\]'), lambda b: lower(array_to_string(string_split(trim(b, '[]'), ' ')[1:2], ' '))) organisms from d""")
def organism_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    title = F.concat(F.lit("gi|1| x ["), "n_name", F.lit(" "), "r_name", F.lit(" str. 1] y ["), "r_name", F.lit(" "), "n_name", F.lit("]"))
    return rows.select("n_nationkey", names.organisms(title).alias("organisms"))


KEYWORDS = ["red widget", "widget", "hot", "small gear"]


@query("""select p_partkey, p_name, case when list_has_all(w, ['red', 'widget']) then 0 when list_has_all(w, ['widget']) then 1 when list_has_all(w, ['hot']) then 2 when list_has_all(w, ['small', 'gear']) then 3 else -1 end as match,
 case when list_has_all(w, ['red', 'widget']) then 'K0' when list_has_all(w, ['widget']) then 'K1' when list_has_all(w, ['hot']) then 'K2' when list_has_all(w, ['small', 'gear']) then 'K3' else '' end as match_id
 from (select p_partkey, p_name, string_split(lower(p_name), ' ') w from part)""")
def keyword_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.first_match(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name"), KEYWORDS, [f"K{i}" for i in range(len(KEYWORDS))])
    return found.withColumns({"match": F.coalesce("match", F.lit(-1)), "match_id": F.coalesce("match_id", F.lit(""))})


#: First and last words of the descriptions that each document gives.
SLICES = [(1, 2), (3, 5), (6, 7), (8, 11), (12, 13)]


def cut_descriptions(docs: DataFrame) -> DataFrame:
    """place, id and description: a few words from the beginning of each text, five times over."""
    words = F.split("text", " ")
    cut = F.array(*[F.struct((F.col("doc_id") * len(SLICES) + k).alias("place"), F.array_join(F.slice(words, a, b - a + 1), " ").alias("description")) for k, (a, b) in enumerate(SLICES)])
    return docs.select(F.explode(cut).alias("d")).select("d.place", F.concat(F.lit("D"), "d.place").alias("id"), "d.description").filter("description <> ''")


@query(f"""with c as (select doc_id * {len(SLICES)} + k place, array_to_string(string_split(text, ' ')[a:b], ' ') description from documents, (values {", ".join(str((k, *x)) for k, x in enumerate(SLICES))}) t(k, a, b)),
 s as (select place, unnest(list_distinct(string_split(lower(description), ' '))) word, len(list_distinct(string_split(lower(description), ' '))) n from c where description <> ''),
 x as (select doc_id, unnest(list_distinct(string_split(lower(text), ' '))) word from documents),
 m as (select doc_id, place from s join x on x.word = s.word group by doc_id, place, n having count(*) = n), f as (select doc_id, min(place) place from m group by 1)
 select d.doc_id, place as match, 'D' || place match_id from documents d left join f on f.doc_id = d.doc_id""")
def description_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first description of all documents' that each document has the words of."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return descriptions.first_matches(docs, "doc_id", "text", cut_descriptions(docs)).select("doc_id", "match", "match_id")


@query("select item_id, list_filter(string_split(text, ' '), lambda w: w not in ('the', 'for', 'of')) words from benchmark")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", names.meaningful(F.split("text", " ")).alias("words"))


@query("select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 50")
def topn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.replace("Accounts", table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    db.create_top_view("least_accounts", "Accounts", "c_acctbal", 50)
    return db.table("least_accounts")


@query("select distinct source, lang from documents")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("select c_acctbal as balance, c_name as name, c_nationkey as nation from customer union all select s_acctbal, s_name, s_nationkey from supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return relational.united([a, b])


@query("select s_suppkey as k from supplier where s_suppkey not in (select c_custkey from customer) union all select c_custkey from customer where c_custkey not in (select s_suppkey from supplier)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in (("supplier", "s_suppkey"), ("customer", "c_custkey"))]
    return relational.differing(*keys)


@query("select count(*) n from lineitem")
def table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.replace("Lines", table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return spark.createDataFrame([(db.count("Lines"),)], "n long")


@query("select c_custkey, c_nationkey, case when c_nationkey = 3 and c_mktsegment = 'BUILDING' then 'OTHER' else c_mktsegment end c_mktsegment from customer")
def update_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.set_where(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), {"c_mktsegment": "OTHER"}, {"c_nationkey": 3, "c_mktsegment": "BUILDING"})


@query("select p_partkey, sqrt(p_retailprice) p_retailprice from part")
def column_sqrt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.square_root(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


def gene_lines(events: DataFrame, kind: Column, cluster: Column, evalue: Column) -> DataFrame:
    """Rows of a gene table from events: each user a gene, with a first row that names its scaffold."""
    fields = lambda *f: F.split(F.concat_ws("\t", *[F.coalesce(x.cast("string"), F.lit("")) for x in f]), "\t")  # a line, as a file has it
    user, none = F.col("user_id"), F.lit("")
    rows = events.select(F.col("event_id").alias("pos"), fields(user, none, kind, cluster, none, evalue).alias("f"))
    return rows.unionByName(events.select("user_id").distinct().select(F.lit(-1).cast("long").alias("pos"), fields(user, none, F.lit("scaffold"), none, F.concat(F.lit("s"), user), none).alias("f")))


@query("select user_id, coalesce(arg_max(value, event_id) filter (where event_type = 'purchase'), -1) purchase, coalesce(arg_max(value, event_id) filter (where event_type = 'click'), -1) click, coalesce(arg_max(props, event_id) filter (where event_type = 'error'), 'NULL_ST') error from events group by 1")
def gene_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as a gene's COG, clicks as its pfam; errors as the COG of a second table."""
    events = table(spark, sf_dir, "events")
    value = F.col("value").cast("string")
    numbers = files.folded_genes(gene_lines(events, F.when(F.col("event_type") == "purchase", "COG1").when(F.col("event_type") == "click", "pfam1"), F.lit(""), value), skip_first_row=False)
    texts = files.folded_genes(gene_lines(events, F.when(F.col("event_type") == "error", "COG1"), F.col("props"), F.lit("1")), skip_first_row=False)
    rows = numbers.select("gene_id", F.col("cog_Evalue").alias("purchase"), F.col("pfam_Evalue").alias("click")).join(texts.select("gene_id", F.col("cog_description").alias("error")), "gene_id")
    return rows.select(F.col("gene_id").cast("long").alias("user_id"), "purchase", "click", "error")


@query("""with h as (select l_orderkey, l_partkey, l_extendedprice, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) rn from lineitem)
 select l_orderkey, string_agg(cast(l_partkey as varchar), '###' order by rn) titles, cast(count(*) as int) n, round(sum(l_extendedprice), 2) bits from h where rn <= 5 group by 1""")
def hitlist_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hits as text, and what is read back from it."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice"))).alias("h"))
    made = F.transform("h", lambda x: F.struct(x["l_partkey"].cast("string").alias("title"), F.lit(0.0).alias("evalue"), x["l_extendedprice"].alias("score"), x["l_extendedprice"].alias("bits")))
    rows = rows.withColumn("hits", arrays.first_hits(made))
    rows = rows.select("l_orderkey", *[arrays.encode_hits(F.col("hits"), f).alias(f) for f in ("title", "evalue", "score", "bits")])
    back = rows.withColumn("back", arrays.decode_hits(*[F.col(c) for c in ("title", "evalue", "score", "bits")]))
    return back.select("l_orderkey", F.col("title").alias("titles"), F.size("back").alias("n"), F.round(F.aggregate("back", F.lit(0.0), lambda a, x: a + x["bits"]), 2).alias("bits"))


# Sequences and k-mers.

PAIRS = """with c as (select doc_id, string_split(translate(text, 'acgt', 'ACGT'), '') a from documents), p as (select doc_id, unnest(a) x, generate_subscripts(a, 1) i from c),
 w as (select doc_id, x || lead(x) over (partition by doc_id order by i) kmer from p), k as (select doc_id, kmer, count(*) n from w where regexp_full_match(kmer, '[ACGT]{2}') group by 1, 2)
"""


@query("select doc_id, case when len(text) > 0 then (len(text) - len(replace(replace(text, 'G', ''), 'C', ''))) / len(text) end gc from documents")
def gc_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sequences.gc_fraction(F.col("text")).alias("gc"))


@query(PAIRS + "select doc_id, kmer, n from k")
def kmer_count_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmercount.histogram(table(spark, sf_dir, "documents"), "doc_id", "text", Kmers(2))


@query(PAIRS + "select doc_id, kmer, n, round(n / sum(n) over (partition by doc_id), 9) freq from k")
def kmer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = kmercount.histogram(table(spark, sf_dir, "documents"), "doc_id", "text", Kmers(2))
    return kmercount.frequencies(counts, "doc_id").withColumn("freq", F.round("freq", 9))


@query(PAIRS + """, l as (select unnest(['A', 'C', 'G', 'T']) x), a as (select u.x || v.x kmer from l u, l v), t as (select doc_id, sum(n) s from k group by 1)
 select t.doc_id, list(round(coalesce(n, 0) / s, 9) order by a.kmer) spectrum from t cross join a left join k on k.doc_id = t.doc_id and k.kmer = a.kmer group by 1""")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense spectra in one pass over the texts."""
    rows = kmercount.spectra(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", Kmers(2), strict=False).filter("spectrum is not null")
    return rows.select("doc_id", F.transform("spectrum", lambda x: F.round(x, 9)).alias("spectrum"))


@query(PAIRS + "select doc_id, least(kmer, reverse(kmer)) kmer, cast(sum(n) as bigint) n from k group by 1, 2")
def kmer_unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmercount.folded_histogram(table(spark, sf_dir, "documents"), "doc_id", "text", Kmers(2))


@query("""with c as (select string_split(translate(text, 'acgt', 'ACGT'), '') a, doc_id from documents), p as (select doc_id, unnest(a) x, generate_subscripts(a, 1) i from c),
 w as (select x || lead(x) over o || lead(x, 2) over o kmer from p window o as (partition by doc_id order by i)), n as (select kmer, count(*) n from w where regexp_full_match(kmer, '[ACGT]{3}') group by 1),
 l as (select unnest(['A', 'C', 'G', 'T']) x, unnest([0, 1, 2, 3]) i)
 select a.x || b.x || c.x kmer, cast(a.i * 16 + b.i * 4 + c.i as bigint) rank, a.x <= c.x first, coalesce(n, 0) n from l a cross join l b cross join l c left join n on n.kmer = a.x || b.x || c.x""")
def kmer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 3-mers with their ranks, and how often all documents hold each."""
    by = Kmers(3)
    held = kmercount.histogram(table(spark, sf_dir, "documents"), "doc_id", "text", by).groupBy("kmer").agg(F.sum("n").alias("n"))
    rows = kmercount.all_kmers(spark, by).drop("rank").join(held, "kmer", "left")
    return kmercount.ranked(rows, "kmer", by).select("kmer", "rank", (F.col("kmer") <= F.reverse("kmer")).alias("first"), F.coalesce("n", F.lit(0)).alias("n"))


LONG = """with t as (select 'd' kind, doc_id as id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') s from documents union all select 'b', item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') from benchmark),
 r as (select kind, id, unnest(regexp_extract_all(s, '[A-Z]{10,}')) r from t), w as (select kind, id, r[i:i + 9] kmer from (select kind, id, r, unnest(range(1, len(r) - 8)) i from r)),
 k as (select kind, id, kmer, count(*) n from w group by 1, 2, 3), f as (select *, n / sum(n) over (partition by kind, id) freq from k)
"""


def long_kmers(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return sparse.spectra(table(spark, sf_dir, name), key, "text", Kmers(10, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


@query(LONG + "select id doc_id, kmer, n, round(freq, 9) freq from f where kind = 'd'")
def kmer10_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of 10-mers over 26 letters, which no dense vector could hold."""
    return long_kmers(spark, sf_dir, "documents", "doc_id").withColumn("freq", F.round("freq", 9))


@query(LONG + """, d as (select a.id doc_id, b.id item_id, round(2 - 2 * sum(least(a.freq, b.freq)), 9) distance from f a join f b on a.kmer = b.kmer where a.kind = 'd' and b.kind = 'b' group by 1, 2),
 o as (select *, row_number() over (partition by doc_id order by distance, item_id) rn, lead(distance) over (partition by doc_id order by distance, item_id) as second from d)
 select doc_id, item_id, distance, second from o where rn = 1""")
def kmer10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage nearest to each document by 10-mers."""
    return sparse.nearest(long_kmers(spark, sf_dir, "documents", "doc_id"), long_kmers(spark, sf_dir, "benchmark", "item_id"), "doc_id", "item_id")


@query("select p_brand genus, cast(len(string_agg(p_name, '' order by p_partkey)) as int) length, md5(string_agg(p_name, '' order by p_partkey)) digest from part group by 1")
def genus_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmercount.concatenated(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name")
    return rows.select(F.col("p_brand").alias("genus"), F.length("p_name").alias("length"), F.md5(F.col("p_name").cast("binary")).alias("digest"))


# Spectra against references: each embedding against the mean of every label.

CENTERS = """with v as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings), c as (select label, i, avg(x) m from v group by 1, 2),
 d as (select vec_id, c.label genus, sum(abs(x - m)) l1, sum((x - m) * (x - m)) l2 from v join c on c.i = v.i group by 1, 2),
 r as (select *, row_number() over (partition by vec_id order by l1, genus) rn, lead(l1) over (partition by vec_id order by l1, genus) l1_next from d), f as (select vec_id, genus, l1 as distance, l1_next as second from r where rn = 1)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("spectrum"))


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = vectors(spark, sf_dir).select("label", F.posexplode("spectrum").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    return places.groupBy(F.col("label").alias("genus")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("spectrum"))


def to_centers(spark: SparkSession, sf_dir: str, measure: Callable = arrays.l1) -> DataFrame:
    return compare.distances(vectors(spark, sf_dir), centers(spark, sf_dir), "vec_id", "spectrum", "genus", measure=measure)


@query(CENTERS + "select vec_id, genus, round(l1, 6) distance from d")
def l1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_centers(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query(CENTERS + "select vec_id, genus, round(l2, 6) distance from d")
def l2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_centers(spark, sf_dir, arrays.l2).withColumn("distance", F.round("distance", 6))


@query(CENTERS + "select vec_id, genus, round(distance, 6) distance, round(second, 6) as second from f")
def nearest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.nearest(vectors(spark, sf_dir), centers(spark, sf_dir), "vec_id", "spectrum", "genus")
    return found.select("vec_id", "genus", F.round("distance", 6).alias("distance"), F.round("second", 6).alias("second"))


@query(CENTERS + "select vec_id, case when distance <= 6.2 and distance / second <= 0.97 then cast(genus as varchar) else 'not assigned' end genus, case when distance <= 6.2 and distance / second <= 0.97 then round(distance, 6) else -1.0 end distance from f")
def kmer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.nearest(vectors(spark, sf_dir), centers(spark, sf_dir), "vec_id", "spectrum", "genus").withColumn("genus", F.col("genus").cast("string"))
    return compare.selected(found, "genus", 6.2, 0.97).withColumn("distance", F.round("distance", 6))


# Design matrices, neighbours, label spreading.


@query("select p_partkey, list_value(round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 6), round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 6), 0.0) features from part")
def zscore_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice", F.lit(7.0)).alias("features"))
    return matrix.scaled(rows, "p_partkey", "features").withColumn("features", F.transform("features", lambda x: arrays.rounded(x, 6)))


@query("select p_partkey, round(ln(p_retailprice) / ln(max(p_retailprice) over ()), 9) coverage from part")
def log_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix.largest_log(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("coverage")), "coverage")
    return rows.withColumn("coverage", F.round("coverage", 9))


KNN = """with n as (select a.vec_id src, b.vec_id dst, list_distance(a.embedding::double[], b.embedding::double[]) distance from embeddings a, embeddings b),
 k as (select *, cast(row_number() over (partition by src order by distance, dst) as int) rank from n qualify rank <= 7)
"""


@query(KNN + "select src, dst, rank, round(distance, 6) distance from k")
def knn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 7).withColumn("distance", F.round("distance", 6))


@query(KNN + """, u as (select src, dst from k where src <> dst union all select dst, src from k where src <> dst), e as (select src, dst, count(*) / 2 w from u group by 1, 2), g as (select src, sum(w) d from e group by 1),
 s as (select e.src, e.dst, w / sqrt(a.d * b.d) w from e join g a on a.src = e.src join g b on b.src = e.dst), y as (select vec_id node, label from embeddings where label < 5),
 m as (select dst node, label, 0.5 * sum(w) weight from s join y on y.node = s.src group by 1, 2 union all select node, label, 0.5 from y)
 select node, label, round(sum(weight), 6) weight from m group by 1, 2""")
def label_spread_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    edges = labelspread.graph(neighbours.nearest(rows, "vec_id", "embedding", 7))
    start = labelspread.seeds(rows.filter("label < 5"), "vec_id", "label")
    return labelspread.step(edges, start, start, 0.5).withColumn("weight", F.round("weight", 6))


@query("""with p as (select doc_id scaffold, n_chars x, len(text) y, lang from documents)
 select scaffold, x, y, round(x * 8e-6 * 10000.0 * 64.0 / max(x) over (), 9) size, case when lang = 'en' then 'not assigned' else lang end as label,
 case lang when 'en' then 'gainsboro' when 'de' then 'blue' when 'es' then 'green' when 'fr' then 'orange' end color from p""")
def plot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scaffolds = docs.select(F.col("doc_id").alias("scaffold"), F.col("n_chars").alias("coverage"), F.length("text").cast("long").alias("GC"), F.col("n_chars").alias("length"))
    labels = docs.select(F.col("doc_id").alias("scaffold"), F.when(F.col("lang") == "en", NOT_ASSIGNED).otherwise(F.col("lang")).alias("label"))
    return report.plot_points(scaffolds, labels, dpi=100, height=8, width=8).withColumn("size", F.round("size", 9))


# Sources, sinks and the catalog: written to the shared folder and read back.


@query("""with h as (select l_orderkey scaffold, lower(replace(n_name, ' ', '_')) genus, l_extendedprice bits, p_type from lineitem join part on p_partkey = l_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)
 select scaffold, genus, round(sum(bits), 2) bits from h where p_type in ('PROMO', 'SMALL') group by 1, 2""")
def gene_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item a gene of its part's family, with one hit."""
    lines, suppliers, nations, parts = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "part"))
    gene = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # no shorter one tells all rows apart
    genes = lines.join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select(gene.alias("gene_id"), F.col("p_type").alias("cog_id"), F.col("l_orderkey").alias("scaffold"))
    named = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("gi|1| x ["), F.translate("n_name", " ", "_"), F.lit(" sp]")).alias("title"))
    hit = F.struct("title", F.lit(0.0).alias("evalue"), F.col("l_extendedprice").alias("score"), F.col("l_extendedprice").alias("bits"))
    results = lines.join(named, F.col("l_suppkey") == F.col("s_suppkey")).select(gene.alias("gene_id"), F.array(hit).alias("hits"))
    markers = spark.createDataFrame([("PROMO",), ("SMALL",), ("PROMO",)], "cog_id string")
    return assign.score_sums(assign.gene_hits(genes, results, markers)).withColumn("bits", F.round("bits", 2))


@query()
def alignment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments of the benchmark's passages with all documents, text as sequences of letters."""
    found = search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text", evalue=1e-9)
    return found.select(F.col("query").alias("item_id"), F.col("target").alias("doc_id"), "score", "q_start", "q_end", "t_start", "t_end")


@query()
def searched_genus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as genes, four to a scaffold, searched in all documents; a hit's organism is its document's source and language."""
    docs = table(spark, sf_dir, "documents")
    genes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gene_id"), F.lit("COG1").alias("cog_id"), F.floor(F.col("item_id") / 4).alias("scaffold"), F.col("text").alias("sequence"))
    titles = docs.select(F.col("doc_id").alias("target"), F.concat(F.lit("passage ["), F.coalesce("source", F.lit("none")), F.lit(" "), F.coalesce("lang", F.lit("und")), F.lit("]")).alias("title"))
    results = search.hit_lists(search.search(genes, docs, "gene_id", "sequence", "doc_id", "text", evalue=1e-9), titles)
    return assign.best_group(assign.score_sums(assign.gene_hits(genes, results, genes.select("cog_id").distinct()))).withColumn("bits", F.round("bits", 6))


@query("""with k as (select user_id, event_type, value, row_number() over (partition by user_id, event_type order by event_id desc) rn from events)
 select cast(u.user_id as varchar) gene_id, 't' || u.user_id locus_tag, 's' || u.user_id scaffold, coalesce(round(max(case when event_type = 'purchase' then value end), 6), -1.0) cog, coalesce(round(max(case when event_type = 'click' then value end), 6), -1.0) pfam
 from (select distinct user_id from events) u left join k on k.user_id = u.user_id and rn = 1 group by u.user_id""")
def gene_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene table as a file with a header, written in order, read by lines and folded."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "COG0001").when(F.col("event_type") == "click", "pfam00001").otherwise("note")
    text = lambda c: c.cast("string")
    tag, none = F.concat(F.lit("t"), F.col("user_id")), F.lit(None).cast("string")
    rows = events.select(F.col("event_id").alias("place"), text(F.col("user_id")).alias("gene_oid"), tag.alias("Locus Tag"), kind.alias("Source"), F.lit("d").alias("Cluster Information"), none.alias("Gene Information"), text(F.col("value")).alias("E-value"))
    users = events.select("user_id").distinct().withColumn("place", F.lit(-1).cast("long"))
    named = users.select("place", text(F.col("user_id")).alias("gene_oid"), tag.alias("Locus Tag"), F.lit("Scaffold").alias("Source"), none.alias("Cluster Information"), F.concat(F.lit("s"), "user_id").alias("Gene Information"), none.alias("E-value"))
    path = new_folder(spark)
    sinks.write_rows(rows.unionByName(named).repartitionByRange(4, "place").sortWithinPartitions("place").drop("place"), path, "\t", header=True)
    found = files.genes(spark, path, skip_first_row=False)
    return found.select("gene_id", "locus_tag", "scaffold", F.round("cog_Evalue", 6).alias("cog"), F.round("pfam_Evalue", 6).alias("pfam"))


LETTERS = "with d as (select doc_id, lang, source, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') s from documents)\n"


@query(LETTERS + "select cast(doc_id as varchar) scaffold_id, 'sg4i_' || doc_id scaffold, md5(s) digest, cast(len(s) as bigint) length, case when len(s) > 0 then (len(s) - len(replace(replace(s, 'G', ''), 'C', ''))) / len(s) end gc from d")
def scaffold_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, letters = new_folder(spark), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    header = F.concat(F.col("doc_id").cast("string"), F.lit(" sg4i_"), "doc_id", F.lit(" assembly"))
    table(spark, sf_dir, "documents").select(sinks.as_fasta(header, letters, 60)).write.text(path)
    return files.scaffolds(spark, path).select("scaffold_id", "scaffold", F.md5(F.col("sequence").cast("binary")).alias("digest"), "length", F.col("GC").alias("gc"))


@query(LETTERS + "select cast(doc_id as varchar) gene_id, 'sg4i_' || doc_id locus_tag, 'of ' || lang description, md5(s) digest from d")
def protein_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, letters = new_folder(spark), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    header = F.concat(F.col("doc_id").cast("string"), F.lit(" sg4i_"), "doc_id", F.lit(" of "), "lang", F.lit(" [Some organism (v2)]"))
    table(spark, sf_dir, "documents").select(sinks.as_fasta(header, letters)).write.text(path)
    return files.proteins(spark, path).select("gene_id", "locus_tag", "description", F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query(LETTERS + "select lang || '' cog_id, cast(count(*) as bigint) records, cast(sum(len(s)) as bigint) letters from d where lang in ('en', 'de') group by 1")
def family_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of records for each marker family, read back by family."""
    path, docs = new_folder(spark), table(spark, sf_dir, "documents")
    genes = docs.select(F.col("doc_id").alias("gene_id"), F.col("lang").alias("cog_id"))
    sequences_ = docs.select(F.col("doc_id").alias("gene_id"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("sequence"))
    sinks.write_family_fasta(genes, sequences_, spark.createDataFrame([("en",), ("de",), ("en",), ("none",)], "cog_id string"), path)
    rows = files.fasta(spark, path)
    return rows.groupBy(F.split("header", ",")[1].alias("cog_id")).agg(F.count("*").alias("records"), F.sum(F.length("sequence")).cast("long").alias("letters"))


@query("select 'sg4i_' || c_custkey scaffold, c_acctbal coverage from customer")
def coverage_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, customers = new_folder(spark), table(spark, sf_dir, "customer")
    sinks.write_rows(customers.select("c_custkey", "c_acctbal"), path, header=True)
    scaffolds = customers.select(F.concat(F.lit("sg4i_"), "c_custkey").alias("scaffold"))
    return relational.updated(scaffolds, files.coverage(spark, path), "scaffold", "coverage", "pos")


@query("select distinct p_type cog_id from part")
def marker_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    sinks.write_rows(table(spark, sf_dir, "part").select("p_type", "p_name"), path, " ", header=True)
    return files.markers(spark, path, " ", header=True)


@query("select cast(p_partkey as varchar) cog_id, lower(p_name) as name from part")
def cog_name_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    sinks.write_rows(table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("p_name")), path, "\t", header=True)
    return files.cog_names(spark, path)


@query("select list_transform(embedding, lambda x: round(x::double, 6)) as row from embeddings")
def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    sinks.write_matrix(table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("row")), "row", path)
    return files.matrix(spark, path).select(F.transform("row", lambda x: arrays.rounded(x, 6)).alias("row"))


@query("""with s as (select s_nationkey, s_suppkey, s_acctbal, row_number() over (partition by s_nationkey order by s_suppkey) k from supplier)
 select cast(n_nationkey as bigint) nation, cast(count(s_suppkey) as int) hits, coalesce(string_agg('gi|' || s_suppkey || ' x [' || n_name || ' sp]', ';' order by k), '') titles, round(coalesce(sum(s_acctbal), 0.0), 2) bits from nation left join s on s_nationkey = n_nationkey and k <= 5 group by n_nationkey""")
def blast_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search's XML for each nation, a file each; its suppliers are the hits."""
    path, suppliers = new_folder(spark), table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "nation").join(suppliers.select("s_nationkey", "s_suppkey", "s_acctbal"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    by_nation = rows.groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.col("s_acctbal").cast("string").alias("bits")))).alias("h"))
    hit = "<Hit><Hit_num>%d</Hit_num><Hit_id>gi|%d</Hit_id><Hit_def>x [%s sp]</Hit_def><Hit_hsps><Hsp><Hsp_bit-score>%s</Hsp_bit-score><Hsp_score>9</Hsp_score><Hsp_evalue>0.5</Hsp_evalue></Hsp></Hit_hsps></Hit>"
    made = F.transform(F.filter("h", lambda x: x["s_suppkey"].isNotNull()), lambda x, i: F.format_string(hit, i + 1, x["s_suppkey"], F.col("n_name"), x["bits"]))
    page = F.concat(F.lit("<BlastOutput><BlastOutput_iterations><Iteration><Iteration_iter-num>1</Iteration_iter-num><Iteration_hits>"), F.array_join(made, ""), F.lit("</Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"))
    by_nation.select(F.col("n_nationkey").alias("nation"), page.alias("value")).repartition("nation").write.partitionBy("nation").text(path)
    found = files.blast_xml(spark, path)
    return found.select(F.regexp_extract("file", "nation=([0-9]+)", 1).cast("long").alias("nation"), F.size("hits").alias("hits"), F.array_join(F.transform("hits", lambda h: h["title"]), ";").alias("titles"), F.round(F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["bits"]), 2).alias("bits"))


@query("select c_custkey as id, c_mktsegment as segment, case when c_mktsegment = 'BUILDING' then 0.5 end as share from customer where c_nationkey = 3 union all select s_suppkey, 'supplier', null from supplier where s_nationkey = 3")
def database_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared table, filled twice, widened, updated, narrowed and seen through a view."""
    db = database(spark)
    db.create("Accounts", ["id", "nation", "segment"], ["int", "int", "str"])
    db.store("Accounts", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")))
    db.store("Accounts", table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("segment")))
    db.add_columns("Accounts", {"share": "float", "note": "str"})
    db.update("Accounts", {"share": 0.5}, {"segment": "BUILDING"})
    db.drop_columns("Accounts", ["note"])
    db.create_view("accounts_of_3", "Accounts", {"nation": 3})
    return db.sql("select id, segment, share from accounts_of_3")


@query(PAIRS + """, u as (select doc_id, least(kmer, reverse(kmer)) kmer, sum(n) n from k group by 1, 2), l as (select unnest(['A', 'C', 'G', 'T']) x), a as (select u.x || v.x kmer from l u, l v where u.x <= v.x), t as (select doc_id, sum(n) s from k group by 1)
 select t.doc_id, list(round(coalesce(n, 0) / s, 9) order by a.kmer) spectrum from t cross join a left join u on u.doc_id = t.doc_id and u.kmer = a.kmer group by 1""")
def kmer_unique_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmercount.folded_spectra(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", Kmers(2), strict=False).filter("spectrum is not null")
    return rows.select("doc_id", F.transform("spectrum", lambda x: F.round(x, 9)).alias("spectrum"))


@query(PAIRS + "select kmer, cast(sum(n) as bigint) n from k where kmer <= reverse(kmer) group by 1")
def kmer_without_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2-mers of all documents that don't come after their reversal."""
    counts = kmercount.histogram(table(spark, sf_dir, "documents"), "doc_id", "text", Kmers(2))
    return kmercount.without_reversed(counts).groupBy("kmer").agg(F.sum("n").alias("n"))


# Iterative operators, which SQL can't express.


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scaffold"), F.col("embedding").cast("array<double>").alias("features"), "label")


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans(features(spark, sf_dir), 10)


@query()
def gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.gaussian_mixture(features(spark, sf_dir), 3)


@query()
def dirichlet_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dirichlet_mixture(features(spark, sf_dir), 10)


@query()
def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each label by themselves."""
    return cluster.complete_linkage(features(spark, sf_dir), 1.2, group="label")


@query()
def label_spread_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return labelspread.propagate(rows, rows.filter("label < 5"), alpha=0.8)


@query("""with t as (select 'd' kind, cast(doc_id as varchar) id, text from documents where doc_id not in (select doc_id from labels) union all select 'g', lang, string_agg(text, '' order by doc_id) from documents where doc_id in (select doc_id from labels) group by lang),
 p as (select kind, id, unnest(a) x, generate_subscripts(a, 1) i from (select kind, id, string_split(translate(text, 'acgt', 'ACGT'), '') a from t)),
 w as (select kind, id, x || lead(x) over o || lead(x, 2) over o kmer from p window o as (partition by kind, id order by i)),
 k as (select kind, id, kmer, count(*) n from w where regexp_full_match(kmer, '[ACGT]{3}') group by 1, 2, 3), f as (select kind, id, kmer, n / sum(n) over (partition by kind, id) freq from k),
 l as (select unnest(['A', 'C', 'G', 'T']) x), a as (select u.x || v.x || w.x kmer from l u, l v, l w),
 s as (select g.kind, g.id, list(coalesce(freq, 0) order by a.kmer) v from (select distinct kind, id from f) g cross join a left join f on f.kind = g.kind and f.id = g.id and f.kmer = a.kmer group by 1, 2),
 m as (select d.id, b.id genus, list_sum(list_transform(list_zip(d.v, b.v), lambda z: abs(z[1] - z[2]))) distance from s d, s b where d.kind = 'd' and b.kind = 'g'),
 r as (select *, row_number() over (partition by id order by distance, genus) rn, lead(distance) over (partition by id order by distance, genus) as second from m),
 y as (select id, genus, distance, distance <= 0.768 and distance / second <= 0.8 good from r where rn = 1)
 select doc_id scaffold, case when good then genus else 'not assigned' end genus, case when good then round(distance, 6) else -1.0 end distance from documents left join y on id = cast(doc_id as varchar) where doc_id not in (select doc_id from labels)""")
def kmer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label against the joined texts of each language's labelled ones, by 3-mers."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scaffold"), F.col("text").alias("sequence"), F.col("lang").alias("genus"))
    assigned = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("scaffold")).distinct(), "scaffold", "left_semi").select("scaffold", "genus")
    return compare.compare_once(assigned, docs, Kmers(3)).withColumn("distance", F.round("distance", 6))


@query()
def kmer_compare_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, repeated with what each round assigns."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scaffold"), F.col("text").alias("sequence"), F.col("lang").alias("genus"))
    assigned = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("scaffold")).distinct(), "scaffold", "left_semi").select("scaffold", "genus")
    return compare.compare_all(assigned, docs, Kmers(3)).withColumn("distance", F.round("distance", 6))


@query()
def binning_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scaffold"), F.col("embedding").cast("array<double>").alias("spectrum"), (F.col("label") + 10).cast("double").alias("coverage"), "label")
    return binning.run_binning(rows.drop("label"), rows.filter("label < 2").select("scaffold"), binning.Binning(threshold=8.0, probability=0.3, rounds=2, alpha=0.9))


