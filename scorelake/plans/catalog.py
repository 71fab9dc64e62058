"""Every registered query with its SQL twin, over the tables of a scale-factor folder.

Events stand in for a long score table, line items for a wide one, documents and labels for items
and ragged references, conversations for reference and hypothesis, embeddings for vectors and for
short signals. Floating results are rounded on both sides, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import columns as C
from scorelake.functions import edit, naming, signal
from scorelake.operators import chunking, corpus, pairing, scores, standardize, wer
from scorelake.plans.session import shared_folder
from scorelake.registry import default_registry
from scorelake.sources import listings
from scorelake.sources import scores as files
from scorelake.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(C.col(c), digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})


# --- stand-ins -------------------------------------------------------------------------------

WIDE = {"espnet_wer_delete": "l_quantity", "pesq": "l_extendedprice", "spk_similarity": "l_discount", "mcd": "l_tax", "asvspoof_score": "l_linenumber"}
_WIDE_SQL = "SELECT l_orderkey || '-' || l_linenumber AS key, " + ", ".join(f"CAST({c} AS DOUBLE) AS {n}" for n, c in WIDE.items()) + " FROM lineitem"
_LONG_SQL = "SELECT key, metric, value FROM (" + " UNION ALL ".join(f"SELECT l_orderkey || '-' || l_linenumber AS key, '{n}' AS metric, CAST({c} AS DOUBLE) AS value FROM lineitem" for n, c in WIDE.items()) + ")"
_STATS_SQL = "count(CASE WHEN isfinite(value) THEN value END) AS count, avg(value) FILTER (isfinite(value)) AS mean, median(value) FILTER (isfinite(value)) AS median, stddev_samp(value) FILTER (isfinite(value)) AS sd, min(value) FILTER (isfinite(value)) AS lo, max(value) FILTER (isfinite(value)) AS hi"
_STD_SQL = "CASE WHEN count <= 1 OR hi - lo < 1e-10 THEN 0.0 ELSE sd END"
_ANALYSIS_SQL = f"""WITH l AS ({_LONG_SQL}), s AS (SELECT metric, {_STATS_SQL} FROM l GROUP BY metric),
t AS (SELECT *, {_STD_SQL} AS std, {naming.category_sql('metric')} AS category, {naming.direction_sql('metric')} AS up, {naming.range_sql('metric', 'lo', 'hi')} AS note FROM s),
u AS (SELECT *, CASE WHEN mean <> 0 THEN std / mean ELSE 'inf'::DOUBLE END AS cv FROM t),
w AS (SELECT *, CASE WHEN cv < 0.1 THEN 'low' WHEN cv > 2.0 THEN 'very_high' WHEN cv > 0.5 THEN 'high' ELSE 'moderate' END AS variability FROM u)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), *(F.col(c).cast("double").alias(n) for n, c in WIDE.items()))


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.to_long(wide(spark, sf_dir), columns=list(WIDE))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("metric"), "value")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, rate, samples, ref_samples): each vector as a signal, its reversal as the reference."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("samples"))
    return v.select("key", F.lit(64).alias("rate"), "samples", F.reverse("samples").alias("ref_samples"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, ref_text, hyp_text): each turn with the next."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp_text"))
    return c.withColumnRenamed("text", "ref_text").join(after, ["conv_id", "turn"])


#: DuckDB's levenshtein compares bytes: each letter beyond ASCII becomes a control character of its own, which keeps distances.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_PLAIN = "translate({}, '" + _LETTERS + "', " + " || ".join(f"chr({i})" for i in [*range(1, 9), *range(14, 27)]) + ")"
_TURNS_SQL = f"SELECT a.conv_id, a.turn, {_PLAIN.format('a.text')} AS ref_text, {_PLAIN.format('b.text')} AS hyp_text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"

# --- score tables ----------------------------------------------------------------------------


@query(f"SELECT metric, count, round(mean, 6) AS mean, round(median, 6) AS median, round({_STD_SQL}, 6) AS std, lo AS min, hi AS max FROM (SELECT event_type AS metric, {_STATS_SQL} FROM events GROUP BY 1)")
def score_statistics(spark, d):
    return rounded(scores.statistics(events(spark, d)), "mean", "median", "std")


@query(_ANALYSIS_SQL + """ SELECT metric AS metric_name, category, count, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, lo AS min, hi AS max, round(hi - lo, 6) AS range, round(cv, 6) AS cv, variability,
CASE variability WHEN 'low' THEN '""" + naming.NOTES["low"] + "' WHEN 'very_high' THEN '" + naming.NOTES["very_high"] + "' WHEN 'high' THEN '" + naming.NOTES["high"] + "' ELSE '" + naming.NOTES["moderate"] + """' END AS quality_note,
note AS range_note, up AS higher_is_better, CASE WHEN up THEN hi WHEN NOT up THEN lo END AS best_value, CASE WHEN up THEN lo WHEN NOT up THEN hi END AS worst_value FROM w""")
def score_analysis(spark, d):
    return rounded(scores.analysis(long(spark, d)), "mean", "median", "std", "range", "cv")


_SUMMARY = "CASE WHEN contains(metric, '_wer') OR contains(metric, '_cer') OR contains(metric, '_per') THEN sum(value) ELSE avg(value) END"


@query(f"SELECT metric, round({_SUMMARY}, 4) AS value FROM ({_LONG_SQL}) GROUP BY metric")
def score_summary(spark, d):
    return rounded(scores.summary(long(spark, d)), "value", digits=4)


@query("SELECT " + ", ".join(f"round({'sum' if '_wer' in n else 'avg'}({n}), 4) AS {n}" for n in WIDE) + f" FROM ({_WIDE_SQL})")
def score_summary_wide(spark, d):
    return rounded(scores.summary_wide(wide(spark, d)), *WIDE, digits=4)


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def aggregate_strict(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(rounded(scores.strict_means(df), "l_quantity", "l_discount", "l_tax"), "l_extendedprice", digits=4)


@query(f"SELECT DISTINCT metric, {naming.category_sql('metric')} AS category FROM ({_LONG_SQL} UNION ALL SELECT CAST(event_id AS VARCHAR), event_type, value FROM events)")
def metric_discovery(spark, d):
    return scores.discover(long(spark, d).select("metric").union(events(spark, d).select("metric")))


@query(f"SELECT * FROM (SELECT DISTINCT metric, {naming.category_sql('metric')} AS category FROM ({_LONG_SQL})) WHERE (contains(category, 'sim') OR contains(category, 'speech')) AND (contains(metric, 'spk') OR contains(metric, 'pesq'))")
def metric_filter(spark, d):
    return scores.filter_metrics(scores.discover(long(spark, d)), ("SIM", "speech"), ("spk", "PESQ"))


@query(_ANALYSIS_SQL + " SELECT category, count(*) AS value, round(avg(mean), 4) AS mean, round(avg(std), 4) AS std FROM w GROUP BY category")
def category_rollup(spark, d):
    return rounded(scores.category_rollup(scores.analysis(long(spark, d))), "mean", "std", digits=4)


@query(_ANALYSIS_SQL + """ SELECT 'Metrics' AS name, '' AS parent, count(*) AS value, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std FROM w
UNION ALL SELECT category, 'Metrics', count(*), NULL, NULL FROM w GROUP BY category UNION ALL SELECT metric, category, 1, round_even(mean, 4), round_even(std, 4) FROM w""")
def metric_tree(spark, d):
    return scores.tree(scores.analysis(long(spark, d)))


@query(_ANALYSIS_SQL + " SELECT n.name, coalesce(round_even(w.mean, 4), 0.0) AS mean FROM (VALUES ('pesq'), ('mcd'), ('nisqa')) n(name) LEFT JOIN w ON w.metric = n.name")
def radar_selection(spark, d):
    wanted = spark.createDataFrame([("pesq",), ("mcd",), ("nisqa",)], "name string")
    return scores.selection(scores.tree(scores.analysis(long(spark, d))), wanted)


_PAIRS = [(a, b) for a in WIDE for b in WIDE]


@query(f"WITH w AS ({_WIDE_SQL}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM w" for a, b in _PAIRS))
def correlation_matrix(spark, d):
    return rounded(scores.correlation(wide(spark, d), list(WIDE)), "r")


@query("""WITH n AS (SELECT event_type AS metric, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE isfinite(value)),
k AS (SELECT min(m) AS m FROM (SELECT max(n) AS m FROM n GROUP BY metric))
SELECT a.metric AS a, b.metric AS b, round(corr(a.value, b.value), 6) AS r FROM n a JOIN n b ON a.n = b.n, k WHERE a.n <= k.m GROUP BY 1, 2""")
def positional_correlation(spark, d):
    return rounded(scores.positional_correlation(events(spark, d), "key"), "r")


@query("""WITH v AS (SELECT event_type AS metric, value FROM events WHERE isfinite(value)), e AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1),
b AS (SELECT v.metric, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin FROM v JOIN e USING (metric))
SELECT metric, bin, round(lo + bin * ((hi - lo) / 20), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS high, count(*) AS count FROM b GROUP BY metric, lo, hi, bin""")
def score_histogram(spark, d):
    return rounded(scores.histogram(events(spark, d)), "low", "high")


@query("SELECT event_type AS metric, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3 FROM events WHERE isfinite(value) GROUP BY 1")
def score_quartiles(spark, d):
    return rounded(scores.quartiles(events(spark, d)), "q1", "q2", "q3")


@query(f"SELECT key, asvspoof_score, espnet_wer_delete, mcd, pesq, spk_similarity FROM ({_WIDE_SQL}) ORDER BY key, asvspoof_score, espnet_wer_delete, mcd, pesq, spk_similarity LIMIT 20")
def score_preview(spark, d):
    return scores.preview(wide(spark, d), ["key", *sorted(WIDE)])


@query("""WITH g AS (SELECT source AS category, lang AS metric, min(doc_id) AS ord FROM documents GROUP BY 1, 2), o AS (SELECT category, min(ord) AS ord FROM g GROUP BY 1)
SELECT metric, arg_min(g.category, o.ord) AS category FROM g JOIN o USING (category) GROUP BY metric""")
def first_category(spark, d):
    groups = table(spark, d, "documents").groupBy(F.col("source").alias("category")).agg(F.collect_set("lang").alias("metrics"), F.min("doc_id").alias("ord"))
    return scores.first_category(groups)


_TYPES = ("click", "view", "purchase", "signup", "error")


@query("SELECT key, " + ", ".join(f"max(CASE WHEN metric = '{t}' THEN value END) AS {t}" for t in _TYPES) + " FROM (SELECT user_id AS key, event_type AS metric, value FROM events) GROUP BY key")
def wide_from_long(spark, d):
    return scores.to_wide(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("metric"), "value"), metrics=list(_TYPES))


# --- pairing ---------------------------------------------------------------------------------


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), "lang", "n_chars")


def _labels(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic")


@query("SELECT d.doc_id AS key, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def pair_references(spark, d):
    return pairing.pair(_docs(spark, d), _labels(spark, d), check=False)


@query("SELECT doc_id AS key, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unpaired_items(spark, d):
    return pairing.unpaired(_docs(spark, d), _labels(spark, d))


@query("SELECT l.doc_id AS key, l.quality, l.toxic, length(d.text) AS n_text FROM labels l JOIN documents d USING (doc_id)")
def pair_text(spark, d):
    text = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    return pairing.with_text(_labels(spark, d), text).select("key", "quality", "toxic", F.length("text").cast("long").alias("n_text"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS old_score, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice * 2 END AS new_score FROM orders")
def resume_run(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "key")
    done = o.filter("o_orderstatus = 'F'").select("key", F.col("o_totalprice").alias("old_score"))
    new = pairing.to_do(o, done).select("key", (F.col("o_totalprice") * 2).alias("new_score"))
    return pairing.resumed(o.select("key"), done, new)


@query("""WITH a AS (SELECT l_orderkey AS key, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS key, sum(l_quantity) AS qty, max(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o.o_orderkey AS key, CASE WHEN b.key IS NOT NULL THEN b.qty ELSE a.qty END AS qty, a.n, b.tax FROM orders o LEFT JOIN a ON a.key = o.o_orderkey LEFT JOIN b ON b.key = o.o_orderkey""")
def merge_metrics(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "key")
    a = li.groupBy("key").agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    b = li.filter("l_returnflag = 'R'").groupBy("key").agg(F.sum("l_quantity").alias("qty"), F.max("l_tax").alias("tax"))
    return pairing.merge_metrics(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), [a, b])


@query("SELECT user_id AS key, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_row_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", "value", "ts")
    return pairing.last_wins(e, F.struct("ts", "event_id")).drop("ts")


@query("SELECT (SELECT count(*) FROM documents) AS baseline, (SELECT count(*) FROM labels) AS evaluation, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS same")
def set_sizes(spark, d):
    return pairing.sizes(_docs(spark, d), _labels(spark, d))


@query("SELECT c_custkey AS key, c_acctbal AS score FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def concat_parts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score"))
    return pairing.concat([c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("score"))])


_VEC = "CAST(embedding AS DOUBLE[])"


@query(f"WITH v AS (SELECT vec_id, {_VEC} AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id")
def all_pairs_similarity(spark, d):
    return rounded(pairing.all_pairs(table(spark, d, "embeddings").withColumnRenamed("vec_id", "key")), "similarity")


# --- error rates -----------------------------------------------------------------------------


@query(f"SELECT conv_id, turn, CAST(levenshtein(ref_text, hyp_text) AS BIGINT) AS errors, CAST(length(ref_text) AS BIGINT) AS ref_length, CAST(length(hyp_text) AS BIGINT) AS hyp_length FROM ({_TURNS_SQL})")
def edit_counts(spark, d):
    t = turns(spark, d).withColumn("c", edit.character_counts(F.col("ref_text"), F.col("hyp_text")))
    part = lambda *names: sum((F.col(f"c.{n}") for n in names[1:]), F.col(f"c.{names[0]}"))
    return t.select("conv_id", "turn", part("delete", "insert", "replace").alias("errors"), part("delete", "replace", "equal").alias("ref_length"), part("insert", "replace", "equal").alias("hyp_length"))


@query(f"SELECT conv_id, turn, CAST(levenshtein(ref_text, hyp_text) AS BIGINT) AS errors, round(CASE WHEN length(ref_text) = 0 THEN 1.0 ELSE levenshtein(ref_text, hyp_text) / length(ref_text)::DOUBLE END, 6) AS rate FROM ({_TURNS_SQL})")
def character_errors(spark, d):
    n = F.levenshtein("ref_text", "hyp_text")
    zero = F.lit(0)
    return turns(spark, d).select("conv_id", "turn", n.cast("long").alias("errors"), r6(wer.mismatch_rate(n, zero, zero, F.length("ref_text"))).alias("rate"))


@query(f"SELECT conv_id, turn, CAST(len(regexp_extract_all(ref_text, '\\S+')) AS BIGINT) AS ref_words, CAST(len(regexp_extract_all(hyp_text, '\\S+')) AS BIGINT) AS hyp_words FROM ({_TURNS_SQL})")
def word_counts(spark, d):
    w = wer.count_errors(turns(spark, d))
    part = lambda e: F.col("whisper_wer_delete") * 0 + F.col(f"whisper_wer_{e}") + F.col("whisper_wer_replace") + F.col("whisper_wer_equal")
    return w.select("conv_id", "turn", part("delete").alias("ref_words"), part("insert").alias("hyp_words"))


_COUNTS_SQL = "SELECT l_orderkey || '-' || l_linenumber AS key, CAST(l_linenumber AS BIGINT) AS d, CAST(floor(l_tax * 100) AS BIGINT) AS i, CAST(floor(l_discount * 100) AS BIGINT) AS r, CAST(l_quantity AS BIGINT) AS e FROM lineitem"
_RATES_SQL = f"SELECT key, d, i, r, e, CASE WHEN e + d + r = 0 THEN 0.0 ELSE (d + i + r) / (e + d + r)::DOUBLE END AS wer, CASE WHEN e + d + r = 0 THEN 0.0 ELSE i / (e + d + r)::DOUBLE END AS ins, CASE WHEN e + d + r = 0 THEN 0.0 ELSE d / (e + d + r)::DOUBLE END AS del, CASE WHEN e + d + r = 0 THEN 0.0 ELSE r / (e + d + r)::DOUBLE END AS sub FROM ({_COUNTS_SQL})"


def _counted(spark, d):
    li = table(spark, d, "lineitem")
    whole = lambda c: F.floor(F.col(c) * 100).cast("long")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.col("l_linenumber").cast("long").alias("whisper_wer_delete"), whole("l_tax").alias("whisper_wer_insert"), whole("l_discount").alias("whisper_wer_replace"), F.col("l_quantity").cast("long").alias("whisper_wer_equal"))


@query(f"SELECT key, round(wer, 6) AS wer, round(ins, 6) AS insertion_error, round(del, 6) AS deletion_error, round(sub, 6) AS substitution_error, wer < 0.05 AS low_wer, ins < 0.05 AS low_insertion, del < 0.05 AS low_deletion, ins < 0.05 AND del < 0.05 AS low_both FROM ({_RATES_SQL})")
def error_rates(spark, d):
    flagged = wer.flags(wer.with_rates(_counted(spark, d)))
    rates = ("wer", "insertion_error", "deletion_error", "substitution_error")
    return rounded(flagged.select("key", *rates, "low_wer", "low_insertion", "low_deletion", "low_both"), *rates)


_KEPT = {"low_wer": "wer < 0.05", "low_insertion": "ins < 0.05", "low_deletion": "del < 0.05", "low_both": "ins < 0.05 AND del < 0.05"}


@query("SELECT count(*) AS rows, round(avg(wer), 6) AS mean_wer, round(avg(ins), 6) AS mean_insertion_error, round(avg(del), 6) AS mean_deletion_error, round(avg(sub), 6) AS mean_substitution_error, round(min(wer), 6) AS min_wer, round(max(wer), 6) AS max_wer, "
       + ", ".join(f"count(*) FILTER ({t}) AS {n}, round(count(*) FILTER ({t}) * 100.0 / count(*), 6) AS {n}_percent" for n, t in _KEPT.items()) + f" FROM ({_RATES_SQL})")
def error_filter_summary(spark, d):
    out = wer.filter_summary(wer.flags(wer.with_rates(_counted(spark, d))))
    return rounded(out, *(c for c in out.columns if c.startswith(("mean", "min", "max")) or c.endswith("percent")))


@query(f"SELECT CAST(sum(d + i + r) AS BIGINT) AS errors, CAST(sum(e + d + r) AS BIGINT) AS words, round(sum(d + i + r) / sum(e + d + r)::DOUBLE, 9) AS wer FROM ({_COUNTS_SQL}) WHERE e + d + r > 0")
def corpus_wer(spark, d):
    return rounded(wer.corpus_wer(_counted(spark, d)), "wer", digits=9)


@query("SELECT key FROM (SELECT 'doc_' || doc_id || '_' || (n_chars % 7) || '_' || (n_chars % 7 + n_chars // 50) AS key, n_chars // 50 AS s, len(regexp_extract_all(text, '\\S+')) AS w FROM documents) WHERE w >= 16 AND s BETWEEN 10 AND 30")
def select_keys(spark, d):
    n = F.col("n_chars")
    key = F.concat_ws("_", F.lit("doc"), F.col("doc_id"), n % 7, n % 7 + F.floor(n / 50).cast("long"))
    return wer.select_keys(table(spark, d, "documents").select(key.alias("key"), F.col("text").alias("ref_text")))


@query("SELECT conv_id, turn, round(len(regexp_extract_all(text, '\\S+')) / (length(text) / 15.0), 6) AS words_a_second FROM conversations WHERE length(text) > 0")
def speaking_rate(spark, d):
    c = table(spark, d, "conversations").filter("length(text) > 0")
    return c.select("conv_id", "turn", r6(wer.speaking_rate(F.col("text"), F.length("text") / F.lit(15.0))).alias("words_a_second"))


# --- vectors and corpora ---------------------------------------------------------------------


@query(f"SELECT round(avg(list_cosine_similarity({_VEC}, list_reverse({_VEC}))), 6) AS clap_score FROM embeddings")
def paired_embedding_score(spark, d):
    s = signals(spark, d)
    return rounded(corpus.paired_score(s.select("key", F.col("samples").alias("embedding")), s.select("key", F.col("ref_samples").alias("embedding"))), "clap_score")


@query("""WITH v AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance FROM v GROUP BY i""")
def embedding_moments(spark, d):
    _, mean, cov = corpus.moments(table(spark, d, "embeddings"), 64)
    rows = [(i, float(m), float(c)) for i, (m, c) in enumerate(zip(mean, cov.diagonal()))]
    return rounded(spark.createDataFrame(rows, "i int, mean double, variance double"), "mean", "variance")


@query()
def frechet_distance(spark, d):
    e = table(spark, d, "embeddings")
    found = corpus.fad(e.filter("label < 5"), e.filter("label >= 5"), 64) | {"fad_r2": corpus.fad(e.filter("label < 5"), e.filter("label >= 5"), 64, infinite=True)["fad_r2"]}
    return spark.createDataFrame([(found["fad_overall"], found["fad_r2"])], "fad_overall double, fad_r2 double")


@query(f"""WITH v AS (SELECT vec_id, label < 5 AS one, {_VEC} AS v FROM embeddings), p AS (SELECT a.one AS a, b.one AS b, a.vec_id = b.vec_id AS same, power(list_dot_product(a.v, b.v) / 64 + 1, 3) AS k FROM v a CROSS JOIN v b)
SELECT round((SELECT avg(k) FROM p WHERE a AND b AND NOT same) + (SELECT avg(k) FROM p WHERE NOT a AND NOT b AND NOT same) - 2 * (SELECT avg(k) FROM p WHERE a AND NOT b), 8) AS kid""")
def kernel_distance(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(corpus.kernel_distance(e.filter("label < 5"), e.filter("label >= 5"), 64, key="vec_id"), "kid", digits=8)


# --- signals ---------------------------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id, n_chars, unnest(range(0, n_chars, 200)) AS a FROM documents), c AS (SELECT doc_id, n_chars, a, least(a + 500, n_chars) AS b FROM s)
SELECT doc_id || '@' || printf('%.3f', a / 100.0) || '-' || printf('%.3f', b / 100.0) AS key, doc_id AS source, a AS start, b AS stop FROM c WHERE a + 500 <= n_chars OR b - a >= 100""")
def chunk_bounds(spark, d):
    rate = F.lit(100)
    docs = table(spark, d, "documents").select("doc_id", F.explode(chunking.bounds(F.col("n_chars"), rate, 5.0, 2.0, 1.0)).alias("c"))
    start, stop = F.col("c.start"), F.col("c.stop")
    return docs.select(chunking.chunk_key(F.col("doc_id"), start, stop, rate).alias("key"), F.col("doc_id").alias("source"), start.alias("start"), stop.alias("stop"))


@query(f"""WITH s AS (SELECT vec_id, {_VEC} AS v, unnest(range(0, 64, 16)) AS a FROM embeddings), c AS (SELECT vec_id, v, a, least(a + 32, 64) AS b FROM s)
SELECT vec_id || '@' || printf('%.3f', a / 64.0) || '-' || printf('%.3f', b / 64.0) AS key, CAST(b - a AS INTEGER) AS n, round(list_avg(v[a + 1:b]), 6) AS mean FROM c WHERE a + 32 <= 64 OR b - a >= 16""")
def chunk_signals(spark, d):
    cut = chunking.chunks(signals(spark, d), seconds=0.5, hop=0.25, least=0.25)
    return cut.select("key", F.size("samples").alias("n"), r6(C.mean("samples")).alias("mean"))


@query(f"""WITH s AS (SELECT vec_id, {_VEC} AS v, unnest(range(0, 64, 16)) AS a FROM embeddings), c AS (SELECT vec_id, v, list_reverse(v) AS w, a, least(a + 32, 64) AS b FROM s)
SELECT vec_id || '@' || printf('%.3f', a / 64.0) || '-' || printf('%.3f', b / 64.0) AS key, round(list_avg(list_transform(range(1, b - a + 1), lambda i: abs(v[a + i] - w[a + i]))), 6) AS difference FROM c WHERE a + 32 <= 64 OR b - a >= 16""")
def chunk_pairs(spark, d):
    s = signals(spark, d)
    cut = chunking.paired_chunks(s.select("key", "rate", "samples"), s.select("key", "rate", F.col("ref_samples").alias("samples")), seconds=0.5, hop=0.25, least=0.25)
    return cut.select("key", r6(C.mean(F.zip_with("samples", "ref_samples", lambda a, b: F.abs(a - b)))).alias("difference"))


@query("SELECT vec_id AS key, vec_id % 2 = 0 AS long_enough, vec_id % 3 <> 0 AND list_min(embedding) < list_max(embedding) AS varies, CASE WHEN vec_id % 2 = 1 THEN 'too short' WHEN vec_id % 3 = 0 THEN 'constant' END AS reason FROM embeddings")
def signal_validity(spark, d):
    s = signals(spark, d).select("key", F.when(F.col("key") % 2 == 0, 64).otherwise(640).alias("rate"), F.when(F.col("key") % 3 == 0, F.transform("samples", lambda x: F.lit(0.5))).otherwise(F.col("samples")).alias("samples"))
    names = ["stoi", "pesq", "estoi"]
    good, bad = chunking.valid(s, names)
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select("key", chunking.long_enough(F.size("samples"), "rate", names).alias("long_enough"), chunking.varies("samples").alias("varies"), "reason")


_ZIPPED = f"SELECT vec_id AS key, {_VEC} AS v, list_reverse({_VEC}) AS w FROM embeddings"
_CENTRED = f"SELECT key, list_transform(v, lambda x: x - list_avg(v)) AS e, list_transform(w, lambda x: x - list_avg(w)) AS t FROM ({_ZIPPED})"


@query(f"WITH c AS ({_CENTRED}), k AS (SELECT key, list_dot_product(e, t) AS et, list_dot_product(t, t) AS tt, list_dot_product(e, e) AS ee FROM c) SELECT key, round(10 * log10((et / tt) * (et / tt) * tt / (ee - (et / tt) * et)), 4) AS si_snr FROM k")
def si_snr(spark, d):
    centre = lambda c: F.transform(c, lambda x: x - F.col(c + "_mean"))
    s = signals(spark, d).withColumns({"samples_mean": C.mean("samples"), "ref_samples_mean": C.mean("ref_samples")})
    s = s.select("key", centre("samples").alias("e"), centre("ref_samples").alias("t"))
    return s.select("key", r6(C.si_snr_of(F.col("e"), F.col("t")), 4).alias("si_snr"))


@query(f"""SELECT key, round(list_cosine_similarity(v, w), 6) AS cosine, round(sqrt(list_avg(list_transform(range(1, 65), lambda i: power(v[i] - w[i], 2)))), 6) AS rmse,
round(10 / ln(10) * list_avg(list_transform(range(0, 16), lambda f: sqrt(2 * list_sum(list_transform(range(1, 5), lambda i: power(v[4 * f + i] - w[4 * f + i], 2)))))), 6) AS mcd FROM ({_ZIPPED})""")
def frame_distances(spark, d):
    frames = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(c, i * 4 + 1, F.lit(4)))
    s = signals(spark, d).withColumns({"a": frames("samples"), "b": frames("ref_samples")})
    return s.select("key", r6(C.cosine("samples", "ref_samples")).alias("cosine"), r6(C.rmse("samples", "ref_samples")).alias("rmse"), r6(C.mel_cepstral_distortion("a", "b")).alias("mcd"))


_FRAMES_SQL = f"SELECT key, list_transform(range(0, 16), lambda f: v[4 * f + 1:4 * f + 4]) AS a, list_transform(range(0, 16), lambda f: w[4 * f + 1:4 * f + 4]) AS b FROM ({_ZIPPED})"


@query(f"""WITH f AS ({_FRAMES_SQL}), p AS (SELECT key, a, b, list_transform(a, lambda x: list_dot_product(x, x)) AS p FROM f)
SELECT key, CAST(len(list_filter(p, lambda x: 10 * log10(x / list_avg(p)) > -20)) AS INTEGER) AS loud, round(list_avg(list_transform(range(1, 17), lambda i: list_dot_product(a[i], b[i]) / ((sqrt(list_dot_product(a[i], a[i])) + 1e-5) * (sqrt(list_dot_product(b[i], b[i])) + 1e-5)))), 6) AS frame_cosine FROM p""")
def frame_features(spark, d):
    frames = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(c, i * 4 + 1, F.lit(4)))
    s = signals(spark, d).withColumns({"a": frames("samples"), "b": frames("ref_samples")})
    return s.select("key", F.size(C.loud_frames("a")).alias("loud"), r6(C.frame_cosine("a", "b")).alias("frame_cosine"))


@query(f"SELECT vec_id AS key, CAST(100 AS INTEGER) AS n, round(list_sum({_VEC}) + list_sum(({_VEC})[1:36]), 6) AS total, round(list_sum(list_transform({_VEC}, lambda x: floor(x * 32767))) / 32767, 6) AS scaled FROM embeddings")
def signal_padding(spark, d):
    s = signals(spark, d)
    pcm = F.transform("samples", lambda x: F.floor(x * 32767))
    return s.select("key", F.size(C.repeat_to("samples", 100)).alias("n"), r6(C.total(C.repeat_to("samples", 100))).alias("total"), r6(C.total(C.normalise_pcm(pcm))).alias("scaled"))


def _longer(spark, d):
    """The stand-in signals repeated to half a second at 16 kHz, spread over all cores, as each takes some 0.1 s to score."""
    s = signals(spark, d).repartition(spark.sparkContext.defaultParallelism, "key")
    return s.select("key", F.lit(16000).alias("rate"), C.repeat_to("samples", 8000).alias("samples"), C.repeat_to("ref_samples", 8000).alias("ref_samples"))


@query()
def signal_metrics(spark, d):
    s = _longer(spark, d)
    return s.select("key", signal.signal_metric("samples", "ref_samples", "rate").alias("m")).select("key", "m.*")


@query()
def intelligibility(spark, d):
    return _longer(spark, d).select("key", signal.intelligibility("samples", "ref_samples", "rate").alias("m")).select("key", "m.*")


@query()
def enhancement_metrics(spark, d):
    return _longer(spark, d).select("key", signal.sepm("samples", "ref_samples", "rate").alias("m")).select("key", "m.*")


@query()
def chroma_alignment(spark, d):
    return _longer(spark, d).select("key", signal.chroma_metric("samples", "ref_samples", "rate").alias("m")).select("key", "m.*")


@query()
def dtw_alignment(spark, d):
    frames = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(c, i * 4 + 1, F.lit(4)))
    return signals(spark, d).select("key", signal.dtw_distance(frames("samples"), frames("ref_samples")).alias("distance"))


def _halving_sql() -> str:
    """Every second of 64 samples after the low-pass of the definition: a sinc of 20 samples a side in a Kaiser window (beta 5)."""
    k = np.arange(-20, 21)
    taps = np.sinc(k / 2) / 2 * np.kaiser(41, 5.0)
    taps = ", ".join(repr(float(t)) for t in taps / taps.sum())
    return f"""WITH v AS (SELECT vec_id AS key, {_VEC} AS v, [{taps}] AS h FROM embeddings), r AS (SELECT key, list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 41), lambda t: CASE WHEN 2 * i + t BETWEEN 20 AND 83 THEN h[t + 1] * v[2 * i + t - 19] ELSE 0 END))) AS x FROM v)
SELECT key, CAST(len(x) AS INTEGER) AS n, round(x[1], 6) AS first, round(x[17], 6) AS middle, round(x[32], 6) AS last, round(list_sum(x), 5) AS total FROM r"""


@query(_halving_sql())
def resample_signals(spark, d):
    x = signals(spark, d).select("key", signal.resampled("samples", F.col("rate"), F.lit(32)).alias("x"))
    return x.select("key", F.size("x").alias("n"), r6(F.col("x")[0]).alias("first"), r6(F.col("x")[16]).alias("middle"), r6(F.col("x")[31]).alias("last"), r6(C.total("x"), 5).alias("total"))


@query("""WITH e AS (SELECT user_id AS key, epoch(ts)::DOUBLE / 600 AS s, epoch(ts)::DOUBLE / 600 + abs(value) / 100 AS t FROM events),
o AS (SELECT *, max(t) OVER (PARTITION BY key ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM o),
k AS (SELECT key, g, min(s) AS s, max(t) AS t FROM g GROUP BY 1, 2) SELECT key, round(greatest(0.0, s - 0.03), 4) AS start, round(t + 0.03, 4) AS "end" FROM k WHERE t - s >= 0.25""")
def speech_segments(spark, d):
    e = table(spark, d, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 600
    seg = e.select(F.col("user_id").alias("key"), s.alias("start"), (s + F.abs("value") / 100).alias("end"))
    return rounded(chunking.merged_segments(seg), "start", "end", digits=4)


# --- sources and texts -----------------------------------------------------------------------


@query("SELECT c_name AS key, c_mktsegment AS path FROM customer")
def listing_scan(spark, d):
    lines = table(spark, d, "customer").select(F.concat("c_name", F.lit("   "), "c_mktsegment").alias("value"), F.col("c_custkey").alias("n"))
    return listings.parsed_lines(lines, order="n")


@query("SELECT CAST(event_id AS VARCHAR) AS key, 'score' AS metric, value FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), 'flag', CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END FROM events")
def json_scores(spark, d):
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("key"), F.col("value").alias("score"), (F.col("value") > 50).alias("flag"), F.col("event_type").alias("kind"), F.col("props")))
    return files.long_scores(e.select(line.alias("value")))


@query("SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1 UNION ALL SELECT 'user', round(avg(user_id), 6) FROM events")
def regex_scores(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit("x {'"), "event_type", F.lit("': "), F.col("value").cast("string"), F.lit(", 'user': "), F.col("user_id").cast("string"), F.lit("}"))
    return rounded(files.regex_scores(e.select(text.alias("value"))).groupBy("metric").agg(F.avg("value").alias("value")), "value")


@query("SELECT CAST(event_id AS VARCHAR) AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def score_listing(spark, d):
    lines = table(spark, d, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(" "), "props").alias("value"))
    return files.score_scp(lines).select("key", F.try_variant_get("scores", "$.k", "long").alias("k"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, replace(upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ẞ', 'SS') AS text FROM documents WHERE len(regexp_extract_all(text, '\\S+')) > 0")
def json_transcripts(spark, d):
    line = F.to_json(F.struct(F.struct(F.col("doc_id").alias("index")).alias("segment"), F.col("text").alias("scene")))
    return files.json_to_transcript(table(spark, d, "documents").select(line.alias("value")), "$.segment.index", "$.scene")


@query("SELECT event_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS error FROM events")
def described_items(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("answer"))
    return files.described(e).select("key", F.try_variant_get("description", "$.k", "long").alias("k"), "error")


@query("SELECT event_id AS key, 'Describe the recording that has these scores, as a JSON object.' || chr(10) || 'Scores: ' || props AS prompt FROM events")
def description_prompts(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("key"), files.prompt("props").alias("prompt"))


@query("SELECT event_id, CASE WHEN m >= 3600000 THEN printf('%02d:', m // 3600000) ELSE '' END || printf('%02d:%02d.%03d', m // 60000 % 60, m // 1000 % 60, m % 1000) AS clock FROM (SELECT event_id, CAST(event_id * 7125 AS BIGINT) AS m FROM events)")
def clock_times(spark, d):
    return table(spark, d, "events").select("event_id", C.timestamp(F.col("event_id") * 7.125).alias("clock"))


# --- answers ---------------------------------------------------------------------------------

#: Language and overlap have rules of their own beside the terms.
_KINDS = tuple(k for k in standardize.VOCABULARY if k not in ("language", "overlapping_speech"))


def _answer(kind: str) -> Column:
    terms = F.array(*(F.lit(t) for t in standardize.VOCABULARY[kind]))
    return F.concat(F.lit("Answer: it is "), F.element_at(terms, (F.col("c_custkey") % len(standardize.VOCABULARY[kind]) + 1).cast("int")), F.lit(", I think"))


def _answer_sql(kind: str) -> str:
    terms = ", ".join(f"'{t}'" for t in standardize.VOCABULARY[kind])
    return f"'Answer: it is ' || list_extract([{terms}], CAST(c_custkey % {len(standardize.VOCABULARY[kind])} + 1 AS BIGINT)) || ', I think'"


def _standard_sql(kind: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(lower({_answer_sql(kind)}), '(^|[^a-z0-9]){t.lower().replace('-', '[-]')}($|[^a-z0-9])') THEN '{t}'" for t in standardize.VOCABULARY[kind])
    return f"CASE {rules} END"


@query("SELECT c_custkey AS key, " + ", ".join(f"{_standard_sql(k)} AS qwen_{k}" for k in _KINDS) + ", CAST(least(greatest(c_custkey % 14, 1), 10) AS VARCHAR) AS qwen_speaker_count FROM customer")
def standardized_answers(spark, d):
    count = F.concat(F.lit("There are "), (F.col("c_custkey") % 14).cast("string"), F.lit(" speakers"))
    # a file of a million answers is one task, and each answer has hundreds of rules
    answers = table(spark, d, "customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    raw = answers.select(F.col("c_custkey").alias("key"), *(_answer(k).alias(f"qwen_{k}") for k in _KINDS), count.alias("qwen_speaker_count"))
    return standardize.standardize_row(raw)


_ALLOWED = tuple(k for k in standardize.ALLOWED if k != standardize.NUMERIC)


def _term(kind: str) -> Column:
    terms = standardize.VOCABULARY[kind]
    return F.element_at(F.array(*map(F.lit, terms)), (F.col("c_custkey") % len(terms) + 1).cast("int"))


def _allowed_sql(kind: str) -> str:
    terms = ", ".join(f"'{t}'" for t in standardize.VOCABULARY[kind])
    return f"CASE WHEN c_custkey % 3 < 2 THEN list_extract([{terms}], CAST(c_custkey % {len(standardize.VOCABULARY[kind])} + 1 AS BIGINT)) END AS qwen_{kind}"


@query("SELECT c_custkey AS key, " + ", ".join(map(_allowed_sql, _ALLOWED)) + ", CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS BIGINT) END AS qwen_speaker_count FROM customer")
def allowed_answers(spark, d):
    k = F.col("c_custkey")
    given = lambda kind: F.when(k % 3 < 2, _term(kind)).otherwise(F.concat(_term(kind), F.lit(".")))
    count = F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5")))
    raw = table(spark, d, "customer").select(k.alias("key"), *(given(kind).alias(f"qwen_{kind}") for kind in _ALLOWED), count.alias("qwen_speaker_count"), F.lit("x").alias("other"))
    return standardize.allow_list(raw)


@query("SELECT c_custkey AS key, c_mktsegment AS answer FROM customer")
def cleaned_answers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), standardize.clean_answer(F.concat(F.lit("  The category is "), "c_mktsegment", F.lit(" "))).alias("answer"))


@query("SELECT source AS file, count(*) AS processed, count(*) FILTER (quality = 1) AS successful, count(*) FILTER (quality IS DISTINCT FROM 1) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def job_stats(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return standardize.job_stats(both.select("source", (F.col("quality") == 1).alias("ok")), "source")


# --- registry and streams --------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('dependent', 'dict', 4, 4, 0), ('dependent', 'float', 16, 16, 0), ('distributional', 'dict', 1, 0, 0), ('distributional', 'float', 2, 0, 1), ('independent', 'dict', 7, 0, 0), ('independent', 'float', 11, 0, 0), ('independent', 'list', 1, 0, 0), ('independent', 'string', 44, 0, 0), ('non_match', 'dict', 6, 0, 6), ('non_match', 'float', 2, 2, 0)) t(category, type, n, with_reference, with_text)")
def metric_registry(spark, d):
    found = default_registry().table(spark).filter("available")
    return found.groupBy("category", "type").agg(*(F.count_if(c).cast("int").alias(n) for c, n in ((F.lit(True), "n"), (F.col("requires_reference"), "with_reference"), (F.col("requires_text"), "with_text"))))


@query("SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1")
def streamed_summary(spark, d):
    schema = table(spark, d, "events").schema
    stream = incremental.stream_table(spark, f"{d}/events.parquet*", schema).select(F.col("event_type").alias("metric"), "value")
    name = "summary_" + shared_folder(spark, "x").rsplit("-", 1)[1]
    q = incremental.running_summary(stream, name, shared_folder(spark, "stream"))
    q.awaitTermination()
    return rounded(spark.table(name), "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS metric, count(value) AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def windowed_summary(spark, d):
    return rounded(incremental.windowed_summary(table(spark, d, "events").select("ts", F.col("event_type").alias("metric"), "value")), "mean")


def queries() -> dict[str, Query]:
    from scorelake.plans import runs  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from scorelake.plans import runs  # noqa: F401

    return dict(SQL)
