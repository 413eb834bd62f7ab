"""Queries that take tables as records of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.numbers import rounded
from turnwise.operators import evaluating as E, ranking, training
from turnwise.registry import query
from turnwise.sources.tables import read


def _cells(spark, sf_dir):
    kept = (F.col("event_id") % 7).cast("long")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("variant"), F.when(F.col("event_id") % 11 == 0, "failed").otherwise("ok").alias("status"), F.floor("value").cast("double").alias("seconds"), kept.alias("kept"), (F.col("event_id") % 5).alias("proposed"), (F.col("event_id") % 2 * (F.col("event_id") % 5)).alias("rejected"))


@query("""SELECT event_type AS model, user_id % 3 AS variant, count(*) AS cells, (CAST(printf('%.2f', CAST(avg(floor(value)) AS DOUBLE)) AS DOUBLE) + 0.0) AS mean_seconds, (CAST(printf('%.3f', CAST(avg(event_id % 7) AS DOUBLE)) AS DOUBLE) + 0.0) AS mean_kept,
    (CAST(printf('%.3f', CAST(sum(event_id % 2 * (event_id % 5)) / nullif(sum(event_id % 5), 0) AS DOUBLE)) AS DOUBLE) + 0.0) AS rejected_share FROM events WHERE event_id % 11 <> 0 GROUP BY ALL""")
def bench_metrics(spark, sf_dir):
    return E.group_metrics(_cells(spark, sf_dir), ["model", "variant"])


@query("SELECT CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS cells FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    return _cells(spark, sf_dir).groupBy("status").agg(F.count("*").alias("cells"))


@query("SELECT o_orderpriority AS model, o_orderstatus AS reason, count(*) * 2 AS n FROM orders GROUP BY ALL")
def reason_counts(spark, sf_dir):
    cells = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.create_map("o_orderstatus", F.lit(2)).alias("reasons"))
    return E.summed_reasons(cells, ["model"])


@query("""WITH w AS (SELECT o_custkey % 50 AS call, o_orderkey AS item, [o_orderkey % 97, o_orderkey % 89 + 100] AS ids FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT o_custkey % 50 AS call, o_orderkey % 97 AS id FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000),
    h AS (SELECT w.call, w.item, bool_or(f.id IS NOT NULL) AS hit FROM (SELECT call, item, unnest(ids) AS id FROM w) w LEFT JOIN f USING (call, id) GROUP BY ALL)
    SELECT call, count(*) AS wanted, count(*) FILTER (hit) AS hit, (CAST(printf('%.4f', CAST(count(*) FILTER (hit) / count(*) AS DOUBLE)) AS DOUBLE) + 0.0) AS recall FROM h GROUP BY 1""")
def action_recall(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("call", F.col("o_custkey") % 50)
    wanted = orders.where("o_orderstatus = 'F'").select("call", F.col("o_orderkey").alias("item"), F.array(F.col("o_orderkey") % 97, F.col("o_orderkey") % 89 + 100).alias("ids"))
    found = orders.where("o_orderstatus = 'O' and o_totalprice > 300000").select("call", F.array(F.col("o_orderkey") % 97).alias("ids"))
    return E.set_recall(wanted, found, ["call"])


@query("SELECT quality AS gold, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS said, count(*) AS n FROM labels JOIN documents d USING (doc_id) GROUP BY ALL")
def confusion(spark, sf_dir):
    return E.confusion(_said(spark, sf_dir), "quality", "said")


def _said(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") > 1500).cast("int").alias("said"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id")


@query("""WITH c AS (SELECT quality AS gold, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS said FROM labels JOIN documents d USING (doc_id)), l AS (SELECT gold AS label FROM c UNION SELECT said FROM c),
    k AS (SELECT label, (SELECT count(*) FROM c WHERE gold = label) AS g, (SELECT count(*) FROM c WHERE said = label) AS s, (SELECT count(*) FROM c WHERE said = label AND gold = label) AS r FROM l)
    SELECT label, (CAST(printf('%.4f', CAST(r / nullif(s, 0) AS DOUBLE)) AS DOUBLE) + 0.0) AS precision, (CAST(printf('%.4f', CAST(r / nullif(g, 0) AS DOUBLE)) AS DOUBLE) + 0.0) AS recall, (CAST(printf('%.4f', CAST(2 * r / nullif(g + s, 0) AS DOUBLE)) AS DOUBLE) + 0.0) AS f1 FROM k""")
def precision_recall(spark, sf_dir):
    return E.class_scores(_said(spark, sf_dir), "quality", "said")


@query("""WITH s AS (SELECT quality AS y, d.n_chars AS x FROM labels JOIN documents d USING (doc_id)), r AS (SELECT y, avg(k) OVER (PARTITION BY x) AS rk FROM (SELECT y, x, row_number() OVER (ORDER BY x) AS k FROM s))
    SELECT (CAST(printf('%.6f', CAST((sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS DOUBLE)) AS DOUBLE) + 0.0) AS auc FROM r""")
def auc(spark, sf_dir):
    return E.auc(_said(spark, sf_dir), "quality", "n_chars")


@query("""WITH v AS (SELECT o_orderpriority AS judge, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS f, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS s, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'tie' END AS h FROM orders)
    SELECT judge, count(*) AS pairs, (CAST(printf('%.4f', CAST(avg(CASE WHEN (CASE WHEN f = s THEN f ELSE 'tie' END) = h THEN 1.0 ELSE 0.0 END) AS DOUBLE)) AS DOUBLE) + 0.0) AS agreement FROM v GROUP BY 1""")
def judge_agreement(spark, sf_dir):
    pick = lambda c: F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (F.col(c) % 3 + 1).cast("int"))
    human = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("tie")
    return E.judge_agreement(read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("judge"), pick("o_orderkey").alias("first"), pick("o_custkey").alias("second"), human.alias("human")))


MATRIX_SQL = "SELECT n_name AS model, r_name AS variant, s AS seed, n_name || '__' || r_name || '__' || s AS cell FROM nation CROSS JOIN region CROSS JOIN (VALUES (1), (2), (3)) t(s)"


def _matrix(spark, sf_dir):
    return E.run_matrix(read(spark, sf_dir, "nation").select(F.col("n_name").alias("model")), read(spark, sf_dir, "region").select(F.col("r_name").alias("variant")), spark.createDataFrame([(1,), (2,), (3,)], "seed int"))


@query(MATRIX_SQL)
def bench_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(f"SELECT cell FROM ({MATRIX_SQL}) m JOIN nation n ON m.model = n.n_name WHERE NOT (n.n_nationkey % 2 = 0 AND seed = 1)")
def resume_matrix(spark, sf_dir):
    done = _matrix(spark, sf_dir).join(read(spark, sf_dir, "nation").select(F.col("n_name").alias("model"), "n_nationkey"), "model").where("n_nationkey % 2 = 0 and seed = 1").select("cell", F.lit("ok").alias("status"))
    return E.still_to_run(_matrix(spark, sf_dir), done).select("cell")


@query()
def test_retest(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_orderkey") / 32).alias("call"), F.col("l_linenumber").alias("seed"))  # a cell has 32 lines at most
    reading = F.struct(F.col("l_linestatus").alias("speaker"), F.when(F.col("l_suppkey") % 2 == 0, "stance").otherwise("unsaid").alias("layer"), F.array(F.col("l_partkey") % 9, F.col("l_partkey") % 5).alias("turns"))
    cells = line.agg(F.array_sort(F.collect_list(F.struct("l_orderkey", reading.alias("r")))).alias("_r")).select(F.col("l_returnflag").alias("model"), "call", "seed", F.transform("_r", lambda x: x["r"]).alias("readings"))
    return E.test_retest(cells, ["model"])


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY value, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id % 3 ORDER BY value, event_id) * 2 - 2 AS doubled FROM events""")
def running_places(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("user_id") % 3).alias("third"))
    return ranking.running_sums(rows, ["value", "event_id"], {"place": F.lit(1), "doubled": F.lit(2)}, ["third"]).select("user_id", "event_id", "place", "doubled")


@query("""WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, rank, value FROM k WHERE rank IN (0, n // 10, n // 2, n - 1)""")
def selected_ranks(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", "value")
    asked = rows.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", F.explode(F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 10), F.floor(F.col("n") / 2), F.col("n") - 1))).alias("rank"))
    return ranking.selected(rows, ["event_type"], "value", asked)


@query()
def trained_head(spark, sf_dir):
    """Macro-F1 of each penalty, over all folds and in each, of the languages of texts by counts of their letters."""
    letters = "aeiounrstldcmäéñçßöüèó"
    text = F.lower(F.col("text"))
    share = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.length(text)
    docs = read(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").alias("id"), F.array(*map(share, letters)).alias("x"), F.col("lang").alias("label"))
    report = training.cross_validated(docs.dropDuplicates(["id"]))[1]
    return report.select("penalty", "fold", rounded("f1", 3).alias("f1"))
