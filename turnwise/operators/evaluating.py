"""Metrics of runs: ratios, agreement, recall, confusion, ranking, retest matching and the run matrix."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from turnwise.functions.numbers import rounded
from turnwise.operators.ranking import running_sums


def group_metrics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of cells with status ok: count, mean seconds and kept, and the ratio of sums rejected to proposed (null without any)."""
    return cells.where("status = 'ok'").groupBy(*keys).agg(
        F.count("*").alias("cells"), rounded(F.avg("seconds"), 2).alias("mean_seconds"), rounded(F.avg("kept"), 3).alias("mean_kept"), rounded(F.expr("try_divide(sum(rejected), sum(proposed))"), 3).alias("rejected_share"),
    )


def summed_reasons(cells: DataFrame, keys: list[str], reasons: str = "reasons") -> DataFrame:
    """Maps of counts added up: keys, reason, n."""
    return cells.select(*keys, F.explode(reasons).alias("reason", "_n")).groupBy(*keys, "reason").agg(F.sum("_n").alias("n"))


def set_recall(wanted: DataFrame, found: DataFrame, keys: list[str], ids: str = "ids") -> DataFrame:
    """(keys, wanted, hit, recall): a wanted row is hit if some found row of its keys shares an id.

    Ids are exploded and joined with the keys, so that no pair of rows is made that shares none.
    """
    w = wanted.withColumn("_row", F.xxhash64(*keys, "item"))
    hit = w.select(*keys, "_row", F.explode(ids).alias("_id")).join(found.select(*keys, F.explode(ids).alias("_id")).distinct(), [*keys, "_id"], "left_semi").select(*keys, "_row").distinct().withColumn("_hit", F.lit(1))
    return w.join(hit, [*keys, "_row"], "left").groupBy(*keys).agg(F.count("*").alias("wanted"), F.count("_hit").alias("hit"), rounded(F.count("_hit") / F.count("*"), 4).alias("recall"))


def confusion(rows: DataFrame, gold: str, said: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(said).alias("said")).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, gold: str, said: str) -> DataFrame:
    """Precision, recall and F1 of each class; null where there is nothing to divide by."""
    cells = confusion(rows, gold, said)
    right = F.sum(F.when(F.col("gold") == F.col("said"), F.col("n")).otherwise(0))
    by_gold = cells.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("_g"), right.alias("_r"))
    by_said = cells.groupBy(F.col("said").alias("label")).agg(F.sum("n").alias("_s"))
    both = by_gold.join(by_said, "label", "full").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("_g", "_s", "_r")))
    return both.select("label", rounded(F.expr("try_divide(_r, _s)"), 4).alias("precision"), rounded(F.expr("try_divide(_r, _g)"), 4).alias("recall"), rounded(F.expr("try_divide(2 * _r, _g + _s)"), 4).alias("f1"))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by ranks, ties at their mean. Scores are counted first, and distinct scores summed by ranges of them: no task has all."""
    by_score = rows.groupBy(F.col(score).alias("_x")).agg(F.count("*").alias("_n"), F.sum(label).alias("_p"))
    ranked = running_sums(by_score, ["_x"], {"_below": F.col("_n")}).withColumn("_mean", F.col("_below") + (F.col("_n") + 1) / 2)
    return ranked.agg(F.sum(F.col("_p") * F.col("_mean")).alias("_sum"), F.sum("_p").alias("_pos"), F.sum("_n").alias("_all")).select(rounded(F.expr("try_divide(_sum - _pos * (_pos + 1) / 2, _pos * (_all - _pos))"), 6).alias("auc"))


def judge_agreement(votes: DataFrame) -> DataFrame:
    """A preference counts if both orders agree, else it is a tie; agreement is the share equal to the human's."""
    said = votes.withColumn("said", F.when(F.col("first") == F.col("second"), F.col("first")).otherwise("tie"))
    return said.groupBy("judge").agg(F.count("*").alias("pairs"), rounded(F.avg((F.col("said") == F.col("human")).cast("double")), 4).alias("agreement"))


def run_matrix(*axes: DataFrame) -> DataFrame:
    """All combinations of a few short axes, which the user lists, and their name."""
    out = axes[0]
    for axis in axes[1:]:
        out = out.crossJoin(F.broadcast(axis))
    return out.withColumn("cell", F.concat_ws("__", *(F.col(c).cast("string") for c in out.columns)))


def still_to_run(matrix: DataFrame, done: DataFrame) -> DataFrame:
    return matrix.join(done.where(F.col("status").isin("ok", "skipped")).select("cell"), "cell", "left_anti")


def matched_readings(a: list[dict], b: list[dict]) -> int:
    """Greedy one-to-one matches: the first unused of b with the same speaker and layer that shares at least half the turns of the smaller."""
    used: set[int] = set()
    for x in a:
        for k, y in enumerate(b):
            turns = set(x["turns"]), set(y["turns"])
            if k not in used and x["speaker"] == y["speaker"] and x["layer"] == y["layer"] and all(turns) and 2 * len(turns[0] & turns[1]) >= min(map(len, turns)):
                used.add(k)
                break
    return len(used)


def test_retest(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean Jaccard overlap of the readings of consecutive seeds of a call; both empty count as 1.

    cells: keys, call, seed, readings (array of speaker, layer, turns). The greedy matching depends on the order, hence Python on a few readings a pair.
    """
    after = F.lead("readings").over(Window.partitionBy(*keys, "call").orderBy("seed"))
    pairs = cells.withColumn("_next", after).where("_next is not null")

    @F.pandas_udf("double")
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            a, b = list(a), list(b)
            m = matched_readings(a, b)
            out.append(1.0 if not a and not b else m / (len(a) + len(b) - m))
        return pd.Series(out)

    return pairs.withColumn("_j", jaccard("readings", "_next")).groupBy(*keys).agg(F.count("*").alias("pairs"), rounded(F.avg("_j"), 3).alias("jaccard"))
