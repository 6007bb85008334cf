"""Human against judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from answergauge.functions import text as tx
from answergauge.functions.verdicts import CRITERIA
from answergauge.operators import agreement as ag
from answergauge.operators.runs import melt, stack_runs
from answergauge.plans import inputs as src
from answergauge.plans.registry import collector

QUERIES, query = collector()

KEYS = ["run_id", "doc_id", "category"]


def _pairs(spark, sf):
    return ag.pair_columns(src.rated_sheet(spark, sf), KEYS, src.PAIRS)


def _long_verdicts(spark, sf):
    """The long verdict table of both raters."""
    raters = {
        "human": melt(src.human_ratings(spark, sf), ["doc_id"], {c: f"human_{c}" for c in CRITERIA}),
        "judge": melt(src.judge_ratings(spark, sf), ["doc_id"], src.JUDGE),
    }
    return stack_runs(raters, tag="rater")


_GAP = f"({src.sql_ordinal('judge')}) - ({src.sql_ordinal('human')})"
_AGREEMENT = f"""count(*) AS n,
  round(avg((human = judge)::INT), 6) AS agreement,
  round(avg({_GAP}), 6) AS bias,
  count(*) FILTER (WHERE human <> judge) AS disagreements"""


@query(f"WITH {src.PAIRS_SQL} SELECT criterion, {_AGREEMENT} FROM comparable GROUP BY criterion")
def rater_agreement(spark, sf):
    return ag.agreement(_pairs(spark, sf), ["criterion"]).select(
        "criterion", "n", F.round("agreement", 6).alias("agreement"),
        F.round("bias", 6).alias("bias"), "disagreements")


@query(f"""WITH {src.PAIRS_SQL} SELECT category, criterion, {_AGREEMENT}
FROM comparable GROUP BY category, criterion""")
def agreement_by_category(spark, sf):
    return ag.agreement(_pairs(spark, sf), ["category", "criterion"]).select(
        "category", "criterion", "n", F.round("agreement", 6).alias("agreement"),
        F.round("bias", 6).alias("bias"), "disagreements")


@query(f"WITH {src.PAIRS_SQL} SELECT doc_id, criterion, human, judge FROM pairs")
def rater_alignment(spark, sf):
    return ag.align_raters(_long_verdicts(spark, sf), ["doc_id"])


@query(f"""WITH {src.PAIRS_SQL}
SELECT rpad(criterion, 10, ' ') AS criterion, count(*) AS n,
  printf('%.1f%%', avg((human = judge)::INT) * 100) AS agreement,
  printf('%+.2f', avg({_GAP})) AS bias
FROM comparable GROUP BY ALL""")
def agreement_table(spark, sf):
    rates = ag.agreement(_pairs(spark, sf), ["criterion"])
    return rates.select(
        F.rpad("criterion", 10, " ").alias("criterion"), "n",
        tx.percent(F.col("agreement")).alias("agreement"), tx.signed(F.col("bias")).alias("bias"))


@query(f"""WITH {src.PAIRS_SQL} SELECT criterion, human, judge, count(*) AS n
FROM comparable GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return ag.confusion(_pairs(spark, sf), ["criterion"])


@query(f"""WITH {src.PAIRS_SQL} SELECT criterion, human,
  count(*) FILTER (WHERE judge = 'good') AS judge_good,
  count(*) FILTER (WHERE judge = 'ok') AS judge_ok,
  count(*) FILTER (WHERE judge = 'bad') AS judge_bad
FROM comparable GROUP BY ALL""")
def confusion_matrix_wide(spark, sf):
    return ag.confusion_wide(_pairs(spark, sf), ["criterion"])


@query(f"""WITH {src.PAIRS_SQL} SELECT criterion, count(*) AS n,
  count(*) FILTER (WHERE {_GAP} > 0) AS more_generous,
  count(*) FILTER (WHERE {_GAP} < 0) AS harsher,
  round(count(*) FILTER (WHERE {_GAP} > 0) / count(*), 6) AS share_generous,
  round(count(*) FILTER (WHERE {_GAP} < 0) / count(*), 6) AS share_harsher
FROM comparable GROUP BY criterion""")
def disagreement_direction(spark, sf):
    n = F.col("n")
    return ag.agreement(_pairs(spark, sf), ["criterion"]).select(
        "criterion", "n", "more_generous", "harsher",
        F.round(F.col("more_generous") / n, 6).alias("share_generous"),
        F.round(F.col("harsher") / n, 6).alias("share_harsher"))


@query(f"""WITH {src.PAIRS_SQL}
SELECT criterion, c.run_id, c.doc_id, human, judge, left(text, 200) AS answer_preview,
  string_split(text, chr(10))[1] AS question, judge || ' for ' || criterion AS judge_explanation
FROM comparable c JOIN documents d USING (doc_id) WHERE human <> judge
ORDER BY criterion, run_id, doc_id""")
def disagreement_report(spark, sf):
    answers = src.documents(spark, sf).select(
        "doc_id", tx.preview(F.col("text"), 200).alias("answer_preview"),
        F.element_at(F.split("text", "\n", 2), 1).alias("question"))
    explained = _pairs(spark, sf).withColumn("judge_explanation", F.concat_ws(" for ", "judge", "criterion"))
    report = ag.disagreement_report(explained, answers, ["doc_id"], ["run_id", "doc_id"])
    return report.select("criterion", "run_id", "doc_id", "human", "judge", "answer_preview", "question",
        "judge_explanation")


@query(f"""WITH {src.PAIRS_SQL}
SELECT criterion, run_id, doc_id, human, judge, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY run_id, doc_id) AS rank
  FROM comparable WHERE human <> judge) WHERE rank <= 10""")
def first_disagreements(spark, sf):
    top = ag.first_disagreements(_pairs(spark, sf), ["run_id", "doc_id"], 10)
    return top.select("criterion", "run_id", "doc_id", "human", "judge", "rank")


@query(f"""WITH {src.PAIRS_SQL}, rates AS (
  SELECT category, criterion, count(*) AS n, avg({_GAP}) AS bias,
    count(*) FILTER (WHERE {_GAP} > 0) AS up, count(*) FILTER (WHERE {_GAP} < 0) AS down
  FROM comparable GROUP BY ALL)
SELECT category, criterion, n, round(bias, 6) AS bias FROM rates
WHERE n >= 20 AND abs(bias) >= 0.3
  AND CASE WHEN bias > 0 THEN down ELSE up END / nullif(up + down, 0) <= 0.2""")
def bias_alarm(spark, sf):
    alarms = ag.bias_alarm(
        _pairs(spark, sf), ["category", "criterion"], min_rows=20, min_bias=0.3, max_opposite=0.2)
    return alarms.select("category", "criterion", "n", F.round("bias", 6).alias("bias"))
