"""Evaluation of ranked results: runs (qid, doc, rank), judgments (qid, doc, rel); unjudged documents count 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query(runs: DataFrame, qrels: DataFrame, n: int = 10, p: float = 0.8) -> DataFrame:
    """All metrics at n of each query of the run, from one sort of its judged results.

    precision, recall, f1, ap (over relevant found), ap_all (over all relevant), ndcg (gain 2^rel - 1, ideal from
    the retrieved n), ndcg_binary (ideal from all relevant), rbp, rr, bpref, retrieved, relevant, found.
    """
    judged = runs.join(qrels, ["qid", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    total = qrels.groupBy("qid").agg(F.count_if(F.col("rel") > 0).alias("relevant"), F.count_if(F.col("rel") == 0).alias("irrelevant"))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("rel") > 0).cast("int")
    known = judged.withColumns({"hits": F.sum(hit).over(w), "misses": F.sum(1 - hit).over(w), "ideal_rank": F.row_number().over(Window.partitionBy("qid", F.col("rank") <= n).orderBy(F.desc("rel"), "rank"))})
    top = F.col("rank") <= n
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    inside = lambda c: F.sum(F.when(top, c).otherwise(0.0))
    sums = known.groupBy("qid").agg(
        F.count("*").alias("retrieved"), F.sum(hit).alias("found"), inside(hit).alias("at"), inside(hit * F.col("hits") / F.col("rank")).alias("s"), F.sum(hit * F.col("hits") / F.col("rank")).alias("s_all"),
        inside(gain / F.log2(1.0 + F.col("rank"))).alias("dcg"), inside(gain / F.log2(1.0 + F.col("ideal_rank"))).alias("idcg"), inside(hit / F.log2(1.0 + F.col("rank"))).alias("bdcg"),
        (F.lit(1 - p) * F.sum(F.least(F.col("rel"), F.lit(1)) * F.pow(F.lit(p), F.col("rank") - 1))).alias("rbp"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"), F.collect_list(F.when(hit == 1, F.col("misses"))).alias("above"),
    ).join(total, "qid", "left").na.fill(0, ["relevant", "irrelevant"])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    precision, recall = F.col("at") / n, ratio(F.col("at"), F.col("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(n), F.col("relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    bpref = F.aggregate("above", F.lit(0.0), lambda s, m: s + 1 - F.least(m, F.col("irrelevant")) / F.greatest(F.col("irrelevant"), F.lit(1)))
    return sums.select(
        "qid", "retrieved", "relevant", "found", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(F.col("s"), F.col("at")).alias("ap"), ratio(F.col("s_all"), F.col("relevant")).alias("ap_all"),
        ratio(F.col("dcg"), F.col("idcg")).alias("ndcg"), F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("bdcg") / ideal).alias("ndcg_binary"), "rbp", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), ratio(bpref, F.col("relevant")).alias("bpref"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """Mean of every metric over the queries."""
    return metrics.agg(*[F.avg(c).alias(c) for c in metrics.columns if c != "qid"])


def risk_reward(a: DataFrame, b: DataFrame, metric: str, alpha: float = 1.0) -> DataFrame:
    """Of run a over baseline b: mean loss, mean gain, their trade-off, and the share of queries won less lost."""
    d = F.col("a") - F.col("b")
    both = a.select("qid", F.col(metric).alias("a")).join(b.select("qid", F.col(metric).alias("b")), "qid")
    risk, reward = F.avg(F.greatest(F.lit(0.0), -d)), F.avg(F.greatest(F.lit(0.0), d))
    return both.agg(risk.alias("risk"), reward.alias("reward"), (reward - (1 + alpha) * risk).alias("tradeoff"), F.avg(F.signum(d)).alias("robustness"))


def paired_t(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """t statistic and degrees of freedom of the paired differences."""
    d = a.select("qid", F.col(metric).alias("a")).join(b.select("qid", F.col(metric).alias("b")), "qid").select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.when(F.stddev_samp("d") == 0, 0.0).otherwise(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("*")))).alias("t"), (F.count("*") - 1).alias("df"))


def rank_changes(old: DataFrame, new: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevant documents' moves between two runs: old rank - new rank, POS or NEG."""
    both = old.select("qid", "doc", F.col("rank").alias("old")).join(new.select("qid", "doc", F.col("rank").alias("new")), ["qid", "doc"]).join(qrels.where("rel > 0"), ["qid", "doc"], "left_semi")
    move = F.col("old") - F.col("new")
    return both.select("qid", "doc", move.alias("move"), F.when(move > 0, "POS").when(move < 0, "NEG").otherwise("SAME").alias("kind"))


def spearman(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns within each key; ties take distinct places."""
    ra = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(a), b))
    rb = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(b), a))
    return df.withColumns({"_a": ra, "_b": rb}).groupBy(key).agg(F.when(F.count("*") < 2, 0.0).otherwise(1 - 6 * F.sum((F.col("_a") - F.col("_b")) ** 2) / (F.count("*") * (F.count("*") ** 2 - 1))).alias("rho"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each label, with its counts."""
    t = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), (F.col(truth) == F.col(predicted)).cast("int").alias("tp"), F.lit(0).alias("p"), F.lit(1).alias("t")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x")).select("x.*")
    s = t.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "p", "t")])
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("t"))
    return s.select("label", F.col("t").alias("support"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def kappa(a: Column, b: Column) -> tuple[Column, Column]:
    """Agreement aggregates of two boolean judges: Cohen's kappa with pooled margins, and observed agreement."""
    same = F.avg((a == b).cast("double"))
    pooled = (F.avg(a.cast("double")) + F.avg(b.cast("double"))) / 2
    chance = pooled**2 + (1 - pooled) ** 2
    return F.when(chance == 1, 1.0).otherwise((same - chance) / (1 - chance)), same


def micro_macro(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: precision, recall and F1 over all decisions, and their means over labels."""
    rows = confusion(df, truth, predicted)
    n = df.agg(F.count("*").alias("n"), F.sum((F.col(truth) == F.col(predicted)).cast("int")).alias("tp"))
    macro = rows.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return n.select((F.col("tp") / F.col("n")).alias("micro_f1")).crossJoin(macro)
