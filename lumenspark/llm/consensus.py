"""Consensus scores from evaluators of unequal care.

A confusion model is fitted by mean-field variational inference: a Dirichlet prior
on the frequencies of the true scores of each dimension and on each row of each
evaluator's confusion matrix for that dimension (which scores are given where a true
score holds): one may be careful on one dimension only. Every update is a group-by:
  * items: the expected log likelihoods of an item's ratings are summed, and
    normalised over the five scores;
  * evaluators: the items' probabilities are summed by evaluator and given score,
    the prior is added, and digamma turns the counts into expected logarithms.
The steps end when the variational bound no longer rises (TOLERANCE of itself).

Ratings are held once, a row for each question with its ratings as numbers. A step
reads that table, adds up in each task and groups the sums by evaluator and given
score; what comes to the driver is five numbers for each of them, and goes back as a
table of expected logarithms. An evaluator counts once for a question, so a row is
never longer than four times the evaluators, whose number is checked; beyond
SHARED_EVALUATORS the same steps run as joins of tables, and nothing is sent round.

A form counts if it is the evaluator's latest for the question (the time, then the
form's id, decide); ids are equal regardless of case and outer blanks; only whole
scores from 1 to 5 of that form count.

Defined cases: null or blank evaluator ids, null questions and null times (which
come before all others) never crash a run, and rows without evaluator or question
do not count; a form delivered twice counts once; questions with fewer than three
counting scores on a dimension get no label there; ties of probability go to the
score nearest the plain mean, then to the lower; an empty table gives empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspark.session import cut_lineage

DIMENSIONS = ("question_clarity", "option_quality", "medical_accuracy", "overall_quality")
SCORES = (1, 2, 3, 4, 5)
#: Prior counts: of each true score; of giving the true score, one beside it, any other.
CLASS_PRIOR, RIGHT, NEAR, OTHER = 1.0, 4.0, 1.0, 0.4
LEAST_RATERS = 3
#: The steps end when the bound rises by less than this share of itself.
TOLERANCE = 1e-6
#: Evaluators whose tables are sent to every task, at most (800 bytes each).
SHARED_EVALUATORS = 100_000


def digamma(x: Column) -> Column:
    """Digamma of a positive value: the recurrence up to x + 6, then the asymptotic series. In lambdas, where x is bound once."""
    y = x + 6
    series = F.log(y) - 0.5 / y - 1 / (12 * y * y) + 1 / (120 * y * y * y * y)
    for k in range(6):
        series = series - 1 / (x + k)
    return series


def counting_scores(forms: DataFrame) -> DataFrame:
    """(question_id, dimension, evaluator, score): the scores that count."""
    who = F.lower(F.trim("evaluator_id"))
    known = forms.filter(F.col("question_id").isNotNull() & F.col("evaluator_id").isNotNull() & (F.trim("evaluator_id") != ""))
    kept = known.select("question_id", who.alias("evaluator"), F.struct("submitted_at", "evaluation_id", *DIMENSIONS).alias("form"))
    latest = kept.groupBy("question_id", "evaluator").agg(F.max_by("form", F.struct(F.col("form.submitted_at"), F.col("form.evaluation_id"))).alias("form"))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"form.{d}").alias("score")) for d in DIMENSIONS)))
    rated = latest.select("question_id", "evaluator", each.alias("r")).select("question_id", "evaluator", "r.dimension", "r.score")
    return rated.filter(F.col("score").isin(*map(float, SCORES))).select("question_id", "dimension", "evaluator", F.col("score").cast("int").alias("score"))


def _prior(true: int, given: int) -> float:
    return RIGHT if true == given else NEAR if abs(true - given) == 1 else OTHER


def _bound(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _normalised(logs: Column) -> Column:
    """Probabilities of an array of logarithms."""
    raised = _bound(logs, lambda x: _bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return _bound(raised, lambda x: _bound(F.aggregate(x, F.lit(0.0), add), lambda total: F.transform(x, lambda v: v / total)))


def _sums(values: Column) -> Column:
    """Sums of the five runs of five."""
    return F.array(*(F.aggregate(F.slice(values, 5 * i + 1, 5), F.lit(0.0), add) for i in range(5)))


class Fit:
    """items: (question_id, dimension, n, mean, q); counts: (evaluator, dimension, c, w): expected counts by true, then given score, and of the true scores."""

    def __init__(self, items: DataFrame, counts: DataFrame):
        self.items, self.counts = items, counts


_PRIOR = np.array([[_prior(true, given) for given in SCORES] for true in SCORES])


def _psi(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers, as the column function above."""
    y = x + 6
    return np.log(y) - 0.5 / y - 1 / (12 * y * y) + 1 / (120 * y**4) - sum(1 / (x + k) for k in range(6))


def _kl(post: np.ndarray, prior: np.ndarray) -> float:
    """Divergence of Dirichlet rows from their priors."""
    ln = np.vectorize(math.lgamma, otypes=[float])
    d = post - prior
    each = ln(post.sum(-1)) - ln(post).sum(-1) - ln(prior.sum(-1)) + ln(prior).sum(-1) + (d * (_psi(post) - _psi(post.sum(-1, keepdims=True)))).sum(-1)
    return float(each.sum())


def _posterior(codes: pa.Array, logs: np.ndarray, classes: np.ndarray, n_evaluators: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of rating codes: the codes, each rating's item (row and dimension), the items' probabilities, the logarithms of their sums."""
    code, at = codes.flatten().to_numpy(zero_copy_only=False), np.diff(codes.offsets.to_numpy())
    item = np.repeat(np.arange(len(codes)), at) * len(DIMENSIONS) + code // (5 * n_evaluators)
    n = len(codes) * len(DIMENSIONS)
    s = np.stack([np.bincount(item, logs[code, k], n) for k in range(5)], 1) + np.tile(classes, (len(codes), 1))
    top = s.max(1, keepdims=True)
    z = np.exp(s - top)
    return code, item, z / z.sum(1, keepdims=True), top[:, 0] + np.log(z.sum(1))


def _part(b: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for lo in range(0, b.num_rows, 4096):
        part = b.slice(lo, 4096)
        yield part, pa.concat_arrays([part.column(name)])


def fit(ratings: DataFrame, shared: int = SHARED_EVALUATORS) -> Fit:
    spark = ratings.sparkSession
    names = [r[0] for r in ratings.select("evaluator").distinct().orderBy("evaluator").limit(shared + 1).collect()]
    if len(names) > shared:
        return _fit_joined(ratings)
    n_e, n_d = len(names), len(DIMENSIONS)
    number = F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(names)], "evaluator string, no int"))  # checked above
    dim = F.array_position(F.array(*map(F.lit, DIMENSIONS)), F.col("dimension")).cast("int") - 1
    code = (dim * n_e + F.col("no")) * 5 + F.col("score") - 1
    coded = ratings.join(number, "evaluator").groupBy("question_id").agg(F.collect_list(code).alias("codes"))
    coded = cut_lineage(coded)  # read by every step
    counts, classes = np.zeros((n_d, n_e, 5, 5)), np.zeros((n_d, 5))  # by true, then given score
    before = None
    while True:
        post, post_c = counts + _PRIOR, classes + CLASS_PRIOR
        logs = _psi(post) - _psi(post.sum(-1, keepdims=True))
        held = spark.sparkContext.broadcast((np.ascontiguousarray(logs.transpose(0, 1, 3, 2)).reshape(-1, 5), _psi(post_c) - _psi(post_c.sum(-1, keepdims=True)), n_e))

        def step(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            logs, of_class, n_e = held.value
            sums, bound, many = np.zeros((len(logs), 5)), 0.0, np.zeros((len(DIMENSIONS), 5))
            for b in batches:
                for _, codes in _part(b, "codes"):
                    code, item, q, z = _posterior(codes, logs, of_class, n_e)
                    for k in range(5):
                        sums[:, k] += np.bincount(code, q[item, k], len(logs))
                    rated = np.unique(item)
                    bound += z[rated].sum()
                    for k in range(5):
                        many[:, k] += np.bincount(rated % len(DIMENSIONS), q[rated, k], len(DIMENSIONS))
            at = np.flatnonzero(sums.any(1))
            keys = np.r_[at, -1 - np.arange(len(DIMENSIONS)), -100]
            values = np.vstack([sums[at], many, [[bound, 0, 0, 0, 0]]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(values[:, k]) for k in range(5))], names=["code", *"abcde"])

        # The group-by of a step: five numbers for each evaluator, dimension and given score.
        total = coded.select("codes").mapInArrow(step, "code bigint, a double, b double, c double, d double, e double").groupBy("code").agg(*(F.sum(x).alias(x) for x in "abcde"))
        got = {r[0]: r[1:] for r in total.collect()}
        bound = got.pop(-100, (0.0,))[0] - _kl(post, np.broadcast_to(_PRIOR, post.shape)) - _kl(post_c, np.full_like(post_c, CLASS_PRIOR))
        if before is not None and bound - before <= TOLERANCE * abs(bound):
            break
        before = bound
        classes = np.array([got.pop(-1 - d, np.zeros(5)) for d in range(n_d)])
        flat = np.zeros((n_d * n_e * 5, 5))
        for k, v in got.items():
            flat[k] = v
        counts = flat.reshape(n_d, n_e, 5, 5).transpose(0, 1, 3, 2)

    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, of_class, n_e = held.value
        for b in batches:
            for part, codes in _part(b, "codes"):
                code, item, q, _ = _posterior(codes, logs, of_class, n_e)
                n = np.bincount(item, minlength=len(q))
                at = np.flatnonzero(n)
                mean = np.bincount(item, code % 5 + 1.0, len(q))[at] / n[at]
                yield pa.RecordBatch.from_arrays(
                    [part.column("question_id").take(pa.array(at // len(DIMENSIONS))), pa.array(DIMENSIONS).take(pa.array(at % len(DIMENSIONS))), pa.array(n[at]), pa.array(mean), pa.array(list(q[at]), pa.list_(pa.float64()))], names=["question_id", "dimension", "n", "mean", "q"]
                )

    rows = [(names[e], DIMENSIONS[d], counts[d, e].ravel().tolist(), classes[d].tolist()) for d in range(n_d) for e in range(n_e) if counts[d, e].any()]
    table = spark.createDataFrame(rows, "evaluator string, dimension string, c array<double>, w array<double>")
    return Fit(coded.mapInArrow(items, "question_id bigint, dimension string, n bigint, mean double, q array<double>"), table)


def _fit_joined(ratings: DataFrame) -> Fit:
    """The same steps as joins of tables, for any number of evaluators; they end when the counts change by less than a ten thousandth."""
    ratings = cut_lineage(ratings)
    zero = ratings.select("evaluator", "dimension").distinct().withColumn("c", F.array_repeat(F.lit(0.0), 25))
    counts = zero.join(F.broadcast(ratings.sparkSession.createDataFrame([(d, [0.0] * 5) for d in DIMENSIONS], "dimension string, w array<double>")), "dimension")
    while True:
        items = cut_lineage(_items(ratings, counts))
        shares = [F.sum(F.when(F.col("score") == given, F.col("q")[true - 1]).otherwise(0.0)) for true in SCORES for given in SCORES]
        held = items.groupBy("dimension").agg(F.array(*(F.sum(F.col("q")[k]) for k in range(5))).alias("w"))  # one row for each dimension
        c = ratings.join(items.select("question_id", "dimension", "q"), ["question_id", "dimension"]).groupBy("evaluator", "dimension").agg(F.array(*shares).alias("c"))
        new = cut_lineage(c.join(F.broadcast(held), "dimension").select("evaluator", "dimension", "c", "w"))
        far = F.aggregate(F.zip_with("c", "o", lambda x, y: F.abs(x - y)), F.lit(0.0), add)
        moved, all_ = new.join(counts.select("evaluator", "dimension", F.col("c").alias("o")), ["evaluator", "dimension"]).agg(F.sum(far), F.sum(F.aggregate("c", F.lit(0.0), add))).first()
        counts = new
        if not all_ or moved <= 1e-4 * all_:
            return Fit(items, counts)


def _items(ratings: DataFrame, counts: DataFrame) -> DataFrame:
    """The items' probabilities under the evaluators' counts (a few numbers for each evaluator)."""
    prior = F.array(*(F.lit(_prior(true, given)) for true in SCORES for given in SCORES))
    with_prior = counts.select("evaluator", "dimension", F.zip_with("c", prior, add).alias("c"))
    cells = with_prior.select("evaluator", "dimension", F.transform("c", digamma).alias("cell"), F.transform(_sums(F.col("c")), digamma).alias("row"))
    log = F.transform("cell", lambda v, i: v - F.col("row")[F.floor(i / 5).cast("int")])
    # For each given score the logarithm of its probability under each true score.
    given = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: F.filter("log", lambda v, i: i % 5 == s))).alias("at", "l")
    logs = cells.select("evaluator", "dimension", log.alias("log")).select("evaluator", "dimension", given)
    logs = logs.select("evaluator", "dimension", (F.col("at") + 1).alias("score"), "l")
    held = counts.groupBy("dimension").agg(F.transform(F.first("w"), lambda v: v + CLASS_PRIOR).alias("w"))
    classes = held.select("dimension", _bound(F.aggregate("w", F.lit(0.0), add), lambda t: F.transform("w", lambda v: digamma(v) - digamma(t))).alias("p"))
    sums = ratings.join(logs, ["evaluator", "dimension", "score"]).groupBy("question_id", "dimension").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.array(*(F.sum(F.col("l")[i]) for i in range(5))).alias("s")
    )
    joined = sums.join(F.broadcast(classes), "dimension")  # one row for each dimension
    return joined.select("question_id", "dimension", "n", "mean", _normalised(F.zip_with("s", "p", add)).alias("q"))


def labels(forms: DataFrame, least: int = LEAST_RATERS) -> DataFrame:
    """(question_id, dimension, label, probability, n_raters) of every question and dimension with enough scores."""
    items = fit(counting_scores(forms)).items.filter(F.col("n") >= least)
    # Ties of probability (to nine places) go to the score nearest the mean, then to the lower.
    ranked = F.array(*(F.struct(F.round(F.col("q")[k - 1], 9).alias("q"), (-F.abs(F.col("mean") - k)).alias("near"), F.lit(-k).alias("low")) for k in SCORES))
    best = F.array_max(ranked)
    return items.select("question_id", "dimension", (-best["low"]).cast("bigint").alias("label"), best["q"].alias("probability"), F.col("n").cast("bigint").alias("n_raters"))


def reliability(forms: DataFrame) -> DataFrame:
    """(evaluator, dimension, n_scores, accuracy, low, high): posterior mean of giving the true score, and its 95 % interval.

    Each row of an evaluator's matrix is a Dirichlet posterior, so the chance of giving true score k is a Beta one;
    they are weighed by how frequent the true scores are, and the interval is that of a Beta with the sum's mean and variance.
    """
    counts = fit(counting_scores(forms)).counts
    prior = F.array(*(F.lit(_prior(true, given)) for true in SCORES for given in SCORES))
    post = counts.select("evaluator", "dimension", F.aggregate("c", F.lit(0.0), add).alias("n"), F.zip_with("c", prior, add).alias("p"), F.transform("w", lambda v: v + CLASS_PRIOR).alias("w"))
    hit, row, share = F.filter("p", lambda v, i: i % 6 == 0), _sums(F.col("p")), F.col("w")
    held = post.select("evaluator", "dimension", "n", F.arrays_zip(hit.alias("a"), row.alias("t"), share.alias("w")).alias("z"), F.aggregate("w", F.lit(0.0), add).alias("all"))
    total = lambda body: F.aggregate(F.transform("z", body), F.lit(0.0), add)
    mean = total(lambda z: z["w"] / F.col("all") * z["a"] / z["t"])
    spread = total(lambda z: (z["w"] / F.col("all")) ** 2 * z["a"] * (z["t"] - z["a"]) / (z["t"] * z["t"] * (z["t"] + 1)))
    sums = held.select("evaluator", "dimension", "n", mean.alias("m"), spread.alias("v")).withColumn("k", F.col("m") * (1 - F.col("m")) / F.col("v") - 1)
    # The Beta's interval through the logit's normal approximation.
    a, b = F.col("m") * F.col("k"), (1 - F.col("m")) * F.col("k")
    logit, sd = F.log(a / b), F.sqrt(1 / a + 1 / b)
    bound = lambda z: 1 / (1 + F.exp(-(logit + z * sd)))
    return sums.select("evaluator", "dimension", F.round("n").cast("bigint").alias("n_scores"), F.round("m", 6).alias("accuracy"), F.round(bound(-1.96), 6).alias("low"), F.round(bound(1.96), 6).alias("high"))


def agreement(forms: DataFrame) -> DataFrame:
    """(dimension, n_items, n_scores, alpha): Krippendorff's alpha with interval differences, of items with two scores or more."""
    by_value = counting_scores(forms).groupBy("question_id", "dimension", "score").agg(F.count(F.lit(1)).alias("n"))
    item = by_value.groupBy("question_id", "dimension").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s"), F.sum(F.col("n") * F.col("score") ** 2).alias("s2")
    )
    paired = item.filter("n >= 2")
    # Pairs' squared differences of an item come from its sums: 2 (n s2 - s s).
    sums = paired.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"),
        F.sum((F.col("n") * F.col("s2") - F.col("s") * F.col("s")) * 2 / (F.col("n") - 1)).alias("within"),
    )
    observed = F.col("within") / F.col("n")
    expected = (F.col("n") * F.col("s2") - F.col("s") * F.col("s")) * 2 / (F.col("n") * (F.col("n") - 1))
    alpha = F.when(expected > 0, 1 - observed / expected)
    return sums.select("dimension", "n_items", F.col("n").alias("n_scores"), F.round(alpha, 6).alias("alpha"))
