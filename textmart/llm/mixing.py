"""Mixing to target weights with soft membership, in DataFrame operations only.

A table of labels (document, domain) teaches a classifier the domains: naive Bayes over binned surface features of the
text, fitted from one aggregate over all labelled rows. Every document then belongs to each domain by its posterior p.
Rates r >= 0, one per document (how often it is to be taken), are fitted so that the expected tokens of each domain,
sum of r x tokens x p, come to their targets: least squares by projected gradient, starting from r = 1. A gradient
step is an aggregate of one number per domain over the documents; it moves a document's rate by its posteriors times
these numbers and cuts it off at 0, so the rates need not be stored: they are an expression over the posteriors. In
variables scaled by the square root of the tokens and with residuals weighted by the inverse of sum tokens x p p', the
step length is 1. That sum goes over the documents whose rates are above 0, as only they can give way; where such a step
does not lower the loss it is taken back, and one with the sum over all documents, which cannot overshoot, is taken.
Steps end when all targets are met, or when none lowers the loss (no rates meet these targets), or after `steps` of them;
`Mixture.missed` is what is left, and unless it is nothing there is a warning.

Only numbers per domain, feature and bin come to the driver; at most DOMAINS domains. Features and posteriors are
expressions on the text, so `mix` adds columns to any documents without a join; whole texts count. Cases: a null text
is empty and has no tokens. Rows without id, or labels without a domain, are not learned from; of several labels of a
document the largest counts. Rows that repeat are each rated. A target for a domain that no label has is left out and
the others are scaled up; a domain without a target has target 0. Without labels, tokens or targets all rates are 1.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmart.llm.common import at_rest, column, fresh

TARGETS = {"1": 0.8, "0": 0.2}  # shares of the tokens by quality label
DOMAINS = 64
BINS = 12
STEPS = 40
PROGRESS = 1e-6  # of the loss: less is no progress
CLOSE = 1e-9     # of all tokens: largest residual at which steps end

_TOKEN = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def features(text: Column, n: Column) -> list[Column]:
    """Shares of capitals, digits, marks and unusual signs, word length, line and text length."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))

    def share(others: str) -> Column:
        return F.length(F.regexp_replace(text, others, "")) / size

    return [share("[^A-Z]+"), share("[^0-9]+"), share(r"[^.,;:'\"?()-]+"), share(r"[^!|*$%&#@<>={}\[\]\\^~_+/]+"),
            F.length(text) / F.greatest(n, F.lit(1)), F.log1p(n.cast("double"))]


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """A small symmetric system, one number per domain; directions of no weight are left out."""
    n = len(b)
    rows = [list(map(float, row)) + [float(v)] for row, v in zip(a, b)]
    scale = max((abs(rows[i][i]) for i in range(n)), default=0.0)
    for i in range(n):
        rows[i][i] += 1e-9 * scale
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        if abs(rows[i][i]) <= 1e-14 * scale or scale == 0:
            continue
        for k in range(n):
            if k != i:
                times = rows[k][i] / rows[i][i]
                rows[k] = [x - times * y for x, y in zip(rows[k], rows[i])]
    return [rows[i][n] / rows[i][i] if scale and abs(rows[i][i]) > 1e-14 * scale else 0.0 for i in range(n)]


@dataclass
class Classifier:
    """Log probabilities by domain, feature and bin, and the bins' upper limits by feature."""

    domains: list[str]
    prior: list[float]
    limits: list[list[float]]
    logs: list[list[list[float]]]

    def scores(self, values: list[Column]) -> list[Column]:
        """A log score per domain, given the feature values."""
        bins = [sum((F.when(v > c, 1).otherwise(0) for c in limits), F.lit(0)) if limits else F.lit(0)
                for v, limits in zip(values, self.limits)]
        return [sum((F.element_at(F.array(*[F.lit(x) for x in row]), b + 1) for row, b in zip(rows, bins)), F.lit(prior))
                for prior, rows in zip(self.prior, self.logs)]


def _with_posteriors(df: DataFrame, values: list[Column], classifier: Classifier, name: str) -> DataFrame:
    """Adds an array of posteriors; scores are computed once, in a column that goes again."""
    taken = fresh([*df.columns, name], "scores")
    scored = df.withColumn(taken, F.array(*classifier.scores(values)))
    shifted = F.transform(column(scored, taken), lambda s: F.exp(s - F.array_max(column(scored, taken))))
    raised = scored.withColumn(taken, shifted)
    whole = F.aggregate(column(raised, taken), F.lit(0.0), lambda a, b: a + b)
    return raised.withColumn(name, F.transform(column(raised, taken), lambda s: s / whole)).drop(taken)


def fit_classifier(labelled: DataFrame, names: list[str], bins: int = BINS) -> Classifier | None:
    """`labelled` has `domain` and the features `names`."""
    classes = sorted(r[0] for r in labelled.select("domain").distinct().limit(DOMAINS + 1).collect())
    if not classes:
        return None
    if len(classes) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains")
    cuts = labelled.agg(*[F.percentile_approx(n, [i / bins for i in range(1, bins)], 10_000) for n in names]).first()
    limits = [sorted(set(c or [])) for c in cuts]
    placed = labelled.select("domain", F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature"), sum((F.when(F.col(n) > c, 1).otherwise(0) for c in limits[i]), F.lit(0)).alias("bin"))
        for i, n in enumerate(names)])))
    counts = {(r["domain"], r["feature"], r["bin"]): r["count"]
              for r in placed.groupBy("domain", "feature", "bin").count().collect()}
    sizes = {d: sum(counts.get((d, 0, b), 0) for b in range(len(limits[0]) + 1)) for d in classes}
    total = sum(sizes.values())

    logs = [[[math.log((counts.get((d, f, b), 0) + 0.5) / (sizes[d] + 0.5 * (len(limits[f]) + 1)))
              for b in range(len(limits[f]) + 1)] for f in range(len(names))] for d in classes]
    return Classifier(classes, [math.log(sizes[d] / total) for d in classes], limits, logs)


@dataclass
class Mixture:
    classifier: Classifier | None
    steps: list[list[float]]      # per gradient step, a number per domain
    totals: list[float]           # expected tokens per domain with the fitted rates
    targets: list[float]
    missed: float = 0.0           # largest distance of a total from its target, as a share of all tokens

    def rate(self, posteriors: Column) -> Column:
        rate = F.lit(1.0)
        for step in self.steps:
            move = sum((posteriors[k] * F.lit(g) for k, g in enumerate(step)), F.lit(0.0))
            rate = F.greatest(F.lit(0.0), rate - move)
        return rate


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id",
        text_col: str = "text", domain_col: str = "quality", steps: int = STEPS) -> Mixture:
    """Classifier and rates for `docs`; `labels` has `id_col` and `domain_col`."""
    targets = TARGETS if targets is None else targets
    text = column(docs, text_col).cast("string")
    counted = docs.select(column(docs, id_col).alias("id"), text.alias("text"), tokens(text).alias("n"))
    values = features(F.col("text"), F.col("n"))
    names = [f"f{i}" for i in range(len(values))]
    thin = at_rest(counted.select("id", "n", *[v.alias(name) for v, name in zip(values, names)]), "mixing-features")
    truth = (labels.select(column(labels, id_col).alias("id"), column(labels, domain_col).cast("string").alias("domain"))
             .where("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.max("domain").alias("domain")))
    classifier = fit_classifier(at_rest(thin.join(truth, "id").select("domain", *names), "mixing-labelled"), names)
    if classifier is None:
        return Mixture(None, [], [], [])
    domains = range(len(classifier.domains))
    soft = at_rest(_with_posteriors(thin.select("n", *names), [F.col(n) for n in names], classifier, "p").select("n", "p"),
                   "mixing-posteriors")
    p = [F.col("p")[k] for k in domains]
    all_tokens = soft.agg(F.sum("n")).first()[0] or 0
    wanted = [max(0.0, targets.get(d, 0.0)) for d in classifier.domains]
    if not all_tokens or not sum(wanted):
        return Mixture(classifier, [], [], [])
    goal = [all_tokens * w / sum(wanted) for w in wanted]
    square = soft.agg(*[F.sum(F.col("n") * p[i] * p[j]) for i in domains for j in domains]).first()
    square = [[square[i * len(domains) + j] for j in domains] for i in domains]
    mixture = Mixture(classifier, [], [], goal)

    def measure() -> tuple[list[float], list[list[float]]]:
        """Residuals, and sum n p p' over the documents whose rates are above 0."""
        rated = soft.select("n", "p", mixture.rate(F.col("p")).alias("rate"))
        above = F.when(F.col("rate") > 0, F.col("n")).otherwise(0)
        sums = rated.agg(*[F.sum(F.col("n") * F.col("rate") * x) for x in p],
                         *[F.sum(above * p[i] * p[j]) for i in domains for j in domains]).first()
        mixture.totals = [float(v) for v in sums[:len(domains)]]
        residual = [a - b for a, b in zip(mixture.totals, goal)]
        mixture.missed = max(map(abs, residual)) / all_tokens
        rest = sums[len(domains):]
        return residual, [[float(rest[i * len(domains) + j]) for j in domains] for i in domains]

    def loss(residual: list[float]) -> float:
        return sum(r * g for r, g in zip(residual, _solve(square, residual)))

    residual, active = measure()
    careful = False  # the step by all documents never overshoots
    while mixture.missed > CLOSE and len(mixture.steps) < steps:
        mixture.steps.append(_solve(square if careful else active, residual))
        before, (found, among) = loss(residual), measure()
        if loss(found) < before * (1 - PROGRESS):
            residual, active, careful = found, among, False
            continue
        mixture.steps.pop()
        measure()
        if careful:
            break
        careful = True
    if mixture.missed > CLOSE:
        warnings.warn(f"mixing: a target is missed by {mixture.missed:.3g} of all tokens after {len(mixture.steps)} steps",
                      stacklevel=2)
    return mixture


def mix(docs: DataFrame, mixture: Mixture, text_col: str = "text", rate_col: str = "rate",
        posteriors_col: str | None = None) -> DataFrame:
    """`docs`, all columns, with each row's rate (and its posteriors, in the order of the classifier's domains)."""
    name = posteriors_col or fresh([*docs.columns, rate_col], "posteriors")
    if mixture.classifier is None:
        rated = docs.withColumn(rate_col, F.lit(1.0))
        return rated.withColumn(name, F.array().cast("array<double>")) if posteriors_col else rated
    text = column(docs, text_col).cast("string")
    # Values in columns of their own, so that each feature is computed once.
    n = fresh([*docs.columns, rate_col, name], "n_of_text")
    wide = docs.withColumn(n, tokens(text))
    values = features(column(wide, text_col).cast("string"), column(wide, n))
    names = []
    for i, value in enumerate(values):
        names.append(fresh([*wide.columns, rate_col, name], f"feature{i}"))
        wide = wide.withColumn(names[-1], value)
    soft = _with_posteriors(wide, [column(wide, f) for f in names], mixture.classifier, name).drop(n, *names)
    rated = soft.withColumn(rate_col, mixture.rate(column(soft, name)))
    return rated if posteriors_col else rated.drop(name)
