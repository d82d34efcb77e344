"""Mixing sources to target weights by soft membership.

1. A classifier is learned from the labelled table: the domains are combinations
   of its labels (``good``: quality 1, ``plain``: quality 0, ``toxic``: toxic 1).
   Document frequencies of words, by domain, over a bounded sample of labelled rows
   give a vocabulary (the words whose presence tells domains apart the most) and
   the weights of a Bernoulli naive Bayes model.
2. Every document gets a posterior over the domains from its whole text.
3. Nonnegative rates r_i, one per document, are fitted so that the expected
   domain token totals  sum_i r_i n_i p_id  meet the targets: accelerated
   projected gradient on the squared (whitened) error, with documents weighted by
   their tokens and all rates starting at 1.  An iteration is one distributed sum over a
   narrow table; what crosses the driver is a vector with a number per domain.
   The rate of a document is a function of its posterior and of those vectors,
   so no state per document is kept between iterations.

Only DataFrame functions are used.  Bounds: ``TRAIN_ROWS`` labelled rows, 256
vocabulary words, three domains, ``ITERATIONS`` vectors; words are
pre-aggregated before the shuffle, and nothing is grouped by document.

Defined cases: null texts are empty and have no tokens; a document without
tokens gets a rate like others but weighs nothing; null or other label values
and labels of unknown documents are not trained on; a document with several
label rows counts once, by the largest label; a domain without rows has a prior
of one pseudo-row and no evidence; rows that repeat a doc_id are documents of their own;
extra columns are ignored; without tokens all rates are 1.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

#: Shares of all tokens that the mixed corpus shall have, by domain.
TARGETS = {"good": 0.85, "plain": 0.12, "toxic": 0.03}
#: Tokens of the mixed corpus, as a multiple of the input's.
VOLUME = 1.0
TRAIN_ROWS = 20_000
VOCABULARY = 256
ITERATIONS = 60
TOLERANCE = 1e-5


def words(text: str = "text") -> Column:
    """Lower-case words of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("plain")


def train(docs: DataFrame, labels: DataFrame, domains: list[str], rows: int = TRAIN_ROWS, size: int = VOCABULARY) -> dict:
    """{'prior': [..], 'absent': [..], 'weights': {word: [..]}}: log-probabilities per domain.

    The sample is the ``rows`` labelled documents with the smallest hashes of their id."""
    known = labels.where("quality in (0, 1) and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", domain().alias("domain"))
    sample = C.written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "mix-sample")
    texts = C.split_by(docs, sample)[0].join(sample, "doc_id").select("domain", F.array_distinct(words()).alias("w"))
    texts = C.written(texts, "mix-words")
    n = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = [n.get(d, 0) + 1 for d in domains]  # a pseudo-row each
    counts = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    table = texts.select("domain", F.explode("w").alias("word")).groupBy("word").agg(*counts)
    # how much the presence of a word tells domains apart: a chi-squared sum over domains
    seen = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))
    chi2 = sum(((F.col(f"n{k}") - seen * t / sum(total)) ** 2 / (seen * t / sum(total)) for k, t in enumerate(total)), F.lit(0.0))
    chosen = table.where(seen >= 3).select("word", chi2.alias("chi2"), *(f"n{k}" for k in range(len(domains)))).orderBy(F.desc("chi2"), "word").limit(size).collect()
    absent, weights = [0.0] * len(domains), {}
    for r in chosen:
        # a domain's pseudo-row has the pooled frequency, so that a domain without rows has no evidence
        pooled = (sum(r[f"n{k}"] for k in range(len(domains))) + 0.5) / (sum(total) + 1)
        p = [(r[f"n{k}"] + pooled) / t for k, t in enumerate(total)]
        weights[r["word"]] = [math.log(x / (1 - x)) for x in p]
        absent = [a + math.log(1 - x) for a, x in zip(absent, p)]
    return {"prior": [math.log(t / sum(total)) for t in total], "absent": absent, "weights": weights}


def _log_sum(base: float, weights: list[float]) -> Column:
    """``base`` plus the weights at the places in ``found_at``."""
    if not weights:
        return F.lit(base)
    row = F.array(*[F.lit(w) for w in weights])
    return F.aggregate("found_at", F.lit(base), lambda a, i: a + F.element_at(row, i))


def memberships(docs: DataFrame, model: dict, domains: list[str]) -> DataFrame:
    """The columns of ``docs`` but for text, n_tokens, and p: array of the domains' probabilities given the words that are present."""
    vocabulary = sorted(model["weights"])
    keep = [c for c in docs.columns if c != "text"]
    if vocabulary:
        at = F.create_map(*[x for k, w in enumerate(vocabulary) for x in (F.lit(w), F.lit(k + 1))])
        found = F.transform(F.array_intersect("w", F.array(*[F.lit(w) for w in vocabulary])), lambda w: F.element_at(at, w))
    else:
        found = F.array().cast("array<int>")
    out = docs.select(*keep, words().alias("w")).select(*keep, F.size("w").cast("long").alias("n_tokens"), found.alias("found_at"))
    ways = range(len(domains))
    out = out.select(*keep, "n_tokens", *(
        _log_sum(model["prior"][k] + model["absent"][k], [model["weights"][w][k] for w in vocabulary]).alias(f"l{k}") for k in ways))
    top = F.greatest(*(F.col(f"l{k}") for k in ways))
    exps = [F.exp(F.col(f"l{k}") - top) for k in ways]
    whole = sum(exps[1:], exps[0])
    return out.select(*keep, "n_tokens", F.array(*[e / whole for e in exps]).alias("p"))


def rates(p: Column, steps: list[tuple[list[float], float]]) -> Column:
    """The rate after all steps (gradient vector scaled by the step size, momentum), from 1.

    Each step: new = max(0, look - p.v); look = new + momentum (new - old)."""
    if not steps:
        return F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    table = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in v]).alias("v"), F.lit(float(m)).alias("m")) for v, m in steps])
    size = len(steps[0][0])

    def step(s: Column, e: Column) -> Column:
        pull = sum((F.element_at(p, k + 1) * F.element_at(e["v"], k + 1) for k in range(size)), F.lit(0.0))
        new = F.greatest(F.lit(0.0), s["y"] - pull)
        return F.struct(new.alias("r"), (new + e["m"] * (new - s["r"])).alias("y"))

    return F.aggregate(table, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), step)


def fit(members: DataFrame, targets: list[float], volume: float = VOLUME, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> list:
    """Gradient steps that lead the expected domain totals to ``targets`` (shares of the mixed volume).

    The squares are of residuals whitened by the second moments m of the
    posteriors (token-weighted), which makes the gradient's Lipschitz constant
    1: the pull on a document is its posterior times m**-1 times the residual."""
    d = len(targets)
    goal = np.array([volume * t / sum(targets) for t in targets])
    moments = [F.sum(F.col("n_tokens") * F.element_at("p", i + 1) * F.element_at("p", j + 1)).alias(f"m{i}_{j}") for i in range(d) for j in range(i, d)]
    first = members.agg(F.sum("n_tokens").alias("n"), *moments).first()
    total = float(first["n"] or 0)
    if not total:
        return []
    m = np.array([[float(first[f"m{min(i, j)}_{max(i, j)}"]) / total for j in range(d)] for i in range(d)])
    m += np.eye(d) * 1e-9 * np.trace(m)  # a domain without mass pulls on nobody
    steps: list[tuple[list[float], float]] = []
    momentum, before = 1.0, np.full(d, np.inf)
    shape = members.select("n_tokens", "p")
    for _ in range(iterations):
        state = rates(F.col("p"), steps)
        sums = shape.select("n_tokens", "p", state.alias("s")).agg(
            *(F.sum(F.col("n_tokens") * F.element_at("p", k + 1) * F.col("s.y")).alias(f"y{k}") for k in range(d)),
            *(F.sum(F.col("n_tokens") * F.element_at("p", k + 1) * F.col("s.r")).alias(f"r{k}") for k in range(d))).first()
        reached = np.array([float(sums[f"r{k}"]) / total for k in range(d)])
        # on target, or as near as nonnegative rates come: a tenth of the tolerance is not gained any more
        if np.abs(reached - goal).max() <= tolerance or np.abs(reached - before).max() < tolerance / 10:
            break
        before = reached
        residual = np.array([float(sums[f"y{k}"]) / total for k in range(d)]) - goal
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        steps.append((np.linalg.solve(m, residual).tolist(), (momentum - 1) / following))
        momentum = following
    return steps


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, volume: float = VOLUME) -> DataFrame:
    """doc_id, source, n_tokens, p_<domain>..., domain (the likeliest), rate, and
    copies: the rate rounded up or down by a hash of the id, so that its
    expectation is the rate."""
    C.prepare(docs.sparkSession)
    domains = sorted(targets)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    model = train(docs.select("doc_id", "text"), labels, domains)
    members = C.written(memberships(docs, model, domains), "memberships")
    steps = fit(members, [targets[k] for k in domains], volume)
    out = members.withColumn("rate", rates(F.col("p"), steps)["r"])
    uniform = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    best = F.element_at(F.array(*[F.lit(k) for k in domains]), F.array_position("p", F.array_max("p")).cast("int"))
    return out.select("doc_id", "source", "n_tokens", *(F.element_at("p", k + 1).alias(f"p_{name}") for k, name in enumerate(domains)),
                      best.alias("domain"), "rate", F.floor(F.col("rate") + uniform).cast("long").alias("copies"))


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates of all ``documents`` for the production targets, domains learned from ``labels``."""
    return mix(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
