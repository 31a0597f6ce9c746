"""Operator 3, mixing sources to target weights: soft-membership mixing, in DataFrame operations only.

1. A naive Bayes classifier over the ``VOCABULARY`` words met in most labelled documents is counted on a bounded sample
   of a labelled table (id, domain): a small table of a log likelihood for each word and domain.
2. Every document's words meet that table; the sums by document give posteriors. The evidence of a document counts as at
   most ``EVIDENCE`` words, so memberships stay soft.
3. Document rates r >= 0 minimise sum_k (sum_d n_d p_dk r_d - t_k)^2 / s_k by projected gradient steps in the metric of
   the tokens n_d, from r = 1, with s_k = sum_d n_d p_dk. In that metric the gradient of document d is
   sum_k p_dk rho_k, where rho_k is the residual of domain k over s_k, and its Lipschitz constant is at most 1. One
   iteration is one aggregate of K numbers; rates are a function of a document's posteriors and of the K residuals of each
   iteration so far, so no state of documents is shipped between iterations, and a lost executor costs nothing but its
   part of one scan. Step lengths are spectral (Barzilai and Borwein), from 1 to ``LONGEST``, and come from the same
   sums; where the error has grown beyond that of the last five iterations, the step is ``STEP``. Every ``REBASE`` iterations the rates are written, and go on from there. Iterations end when the
   targets are met to ``TOLERANCE``, or when a step moves no more than ``STILL`` of the tokens: the projected gradient is zero, the
   targets are met as nearly as the bounds of the rates allow. :class:`Fit` says which, and what was reached.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, UPPER, discard, fresh, written

#: Defaults of the classifier's parameters: labelled documents, words, and words that a document's evidence counts as at most.
SAMPLE, VOCABULARY, EVIDENCE = 10_000, 4096, 20
STEP, LONGEST, ITERATIONS, TOLERANCE, STILL, REBASE = 1.6, 1e4, 100, 1e-4, 1e-7, 20


def _words(text: str) -> Column:
    return F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), "[ \\t\\n\\x0B\\f\\r]+")


def _tall(docs: DataFrame) -> DataFrame:
    return docs.select("_id", F.explode(_words("_text")).alias("w"))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> tuple[DataFrame, list[float]]:
    """The word table (w, s0, s1, ...) and the log priors (None for a domain without labelled documents).

    ``docs``: (_id, _text). ``labelled``: (_id, domain); of its ids the ``sample`` with the smallest hash count, each with
    its smallest domain. The words are the ``vocabulary`` met in most of these documents.
    """
    known = labelled.filter(F.col("domain").isin(domains) & F.col("_id").isNotNull()).groupBy("_id").agg(F.min("domain").alias("domain"))
    chosen = written(known.orderBy(F.xxhash64("_id"), "_id").limit(sample), "chosen")
    # at most ``sample`` rows of an id and a name
    found = docs.join(F.broadcast(chosen.withColumnRenamed("_id", "_key")), F.col("_id") == F.col("_key"))
    met = found.select("_id", "domain", F.explode(_words("_text")).alias("w")).filter("w != ''")
    counts = [F.sum((F.col("domain") == d).cast("double")).alias(f"c{k}") for k, d in enumerate(domains)]
    words = met.groupBy("w", "_id", "domain").agg(F.count("*").alias("n")).groupBy("w").agg(F.count("*").alias("docs"), *counts)
    table = written(words.orderBy(F.desc("docs"), "w").limit(vocabulary), "words")
    total = table.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0.0)).alias(f"c{k}") for k in range(len(domains))), F.count("*").alias("v")).first()
    seen = {r.domain: r.n for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    logs = [F.log((F.col(f"c{k}") + 0.5) / F.lit(total[f"c{k}"] + 0.5 * max(1, total.v))) for k in range(len(domains))]
    prior = [math.log(seen[d] / sum(seen.values())) if seen.get(d) else None for d in domains]
    return table.select("w", *(x.alias(f"s{k}") for k, x in enumerate(logs))), prior


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], evidence: int = EVIDENCE, **sizes: int) -> DataFrame:
    """Per id: _id, n_tokens, p0, p1, ... (0 for a domain without labelled documents; equal if no domain has any)."""
    table, prior = classifier(docs, labelled, domains, **sizes)
    k_all = range(len(domains))
    sums = [F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"s{k}") for k in k_all]
    # at most ``vocabulary`` rows
    scored = _tall(docs).join(F.broadcast(table), "w", "left").groupBy("_id").agg(F.count_if(F.col("w") != "").alias("n_tokens"), F.count("s0").alias("known"), *sums)
    live = [k for k in k_all if prior[k] is not None] or list(k_all)
    part = F.least(F.lit(float(evidence)), F.col("known")) / F.greatest(F.col("known"), F.lit(1))
    logit = {k: F.lit(prior[k] or 0.0) + part * F.col(f"s{k}") for k in live}
    with_logits = scored.select("_id", "n_tokens", *(x.alias(f"l{k}") for k, x in logit.items()))
    top = F.greatest(*(F.col(f"l{k}") for k in live)) if len(live) > 1 else F.col(f"l{live[0]}")
    with_top = with_logits.withColumn("top", top)
    total = sum((F.exp(F.col(f"l{k}") - F.col("top")) for k in live), F.lit(0.0))
    p = [(F.exp(F.col(f"l{k}") - F.col("top")) / total if k in live else F.lit(0.0)).alias(f"p{k}") for k in k_all]
    return with_top.select("_id", "n_tokens", *p)


@dataclass
class Fit:
    """What a fit has reached, by sorted domain."""

    targets: list[float]  # shares of the tokens
    reached: list[float]
    iterations: int
    met: bool  # to TOLERANCE
    converged: bool  # met, or no step changes anything


def _rate(residuals: list[list[float]], least: float, most: float) -> Column:
    """The rate after these iterations, whose residuals are multiplied by their steps, from the column ``base``."""
    r = F.col("base")
    for rho in residuals:
        step = sum((F.col(f"p{k}") * F.lit(x) for k, x in enumerate(rho)), F.lit(0.0))
        r = F.least(F.lit(most), F.greatest(F.lit(least), r - step))
    return r


def fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", least: float = 0.0, most: float = 1e9, tokens: float | None = None, **model: int) -> tuple[DataFrame, Fit]:
    """Per id: _id, n_tokens, p0.. (posteriors, in the order of sorted targets), rate; and what was reached.

    ``targets``: domain -> weight; the expected tokens of domain k are to be ``tokens`` times its share. ``tokens`` is all
    tokens if None, or where ``least`` is above 0 as many as the domains need whose documents are too many already.
    Rates lie in [least, most]. Rows that repeat an id are one document. Null and empty texts have no tokens and get the
    rate of the prior. A target domain without labelled documents can't be reached and is left out of the fit. An empty
    table gives an empty table. Columns other than id and text are not read. ``model``: the classifier's parameters.
    """
    domains = sorted(targets)
    weight = sum(targets.values())
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    table = written(posteriors(own, labelled, domains, **model).withColumn("base", F.lit(1.0)), "posteriors")
    names = [c for c in table.columns if c != "base"]
    mass = [F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{k}")), F.lit(0.0)).alias(f"m{k}") for k in range(len(domains))]
    s = list(table.agg(*mass).first())
    share = [targets[d] / weight if s[k] > 0 else 0.0 for k, d in enumerate(domains)]
    share = [x / (sum(share) or 1) for x in share]
    if tokens is None:
        tokens = sum(s) if least <= 0 else max((least * s[k] / share[k] for k in range(len(s)) if share[k] > 0), default=0.0)
    residuals: list[list[float]] = []
    fit = [F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p{k}") * F.col("rate")), F.lit(0.0)) for k in range(len(s))]
    change = F.abs(F.col("rate") - F.col("before"))
    moved = [F.coalesce(F.sum(F.col("n_tokens") * x), F.lit(0.0)) for x in (change, change * change)]
    done, errors, last = 0, [], None
    while True:
        *got, move, square = table.withColumns({"rate": _rate(residuals, least, most), "before": _rate(residuals[:-1], least, most)}).agg(*fit, *moved).first()
        gap = [g - tokens * x for g, x in zip(got, share, strict=True)]
        rho = [g / x if x > 0 else 0.0 for g, x in zip(gap, s, strict=True)]
        met = max(map(abs, gap), default=0.0) <= TOLERANCE * tokens
        still = done > 0 and move <= STILL * tokens
        if met or still or done >= ITERATIONS:
            break
        step, error = STEP, sum(g * r for g, r in zip(gap, rho, strict=True))
        if last is not None and error <= max(errors[-5:]):
            bend = sum((r - a) * (g - b) for r, a, g, b in zip(rho, last[0], got, last[1], strict=True))
            step = min(max(square / bend, 1.0), LONGEST) if bend > 0 else STEP
        errors.append(error)
        last = rho, got
        if len(residuals) >= REBASE:
            old, table = table, written(table.select(*names, _rate(residuals, least, most).alias("base")), "rates")
            discard(old)
            residuals = []
        residuals.append([step * x for x in rho])
        done += 1
    reached = Fit(share, [g / (sum(got) or 1) for g in got], done, met, met or still)
    if not reached.converged:
        warnings.warn(f"mixing: {done} iterations reached {reached.reached} instead of {share}", stacklevel=2)
    return table.select(*names, _rate(residuals, least, most).alias("rate")), reached


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """The table of :func:`fitted`."""
    return fitted(docs, labelled, targets, **how)[0]


def copies(rate: Column, id_col: Column) -> Column:
    """The rate as a whole number: its floor, and one more for the share of ids whose hash says so."""
    part = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("long")).cast("int")


#: Copies of a row that a task makes at once; a rarer domain's documents may come far more often.
COPIES = 1000


def expanded(rows: DataFrame, times: str, largest: int) -> DataFrame:
    """``rows`` as often as the column ``times`` says, which goes. Rows that come more than ``COPIES`` times (there are some if
    ``largest`` is above it) are first dealt as blocks of copies, which other tasks expand."""
    names = [c for c in rows.columns if c != times]
    copied = lambda df: df.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
    if largest <= COPIES:
        return copied(rows)
    block = fresh("_block", rows.columns)
    blocks = rows.filter(F.col(times) > COPIES).withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / COPIES))))
    dealt = blocks.withColumn(times, F.least(F.lit(COPIES), F.col(times) - F.col(block) * COPIES).cast("int")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return copied(rows.filter(F.col(times) <= COPIES)).unionByName(copied(dealt.drop(block)))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, most: float = 1e9, **model: int) -> DataFrame:
    """``docs`` with each row as often as its document's rate says. Rows with a null id stay as they are. ``model``: the
    classifier's parameters. Warns of what the fit did not reach; :func:`fitted` tells it."""
    names = docs.columns
    key, times = fresh("_key", names), fresh("_times", names)
    rate = rates(docs, labelled, targets, least=least, most=most, **model).select(F.col("_id").alias(key), copies(F.col("rate"), F.col("_id")).alias(times))
    largest = rate.agg(F.max(times)).first()[0] or 0
    joined = docs.join(rate, F.col("doc_id") == F.col(key), "left").withColumn(times, F.coalesce(times, F.lit(1))).filter(F.col(times) > 0)
    return expanded(joined.drop(key), times, largest).select(*names)


def report(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain_col: str = "lang", **model: int) -> DataFrame:
    """Per document: doc_id, n_tokens, posterior of each domain, rate, copies, and of the whole fit the share of tokens that
    each domain reached and whether the fit converged. The labelled table: the domain of the documents that ``labels``
    covers. For nulls, repeated ids and empty tables see :func:`fitted`."""
    covered = docs.select(F.col("doc_id").alias("_id"), F.col(domain_col).alias("domain")).join(labels.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    out, fit = fitted(docs, covered, targets, **model)
    named = [F.round(F.col(f"p{k}"), 9).alias(f"p_{d}") for k, d in enumerate(sorted(targets))]
    reached = [F.lit(x).alias(f"reached_{d}") for x, d in zip(fit.reached, sorted(targets), strict=True)]
    return out.select(F.col("_id").alias("doc_id"), "n_tokens", *named, "rate", copies(F.col("rate"), F.col("_id")).alias("copies"), *reached, F.lit(fit.converged).alias("converged"))
