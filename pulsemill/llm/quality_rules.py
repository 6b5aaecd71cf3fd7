"""Quality rules: learned decision lists by sequential covering.

Rules that reject are learned from labelled statistics. One rule is grown on two thirds of the rows: a conjunction to which
the threshold condition with the best FOIL gain is added until it covers no row to keep. It is pruned on the other third:
conditions are dropped from its end while (p - n) / (p + n) doesn't fall. A rule of enough precision there is taken, the
rows it covers go, and the next one is grown. The list is emitted as one ordered Spark conditional expression.

Fitting takes at most `most` labelled rows (a parameter); the rules then hold for all rows, narrowly, without a shuffle.

Edge cases: null and empty texts fail the base rule. Very long texts are judged whole. Without labels, or where no rule is
precise enough, only the base rule rejects. Of conditions with the same gain the first one, in the order of the statistics, is taken; of rows
that share a labelled id, one is learned from. A rule that covers no row of the pruning third has no evidence and ends the list. Rows are
independent: nulls in other columns, repeated rows and extra columns don't matter; columns that have a result's name are
replaced, unless a prefix keeps them apart. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import COUNTS, RATIOS, labelled_sample, one_each, with_stats

Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    m = np.ones(len(next(iter(x.values()))), bool)
    for name, op, v in rule:
        m &= x[name] >= v if op == ">=" else x[name] <= v
    return m


def _grow(x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    rule: Rule = []
    live = np.ones(len(y), bool)
    while len(rule) < 4:
        p0, n0 = int((y & live).sum()), int((~y & live).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, col in x.items():
            v, t = col[live], y[live]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            step = np.flatnonzero(v[1:] > v[:-1])
            if not len(step):
                continue
            p_low = np.cumsum(t)[step]
            n_low = step + 1 - p_low
            for op, p, n in (("<=", p_low, n_low), (">=", p0 - p_low, n0 - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (name, op, float((v[step[k]] + v[step[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live = _covers(rule, x)
    return rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, precision: float = 0.9, most_rules: int = 12, least: int = 3, seed: int = 42) -> list[Rule]:
    """Ordered rules that reject; y marks the rows to reject."""
    rng, rules = np.random.default_rng(seed), []
    while len(rules) < most_rules and y.sum() >= least:
        part = rng.random(len(y)) < 2 / 3
        grow, prune = ({k: v[m] for k, v in x.items()} for m in (part, ~part))
        rule = _grow(grow, y[part])
        worth = lambda r: (lambda c: (2 * (y[~part] & c).sum() - c.sum()) / max(1, c.sum()))(_covers(r, prune))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(rule, x) if rule else np.zeros(len(y), bool)
        hit = _covers(rule, prune) if rule else covered
        if covered.sum() < least or (y & covered).sum() < precision * covered.sum() or not hit.sum() or (y[~part] & hit).sum() < precision * hit.sum():
            break
        rules.append(rule)
        x, y = {k: v[~covered] for k, v in x.items()}, y[~covered]
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> list[Rule]:
    rows = one_each(with_stats(labelled_sample(docs, labels, "quality", None, most), "__text").drop("__text")).orderBy("__id").toPandas()
    if not len(rows):
        return []
    return learn({c: rows[c].to_numpy(float) for c in [*RATIOS, "n_words"]}, (rows["__y"] == 0).to_numpy())


def expression(rules: list[Rule], prefix: str = "") -> Column:
    """False for what a rule rejects, in the order of the list; else true."""
    out = None
    for rule in rules:
        hit = F.lit(True)
        for name, op, v in rule:
            c = F.col(prefix + name)
            hit = hit & (c >= v if op == ">=" else c <= v)
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the statistics, base_failed and kept, each with the prefix."""
    d = with_stats(docs, text, prefix).withColumn(prefix + "base_failed", base_failed(prefix))
    return d.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & expression(rules, prefix))


