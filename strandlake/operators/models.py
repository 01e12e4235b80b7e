"""Small models per group: hidden states over ordered sites, hard EM, matching, greedy cover, votes.

Each takes a group of bounded size (a sample's sites, a component) as pandas, or a histogram; none takes a fact table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emissions(observed: list, panel: np.ndarray, mismatch: float) -> np.ndarray:
    """How well each panel row explains the call of each site (runs x sites); unknown calls or alleles (None, -1) tell nothing."""
    calls = np.array([-1 if x is None else x for x in observed])
    fits = np.where(panel == calls, 1 - mismatch, mismatch)
    return np.where((panel >= 0) & np.array([x is not None for x in observed]), fits, 1.0)


def viterbi(observed: list, panel: np.ndarray, mismatch: float = 0.01, switch: float = 0.001) -> list[int]:
    """The best path of panel rows through ordered sites; a switch may draw the same row again; of equals the last row counts."""
    runs, sites = panel.shape
    stay, move = math.log(1 - switch + switch / runs), math.log(switch / runs)
    e = np.log(emissions(observed, panel, mismatch))
    last = lambda x: runs - 1 - int(x[::-1].argmax())
    score, back = e[:, 0], []
    for s in range(1, sites):
        best = last(score)
        own, jump = score + stay, score[best] + move
        keep = (own > jump) | ((own == jump) & (np.arange(runs) >= best))
        back.append(np.where(keep, np.arange(runs), best))
        score = np.where(keep, own, jump) + e[:, s]
    at = [last(score)]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return at[::-1]


def forward_backward(observed: list, panel: np.ndarray, mismatch: float = 0.01, switch: float = 0.001) -> np.ndarray:
    """Probability of each panel row at each site (runs x sites) from all the other sites' calls."""
    runs, sites = panel.shape
    e = emissions(observed, panel, mismatch)
    mix = lambda p: (1 - switch) * p + switch * p.sum() / runs
    before, after = np.full((runs, sites), 1.0 / runs), np.ones((runs, sites))
    for s in range(1, sites):
        p = mix(before[:, s - 1] * e[:, s - 1])
        before[:, s] = p / p.sum()
    for s in range(sites - 2, -1, -1):
        p = mix(after[:, s + 1] * e[:, s + 1])
        after[:, s] = p / p.sum()
    out = before * after
    return out / out.sum(0)


def em_lengths(runs: list[np.ndarray], start: list[int], rounds: int = 12, most: int = 64) -> list[int]:
    """Lengths of homopolymer runs from histograms of called lengths, by hard EM; the current length wins ties."""
    now = list(start)
    for _ in range(rounds):
        calls = np.full((most + 1, most + 1), 0.5)
        prior = np.zeros(most + 1)
        for h, n in zip(runs, now, strict=True):
            calls[n] += h
            prior[n] += 1
        log_call = np.log(calls / calls.sum(1, keepdims=True))
        with np.errstate(divide="ignore"):
            log_prior = np.log(prior / prior.sum())  # lengths that no run has can't win
        new = []
        for h, n in zip(runs, now, strict=True):
            seen = np.flatnonzero(h)
            low, high = (int(seen[0]), int(seen[-1])) if len(seen) else (1, most)
            around = range(max(1, low - 1), min(most, high + 1) + 1)
            score = {m: float(h @ log_call[m] + log_prior[m]) for m in {*around, n}}
            top = max(score.values())
            new.append(n if score[n] >= top - 1e-12 else max(score, key=lambda m: (score[m], -m)))
        if new == now:
            break
        now = new
    return now


def best_matching(left: list, right: list, weight: dict[tuple, float]) -> tuple[float, list[tuple]]:
    """The heaviest way to pair each of the smaller side with one of the larger, by trying all; for sides of up to eight."""
    if min(len(left), len(right)) > 8 or max(len(left), len(right)) > 9:
        raise ValueError("component too large for exact matching")
    flip = len(left) > len(right)
    a, b = (right, left) if flip else (left, right)
    best: tuple[float, list[tuple]] = (-math.inf, [])
    for order in itertools.permutations(b, len(a)):
        pairs = [(y, x) if flip else (x, y) for x, y in zip(a, order, strict=True)]
        total = sum(weight.get(p, 0.0) for p in pairs)
        if total > best[0]:
            best = total, pairs
    return best


def minority_interval(minority: int, majority: int, draws: int = 1000, seed: int = 1) -> tuple[float, float, float]:
    """Share of the minority and its 95 % bootstrap interval, seeded by the data."""
    n = minority + majority
    share = minority / n
    rng = np.random.default_rng(seed ^ n)
    sample = np.sort(rng.binomial(n, share, draws) / n)
    return share, float(sample[int(draws * 0.025)]), float(sample[min(int(draws * 0.975), draws - 1)])


def rho(a: np.ndarray, b: np.ndarray, n: np.ndarray, rounds: int = 1000) -> float:
    """Fixed point of how often votes (n of each kind) follow the first of two models: start at a half, stop when it moves less than 1e-12."""
    r = new = 0.5
    for _ in range(rounds):
        new = float((n * (r * a) / (r * a + (1 - r) * b)).sum() + 0.5) / (n.sum() + 1)
        if abs(new - r) < 1e-12:
            break
        r = new
    return float(new)


def greedy_cover(sets: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> list[tuple]:
    """(set, gain): sets (set, item) picked by most new items, the lesser of equals, until nothing is new; a pick a round comes to the driver.  Nulls are left aside."""
    left, picked = write(sets.select("set", "item").dropna().distinct(), "cover"), []
    for i in itertools.count():
        top = left.groupBy("set").agg(F.count("*").alias("gain")).orderBy(F.desc("gain"), "set").first()
        if top is None:
            return picked
        picked.append((top["set"], top["gain"]))
        covered = left.where(F.col("set") == top["set"]).select("item")
        left = write(left.join(covered, "item", "left_anti"), f"cover-{i}")


def mosaic(calls: DataFrame) -> DataFrame:
    """(sample, switches, sites) of each sample's path through the others as haplotypes; calls (sample, site, allele) of a bounded cohort."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["sample"].iloc[0]
        table = pdf.pivot_table(index="other", columns="site", values="theirs", aggfunc="first", sort=True)
        mine = pdf.drop_duplicates("site").set_index("site")["mine"]
        sites = list(table.columns)
        path = viterbi([mine.get(s) for s in sites], np.where(table.isna(), -1, table.to_numpy()).astype(int))
        return pd.DataFrame({"sample": [own], "switches": [sum(x != y for x, y in zip(path, path[1:], strict=False))], "sites": [len(sites)]})

    others = calls.select(F.col("sample").alias("other"), "site", F.col("allele").alias("theirs"))
    pairs = calls.select("sample", "site", F.col("allele").alias("mine")).join(others, "site").where("sample <> other")
    return pairs.groupBy("sample").applyInPandas(run, "sample long, switches long, sites long")
