"""Plain forms of what the library does with trees in Spark: what tests compare with."""

from __future__ import annotations

from math import factorial

import numpy as np

Tree = dict[str, list]


def attributions(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Exact Shapley values of one tree for one row, with node counts as weights; last entry is the bias.

    The value of a coalition follows known features and averages over unknown ones.
    Shapley weights are summed over the features on the tree's own paths only, which are
    few; each subset's value is computed once.
    """
    feats = sorted(set(tree.get("split_feature", [])))
    out = np.zeros(len(x) + 1)
    if not feats:
        out[-1] = tree["leaf_value"][0]
        return out

    def count(at: int) -> float:
        return tree["leaf_count"][~at] if at < 0 else tree["internal_count"][at]

    def leaves(at: int, share: float, conditions: dict[int, tuple[float, bool]]):
        """(value, {feature: (share if unknown, reached if known)}) of each leaf."""
        if at < 0:
            yield tree["leaf_value"][~at], conditions
            return
        f, t = tree["split_feature"][at], tree["threshold"][at]
        goes_left = x[f] <= t
        for child, here in ((tree["left_child"][at], goes_left), (tree["right_child"][at], not goes_left)):
            old, reached = conditions.get(f, (1.0, True))
            yield from leaves(child, share, conditions | {f: (old * count(child) / count(at), reached and bool(here))})

    for value, conditions in leaves(0, 1.0, {}):
        path = list(conditions.items())
        m = len(path)
        out[-1] += value * float(np.prod([s for _, (s, _) in path]))
        for f, (share, reached) in path:
            # polynomial over the number of known features among the others
            poly = np.ones(1)
            for g, (s, r) in path:
                if g != f:
                    poly = np.convolve(poly, [s, 1.0 if r else 0.0])
            weight = sum(c * factorial(k) * factorial(m - k - 1) / factorial(m) for k, c in enumerate(poly))
            out[f] += value * (float(reached) - share) * weight
    return out


def lambda_gradients(score: np.ndarray, tier: np.ndarray, truncate: int = 50, truncation_of_pairs: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairwise gradients and curvatures of one query group, weighted by the change of NDCG."""
    gain = 2.0**tier - 1
    pos = np.empty(len(score))
    pos[np.argsort(-score, kind="stable")] = np.arange(len(score))
    discount = 1 / np.log2(pos + 2)
    ideal = (np.sort(gain)[::-1][:truncate] / np.log2(np.arange(min(len(gain), truncate)) + 2)).sum() or 1.0
    better = tier[:, None] > tier[None, :]
    if truncation_of_pairs is not None:
        better &= np.minimum(pos[:, None], pos[None, :]) < truncation_of_pairs
    delta = np.abs((gain[:, None] - gain[None, :]) * (discount[:, None] - discount[None, :])) / ideal
    rho = 1 / (1 + np.exp(np.clip(score[:, None] - score[None, :], -50, 50)))
    push = np.where(better, rho * delta, 0.0)
    curve = np.where(better, rho * (1 - rho) * delta, 0.0)
    return push.sum(1) - push.sum(0), curve.sum(1) + curve.sum(0)


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for i, row in enumerate(x):
        at = 0 if tree.get("split_feature") else -1
        while at >= 0:
            at = tree["left_child"][at] if row[tree["split_feature"][at]] <= tree["threshold"][at] else tree["right_child"][at]
        out[i] = tree["leaf_value"][~at]
    return out
