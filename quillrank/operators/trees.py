"""Tree ensembles: text models, predictions and attributions as columns. boosting.py trains them."""

from __future__ import annotations

from functools import reduce
from math import factorial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Tree = dict[str, list]


def parse_model(text: str) -> tuple[list[str], list[Tree]]:
    """Feature names and trees of a LightGBM text model (numerical splits)."""
    names: list[str] = []
    trees: list[Tree] = []
    for line in text.splitlines():
        key, _, value = line.partition("=")
        if key == "feature_names":
            names = value.split()
        elif key == "Tree":
            trees.append({})
        elif key == "end of trees":
            break
        elif trees and key in ("split_feature", "left_child", "right_child"):
            trees[-1][key] = [int(v) for v in value.split()]
        elif trees and key in ("threshold", "leaf_value", "split_gain", "leaf_count", "internal_count"):
            trees[-1][key] = [float(v) for v in value.split()]
    return names, trees


def format_model(names: list[str], trees: list[Tree]) -> str:
    """The text of a model, as parse_model() reads it."""
    lines = ["tree", "version=v4", f"feature_names={' '.join(names)}", ""]
    for i, tree in enumerate(trees):
        lines += [f"Tree={i}", f"num_leaves={len(tree['leaf_value'])}"]
        lines += [f"{k}={' '.join(repr(v) for v in values)}" for k, values in tree.items()] + [""]
    return "\n".join([*lines, "end of trees", ""])


def save_model(spark: SparkSession, path: str, names: list[str], trees: list[Tree]) -> None:
    """A model as text, with the names of its columns beside it, on any file system that Spark writes."""
    for where, text in ((path, format_model(names, trees)), (f"{path}.cols", "\n".join(names))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(where)


def load_model(spark: SparkSession, path: str) -> tuple[list[str], list[Tree]] | tuple[None, None]:
    """(columns, trees) of a saved model; (None, None) where there is none."""
    try:
        parts = [spark.read.text(p, wholetext=True).first()[0] for p in (path, f"{path}.cols")]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None, None
        raise
    return parts[1].split(), parse_model(parts[0])[1]


def predict_column(names: list[str], trees: list[Tree], missing: set[str] = frozenset()) -> Column:
    """Sum of leaf values as one expression: value <= threshold goes left, a negative child is ~leaf."""

    def value(feature: int) -> Column:
        if names[feature] in missing:
            return F.lit(0.0)
        c = F.col(names[feature]).cast("float").cast("double")
        return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))

    def node(tree: Tree, at: int) -> Column:
        if at < 0:
            return F.lit(tree["leaf_value"][~at])
        return F.when(value(tree["split_feature"][at]) <= tree["threshold"][at], node(tree, tree["left_child"][at])).otherwise(node(tree, tree["right_child"][at]))

    out = F.lit(0.0)
    for tree in trees:
        out = out + (node(tree, 0) if tree.get("split_feature") else F.lit(tree["leaf_value"][0]))
    return out


def importance(splits: DataFrame, top: int = 15) -> DataFrame:
    """Features by total gain of `splits` (feature, gain), those of a model or of many."""
    return splits.groupBy("feature").agg(F.sum("gain").alias("gain")).orderBy(F.desc("gain"), "feature").limit(top)


def split_table(spark: SparkSession, names: list[str], trees: list[Tree]) -> DataFrame:
    """feature, gain of every split of a model."""
    rows = [(names[f], g) for t in trees for f, g in zip(t.get("split_feature", []), t.get("split_gain", []), strict=False)]
    return spark.createDataFrame(rows, "feature string, gain double")


def leaf_paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, [(feature, low, high, share)]) of each leaf: low < x <= high reaches it, `share` of the rows would if the feature were unknown."""

    def count(at: int) -> float:
        return tree["leaf_count"][~at] if at < 0 else tree["internal_count"][at]

    def walk(at: int, path: dict[int, tuple[float, float, float]]):
        if at < 0:
            yield tree["leaf_value"][~at], [(f, *bounds) for f, bounds in path.items()]
            return
        f, t = tree["split_feature"][at], tree["threshold"][at]
        low, high, share = path.get(f, (float("-inf"), float("inf"), 1.0))
        for child, bounds in ((tree["left_child"][at], (low, min(high, t))), (tree["right_child"][at], (max(low, t), high))):
            yield from walk(child, path | {f: (*bounds, share * count(child) / count(at))})

    return list(walk(0, {})) if tree.get("split_feature") else [(tree["leaf_value"][0], [])]


def attribution_columns(names: list[str], trees: list[Tree]) -> dict[str, Column]:
    """Exact Shapley values of every feature, as columns over the row.

    A feature gets, from each leaf below one of its splits, the leaf's value times (reached
    - share) times the Shapley-weighted mean, over the sets of other features on the path,
    of the product of their `reached` (in the set) or `share` (out of it). The products of
    sets of one size are the coefficients of a polynomial, folded over the path.
    """
    totals: dict[int, list[Column]] = {}

    def value(f: int) -> Column:
        return F.coalesce(F.nanvl(F.col(names[f]).cast("float").cast("double"), F.lit(0.0)), F.lit(0.0))

    for tree in trees:
        for leaf, path in leaf_paths(tree):
            m = len(path)
            reached = {f: ((value(f) > low) & (value(f) <= high)).cast("double") for f, low, high, _ in path}
            weights = F.array(*(F.lit(factorial(k) * factorial(m - k - 1) / factorial(m)) for k in range(m)))
            for f, _, _, share in path:
                others = F.array(*(F.struct(F.lit(s).alias("share"), reached[g].alias("reached")) for g, _, _, s in path if g != f)) if m > 1 else None
                one = F.array(F.lit(1.0))
                step = lambda poly, e: F.zip_with(F.concat(F.transform(poly, lambda c: c * e["share"]), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(poly, lambda c: c * e["reached"])), lambda a, b: a + b)
                poly = F.aggregate(others, one, step) if others is not None else one
                mean = F.aggregate(F.zip_with(poly, weights, lambda c, w: c * w), F.lit(0.0), lambda a, c: a + c)
                totals.setdefault(f, []).append(F.lit(leaf) * (reached[f] - F.lit(share)) * mean)
    return {names[f]: reduce(lambda a, b: a + b, parts) for f, parts in sorted(totals.items())}


def top_attributions(rows: DataFrame, id_: str, names: list[str], trees: list[Tree], k: int = 5, labels: dict[str, str] | None = None) -> DataFrame:
    """id, factor, shap_value of the k strongest features of each row (ties by the order of `names`); `labels` adds a readable name.

    Columns only: one row, a ranking or a whole table alike. Features that no tree splits
    on have the value 0.
    """
    found = attribution_columns(names, trees)
    factors = F.array(*(F.struct(-F.round(F.abs(found.get(n, F.lit(0.0))), 9).alias("less"), F.lit(i).alias("i"), F.lit(n).alias("factor"), found.get(n, F.lit(0.0)).alias("shap_value")) for i, n in enumerate(names)))
    out = rows.select(id_, F.explode(F.slice(F.array_sort(factors), 1, k)).alias("_f")).select(id_, "_f.factor", "_f.shap_value")
    if labels is None:
        return out
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else F.create_map().cast("map<string,string>")
    return out.select(id_, "factor", F.coalesce(known[F.col("factor")], F.col("factor")).alias("label"), "shap_value")
