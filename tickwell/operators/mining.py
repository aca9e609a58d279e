"""Factor mining by genetic programming: formulas are trees that compile to columns, a generation is scored in one aggregate.

The driver holds formulas only. The formulas of a generation are one array over each row of the panel, some tens at a time so that generated code
stays small, and their correlations with the label are one grouped aggregate, combined before anything is shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tree = str | tuple
#: Functions and their numbers of arguments; below NEAR a divisor counts as one, and a logarithm is zero.
FUNCTIONS = {"add": 2, "sub": 2, "mul": 2, "div": 2, "sqrt": 1, "log": 1, "abs": 1, "neg": 1}
NEAR = 1e-3
#: Chances of crossover, subtree, hoist and point mutation; what is left copies the parent. A point mutation changes a node with this chance.
CHANCES, POINT = (0.9, 0.01, 0.01, 0.01), 0.05
_AT_ONCE, _DEEPEST = 40, 6


def column(tree: Tree) -> Column:
    """A formula as a column. Division, logarithm and root are defined for all numbers."""
    if isinstance(tree, str):
        return F.col(tree).cast("double")
    a, *rest = (column(t) for t in tree[1:])
    return {
        "add": lambda: a + rest[0], "sub": lambda: a - rest[0], "mul": lambda: a * rest[0], "div": lambda: F.when(F.abs(rest[0]) > NEAR, F.try_divide(a, rest[0])).otherwise(1.0),
        "sqrt": lambda: F.sqrt(F.abs(a)), "log": lambda: F.when(F.abs(a) > NEAR, F.log(F.abs(a))).otherwise(0.0), "abs": lambda: F.abs(a), "neg": lambda: -a,
    }[tree[0]]()


def formula(tree: Tree) -> str:
    return tree if isinstance(tree, str) else f"{tree[0]}({', '.join(map(formula, tree[1:]))})"


def _size(tree: Tree) -> int:
    return 1 if isinstance(tree, str) else 1 + sum(map(_size, tree[1:]))


def _depth(tree: Tree) -> int:
    return 0 if isinstance(tree, str) else 1 + max(map(_depth, tree[1:]))


def _grown(rng: random.Random, names: Sequence[str], depth: int, full: bool) -> Tree:
    if depth == 0 or (not full and rng.random() < len(names) / (len(names) + len(FUNCTIONS))):
        return rng.choice(names)
    name = rng.choice(list(FUNCTIONS))
    return (name, *(_grown(rng, names, depth - 1, full) for _ in range(FUNCTIONS[name])))


def _nodes(tree: Tree, at: tuple = ()) -> list[tuple]:
    return [at] if isinstance(tree, str) else [at, *(x for i, t in enumerate(tree[1:], 1) for x in _nodes(t, (*at, i)))]


def _part(tree: Tree, at: tuple) -> Tree:
    for i in at:
        tree = tree[i]
    return tree


def _with(tree: Tree, at: tuple, new: Tree) -> Tree:
    return new if not at else (*tree[: at[0]], _with(tree[at[0]], at[1:], new), *tree[at[0] + 1 :])


def _pointed(tree: Tree, rng: random.Random, names: Sequence[str]) -> Tree:
    if isinstance(tree, str):
        return rng.choice(names) if rng.random() < POINT else tree
    name = rng.choice([n for n, k in FUNCTIONS.items() if k == len(tree) - 1]) if rng.random() < POINT else tree[0]
    return (name, *(_pointed(t, rng, names) for t in tree[1:]))


def _child(rng: random.Random, names: Sequence[str], pick) -> Tree:  # noqa: ANN001
    parent, draw = pick(), rng.random()
    at = rng.choice(_nodes(parent))
    a, b, c, d = (sum(CHANCES[: i + 1]) for i in range(4))
    if draw < a:
        other = pick()
        new = _with(parent, at, _part(other, rng.choice(_nodes(other))))
    elif draw < b:
        new = _with(parent, at, _grown(rng, names, rng.randint(1, 3), False))
    elif draw < c:
        inner = _part(parent, at)
        new = _with(parent, at, _part(inner, rng.choice(_nodes(inner))))
    else:
        new = _pointed(parent, rng, names) if draw < d else parent
    return new if _depth(new) <= _DEEPEST else parent


def scores(panel: DataFrame, trees: Sequence[Tree], label: str, by: str | None = None) -> dict[Tree, float]:
    """Size of the correlation of each formula with the label: over all rows, or the mean over the dates ``by`` of at least three rows. A constant formula has none: 0."""
    out: dict[Tree, float] = {}
    distinct = list(dict.fromkeys(trees))
    y = F.col(label).cast("double")
    for k in range(0, len(distinct), _AT_ONCE):
        some = distinct[k : k + _AT_ONCE]
        long = panel.select(*([by] if by else []), y.alias("__y"), F.posexplode(F.array(*map(column, some))).alias("__i", "__f"))
        one = F.try_divide(F.covar_pop("__f", "__y"), F.nullif(F.stddev_pop("__f") * F.stddev_pop("__y"), F.lit(0.0)))
        got = long.groupBy("__i", *([by] if by else [])).agg(one.alias("c"), F.count(F.lit(1)).alias("n"))
        if by:
            got = got.where("n >= 3").groupBy("__i").agg(F.avg("c").alias("c"))
        found = {r["__i"]: r["c"] for r in got.collect()}
        out |= {t: abs(v) if (v := found.get(i)) is not None and v == v and abs(v) <= 1 + 1e-9 else 0.0 for i, t in enumerate(some)}
    return out


@dataclass
class Mined:
    formulas: list[Tree]
    scores: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with gp_factor_0, gp_factor_1 and so on."""
        return df.withColumns({f"gp_factor_{i}": column(t) for i, t in enumerate(self.formulas)})

    def table(self, spark) -> DataFrame:  # noqa: ANN001
        return spark.createDataFrame([(f"gp_factor_{i}", formula(t), _size(t), s) for i, (t, s) in enumerate(zip(self.formulas, self.scores, strict=True))], "factor string, formula string, size int, score double")


def mine(panel: DataFrame, features: Sequence[str], label: str, population: int = 500, generations: int = 10, tournament: int = 20, parsimony: float = 0.01, n_factors: int = 5, seed: int = 42, by: str | None = None) -> Mined:
    """The ``n_factors`` least alike of the best ``2 * n_factors`` formulas of the last generation. Rows that lack a feature or the label do not count.

    Selection goes by the score less ``parsimony`` for each node; the best formulas are told by their plain scores. Equal seeds give equal formulas.
    """
    rng, names = random.Random(seed), list(features)
    rows = panel.dropna(subset=[*names, label]).select(*([by] if by else []), *names, label)
    alive = [_grown(rng, names, 2 + i % 5, bool(i % 2)) for i in range(population)]
    known: dict[Tree, float] = {}
    for generation in range(generations):
        known |= scores(rows, [t for t in alive if t not in known], label, by)
        if generation + 1 < generations:
            fit = {t: known[t] - parsimony * _size(t) for t in alive}
            pick = lambda: max(rng.choices(alive, k=tournament), key=lambda t: fit[t])  # noqa: B023, E731
            alive = [_child(rng, names, pick) for _ in range(population)]
    best = sorted(dict.fromkeys(alive), key=lambda t: (-known[t], _size(t), formula(t)))[: 2 * n_factors]
    n = len(best)
    cols = rows.select(*[column(t).alias(f"__{i}") for i, t in enumerate(best)])
    pairs = [(i, j) for i in range(n) for j in range(i)]
    alike = cols.agg(*[F.abs(F.try_divide(F.covar_pop(f"__{i}", f"__{j}"), F.nullif(F.stddev_pop(f"__{i}") * F.stddev_pop(f"__{j}"), F.lit(0.0)))).alias(f"{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("n")).first()
    left = list(range(n))
    while len(left) > n_factors:
        i, j = max(((i, j) for i, j in pairs if i in left and j in left), key=lambda p: (alike[f"{p[0]}_{p[1]}"] or 0.0, p))
        left.remove(max(i, j))  # the lesser of the two, as they are sorted
    return Mined([best[i] for i in left], [known[best[i]] for i in left])
