"""Selection among threshold points: metric language, grids, Pareto fronts, operating points (Q1-Q3, Q5-Q9, J15); sweep.py searches (Q4)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[A-Za-z_][\w.]*)|(?P<sign>\*\*|[<>=!]=|[-+*/<>(),]))")


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


#: Left to right, the loosest first.
_LEVELS: list[dict[str, Callable[[Column, Column], Column]]] = [
    {"or": lambda a, b: a | b}, {"and": lambda a, b: a & b},
    {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b},
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b}, {"*": lambda a, b: a * b, "/": _over},
]
_TESTS = 2
_CALL = {"min": F.least, "max": F.greatest, "abs": F.abs}


def expression(text: str, metrics: dict[str, Column]) -> Column:
    """Q1: arithmetic, comparisons (a chain holds if each of its links does), and/or, min/max/abs over dotted metric names, as one Column;
    division by 0 is 0; minus binds looser than ** and tighter than the rest."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not part of the metric language: {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    tokens.reverse()  # the next token is the last

    def take(*wanted: str) -> str | None:
        return tokens.pop()[1] if tokens[-1][0] != "number" and tokens[-1][1] in wanted else None

    def need(sign: str) -> None:
        if not take(sign):
            raise ValueError(f"{sign!r} is missing before {tokens[-1][1]!r} in {text!r}")

    def level(k: int) -> Column:
        if k == len(_LEVELS):
            return signed()
        left, chain = level(k + 1), None
        while (op := take(*_LEVELS[k])) is not None:
            right = level(k + 1)
            now = _LEVELS[k][op](left, right)
            if k == _TESTS:
                chain, left = now if chain is None else chain & now, right
            else:
                left = now
        return left if chain is None else chain

    def signed() -> Column:
        if take("-"):
            return -signed()
        if take("+"):
            return signed()
        base = single()
        return F.pow(base, signed()) if take("**") else base

    def single() -> Column:
        if take("("):
            inner = level(0)
            need(")")
            return inner
        kind, value = tokens.pop()
        if kind == "number":
            return F.lit(float(value) if re.search(r"[.eE]", value) else int(value))
        if value in _CALL and take("("):
            given = [level(0)]
            while take(","):
                given.append(level(0))
            need(")")
            return _CALL[value](*given)
        if kind == "word" and "." in value:
            if value not in metrics:
                raise KeyError(f"no metric {value!r}; there are {', '.join(sorted(metrics))}")
            return metrics[value]
        raise ValueError(f"not part of the metric language: {value!r} in {text!r}")

    out = level(0)
    if tokens[-1][0] != "end":
        raise ValueError(f"not part of the metric language: {tokens[-1][1]!r} in {text!r}")
    return out


# Q2. The named objectives; {w} weighs {fp}, the mean image rate of the given negatives.
PRESETS = {
    "woman_recall_vs_fp": "lagenda.woman_recall_e2e - {w}*({fp})", "min_fp": "-({fp})", "woman_f1": "lagenda.woman_f1_e2e", "acc3": "lagenda.acc3", "crowd_f1": "crowd.f1",
    "balanced_recall_vs_fp": "(lagenda.woman_recall_e2e + lagenda.man_recall_e2e + lagenda.child_recall_e2e)/3 - {w}*({fp})",
}


def preset(name: str, negatives: list[str], weight: float) -> str:
    """The objective's text, with the mean false-positive rate of the negative sets where it has a place for it."""
    parts = [f"{n}.img_fp_rate" for n in negatives]
    if not parts and "{fp}" in PRESETS[name]:
        raise ValueError(f"{name} needs a set of negatives")
    mean = parts[0] if len(parts) == 1 else f"({' + '.join(parts)})/{len(parts)}"
    return PRESETS[name].replace("{w}", str(weight)).replace("{fp}", mean)


def grid(lo: float, hi: float, step: float) -> list[float]:
    """Q3: lo, lo + step, .. hi inclusive, at six decimals."""
    return [round(lo + i * step, 6) for i in range(int((hi - lo) / step + 1e-9) + 1)]


def grid_frame(spark: SparkSession, axes: list[list[float]]) -> DataFrame:
    """All threshold vectors (t0, t1, ..); its size is the product of the axes', which the caller sets."""
    out = spark.createDataFrame([(v,) for v in axes[0]], "t0 double")
    for i, axis in enumerate(axes[1:], 1):
        out = out.join(F.broadcast(spark.createDataFrame([(v,) for v in axis], f"t{i} double")), F.lit(True))
    return out


def pick_best(points: DataFrame, objective: str, feasible: str, thresholds: list[str], group: list[str] | None = None) -> DataFrame:
    """The feasible point of the greatest objective; of equals the one with the highest thresholds."""
    total = sum((F.col(t) for t in thresholds[1:]), F.col(thresholds[0]))
    w = Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.desc(objective), total.desc(), *[F.desc(t) for t in thresholds])
    return points.filter(feasible).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: Cells of the grid that a skyline is dealt by, at most.
CELLS = 512


def _front(rows: np.ndarray) -> np.ndarray:
    """Which of distinct vectors no other one beats (the greater is the better)."""
    left, done = np.lexsort(rows.T[::-1])[::-1], 0  # one that comes later here never beats an earlier one
    while done < len(left):
        beaten = (rows[left] <= rows[left[done]]).all(1)
        beaten[: done + 1] = False
        left = left[~beaten]
        done += 1
    return left


def _fronts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The front of each cell's rows in a partition, kept up to date batch by batch. Columns: v0 .. vn-1, c0 .. cn-1."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        v, c = (np.stack([rows.column(f"{p}{i}").to_numpy() for i in range(n)], axis=1) for p in "vc")
        _, of = np.unique(c, axis=0, return_inverse=True)
        order = np.argsort(of, kind="stable")
        keep = [at[_front(v[at])] for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(at)]
        held = rows.take(np.concatenate(keep)) if keep else None
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _beaten_in_cell(rows: pa.Table, n: int) -> pa.Table:
    """Of a cell's own front and the fronts of cells that could beat it: the own rows that stay."""
    v, own = np.stack([rows.column(f"v{i}").to_numpy() for i in range(n)], axis=1), rows.column("own").to_numpy()
    at = _front(v)
    return rows.select([f"v{i}" for i in range(n)]).take(at[own[at]])


def pareto(points: DataFrame, axes: list[tuple[str, str]]) -> DataFrame:
    """Q6: points that no other point beats; axes are ('max' | 'min', column); points with a null or NaN axis are left out. Equal points are first made one.

    The axes' ranges are cut into a grid of at most CELLS cells. Every partition keeps a front for each cell; a cell all of whose axes lie
    below another's that has a point is dropped whole; what is left of a cell meets only the fronts of the cells that are nowhere below it."""
    n, spark = len(axes), points.sparkSession
    sign = lambda d, c: (F.col(c) if d == "max" else -F.col(c)).cast("double")
    keyed = points.withColumns({f"v{i}": sign(d, c) for i, (d, c) in enumerate(axes)})
    names, cells = [f"v{i}" for i in range(n)], [f"c{i}" for i in range(n)]
    v = keyed.select(*names).dropna().distinct()
    side = max(2, int(CELLS ** (1 / n)))
    ends = v.agg(*[f(c).alias(f"{c}_{e}") for c in names for f, e in ((F.min, "lo"), (F.max, "hi"))]).first()
    if ends[0] is None:
        return points.limit(0)
    cut = lambda c: F.least(F.floor((F.col(c) - ends[f"{c}_lo"]) / (ends[f"{c}_hi"] - ends[f"{c}_lo"]) * side), F.lit(side - 1)) if ends[f"{c}_hi"] > ends[f"{c}_lo"] else F.lit(0)
    kind = ", ".join([f"{c} double" for c in names] + [f"{c} int" for c in cells])
    own = v.select(*names, *[cut(c).cast("int").alias(k) for c, k in zip(names, cells, strict=True)]).mapInArrow(lambda b: _fronts(b, n), kind).repartition(*cells).mapInArrow(lambda b: _fronts(b, n), kind).persist()
    filled = [tuple(r) for r in own.select(*cells).distinct().collect()]  # at most CELLS
    grid = np.array(filled)
    alive = [c for c in filled if not (grid > np.array(c)).all(1).any()]
    meets = [(*a, *b) for a in alive for b in alive if a != b and all(x >= y for x, y in zip(a, b, strict=True))] + [(*a, *a) for a in alive]
    to = spark.createDataFrame(meets, ", ".join([f"{c} int" for c in cells] + [f"t{i} int" for i in range(n)]))  # pairs of cells of one staircase
    targets = [f"t{i}" for i in range(n)]
    same = F.lit(True)
    for c, t in zip(cells, targets, strict=True):
        same = same & (F.col(c) == F.col(t))
    sent = own.join(F.broadcast(to), cells).select(*names, *targets, same.alias("own"))
    front = sent.groupBy(*targets).applyInArrow(lambda t: _beaten_in_cell(t, n), ", ".join(f"{c} double" for c in names))
    return keyed.join(front, names, "left_semi").drop(*names)


def matched_point(curve: DataFrame, group: list[str], metric: str, target: str, conf: str) -> DataFrame:
    """Q7: per group the point whose metric is nearest the target; lower confidence on ties."""
    return curve.groupBy(*group).agg(F.min_by(F.struct(*[c for c in curve.columns if c not in group]), F.struct(F.abs(F.col(metric) - F.col(target)), F.col(conf))).alias("p")).select(*group, "p.*")


def budget_pick(curve: DataFrame, group: list[str], cost: list[tuple[str, str]], value: str, conf: str) -> DataFrame:
    """Q8: per group the least value whose costs are within their budgets (a missing side binds nothing); lower confidence on ties."""
    ok = F.lit(True)
    for c, budget in cost:
        ok = ok & (F.col(c).isNull() | F.col(budget).isNull() | (F.col(c) <= F.col(budget) + 1e-12))
    rest = [c for c in curve.columns if c not in group]
    return curve.filter(ok & F.col(value).isNotNull()).groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(value, conf)).alias("p")).select(*group, "p.*")


def youden(curve: DataFrame, hit: str, false: str, conf: str, group: list[str]) -> DataFrame:
    """Q9: per group the point of the greatest hit - false rate, higher confidence on ties."""
    j = curve.withColumn("j", F.col(hit) - F.col(false))
    return j.groupBy(*group).agg(F.max_by(F.struct(*[c for c in j.columns if c not in group]), F.struct("j", conf)).alias("p")).select(*group, "p.*")


def utopia(curve: DataFrame, parts: list[tuple[str, str]], conf: str, group: list[str]) -> DataFrame:
    """Q9: per group the point nearest to all-zero, each measure relative to its reference; higher confidence on ties."""
    d = sum((F.pow(F.col(c) / F.col(r), 2) for c, r in parts[1:]), F.pow(F.col(parts[0][0]) / F.col(parts[0][1]), 2))
    u = curve.withColumn("distance", F.sqrt(d))
    return u.groupBy(*group).agg(F.min_by(F.struct(*[c for c in u.columns if c not in group]), F.struct("distance", -F.col(conf))).alias("p")).select(*group, "p.*")
