"""Reports as named counts: what was found and how it was named, what a gate lets through, why ages are unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtide.functions import classify as C
from boxtide.functions import rates

#: A matched adult of this age and more who is written as a child is a leak.
ADULT_LEAK = 20


def named_rates(rows: DataFrame, parts: dict[str, tuple[Column, Column]], by: list[str] | None = None) -> DataFrame:
    """A row (by, metric, k, n, rate) for each named pair of tests: how many rows of the second pass the first too. One pass, sums map-side; a null test fails."""
    sums = []
    for i, (hit, of) in enumerate(parts.values()):
        of = F.coalesce(of, F.lit(False))
        sums += [F.sum((of & F.coalesce(hit, F.lit(False))).cast("long")).alias(f"k{i}"), F.sum(of.cast("long")).alias(f"n{i}")]
    one = rows.groupBy(*(by or [])).agg(*sums)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(f"k{i}", F.lit(0)).alias("k"), F.coalesce(f"n{i}", F.lit(0)).alias("n")) for i, m in enumerate(parts)])
    return one.select(*(by or []), F.explode(pairs).alias("p")).select(*(by or []), "p.metric", "p.k", "p.n", rates.rate(F.col("p.k"), F.col("p.n")).alias("rate"))


def end_to_end(gt: DataFrame, det: DataFrame, matched: DataFrame, names: list[str], bands: list[str]) -> DataFrame:
    """Recall of people, recall end to end (found and named rightly), precision among the matched, accuracy, gender accuracy of adults,
    adults of 20 and more written as children, and recalls by band. gt: stem, gt_index, cls, age, band; classes 0 and 1 are adults, 2 children."""
    as_ = det.select("stem", "det_index", F.col("cls").alias("said"))
    j = gt.join(matched.select("stem", "gt_index", "det_index").join(as_, ["stem", "det_index"]).drop("det_index"), ["stem", "gt_index"], "left")
    cls, said, found = F.col("cls"), F.col("said"), F.col("said").isNotNull()
    yes, right = F.lit(True), cls == said
    parts = {"det_recall": (found, yes), "acc3": (right, found), "gender_acc_adults": (right, found & (cls < 2)), "leak_adult20_child": (said == 2, found & (F.col("age") >= ADULT_LEAK))}
    for i, name in enumerate(names):
        parts |= {f"det_recall_{name}": (found, cls == i), f"{name}_recall_e2e": (right, cls == i), f"{name}_precision_matched": (right, said == i)}
    for b in bands:
        parts |= {f"det_recall_{b}": (found, F.col("band") == b), f"{names[0]}_recall_e2e_{b}": (right, (F.col("band") == b) & (cls == 0))}
    return named_rates(j, parts)


def gate(crops: DataFrame) -> DataFrame:
    """By expectation ('keep': verified people, 'reject': verified false positives) and class ('all' too) what a gate kept, rejected and failed to
    answer, and the rate in percent that it is for: rejected of false positives, kept of people. crops: expect, cls, verdict (null: unreadable)."""
    both = crops.select("expect", F.explode(F.array(F.lit("all"), F.col("cls").cast("string"))).alias("cls"), "verdict")
    count = lambda test, name: F.sum(F.coalesce(test, F.lit(False)).cast("long")).alias(name)
    v = F.col("verdict")
    s = both.groupBy("expect", "cls").agg(F.count("*").alias("crops"), count(v.isin("real_person", "depiction"), "kept"), count(v == "not_person", "rejected"), count(v.isNull(), "parse_fail"))
    return s.withColumn("rate_pct", F.round(100.0 * F.when(F.col("expect") == "reject", F.col("rejected")).otherwise(F.col("kept")) / F.col("crops"), 1))


def age_counts(verdicts: DataFrame, lowconf: bool = False) -> DataFrame:
    """Stat and n: people or not, their genders and ages on the two axes, why an age is unknown, whether children keep a gender, five-year bins. verdicts: v."""
    v = F.col("v")
    two = C.two_axis(v)
    ids = verdicts.select(two["gender_id"].alias("g"), two["age_id"].alias("a"), C.why_age_unknown(v, lowconf=lowconf).alias("why"), F.floor(v["estimated_age"] / 5).cast("int").alias("bin"))
    person = F.col("g").isNotNull()
    of = lambda test, text: F.when(person & test, text)
    stats = F.array(
        F.lit("verdicts"), F.when(person, "people").otherwise("not_person"), F.when(person, F.concat(F.lit("gender_"), F.col("g").cast("string"))), F.when(person, F.concat(F.lit("age_"), F.col("a").cast("string"))),
        of(F.col("a") == 5, F.concat(F.lit("why_"), "why")), of(F.col("a") == 4, F.when(F.col("g") == 2, "child_gender_unknown").otherwise("child_gender_known")), of(F.col("bin").isNotNull(), F.concat(F.lit("from_"), (F.col("bin") * 5).cast("string"))),
    )
    return ids.select(F.explode(F.array_compact(stats)).alias("stat")).groupBy("stat").agg(F.count("*").alias("n"))


def rescue_census(verdicts: DataFrame, child_max: float = 12, teen_max: float = 17) -> DataFrame:
    """Stat and n: people whose class stayed unknown, by why a child could be among them, and those kept as adults although young. verdicts: v."""
    v = F.col("v")
    m, age, child = C.merge(v), v["estimated_age"], F.coalesce(v["age_group"] == "child", F.lit(False))
    young, lost, keep = F.coalesce(age <= child_max, F.lit(False)), m["final_class"] == "Unknown", m["keep"]
    teen = lost & ~young & F.coalesce(age <= teen_max, F.lit(False))
    adult = keep & ~lost & (m["final_class"] != "Child") & young
    tests = {
        "verdicts": F.lit(True), "not_person": ~keep, "people": keep, "dropped_unknown": lost, "rescuable_child": lost & young, "dropped_teen": teen, "dropped_teen_grp_child": teen & child, "dropped_adult": lost & ~young & (age > teen_max),
        "dropped_age_none": lost & age.isNull(), "dropped_age_none_grp_child": lost & age.isNull() & child, "kept_adult_but_young": adult, "kept_adult_but_young_grp_child": adult & child,
    }
    return named_rates(verdicts, {k: (t, F.lit(True)) for k, t in tests.items()}).select(F.col("metric").alias("stat"), F.col("k").alias("n"))


def edge_errors(pairs: DataFrame, bucket: Column, step: float, tol: float) -> DataFrame:
    """Errors of matched boxes' edges (d_* less g_*) by bucket: edges, mean of their size, and the shares within tol of multiples of a step and, as
    a control, of multiples shifted by half of it."""
    sides = F.array(*[(F.col(f"d_{c}") - F.col(f"g_{c}")).cast("double") for c in ("x1", "y1", "x2", "y2")])
    e = pairs.select(bucket.alias("bucket"), F.explode(sides).alias("e"))
    off = lambda v: F.abs(v / step - F.bround(v / step)) * step <= tol
    return e.groupBy("bucket").agg(F.count("*").alias("edges"), F.avg(F.abs("e")).alias("mean_abs"), F.avg(off(F.col("e")).cast("double")).alias("on_grid"), F.avg(off(F.col("e") + step / 2).cast("double")).alias("null_grid"))


def scale_rates(runs: DataFrame, gt: DataFrame) -> DataFrame:
    """Recall and class accuracy among the matched by model and scale, at four decimals; null where nothing counts. runs: model, scale, stem, gt_index, right."""
    n = gt.agg(F.count("*").alias("n_gt"))
    s = runs.groupBy("model", "scale").agg(F.count("gt_index").alias("k"), F.sum(F.col("right").cast("long")).alias("r")).join(F.broadcast(n), F.lit(True))
    return s.select("model", "scale", "n_gt", F.round(F.col("k") / F.nullif("n_gt", F.lit(0)), 4).alias("recall"), F.round(F.col("r") / F.nullif("k", F.lit(0)), 4).alias("class_acc"))


def population(rows: DataFrame, which: str, least: float = 0.0) -> DataFrame:
    """'all' boxes, those 'misclassified' (said, but not as labelled), or of these the ones said with at least `least` confidence ('high_conf_mismatch'). rows: label, said, conf."""
    wrong = F.col("said").isNotNull() & (F.col("said") != F.col("label"))
    return {"all": rows, "misclassified": rows.filter(wrong), "high_conf_mismatch": rows.filter(wrong & (F.coalesce("conf", F.lit(0.0)) >= least))}[which]


def populations(rows: DataFrame, least: float = 0.0) -> DataFrame:
    """which, stem, gt_index of the three populations, from one pass over rows."""
    wrong = F.col("said").isNotNull() & (F.col("said") != F.col("label"))
    which = F.array_compact(F.array(F.lit("all"), F.when(wrong, "misclassified"), F.when(wrong & (F.coalesce("conf", F.lit(0.0)) >= least), "high_conf_mismatch")))
    return rows.select(F.explode(which).alias("which"), "stem", "gt_index")
