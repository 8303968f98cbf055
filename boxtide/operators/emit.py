"""Label projection with audit (K2, C9, D5): verdicts decide which label lines stay and as what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtide.functions import classify as C


def decide(lines: DataFrame, verdicts: DataFrame, rescue: bool = False, need_child: bool = False, min_px: float = 0, keep_unknown: bool = False, unknown_class: int | None = None, allow_unverified: bool = False) -> DataFrame:
    """lines (stem, det_index, geometry) joined to verdicts (stem, det_index, sam_class_id, person_px_height, v): columns
    emitted (its image is: all its lines have verdicts, or unverified ones are allowed), action, keep, new_class."""
    j = lines.join(verdicts, ["stem", "det_index"], "left")
    has = F.col("sam_class_id").isNotNull()
    per = j.groupBy("stem").agg(F.count("*").alias("n_lines"), F.sum(has.cast("int")).alias("n_verdicts"))
    allow = (C.rescue_allowed(F.col("sam_class_id"), F.col("person_px_height"), need_child, min_px)) if rescue else False
    j = j.withColumn("m", C.merge(F.col("v"), allow)).join(per, "stem")
    final, keep = F.col("m.final_class"), F.col("m.keep")
    unknown = keep & (final == "Unknown")
    by_name = F.when(final == "Woman", 0).when(final == "Man", 1).when(final == "Child", 2)
    new = F.when(~has, F.lit(None)).when(unknown, F.lit(unknown_class) if unknown_class is not None else F.when(F.lit(keep_unknown), F.col("sam_class_id"))).when(keep, by_name)
    action = (
        F.when(~has, "no_verdict").when(~keep, "delete").when(unknown & F.lit(unknown_class is not None), "kept_as_unknown_class").when(unknown & ~F.lit(keep_unknown), "drop_unknown_gender")
        .when(F.col("m.via") == "age_only", "child_by_age").when(new != F.col("sam_class_id"), "relabel").otherwise("keep")
    )
    stays = (~has) | new.isNotNull()
    return j.withColumns({"emitted": F.lit(allow_unverified) | (F.col("n_verdicts") >= F.col("n_lines")), "action": action, "keep": stays, "new_class": new.cast("int")}).drop("m")


def label_lines(decided: DataFrame) -> DataFrame:
    """The lines that are written: stem, det_index, line."""
    return decided.filter("emitted AND keep").select("stem", "det_index", F.concat_ws(" ", F.coalesce(F.col("new_class"), F.col("cls")).cast("string"), "geometry").alias("line"))


def audit(decided: DataFrame) -> DataFrame:
    return decided.filter("emitted AND action NOT IN ('keep', 'no_verdict')").select("stem", "det_index", "action", F.col("sam_class_id").alias("was"), F.col("new_class").alias("now"))


def totals(decided: DataFrame) -> DataFrame:
    """Lines by outcome. Of an image that is not emitted only the lines without a verdict count."""
    s = lambda t, n: F.coalesce(F.sum(F.when(t, 1).otherwise(0)), F.lit(0)).alias(n)
    e, a = F.col("emitted"), F.col("action")
    relabelled = (a == "relabel") | ((a == "child_by_age") & (F.col("new_class") != F.col("sam_class_id")))
    return decided.agg(
        s(e & a.isin("keep", "relabel", "child_by_age"), "kept"), s(e & (a == "delete"), "deleted"), s(e & relabelled, "relabeled"),
        s(e & a.isin("drop_unknown_gender", "kept_as_unknown_class"), "dropped_unknown"), s(a == "no_verdict", "no_verdict"), s(e & (a == "child_by_age"), "child_by_age"),
    )
