"""Classes, bands and policies as Column expressions and dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The age bands and their inclusive upper years; none above is "senior".
BANDS = ["infant", "toddler", "child", "preteen", "teenager", "young_adult", "adult", "middle_aged", "elderly", "senior"]
EDGES = [0, 3, 9, 12, 17, 29, 49, 64, 79]
CHILD = BANDS[:4]
# Exposed parts and their tiers.
COVERED, MODEST, ORDINARY = ["face", "hands", "eyes"], ["hair", "neck", "ears"], ["arms", "shoulders", "feet", "knees", "wrists", "head", "upper_arms", "forearms"]
HIGH, OTHER_PARTS = ["midriff", "stomach", "torso", "thighs"], ["chest", "legs", "back"]
# Cues that contradict a stated gender, in order of the fields.
CONTRADICTORS = {
    "woman": [("facial_hair", ["moustache", "short_beard", "full_beard"]), ("head_covering", ["ghutra_keffiyeh", "turban"]), ("garment_type", ["thobe_robe"])],
    "man": [("head_covering", ["hijab"]), ("garment_type", ["abaya", "dress"])],
}


def _steps(value: Column, edges: list, names: list[str]) -> Column:
    """names[i] of the first edge not exceeded, else the last name."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        out = F.when(value <= edge, name).otherwise(out)
    return out


def age_band(age: Column) -> Column:
    """Whole years (cut toward zero) to a band; null, unreadable or negative is 'unknown'."""
    years = age.try_cast("double").cast("int")
    return F.when(years.isNull() | (years < 0), "unknown").otherwise(_steps(years, EDGES, BANDS))


def band_name(s: Column) -> Column:
    """C2."""
    b = F.lower(F.trim(s))
    return F.when(b.isin(BANDS), b).otherwise("unknown")


def gender(s: Column) -> Column:
    """C3."""
    g = F.lower(F.trim(s))
    return F.when(g.isin("f", "female", "woman", "w"), "woman").when(g.isin("m", "male", "man"), "man").otherwise("unknown")


def _named(g: str) -> str | None:
    return {"woman": "Woman", "man": "Man"}.get(g)


def _coarse(b: str) -> str | None:
    return "child" if b in CHILD else "teen" if b == "teenager" else "adult" if b in ("young_adult", "adult", "middle_aged") else "senior" if b in ("elderly", "senior") else None


def _grown(g: str, b: str, young: list[str]) -> str | None:
    return None if b == "unknown" or b in young else _named(g)


def _stage(b: str, young: list[str]) -> str | None:
    return None if b == "unknown" else "Child" if b in young else "Adult"


#: C4: (taxonomy, head) -> rule over (gender, band); None abstains.
HEADS = {
    ("production_3class", "class"): lambda g, b: None if b == "unknown" else "Child" if b in CHILD else _named(g),
    ("two_axis", "gender"): lambda g, b: _grown(g, b, CHILD),
    ("two_axis", "age"): lambda g, b: _coarse(b),
    ("two_axis_full", "gender"): lambda g, b: _named(g),
    ("two_axis_full", "age"): lambda g, b: _stage(b, CHILD),
    ("gender_only", "gender"): lambda g, b: _grown(g, b, CHILD),
    ("child_vs_adult_9", "stage"): lambda g, b: _stage(b, CHILD[:3]),
    ("gender_9plus", "gender"): lambda g, b: _grown(g, b, CHILD[:3]),
    ("child_vs_adult", "stage"): lambda g, b: _stage(b, CHILD),
    ("child_vs_adult_18", "stage"): lambda g, b: _stage(b, [*CHILD, "teenager"]),
    ("age_band", "age"): lambda g, b: _coarse(b),
}


def taxonomy(spark: SparkSession) -> DataFrame:
    """The dimension (taxonomy, head, gender, band, label): genders x bands x heads, a fixed size."""
    rows = [(t, h, g, b, rule(g, b)) for (t, h), rule in HEADS.items() for g in ("woman", "man", "unknown") for b in [*BANDS, "unknown"]]
    return spark.createDataFrame(rows, "taxonomy string, head string, gender string, band string, label string")


def production_class(g: Column, band: Column) -> Column:
    """C5."""
    return F.when(band == "unknown", F.lit(None)).when(band.isin(CHILD), "Child").otherwise(F.when(g == "woman", "Woman").when(g == "man", "Man"))


def two_axis(v: Column, low: float = 13, high: float = 17, child_max: float = 12, low_confidence_unknown: bool = False) -> Column:
    """A verdict -> struct(gender_id 0 woman 1 man 2 unknown, age_id 3 adult 4 child 5 unknown); null if it is no person. Ages in the band win."""
    age, group = v["estimated_age"], v["age_group"]
    g = F.when(v["gender"] == "woman", 0).when(v["gender"] == "man", 1).otherwise(2)
    a = F.when(age.between(low, high), 5).when(group.isNull() | ~group.isin("child", "adult"), 5).when((group == "child") & (age.isNull() | (age <= child_max)), 4).otherwise(3)
    if low_confidence_unknown:
        a = F.when(v["confidence"] == "low", 5).otherwise(a)
    return F.when(v["verdict"].isin("real_person", "depiction"), F.struct(g.alias("gender_id"), a.alias("age_id")))


def collapse(gender_id: Column, age_id: Column, keep_unknown: bool = True) -> Column:
    """2 child first, else 0 woman, 1 man, 3 unknown gender (or null)."""
    return F.when(age_id == 4, 2).when(gender_id == 0, 0).when(gender_id == 1, 1).otherwise(F.lit(3 if keep_unknown else None).cast("int"))


def split_scores(scores: Column, groups: tuple[tuple[int, int], ...] = ((0, 3), (3, 6))) -> Column:
    """Per group of an array of scores, the index (first of equals) and value of the greatest; and the greatest of all."""
    out = []
    for k, (a, b) in enumerate(groups):
        part = F.slice(scores, a + 1, b - a)
        out += [(F.array_position(part, F.array_max(part)) - 1 + a).cast("int").alias(f"id{k}"), F.array_max(part).alias(f"score{k}")]
    return F.struct(*out, F.array_max(scores).alias("score"))


def child_by_age(v: Column, least: float = 1, most: float = 12) -> Column:
    return v["estimated_age"].between(least, most) & (v["highlight_quality"] == "good")


def merge(v: Column, rescue: Column | bool = False, child_max: float = 12) -> Column:
    """A verdict's decision, struct(keep, final_class, via). `rescue` allows a child on its age alone."""
    rescue = F.lit(rescue) if isinstance(rescue, bool) else rescue
    age = v["estimated_age"]
    person = F.coalesce(v["verdict"].isin("real_person", "depiction"), F.lit(False))
    plain = F.when((v["age_group"] == "child") & (age.isNull() | (age <= child_max)), "Child").when(v["gender"] == "man", "Man").when(v["gender"] == "woman", "Woman")
    saved = F.coalesce(rescue & child_by_age(v), F.lit(False))
    final = F.coalesce(plain, F.when(saved, "Child"), F.lit("Unknown"))
    return F.struct(person.alias("keep"), F.when(person, final).alias("final_class"), F.when(person & plain.isNull() & saved, "age_only").alias("via"))


def rescue_allowed(detector_class: Column, px_height: Column, need_child: bool = False, min_px: float = 0) -> Column:
    ok = F.lit(True)
    if need_child:
        ok = ok & F.coalesce(detector_class == 2, F.lit(False))
    return ok & F.coalesce(px_height >= min_px, F.lit(False)) if min_px else ok


def truth(g: Column, stage: Column) -> Column:
    return F.when(stage == "child", "Child").when(g == "woman", "Woman").when(g == "man", "Man")


def arbitration(label: Column, predicted: Column, true_class: Column) -> Column:
    """C10."""
    return F.when(true_class.isNull(), "uncertain").when(true_class == label, "model_error").when(true_class == predicted, "label_error").otherwise("vlm_disagrees_both")


def label_error(label: Column, predicted: Column, band: Column) -> Column:
    """C11: struct(category, confirmed); null category where label and prediction agree."""
    adult = [b for b in BANDS if b not in CHILD]
    sure_child = (predicted == "Child") & label.isin("Man", "Woman") & band.isin(CHILD)
    sure_adult = predicted.isin("Man", "Woman") & (label == "Child") & band.isin(adult)
    category = F.when(label == predicted, F.lit(None)).when(sure_child, F.concat(F.lit("labeled_"), label, F.lit("__really_Child"))).when(sure_adult, F.concat(F.lit("labeled_Child__really_"), predicted)).otherwise(
        F.concat(F.lit("needs_review__"), label, F.lit("_as_"), predicted)
    )
    return F.struct(category.alias("category"), ((label != predicted) & (sure_child | sure_adult)).alias("confirmed"))


def contradiction(g: Column, cue: dict[str, Column], rules: dict = CONTRADICTORS) -> Column:
    """The first field, in the rules' order, whose value contradicts the gender."""
    found = [
        F.when((g == who) & cue[field].isin(bad), F.concat(F.lit(f"apparent_gender={who} but {field}="), cue[field])) for who, fields in rules.items() for field, bad in fields if field in cue
    ]
    return F.coalesce(*found)


def exposure_tier(parts: Column) -> Column:
    """Tier of a set of parts; parts that are not known count as the highest tier."""
    core = F.array_distinct(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p != "none"))
    within = lambda known: F.size(F.array_except(core, F.array(*map(F.lit, known)))) == 0
    known = COVERED + MODEST + ORDINARY + HIGH + OTHER_PARTS
    high = ~within(known) | F.arrays_overlap(core, F.array(*map(F.lit, HIGH))) | (F.array_contains(core, "chest") & F.array_contains(core, "legs"))
    return F.when(within(COVERED), "t0_covered").when(within(COVERED + MODEST), "t1_modest").when(within(COVERED + MODEST + ORDINARY), "t2_ordinary").when(high, "t4_high").otherwise("t3_revealing")


def exposure_tier_report(parts: Column) -> Column:
    """C13, the reports' variant: unknown parts stay below the highest tier."""
    core = F.array_distinct(F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda p: p != "none"))
    within = lambda known: F.size(F.array_except(core, F.array(*map(F.lit, known)))) == 0
    high = F.arrays_overlap(core, F.array(*map(F.lit, HIGH))) | (F.array_contains(core, "chest") & F.array_contains(core, "legs"))
    return F.when(within(COVERED), "t0").when(within(COVERED + MODEST), "t1").when(within(COVERED + MODEST + ORDINARY[:6]), "t2").when(high, "t4").otherwise("t3")


def band_of(value: Column, bands: list[tuple[float, float, str]]) -> Column:
    """C14: lo <= v < hi; whatever fits none goes to the last band."""
    out = F.lit(bands[-1][2])
    for lo, hi, name in reversed(bands):
        out = F.when((value >= lo) & (value < hi), name).otherwise(out)
    return out


def band_or_na(value: Column, bands: list[tuple[float, float, str]], missing: str | None = None) -> Column:
    """C15."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(band_of(value, bands))


def occlusion(visible: Column, light: float = 0.7, partial: float = 0.3) -> Column:
    """The emit-time variant has 0.9 and 0.5."""
    return F.when(visible >= light, "light").when(visible >= partial, "partial").otherwise("heavy")


def confidence_band(c: Column, high: float = 0.97, mid: float = 0.93) -> Column:
    """C17."""
    return F.when(c >= high, "high").when(c >= mid, "mid").otherwise("low")


def tone_band(value: Column, lighting: Column | None = None) -> Column:
    """The first whole number in the value, in bands; an uncertain-lighting flag wins."""
    n = F.nullif(F.regexp_extract(value.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("int")
    out = F.when(n.isNull() | (n > 10), "unknown").when(n <= 3, "light(1-3)").when(n <= 6, "medium(4-6)").when(n == 7, "tan(7)").otherwise("dark(8-10)")
    return out if lighting is None else F.when(lighting == "uncertain_lighting", "uncertain_lighting").otherwise(out)


def age_label(age: Column) -> Column:
    """Each year to 20, then decades, the last from 90."""
    return F.when(age.isNull(), "unknown").when(age <= 20, age.cast("int").cast("string")).otherwise(F.concat(F.least(F.floor(age / 10) * 10, F.lit(90)).cast("int").cast("string"), F.lit("s")))


def five_years(age: Column) -> Column:
    """C20."""
    return (F.floor(age.cast("int") / 5) * 5).cast("int")


def primary(policy: str, g: Column, group: Column) -> Column:
    """Three policies that differ in whether man or child wins."""
    child, man, woman = group == "child", g == "man", g == "woman"
    order = {"man_first": ((man, "Man"), (child, "Child"), (woman, "Woman")), "child_first": ((child, "Child"), (man, "Man"), (woman, "Woman")), "woman_first": ((woman, "Woman"), (man, "Man"), (child, "Child"))}[policy]
    out = F.lit("Unknown")
    for test, name in reversed(order):
        out = F.when(test, name).otherwise(out)
    return out


def map_detection(mode: Column, cls: Column, name: Column) -> Column:
    """struct(emit_cls, excluded) by detection mode: identity keeps classes, person keeps only class 0 as 0, prompts map by name, two_axis keeps 0-5."""
    prompts = F.when(name.contains("child"), 2).when(name.contains("woman"), 0).when(name.contains("man"), 1)
    emit = F.when(mode == "identity", cls).when(mode == "person", F.when(cls == 0, 0)).when(mode == "prompts", prompts).when(mode == "two_axis", F.when(cls.between(0, 5), cls))
    return F.struct(emit.cast("int").alias("emit_cls"), F.when(emit.isNull(), F.concat(F.lit("unmapped:"), F.coalesce(name, F.lit("?")))).alias("excluded"))


def why_age_unknown(v: Column, band: tuple[float, float] = (13, 17), lowconf: bool = False) -> Column:
    """Which rule makes a person's age unknown: low_confidence, teen_band, age_group_unknown; null where none does. The order is that of two_axis()."""
    age = v["estimated_age"]
    low = (v["confidence"] == "low") if lowconf else F.lit(False)
    return F.when(low, "low_confidence").when(age.between(*band), "teen_band").when(~F.coalesce(v["age_group"].isin("child", "adult"), F.lit(False)), "age_group_unknown")
