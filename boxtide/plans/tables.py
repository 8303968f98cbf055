"""Queries over scalars, cross-tabs, samples, searches, diffs and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boxtide.functions import classify as C
from boxtide.functions import rates as R
from boxtide.functions import text as T
from boxtide.operators import boundary as B
from boxtide.operators import emit as E
from boxtide.operators import quality as Q
from boxtide.operators import sampling as S
from boxtide.operators import search as H
from boxtide.operators import tabulate as A
from boxtide.plans.fixtures import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# people: one per customer, made from keys
_P = """(SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN ' male ' WHEN 2 THEN 'woman' WHEN 3 THEN 'M' ELSE '?' END AS raw_gender, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 97 - 1 END AS age, c_custkey % 101 AS conf, c_custkey % 7 AS m7, c_mktsegment AS seg FROM customer)"""
_BAND = "CASE WHEN age IS NULL OR age < 0 THEN 'unknown' WHEN age <= 0 THEN 'infant' WHEN age <= 3 THEN 'toddler' WHEN age <= 9 THEN 'child' WHEN age <= 12 THEN 'preteen' WHEN age <= 17 THEN 'teenager' WHEN age <= 29 THEN 'young_adult' WHEN age <= 49 THEN 'adult' WHEN age <= 64 THEN 'middle_aged' WHEN age <= 79 THEN 'elderly' ELSE 'senior' END"
_GENDER = "CASE WHEN lower(trim(raw_gender)) IN ('f','female','woman','w') THEN 'woman' WHEN lower(trim(raw_gender)) IN ('m','male','man') THEN 'man' ELSE 'unknown' END"


def people(s, d):
    return s.sql(f"SELECT * FROM {_P.replace('FROM customer', 'FROM {customer}')}", customer=load(s, d, "customer")).withColumns({"band": C.age_band(F.col("age")), "gender": C.gender(F.col("raw_gender"))})


@query(f"SELECT id, {_BAND} AS band, {_GENDER} AS gender, CASE WHEN {_BAND} = 'unknown' THEN NULL WHEN {_BAND} IN ('infant','toddler','child','preteen') THEN 'Child' WHEN {_GENDER} = 'woman' THEN 'Woman' WHEN {_GENDER} = 'man' THEN 'Man' END AS class3, (age // 5 * 5)::INT AS five, CASE WHEN age IS NULL THEN 'unknown' WHEN age <= 20 THEN age::VARCHAR ELSE least(age // 10 * 10, 90)::VARCHAR || 's' END AS label FROM {_P} p".replace("(age // 5 * 5)", "(CASE WHEN age < 0 THEN -5 ELSE age // 5 * 5 END)"))
def age_and_gender(s, d):
    """C1, C2, C3, C5, C19, C20."""
    return people(s, d).select("id", "band", "gender", C.production_class(F.col("gender"), F.col("band")).alias("class3"), C.five_years(F.col("age")).alias("five"), C.age_label(F.col("age")).alias("label"))


@query(f"""WITH p AS (SELECT id, {_BAND} AS b, {_GENDER} AS g FROM {_P} q), young AS (SELECT 'infant' AS b UNION ALL SELECT 'toddler' UNION ALL SELECT 'child'),
h AS (SELECT 'production_3class' AS taxonomy, 'class' AS head, CASE WHEN b = 'unknown' THEN NULL WHEN b IN ('infant','toddler','child','preteen') THEN 'Child' WHEN g = 'woman' THEN 'Woman' WHEN g = 'man' THEN 'Man' END AS label FROM p
UNION ALL SELECT 'two_axis_full', 'gender', CASE g WHEN 'woman' THEN 'Woman' WHEN 'man' THEN 'Man' END FROM p
UNION ALL SELECT t, 'gender', CASE WHEN b IN ('unknown','infant','toddler','child','preteen') THEN NULL WHEN g = 'woman' THEN 'Woman' WHEN g = 'man' THEN 'Man' END FROM p, (VALUES ('two_axis'), ('gender_only')) v(t)
UNION ALL SELECT 'gender_9plus', 'gender', CASE WHEN b IN ('unknown','infant','toddler','child') THEN NULL WHEN g = 'woman' THEN 'Woman' WHEN g = 'man' THEN 'Man' END FROM p
UNION ALL SELECT t, hd, CASE WHEN b = 'unknown' THEN NULL WHEN b IN ('infant','toddler','child','preteen') THEN 'Child' ELSE 'Adult' END FROM p, (VALUES ('two_axis_full', 'age'), ('child_vs_adult', 'stage')) v(t, hd)
UNION ALL SELECT 'child_vs_adult_9', 'stage', CASE WHEN b = 'unknown' THEN NULL WHEN b IN (SELECT b FROM young) THEN 'Child' ELSE 'Adult' END FROM p
UNION ALL SELECT 'child_vs_adult_18', 'stage', CASE WHEN b = 'unknown' THEN NULL WHEN b IN ('infant','toddler','child','preteen','teenager') THEN 'Child' ELSE 'Adult' END FROM p
UNION ALL SELECT t, 'age', CASE WHEN b = 'unknown' THEN NULL WHEN b IN ('infant','toddler','child','preteen') THEN 'child' WHEN b = 'teenager' THEN 'teen' WHEN b IN ('elderly','senior') THEN 'senior' ELSE 'adult' END FROM p, (VALUES ('two_axis'), ('age_band')) v(t))
SELECT taxonomy, head, coalesce(label, '(abstain)') AS label, count(*) AS n FROM h GROUP BY ALL""")
def taxonomies(s, d):
    """Every taxonomy's heads over the people, abstentions counted."""
    j = people(s, d).join(F.broadcast(C.taxonomy(s)), ["gender", "band"])  # 11 heads x 33 pairs
    return j.groupBy("taxonomy", "head", F.coalesce("label", F.lit("(abstain)")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""SELECT id, CASE WHEN conf >= 70 THEN 'light' WHEN conf >= 30 THEN 'partial' ELSE 'heavy' END AS occ, CASE WHEN conf >= 90 THEN 'light' WHEN conf >= 50 THEN 'partial' ELSE 'heavy' END AS occ_emit, CASE WHEN conf >= 97 THEN 'high' WHEN conf >= 93 THEN 'mid' ELSE 'low' END AS conf_band,
CASE WHEN age >= 0 AND age < 30 THEN 'small' WHEN age >= 30 AND age < 60 THEN 'med' WHEN age IS NULL THEN 'large' ELSE 'large' END AS size, CASE WHEN age IS NULL THEN 'na' WHEN age >= 0 AND age < 30 THEN 'small' WHEN age >= 30 AND age < 60 THEN 'med' ELSE 'large' END AS size_na,
CASE WHEN id % 13 = 0 THEN 'uncertain_lighting' WHEN m7 * 2 <= 3 THEN 'light(1-3)' WHEN m7 * 2 <= 6 THEN 'medium(4-6)' WHEN m7 * 2 <= 10 THEN 'dark(8-10)' ELSE 'unknown' END AS tone FROM {_P} p""")
def bands(s, d):
    """Bands with their own rules for missing and out-of-range values."""
    sizes = [(0, 30, "small"), (30, 60, "med"), (60, 10**9, "large")]
    c = F.col("conf")
    tone = C.tone_band(F.concat(F.lit("MST "), (F.col("m7") * 2).cast("string")), F.when(F.col("id") % 13 == 0, "uncertain_lighting").otherwise("fair"))
    return people(s, d).select("id", C.occlusion(c, 70, 30).alias("occ"), C.occlusion(c, 90, 50).alias("occ_emit"), C.confidence_band(c, 97, 93).alias("conf_band"), C.band_of(F.col("age"), sizes).alias("size"), C.band_or_na(F.col("age"), sizes, "na").alias("size_na"), tone.alias("tone"))


_V = """(SELECT id, CASE id % 6 WHEN 0 THEN 'not_person' WHEN 1 THEN 'depiction' ELSE 'real_person' END AS verdict, CASE id % 3 WHEN 0 THEN 'man' WHEN 1 THEN 'woman' ELSE 'unclear' END AS gender, CASE id % 4 WHEN 0 THEN 'child' WHEN 1 THEN 'adult' ELSE 'unsure' END AS age_group,
CASE WHEN id % 9 = 0 THEN NULL ELSE (id % 31)::DOUBLE END AS estimated_age, CASE WHEN id % 2 = 0 THEN 'good' ELSE 'bad' END AS highlight_quality, CASE WHEN id % 8 = 0 THEN 'low' ELSE 'high' END AS confidence, (id % 3)::INT AS sam FROM (SELECT c_custkey AS id FROM customer) c)"""


def verdicts(s, d):
    flat = s.sql(f"SELECT * FROM {_V.replace('FROM customer', 'FROM {customer}').replace('::DOUBLE', '*1.0D')}".replace("(id % 3)::INT", "CAST(id % 3 AS INT)"), customer=load(s, d, "customer"))
    names = ("verdict", "gender", "age_group", "estimated_age", "highlight_quality", "confidence")
    return flat.select("id", "sam", F.struct(*names).alias("v"), *names)


_PERSON = "verdict IN ('real_person', 'depiction')"
_FINAL = "CASE WHEN age_group = 'child' AND (estimated_age IS NULL OR estimated_age <= 12) THEN 'Child' WHEN gender = 'man' THEN 'Man' WHEN gender = 'woman' THEN 'Woman' WHEN estimated_age BETWEEN 1 AND 12 AND highlight_quality = 'good' THEN 'Child' ELSE 'Unknown' END"


@query(f"""WITH x AS (SELECT id, CASE WHEN {_PERSON} THEN CASE gender WHEN 'woman' THEN 0 WHEN 'man' THEN 1 ELSE 2 END END AS gender_id,
CASE WHEN {_PERSON} THEN CASE WHEN estimated_age BETWEEN 13 AND 17 THEN 5 WHEN age_group NOT IN ('child', 'adult') THEN 5 WHEN age_group = 'child' AND (estimated_age IS NULL OR estimated_age <= 12) THEN 4 ELSE 3 END END AS age_id, {_PERSON} AS keep, CASE WHEN {_PERSON} THEN {_FINAL} END AS final_class FROM {_V} v)
SELECT gender_id, age_id, CASE WHEN gender_id IS NULL THEN NULL WHEN age_id = 4 THEN 2 WHEN gender_id = 0 THEN 0 WHEN gender_id = 1 THEN 1 ELSE 3 END AS collapsed, keep, final_class, count(*) AS n FROM x GROUP BY ALL""")
def verdict_classes(s, d):
    """C6, C7, C9, A31, A32."""
    v = verdicts(s, d).withColumns({"a": C.two_axis(F.col("v")), "m": C.merge(F.col("v"), True)})
    g, a = F.col("a.gender_id"), F.col("a.age_id")
    return v.select(g.alias("gender_id"), a.alias("age_id"), F.when(g.isNotNull(), C.collapse(g, a)).alias("collapsed"), F.col("m.keep").alias("keep"), F.col("m.final_class").alias("final_class")).groupBy("gender_id", "age_id", "collapsed", "keep", "final_class").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT id, {_BAND} AS b, CASE id % 3 WHEN 0 THEN 'Woman' WHEN 1 THEN 'Man' ELSE 'Child' END AS l, CASE id % 4 WHEN 0 THEN 'Woman' WHEN 1 THEN 'Man' ELSE 'Child' END AS m, CASE id % 5 WHEN 0 THEN 'Woman' WHEN 1 THEN 'Man' WHEN 2 THEN 'Child' END AS t FROM {_P} q)
SELECT CASE WHEN t IS NULL THEN 'uncertain' WHEN t = l THEN 'model_error' WHEN t = m THEN 'label_error' ELSE 'vlm_disagrees_both' END AS arbitration,
CASE WHEN l = m THEN NULL WHEN m = 'Child' AND l <> 'Child' AND b IN ('infant','toddler','child','preteen') THEN 'labeled_' || l || '__really_Child' WHEN m <> 'Child' AND l = 'Child' AND b NOT IN ('infant','toddler','child','preteen','unknown') THEN 'labeled_Child__really_' || m ELSE 'needs_review__' || l || '_as_' || m END AS category, count(*) AS n FROM p GROUP BY ALL""")
def label_errors(s, d):
    """C10, C11, A16."""
    name = lambda k, n: F.when(k == 0, "Woman").when(k == 1, "Man").when(k < n, "Child")
    p = people(s, d).withColumns({"l": name(F.col("id") % 3, 3), "m": name(F.col("id") % 4, 4), "t": name(F.col("id") % 5, 3)})
    return p.select(C.arbitration(F.col("l"), F.col("m"), F.col("t")).alias("arbitration"), C.label_error(F.col("l"), F.col("m"), F.col("band"))["category"].alias("category")).groupBy("arbitration", "category").agg(F.count("*").alias("n"))


_PARTS = "[x for x in [CASE WHEN id % 2 = 0 THEN 'face' END, CASE WHEN id % 3 = 0 THEN 'hair' END, CASE WHEN id % 5 = 0 THEN 'arms' END, CASE WHEN id % 7 = 0 THEN 'legs' END, CASE WHEN id % 11 = 0 THEN 'chest' END, CASE WHEN id % 13 = 0 THEN 'tail' END] if x IS NOT NULL]"


@query("""WITH p AS (SELECT c_custkey AS id FROM customer), f AS (SELECT id, id % 3 = 0 AS hair, id % 5 = 0 AS arms, id % 7 = 0 AS legs, id % 11 = 0 AS chest, id % 13 = 0 AS tail FROM p)
SELECT id, CASE WHEN tail OR (legs AND chest) THEN 't4_high' WHEN legs OR chest THEN 't3_revealing' WHEN arms THEN 't2_ordinary' WHEN hair THEN 't1_modest' ELSE 't0_covered' END AS tier, CASE WHEN legs AND chest THEN 't4' WHEN tail OR legs OR chest THEN 't3' WHEN arms THEN 't2' WHEN hair THEN 't1' ELSE 't0' END AS tier_report,
CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 'apparent_gender=woman but facial_hair=full_beard' WHEN id % 2 = 0 AND id % 5 = 0 THEN 'apparent_gender=woman but head_covering=turban' WHEN id % 2 = 1 AND id % 7 = 0 THEN 'apparent_gender=man but garment_type=abaya' END AS contradiction FROM f""")
def exposure_tiers(s, d):
    """C12, C13."""
    i = F.col("c_custkey")
    parts = F.filter(F.array(*[F.when(i % k == 0, n) for k, n in ((2, "face"), (3, "hair"), (5, "arms"), (7, "legs"), (11, "chest"), (13, "tail"))]), lambda x: x.isNotNull())
    cues = {"facial_hair": F.when(i % 3 == 0, "full_beard").otherwise("none"), "head_covering": F.when(i % 5 == 0, "turban").otherwise("none"), "garment_type": F.when(i % 7 == 0, "abaya").otherwise("shirt")}
    return load(s, d, "customer").select(i.alias("id"), C.exposure_tier(parts).alias("tier"), C.exposure_tier_report(parts).alias("tier_report"), C.contradiction(F.when(i % 2 == 0, "woman").otherwise("man"), cues).alias("contradiction"))


@query("""SELECT vec_id, (list_position(embedding[1:3], list_max(embedding[1:3])) - 1)::INT AS id0, (list_position(embedding[4:6], list_max(embedding[4:6])) + 2)::INT AS id1, list_max(embedding[1:6])::DOUBLE AS score FROM embeddings""")
def score_groups(s, d):
    """C8."""
    x = C.split_scores(F.slice("embedding", 1, 6))
    return load(s, d, "embeddings").select("vec_id", x.alias("x")).select("vec_id", "x.id0", "x.id1", F.col("x.score").cast("double").alias("score"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 5 WHEN 1 THEN CASE WHEN c_custkey % 5 = 0 THEN 0 END WHEN 2 THEN CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END ELSE c_custkey % 5 END::INT AS emit_cls,
CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'Man' WHEN c_custkey % 3 = 0 THEN 'Child' WHEN c_custkey % 2 = 0 THEN 'Man' ELSE 'Woman' END AS man_first, CASE WHEN c_custkey % 3 = 0 THEN 'Child' WHEN c_custkey % 2 = 0 THEN 'Man' ELSE 'Woman' END AS child_first FROM customer""")
def detection_modes(s, d):
    """C21, C22."""
    i = F.col("c_custkey")
    mode = F.element_at(F.array(*map(F.lit, ("identity", "person", "prompts", "two_axis"))), (i % 4 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("a child", "a woman", "a man"))), (i % 3 + 1).cast("int"))
    g, grp = F.when(i % 2 == 0, "man").otherwise("woman"), F.when(i % 3 == 0, "child").otherwise("adult")
    return load(s, d, "customer").select(i.alias("id"), C.map_detection(mode, i % 5, name)["emit_cls"].alias("emit_cls"), C.primary("man_first", g, grp).alias("man_first"), C.primary("child_first", g, grp).alias("child_first"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::INT AS k, CASE WHEN event_id % 4 = 3 THEN 'unknown' ELSE event_type END AS kind, replace(replace(event_type || '/' || (event_id % 7)::VARCHAR || ' x', '/', '_'), ' ', '_') AS name, 'type: ' || event_type || CASE WHEN event_id % 2 = 0 THEN '; user: ' || user_id::VARCHAR ELSE '' END AS shown, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 2.5 + user_id * 10.0) / 1e6 END AS cost FROM events""")
def texts(s, d):
    """The last object of a noisy answer, coercion, rendering, cost."""
    e = load(s, d, "events")
    noisy = F.concat(F.lit('first {"k": 1} then '), F.col("props"), F.lit(" end"))
    kind = F.when(F.col("event_id") % 4 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "event_type"))
    shown = T.canonical([("type", F.col("event_type")), ("user", F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise("none"))])
    rate = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(2.5)
    return e.select("event_id", F.get_json_object(T.last_flat_object(noisy), "$.k").cast("int").alias("k"), T.coerced(kind).alias("kind"), T.safe_name(F.concat("event_type", F.lit("/"), (F.col("event_id") % 7).cast("string"), F.lit(" x"))).alias("name"), shown.alias("shown"), T.cost(F.col("event_id"), F.col("user_id"), rate, F.lit(10.0)).alias("cost"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::INT AS k, event_id % 2 = 0 AS even, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'real_person' END AS verdict, (event_id % 50)::DOUBLE AS age FROM events""")
def tolerant_json(s, d):
    """Answers with trailing commas around the object, normalised; flattened maps keep the later key."""
    e = load(s, d, "events")
    broken = F.concat(F.lit('Sure! {"o": '), F.col("props"), F.lit(", }"))
    raw = F.concat(F.lit('{"verdict": " '), F.when(F.col("event_id") % 2 == 0, "View").otherwise("Real_Person"), F.lit('", "estimated_age": "'), (F.col("event_id") % 50).cast("string"), F.lit('"} done'))
    flat = T.flattened(F.create_map(F.lit("k"), F.lit("a")), F.create_map(F.lit("k"), F.when(F.col("event_id") % 2 == 0, "y").otherwise("n")))
    return e.select("event_id", F.get_json_object(T.whole_or_last(broken), "$.o.k").cast("int").alias("k"), (flat["k"] == "y").alias("even"), T.verdict(raw)["verdict"].alias("verdict"), T.verdict(raw)["estimated_age"].alias("age"))


_LONG = "(SELECT c_custkey AS id, unnest(['seg', 'nation', 'm7']) AS field, unnest([c_mktsegment, c_nationkey::VARCHAR, (c_custkey % 7)::VARCHAR]) AS value FROM customer)"


def _cards(s, d):
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 7).alias("m7"))


@query(f"WITH c AS (SELECT field, value, count(*) AS n FROM {_LONG} l GROUP BY ALL) SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY field) AS share, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INT AS rank FROM c")
def distributions(s, d):
    """All fields in one scan."""
    long = A.long_form(_cards(s, d), "id", ["seg", "nation", "m7"])
    return A.distribution(long.join(A.detect_fields(long).select("field"), "field"))


@query(f"""WITH l AS {_LONG}, c AS (SELECT a.field AS field_a, a.value AS value_a, b.field AS field_b, b.value AS value_b, count(*) AS n FROM l a JOIN l b ON a.id = b.id AND a.field < b.field GROUP BY ALL),
x AS (SELECT DISTINCT field_a, field_b, value_a FROM c), y AS (SELECT DISTINCT field_a, field_b, value_b FROM c) SELECT field_a, value_a, field_b, value_b, coalesce(n, 0)::BIGINT AS n FROM x JOIN y USING (field_a, field_b) LEFT JOIN c USING (field_a, field_b, value_a, value_b)""")
def cross_tabs(s, d):
    """A27, with the cells that never occur."""
    return A.cross_tab(_cards(s, d), ["seg", "nation", "m7"], zero_cells=True)


@query(f"WITH l AS {_LONG}, c AS (SELECT a.field AS field_a, a.value AS value_a, b.field AS field_b, b.value AS value_b, count(*) AS n FROM l a JOIN l b ON a.id = b.id AND a.field < b.field GROUP BY ALL) SELECT * FROM c ORDER BY n, field_a, value_a, field_b, value_b LIMIT 12")
def sparsest_cells(s, d):
    """The twelve thinnest cells that occur."""
    return A.sparsest(A.cross_tab(_cards(s, d), ["seg", "nation", "m7"]), 12)


@query(f"""WITH l AS (SELECT id, field || '=' || value AS item FROM {_LONG} q), s2 AS (SELECT a.item || ' & ' || b.item AS items, count(*) AS n FROM l a JOIN l b ON a.id = b.id AND a.item < b.item GROUP BY 1),
s3 AS (SELECT a.item || ' & ' || b.item || ' & ' || c.item AS items, count(*) AS n FROM l a JOIN l b ON a.id = b.id AND a.item < b.item JOIN l c ON a.id = c.id AND b.item < c.item GROUP BY 1) SELECT * FROM s2 WHERE n >= 8 UNION ALL SELECT * FROM s3 WHERE n >= 8""")
def itemsets(s, d):
    """A28."""
    return A.itemsets(_cards(s, d), ["seg", "nation", "m7"], (2, 3), 8)


@query(f"""SELECT 'young women' AS slice, sum((age BETWEEN 0 AND 12 AND {_GENDER} = 'woman')::INT)::BIGINT AS n, CASE WHEN sum((age BETWEEN 0 AND 12 AND {_GENDER} = 'woman')::INT) >= 100 THEN 'ok' ELSE 'thin' END AS verdict FROM {_P} p
UNION ALL SELECT 'sure', sum((conf >= 50)::INT)::BIGINT, CASE WHEN sum((conf >= 50)::INT) >= 100 THEN 'ok' ELSE 'thin' END FROM {_P} p UNION ALL SELECT 'nobody', 0, 'missing'""")
def slices(s, d):
    """F6, F7, A29."""
    return A.slice_counts(people(s, d), {"young women": F.col("age").between(0, 12) & (F.col("gender") == "woman"), "sure": F.col("conf") >= 50, "nobody": F.col("age") > 1000}, 100)


@query("""WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS v, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT nation, sum(n) AS t, count(*) AS seen FROM c GROUP BY 1)
SELECT nation, round(sum(-(n / t) * ln(n / t)) / ln(5), 9) AS fixed, round(CASE WHEN any_value(seen) > 1 THEN sum(-(n / t) * ln(n / t)) / ln(any_value(seen)) ELSE 0 END, 9) AS observed FROM c JOIN t USING (nation) GROUP BY nation""")
def entropies(s, d):
    """A22, A23."""
    c = load(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.count("*").alias("n"))
    a, b = R.entropy(c, ["nation"], "n", 5), R.entropy(c, ["nation"], "n")
    return a.withColumnRenamed("entropy", "fixed").join(b.withColumnRenamed("entropy", "observed"), "nation").select("nation", F.round("fixed", 9).alias("fixed"), F.round("observed", 9).alias("observed"))


@query("""WITH v AS (SELECT o_custkey % 10 AS grp, o_custkey, count(*) AS x FROM orders GROUP BY ALL), r AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) AS i, count(*) OVER (PARTITION BY grp) AS n, sum(x) OVER (PARTITION BY grp) AS t FROM v)
SELECT grp, round(2.0 * sum(i * x) / (any_value(n) * any_value(t)) - (any_value(n) + 1.0) / any_value(n), 9) AS gini FROM r GROUP BY grp""")
def gini(s, d):
    """A24."""
    v = load(s, d, "orders").groupBy((F.col("o_custkey") % 10).alias("grp"), "o_custkey").agg(F.count("*").alias("x"))
    return R.gini(v, ["grp"], "x").select("grp", F.round("gini", 9).alias("gini"))


@query("""WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
p AS (SELECT 'floor_n' AS convention, grp, v FROM r WHERE i = least(n - 1, floor(n * 90 / 100.0)) UNION ALL SELECT 'round_n1', grp, v FROM r WHERE i = round_even(0.9 * (n - 1), 0) UNION ALL SELECT 'floor_n1', grp, v FROM r WHERE i = floor(0.9 * (n - 1)) UNION ALL SELECT 'floor_n_less1', grp, v FROM r WHERE i = greatest(0, floor(0.9 * n) - 1) UNION ALL SELECT 'upper_middle', grp, v FROM r WHERE i = n // 2)
SELECT convention, grp, v AS value FROM p""")
def percentiles(s, d):
    """Five conventions."""
    li = load(s, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"))
    return R.percentiles(li, ["grp"], "v", {c: (90, c) for c in R.PLACES}).select(F.col("name").alias("convention"), "grp", "value")


@query("""SELECT l_returnflag AS grp, count(*) AS n, avg(l_quantity) AS qty_mean, min(l_quantity) AS qty_min, max(l_quantity) AS qty_max, sum((l_discount > 0.05)::INT)::BIGINT AS cheap, sum((l_tax = 0)::INT)::BIGINT AS untaxed FROM lineitem GROUP BY 1""")
def anatomy(s, d):
    """One scan, many aggregates."""
    li = load(s, d, "lineitem").withColumnsRenamed({"l_returnflag": "grp", "l_quantity": "qty"})
    return A.anatomy(li, ["grp"], ["qty"], {"cheap": F.col("l_discount") > 0.05, "untaxed": F.col("l_tax") == 0})


@query("""WITH h AS (SELECT least(greatest(floor(l_discount * 100 + 0.5), 0), 10)::BIGINT AS bucket, count(*) AS n FROM lineitem GROUP BY 1) SELECT *, sum(n) OVER (ORDER BY bucket)::BIGINT AS below FROM h""")
def histogram(s, d):
    """Counts and running counts of a confidence-like column in hundredths."""
    b = F.least(F.greatest(F.floor(F.col("l_discount") * 100 + 0.5), F.lit(0)), F.lit(10))
    h = load(s, d, "lineitem").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))
    return h.withColumn("below", F.sum("n").over(Window.orderBy("bucket")))  # eleven rows


@query("""WITH n AS (SELECT c_nationkey AS grp, count(*) AS t FROM customer GROUP BY 1), k0 AS (SELECT c_nationkey AS grp, c_mktsegment AS v, count(*) AS c FROM customer GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY c DESC, v) AS r FROM k0)
SELECT n.grp, coalesce(max(CASE WHEN r = 1 AND c >= 0.25 * t THEN v END), 'mixed') AS label FROM n JOIN k USING (grp) GROUP BY n.grp""")
def modal_labels(s, d):
    """A44."""
    return A.modal_label(load(s, d, "customer"), "c_nationkey", ["c_mktsegment"], 0.25)


@query("""WITH m AS (SELECT o_orderpriority AS model, extract(year FROM o_orderdate) AS run, median(o_totalprice) AS med FROM orders GROUP BY ALL), q AS (SELECT model, avg(med) AS v FROM m GROUP BY 1), r AS (SELECT v FROM q WHERE model LIKE '1%')
SELECT model, round(q.v, 6) AS v, round(q.v - r.v, 6) AS delta FROM q, r""")
def benchmark_deltas(s, d):
    """Medians by run, then differences from the reference row."""
    from boxtide.operators.detection import against_reference

    o = load(s, d, "orders").select(F.col("o_orderpriority").alias("model"), F.year("o_orderdate").alias("run"), "o_totalprice")
    q = o.groupBy("model", "run").agg(F.percentile("o_totalprice", F.lit(0.5)).alias("med")).groupBy("model").agg(F.avg("med").alias("v")).withColumns({"tag": F.substring("model", 1, 1), "all": F.lit(1)})
    return against_reference(q, ["all"], "tag", "1", "v").select("model", F.round("v", 6).alias("v"), F.round("delta", 6).alias("delta"))


@query("""SELECT o_orderstatus AS model, sum(o_orderkey)::BIGINT AS tokens_in, round(sum((o_orderkey * 2.5 + o_custkey * 10.0) / 1e6), 6) AS usd, round(sum((o_orderkey * 2.5 + o_custkey * 10.0) / 1e6) / count(*) * 1000, 6) AS per_1k FROM orders GROUP BY 1""")
def costs(s, d):
    """A39, J14."""
    rates = s.createDataFrame([("O", 2.5, 10.0), ("F", 2.5, 10.0), ("P", 2.5, 10.0)], "o_orderstatus string, i double, o double")
    o = load(s, d, "orders").join(F.broadcast(rates), "o_orderstatus", "left")
    c = T.cost(F.col("o_orderkey"), F.col("o_custkey"), F.col("i"), F.col("o"))
    return o.groupBy(F.col("o_orderstatus").alias("model")).agg(F.sum("o_orderkey").alias("tokens_in"), F.round(F.sum(c), 6).alias("usd"), F.round(F.sum(c) / F.count("*") * 1000, 6).alias("per_1k"))


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':7'), o_orderkey LIMIT 100")
def seeded_sample(s, d):
    """The limit is the operator."""
    return S.take(load(s, d, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || ':3'), c_custkey) AS r FROM customer) WHERE r <= 5")
def stratum_sample(s, d):
    """O3: five of each stratum."""
    return S.per_stratum(load(s, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 5, 3)


@query("""WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || ':5'), c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_custkey, c_nationkey FROM r ORDER BY (r > 8)::INT, CASE WHEN r > 8 THEN -n ELSE 0 END, c_nationkey, r LIMIT 300""")
def stratified_fill(s, d):
    """O4."""
    return S.stratified_fill(load(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 8, 300, 5)


@query("SELECT l_orderkey AS stem, arg_max(l_partkey, {'a': l_extendedprice, 'b': l_partkey}) AS part FROM lineitem GROUP BY 1")
def most_confident(s, d):
    """O5."""
    return S.most_confident(load(s, d, "lineitem").select(F.col("l_orderkey").alias("stem"), "l_extendedprice", "l_partkey"), ["stem"], "l_extendedprice", ["l_partkey"]).select("stem", F.col("l_partkey").alias("part"))


@query("""WITH o AS (SELECT (o_orderstatus = 'F')::INT AS a, (o_custkey % 2)::INT AS b FROM orders), g AS (SELECT a, b, count(*) AS c, row_number() OVER (ORDER BY a, b) AS i FROM o GROUP BY a, b),
k AS (SELECT i, c, unnest(range(greatest(0, floor(c - 9 * sqrt(c)))::BIGINT, ceil(c + 9 * sqrt(c) + 12)::BIGINT + 1)) AS k FROM g),
e AS (SELECT i, k, exp(k * ln(c) - c - lgamma(k + 1)) AS e FROM k), t AS (SELECT i, k, sum(e) OVER (PARTITION BY i ORDER BY k) / sum(e) OVER (PARTITION BY i) AS u FROM e),
dr AS (SELECT r, i, (('0x' || substr(md5('20260825:' || r || ':' || i), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE AS u FROM g, range(1, 5001) q(r)),
w AS (SELECT dr.r, dr.i, t.k AS w FROM dr ASOF JOIN t ON t.i = dr.i AND t.u >= dr.u),
m AS (SELECT r, sum(w * a)::DOUBLE / sum(w) AS m, sum(w * (a - b))::DOUBLE / sum(w) AS d FROM w JOIN g USING (i) GROUP BY r)
SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, round(quantile_cont(d, 0.025), 9) AS diff_low, round(quantile_cont(d, 0.975), 9) AS diff_high, (SELECT round(avg(a), 9) FROM o) AS mean, (SELECT round(avg(a - b), 9) FROM o) AS diff_mean FROM m""")
def bootstrap(s, d):
    """5,000 rounds of a paired bootstrap, drawn for each distinct outcome."""
    o = load(s, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("a"), (F.col("o_custkey") % 2).cast("int").alias("b"))
    out = S.bootstrap(o, "a", 5000, 20260825, "b")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


_PTS = "(SELECT p_partkey AS id, (p_partkey % 20) / 20.0::DOUBLE AS t, (p_size * 7 % 50) / 50.0::DOUBLE AS rec, (p_partkey % 37) / 37.0::DOUBLE AS fp, p_brand AS brand FROM part)"


def _points(s, d):
    p = load(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20 / 20.0).alias("t"), (F.col("p_size") * 7 % 50 / 50.0).alias("rec"), (F.col("p_partkey") % 37 / 37.0).alias("fp"), F.col("p_brand").alias("brand"))


@query(f"SELECT id, rec - 0.5 * fp + abs(rec - fp) + least(rec, fp) AS objective, (rec >= 0.2 AND fp < 0.9) OR (0.1 < t AND t <= 0.3) AS feasible, CASE WHEN fp = 0 THEN 0.0 ELSE rec / fp END AS ratio FROM {_PTS} p".replace("- 0.5 *", "- 0.5::DOUBLE *").replace("THEN 0.0 ELSE", "THEN 0.0::DOUBLE ELSE"))
def metric_expressions(s, d):
    """Q1, Q2, F11."""
    m = {"arm.rec": F.col("rec"), "arm.fp": F.col("fp"), "arm.t": F.col("t")}
    return _points(s, d).select("id", H.expression("arm.rec - 0.5*(arm.fp) + abs(arm.rec - arm.fp) + min(arm.rec, arm.fp)", m).alias("objective"), H.expression("(arm.rec >= 0.2 and arm.fp < 0.9) or 0.1 < arm.t <= 0.3", m).alias("feasible"), H.expression("arm.rec / arm.fp", m).alias("ratio"))


@query(f"WITH p AS {_PTS} SELECT id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.rec >= a.rec AND b.fp <= a.fp AND (b.rec > a.rec OR b.fp < a.fp))")
def pareto(s, d):
    """Q6."""
    return H.pareto(_points(s, d), [("max", "rec"), ("min", "fp")]).select("id")


@query(f"WITH p AS {_PTS} SELECT id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.rec >= a.rec AND b.fp <= a.fp AND b.t >= a.t AND (b.rec > a.rec OR b.fp < a.fp OR b.t > a.t))")
def pareto_three(s, d):
    """Q6 with three axes."""
    return H.pareto(_points(s, d), [("max", "rec"), ("min", "fp"), ("max", "t")]).select("id")


@query(f"""WITH p AS {_PTS}, b AS (SELECT brand, 0.3::DOUBLE AS target FROM p GROUP BY 1)
SELECT brand, arg_min(t, {{'a': abs(fp - 0.3), 't': t, 'i': id}}) AS matched, max(CASE WHEN br = 1 THEN t END) AS best, arg_min(t, {{'r': CASE WHEN fp <= 0.5 THEN rec ELSE 99 END, 't': t}}) AS budget, arg_max(t, {{'j': rec - fp, 't': t}}) AS youden
FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY (fp < 0.8)::INT DESC, rec DESC, t DESC) AS br FROM p) GROUP BY brand""".replace("fp - 0.3", "fp - 0.3::DOUBLE"))
def operating_points(s, d):
    """Q5, Q7, Q8, Q9."""
    p = _points(s, d).withColumns({"target": F.lit(0.3), "most": F.lit(0.5), "ok": F.col("fp") < 0.8})
    a = H.matched_point(p, ["brand"], "fp", "target", "t").select("brand", F.col("t").alias("matched"))
    b = H.pick_best(p, "rec", "ok", ["t"], ["brand"]).select("brand", F.col("t").alias("best"))
    c = H.budget_pick(p, ["brand"], [("fp", "most")], "rec", "t").select("brand", F.col("t").alias("budget"))
    e = H.youden(p, "rec", "fp", "t", ["brand"]).select("brand", F.col("t").alias("youden"))
    return a.join(b, "brand").join(c, "brand").join(e, "brand")


@query("SELECT count(*) AS n, round(sum(a.v * 100 + b.v), 6) AS s FROM (SELECT i / 20.0::DOUBLE AS v FROM range(1, 20) t(i)) a, (SELECT i / 10.0::DOUBLE AS v FROM range(1, 6) t(i)) b")
def grids(s, d):
    """Q3, Q4, J15."""
    return H.grid_frame(s, [H.grid(0.05, 0.95, 0.05), H.grid(0.1, 0.5, 0.1)]).agg(F.count("*").alias("n"), F.round(F.sum(F.col("t0") * 100 + F.col("t1")), 6).alias("s"))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k""")
def key_diff(s, d):
    """D1."""
    o = load(s, d, "orders").withColumnRenamed("o_custkey", "k")
    return Q.stem_diff(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), "k")


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events")
def in_all(s, d):
    """D1, J8."""
    return Q.in_all({"c": load(s, d, "customer").select(F.col("c_custkey").alias("k")), "o": load(s, d, "orders").select(F.col("o_custkey").alias("k")), "e": load(s, d, "events").select(F.col("user_id").alias("k"))}, "k")


@query("""WITH a AS (SELECT l_orderkey AS stem, l_partkey AS line FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_orderkey AS stem, l_partkey AS line FROM lineitem WHERE l_linenumber >= 2), s AS (SELECT stem FROM a INTERSECT SELECT stem FROM b)
SELECT 'lost' AS kind, count(*) AS n FROM a WHERE stem IN (SELECT stem FROM s) AND NOT EXISTS (SELECT 1 FROM b WHERE b.stem = a.stem AND b.line = a.line) UNION ALL SELECT 'added', count(*) FROM b WHERE stem IN (SELECT stem FROM s) AND NOT EXISTS (SELECT 1 FROM a WHERE b.stem = a.stem AND b.line = a.line)""")
def additive(s, d):
    """D2."""
    li = load(s, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.col("l_partkey").alias("line"), "l_linenumber")
    lost, added = Q.additive(li.filter("l_linenumber <= 4").drop("l_linenumber"), li.filter("l_linenumber >= 2").drop("l_linenumber"), ["stem", "line"])
    return lost.agg(F.lit("lost").alias("kind"), F.count("*").alias("n")).unionAll(added.agg(F.lit("added").alias("kind"), F.count("*").alias("n")))


@query("""WITH r AS (SELECT doc_id, sha1(text) AS h, n_chars AS nm FROM documents WHERE doc_id % 10 = 0), i AS (SELECT doc_id, sha1(text) AS h, n_chars AS nm FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id, CASE WHEN h IN (SELECT h FROM r) THEN 'h' ELSE 'nm' END AS found_by FROM i WHERE h IN (SELECT h FROM r) OR nm IN (SELECT nm FROM r)""")
def contaminated(s, d):
    """D3: by content hash first, then by size."""
    x = load(s, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("h"), F.col("n_chars").alias("nm"))
    return Q.contaminated(x.filter("doc_id % 10 <> 0"), x.filter("doc_id % 10 = 0"), ["h", "nm"]).select("doc_id", "found_by")


@query("""SELECT 'quantity' AS "check", count(*) AS n, sum((NOT (l_quantity BETWEEN 1 AND 45))::INT)::BIGINT AS failed FROM lineitem UNION ALL SELECT 'order', count(*), sum((o_orderkey IS NULL)::INT)::BIGINT FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def integrity(s, d):
    """D5, D6, D7."""
    li, o = load(s, d, "lineitem"), load(s, d, "orders")
    return Q.integrity([("quantity", li, F.col("l_quantity").between(1, 45)), ("order", li.join(o, li["l_orderkey"] == o["o_orderkey"], "left"), F.col("o_orderkey").isNotNull())])


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0)::BIGINT AS n_left, coalesce(y, 0)::BIGINT AS n_right FROM (SELECT o_custkey AS k, count(*) AS x FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS y FROM events GROUP BY 1) b ON a.k = b.k WHERE coalesce(x, 0) <> coalesce(y, 0)""")
def reconcile(s, d):
    """D6."""
    return Q.reconcile(load(s, d, "orders").select(F.col("o_custkey").alias("k")), load(s, d, "events").select(F.col("user_id").alias("k")), "k")


@query("""WITH a AS (SELECT l_orderkey AS grp, l_quantity::INT AS v, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS grp, (CASE WHEN l_partkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END)::INT AS v, count(*) AS m FROM lineitem GROUP BY ALL)
SELECT grp, sum(abs(coalesce(n, 0) - coalesce(m, 0)))::BIGINT AS differences FROM a FULL JOIN b USING (grp, v) WHERE coalesce(n, 0) <> coalesce(m, 0) GROUP BY grp""")
def multisets(s, d):
    """D7."""
    li = load(s, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("grp"), F.col("l_quantity").cast("int").alias("v"))
    b = li.select(F.col("l_orderkey").alias("grp"), F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast("int").alias("v"))
    return Q.same_multiset(a, b, "grp", "v")


@query("SELECT user_id, arg_min(event_id, ts) AS first_event, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event FROM events GROUP BY 1".replace("arg_min(event_id, ts)", "arg_min(event_id, {'t': ts, 'e': event_id})"))
def first_and_last(s, d):
    """First wins, last wins."""
    e = load(s, d, "events").select("user_id", "event_id", "ts")
    order = [F.col("ts"), F.col("event_id")]
    return Q.dedupe(e, ["user_id"], order).select("user_id", F.col("event_id").alias("first_event")).join(Q.dedupe(e, ["user_id"], order, "last").select("user_id", F.col("event_id").alias("last_event")), "user_id")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT user_id FROM events)")
def pending(s, d):
    """J11."""
    return Q.pending(load(s, d, "customer").select(F.col("c_custkey").alias("k")), load(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), load(s, d, "events").select(F.col("user_id").alias("k")), ["k"])


@query("""WITH b AS (SELECT l_orderkey AS stem, l_partkey AS v FROM lineitem WHERE l_orderkey % 2 = 0), o AS (SELECT l_orderkey AS stem, l_suppkey AS v FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT * FROM b WHERE stem NOT IN (SELECT stem FROM o) UNION ALL SELECT * FROM o WHERE stem IN (SELECT stem FROM b)""")
def overlay(s, d):
    """J12."""
    li = load(s, d, "lineitem").withColumnRenamed("l_orderkey", "stem")
    return Q.overlay(li.filter("stem % 2 = 0").select("stem", F.col("l_partkey").alias("v")), li.filter("stem % 3 = 0").select("stem", F.col("l_suppkey").alias("v")), "stem")


@query("""WITH a AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS r, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS rank FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS r, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS rank FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.rank, b.rank)::INT AS rank, a.r AS a_row, b.r AS b_row FROM a FULL JOIN b ON a.k = b.k AND a.rank = b.rank""")
def paired_rows(s, d):
    """J16, W7."""
    li = load(s, d, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r"), "l_linenumber")
    return Q.paired_rows(li.filter("l_linenumber % 2 = 0"), li.filter("l_linenumber % 2 = 1"), ["k"], "r")


@query("SELECT event_id FROM (SELECT event_id, sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 100")
def spend_limit(s, d):
    """ST7."""
    e = load(s, d, "events").withColumn("usd", F.col("event_id") % 10)
    return Q.spend_limit(e, ["user_id"], ["ts", "event_id"], "usd", 100).select("event_id")


_L = "(SELECT c_nationkey AS stem, c_custkey AS id, (c_custkey % 3)::INT AS cls FROM customer)"


@query(f"""WITH v AS {_V}, l AS {_L}, j AS (SELECT l.stem, l.id, v.*EXCLUDE (id), v.id IS NOT NULL AS has FROM l LEFT JOIN (SELECT * FROM v WHERE id % 97 <> 0) v ON l.id = v.id),
e AS (SELECT stem, count(*) = count(CASE WHEN has THEN 1 END) AS emitted FROM j GROUP BY 1), x AS (SELECT j.*, emitted, {_PERSON} AS keep, {_FINAL.replace("WHEN estimated_age BETWEEN 1 AND 12 AND highlight_quality = 'good' THEN 'Child'", "")} AS f FROM j JOIN e USING (stem)),
y AS (SELECT *, CASE f WHEN 'Woman' THEN 0 WHEN 'Man' THEN 1 WHEN 'Child' THEN 2 END AS nc FROM x)
SELECT sum((emitted AND has AND keep AND f <> 'Unknown')::INT)::BIGINT AS kept, sum((emitted AND has AND NOT keep)::INT)::BIGINT AS deleted, sum((emitted AND has AND keep AND nc <> sam)::INT)::BIGINT AS relabeled, sum((emitted AND has AND keep AND f = 'Unknown')::INT)::BIGINT AS dropped_unknown, sum((NOT has)::INT)::BIGINT AS no_verdict, 0::BIGINT AS child_by_age FROM y""")
def emit_totals(s, d):
    """All or nothing per image."""
    v = verdicts(s, d).filter("id % 97 <> 0").select(F.col("id").alias("det_index"), F.col("sam").alias("sam_class_id"), F.lit(100.0).alias("person_px_height"), "v")
    lines = load(s, d, "customer").select(F.col("c_nationkey").alias("stem"), F.col("c_custkey").alias("det_index"), (F.col("c_custkey") % 3).cast("int").alias("cls"), F.lit("0.1 0.1 0.2 0.2").alias("geometry"))
    v = v.join(lines.select("stem", "det_index"), "det_index")
    return E.totals(E.decide(lines, v))


@query(
    "SELECT doc_id, CAST((((('0x' || substr(md5(doc_id::VARCHAR), 1, 16))::UBIGINT % 13) * (18446744073709551616::HUGEINT % 13) + (('0x' || substr(md5(doc_id::VARCHAR), 17, 16))::UBIGINT % 13)) % 13) AS BIGINT) AS shard FROM documents"
)
def shard_check(s, d):
    """Stable shards of all documents: the 128-bit md5 of the key as a number, mod 13; SQL folds its two halves."""
    return load(s, d, "documents").select("doc_id", T.md5_shard(F.col("doc_id").cast("string"), 13).alias("shard"))


@query()
def mock_engine(s, d):
    """The deterministic stand-in over all documents' ids."""
    return B.apply_engine(load(s, d, "documents").select(F.col("doc_id").cast("string").alias("key")), B.mock_engine, "key string, gender string, age long")


@query()
def clusters(s, d):
    """U3."""
    return B.one_hot_clusters(_cards(s, d).withColumn("nation", F.col("nation").cast("string")), "id", ["seg", "nation"], 4)
