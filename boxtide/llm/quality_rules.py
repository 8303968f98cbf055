"""Quality rules with adaptive fences from mergeable quantile sketches, in DataFrame functions only.

Each document's measures are integers (shares are scaled to 1/10000). A sketch of one measure is a histogram whose
buckets keep the leading SIGNIFICANT bits of the value: it is exact below 2**SIGNIFICANT, within 1/2**(SIGNIFICANT-1)
above, and two sketches merge by adding counts, so the outcome depends neither on partitions nor on order. Sketches
are kept per (lang, source), merged into one per lang and one for all; a group with too few documents takes its
fences from the next wider sketch. A document is kept if it passes the base rule and no measure lies beyond its
group's outer fence, upper quartile + REACH * (inter-quartile range) + the measure's slack.

Defined results: null text has no words and fails the base rule; null lang or source form a group of their own; an
empty table gives an empty result. In `stage` all columns of the documents come through untouched, whatever their names;
`apply` adds its measures and verdict to the kept columns, and leaves out those of the same names or that begin with `qr_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, cut, table, text_of, written

SIGNIFICANT = 6
REACH = 4
MIN_GROUP = 200
#: Fences of up to BROADCAST groups (about 100 bytes each) are broadcast; more are joined, with each group's documents dealt over SALTS keys.
BROADCAST, SALTS = 100_000, 64
#: Measure -> slack, in the measure's units: what every group may exceed its fence by.
SLACK = {"word_len": 3000, "symbols": 100, "dup_lines": 5000, "repeats": 4000, "caps": 1500, "bangs": 100, "pipes": 300}
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
#: Bits of a packed value that hold a position; texts with more words sort pairs of a whole hash and a position instead.
POSITION_BITS = 18


def _windows(h: Column, of) -> Column:
    """of(hash, position) for each window of three word hashes, in order."""
    n = F.size(h) - 2
    return F.sort_array(F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: of(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), i.cast("long"))))


def _recurring(s: Column, high, low) -> Column:
    """Positions, in order, of those windows whose high(), the hash, a neighbour has too."""
    same = lambda x, i: (i > 0) & (high(x) == high(F.get(s, F.greatest(i - 1, F.lit(0)))))
    again = F.filter(s, lambda x, i: F.coalesce((high(x) == high(F.get(s, i + 1))) | same(x, i), same(x, i)))
    return F.sort_array(F.transform(again, low))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and qr_* columns with the measures of every whole text; no shuffle."""
    group = {k: F.coalesce(docs[c].cast("string"), F.lit("")) for k, c in (("qr_lang", "lang"), ("qr_source", "source"))}
    df = docs.select(*[docs[c] for c in keep if not c.startswith("qr_") and c not in RESULTS], *[v.alias(k) for k, v in group.items()], text_of(docs).alias("qr_text"))
    df = df.withColumns({
        "qr_w": F.filter(F.split("qr_text", SPACE, -1), lambda w: w != ""),
        "qr_l": F.filter(F.split("qr_text", "\n", -1), lambda s: s.rlike(WORD)),
    })
    without = lambda chars: F.length("qr_text") - F.length(F.regexp_replace("qr_text", chars, ""))
    df = df.withColumns({
        "n_words": F.size("qr_w").cast("long"),
        "word_chars": F.length(F.array_join("qr_w", "")).cast("long"),
        "n_symbols": without("[#*$%&|<>]").cast("long"),
        "qr_lines": F.size("qr_l").cast("long"),
        "n_dup_lines": (F.size("qr_l") - F.size(F.array_distinct("qr_l"))).cast("long"),
        "qr_caps": without("[A-Z]").cast("long"),
        "qr_bangs": without("!").cast("long"),
        "qr_pipes": without("[|]").cast("long"),
        "qr_h": F.transform("qr_w", lambda w: F.xxhash64(w)),
    }).drop("qr_w", "qr_l", "qr_text")
    h, wide = F.col("qr_h"), F.size("qr_h") >= (1 << POSITION_BITS)
    mask = (1 << POSITION_BITS) - 1
    df = df.withColumns({  # one of the two is null
        "qr_s": F.when(~wide, _windows(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i))),
        "qr_t": F.when(wide, _windows(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    }).drop("qr_h")
    packed = _recurring(F.col("qr_s"), lambda x: F.call_function("shiftright", x, F.lit(POSITION_BITS)), lambda x: x.bitwiseAND(F.lit(mask)))
    df = df.withColumn("qr_p", F.coalesce(packed, _recurring(F.col("qr_t"), lambda x: x["h"], lambda x: x["i"]))).drop("qr_s", "qr_t")
    p = F.col("qr_p")
    cover = F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
    df = df.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x)).drop("qr_p")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def scaled() -> dict[str, Column]:
    """The measures that fences are set on."""
    per = lambda k, of, scale: F.floor(F.col(k) * scale / F.greatest(F.col(of), F.lit(1))).cast("long")
    return {
        "word_len": per("word_chars", "n_words", 1000), "symbols": per("n_symbols", "word_chars", 10000), "dup_lines": per("n_dup_lines", "qr_lines", 10000),
        "repeats": per("n_repeat_words", "n_words", 10000), "caps": per("qr_caps", "word_chars", 10000), "bangs": per("qr_bangs", "word_chars", 10000), "pipes": per("qr_pipes", "word_chars", 10000),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """Counts by (qr_lang, qr_source, qr_measure, qr_bucket) of documents that pass the base rule; '*' marks a merged level.
    Its size depends on the number of groups, not of documents."""
    m = scaled()
    value = F.col("qr_v.v")
    drop = F.greatest(F.length(F.bin(value)) - SIGNIFICANT, F.lit(0))
    own = (
        measured.filter(~F.col("base_failed"))
        .select("qr_lang", "qr_source", F.explode(F.array(*[F.struct(F.lit(k).alias("m"), v.alias("v")) for k, v in m.items()])).alias("qr_v"))
        .select("qr_lang", "qr_source", F.col("qr_v.m").alias("qr_measure"), F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop).alias("qr_bucket"))
        .groupBy("qr_lang", "qr_source", "qr_measure", "qr_bucket").agg(F.count("*").alias("qr_n"))
    )
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), a.alias("l"), b.alias("s")) for k, a, b in ((0, F.col("qr_lang"), F.col("qr_source")), (1, F.col("qr_lang"), F.lit("*")), (2, F.lit("*"), F.lit("*")))]))
    return (
        own.select(levels.alias("x"), "qr_measure", "qr_bucket", "qr_n")
        .groupBy(F.col("x.k").alias("qr_level"), F.col("x.l").alias("qr_lang"), F.col("x.s").alias("qr_source"), "qr_measure", "qr_bucket").agg(F.sum("qr_n").alias("qr_n"))
    )


def fences(sketches: DataFrame) -> DataFrame:
    """A row per level and group: its documents, and a fence for each measure."""
    group = ["qr_level", "qr_lang", "qr_source", "qr_measure"]
    w = Window.partitionBy(*group)
    ranked = sketches.withColumns({"below": F.sum("qr_n").over(w.orderBy("qr_bucket")), "total": F.sum("qr_n").over(w)})
    quarter = lambda k: F.min(F.when(F.col("below") * 4 >= F.col("total") * k, F.col("qr_bucket")))
    per = ranked.groupBy(*group).agg(quarter(1).alias("lo"), quarter(3).alias("hi"), F.max("total").alias("n"))
    limit = lambda k: F.max(F.when(F.col("qr_measure") == k, F.col("hi") + (F.col("hi") - F.col("lo")) * REACH + SLACK[k]))
    return per.groupBy(*group[:3]).agg(F.max("n").alias("qr_docs"), *[limit(k).alias(f"qr_max_{k}") for k in SLACK])


def apply(docs: DataFrame, keep: list[str], wide: bool = False) -> DataFrame:
    """`keep` columns of docs, the measures, and `kept`. wide: the columns carry texts, so the cut is compressed."""
    measured = (written if wide else cut)(measures(docs, keep))
    f = fences(sketch(measured)).filter(F.col("qr_docs") >= F.when(F.col("qr_level") == 2, 0).otherwise(MIN_GROUP))
    limits = [f"qr_max_{k}" for k in SLACK]
    keys = measured.select("qr_lang", "qr_source").distinct()
    at = [f.filter(F.col("qr_level") == k).select(*[F.col(c).alias(f"{c}_{k}") for c in limits], *([F.col("qr_lang")] * (k < 2)), *([F.col("qr_source")] * (k < 1))) for k in range(3)]
    fenced = keys.join(at[0], ["qr_lang", "qr_source"], "left").join(at[1], ["qr_lang"], "left").join(F.broadcast(at[2]), F.lit(True), "left")  # at[2] is one row
    fenced = fenced.select("qr_lang", "qr_source", *[F.coalesce(*[F.col(f"{c}_{k}") for k in range(3)]).alias(c) for c in limits])
    joined = _with_fences(measured, fenced)
    inside = F.lit(True)
    for k, v in scaled().items():
        inside = inside & F.coalesce(v <= F.col(f"qr_max_{k}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def _with_fences(measured: DataFrame, fenced: DataFrame) -> DataFrame:
    """Every document with its group's fences; no group's documents meet in one task."""
    by, few = ["qr_lang", "qr_source"], fenced.limit(BROADCAST + 1).collect()
    if len(few) <= BROADCAST:
        return measured.join(F.broadcast(measured.sparkSession.createDataFrame(few, fenced.schema)), by, "left")
    fenced = cut(fenced)
    salted = fenced.withColumn("qr_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = measured.withColumn("qr_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "qr_caps", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return dealt.join(salted.hint("merge"), [*by, "qr_salt"], "left").drop("qr_salt")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = apply(table(spark, sf_dir, "documents"), ["doc_id"])
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[docs[c].alias(n) for c, n in own.items()], *[docs[c] for c in ("lang", "source", "text")])
    return apply(named, list(own.values()), wide=True).filter("kept").select(*[F.col(n).alias(c) for c, n in own.items()])


def _limit_sql(k: str, lv: int) -> str:
    return f"max(CASE WHEN level = {lv} AND measure = '{k}' THEN hi + (hi - lo) * {REACH} + {SLACK[k]} END)"


_MEASURE_SQL = {
    "word_len": "word_chars * 1000 // greatest(n_words, 1)", "symbols": "n_symbols * 10000 // greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 10000 // greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 10000 // greatest(n_words, 1)", "caps": "caps * 10000 // greatest(word_chars, 1)", "bangs": "bangs * 10000 // greatest(word_chars, 1)", "pipes": "pipes * 10000 // greatest(word_chars, 1)",
}

#: DuckDB, as CTEs over `documents` that end in qr_verdict(all columns of documents, the measures, kept).
CTES = f"""
qr_base AS (SELECT *, coalesce(text, '') AS qt, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM documents),
qr_words AS (SELECT doc_id, regexp_extract_all(qt, '[^\\x20\\x09-\\x0D]+') AS w FROM qr_base),
qr_pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM qr_words),
qr_win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM qr_pos),
qr_rep AS (SELECT doc_id, count(DISTINCT p) AS n_rep FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM qr_win WHERE c > 1) GROUP BY doc_id),
qr_lines AS (SELECT doc_id, list_filter(string_split(qt, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM qr_base),
qr_m AS (SELECT b.*, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(qt, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
  coalesce(n_rep, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(qt, '[A-Z]'))::BIGINT AS caps, len(regexp_extract_all(qt, '!'))::BIGINT AS bangs, len(regexp_extract_all(qt, '[|]'))::BIGINT AS pipes
  FROM qr_base b JOIN qr_words USING (doc_id) JOIN qr_lines USING (doc_id) LEFT JOIN qr_rep USING (doc_id)),
qr_s AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, {", ".join(f"{v} AS m_{k}" for k, v in _MEASURE_SQL.items())} FROM qr_m),
qr_long AS ({" UNION ALL ".join(f"SELECT l, s, '{k}' AS measure, m_{k} AS v FROM qr_s WHERE NOT base_failed" for k in SLACK)}),
qr_own AS (SELECT l, s, measure, (v >> greatest(length(bin(v)) - {SIGNIFICANT}, 0)) << greatest(length(bin(v)) - {SIGNIFICANT}, 0) AS b, count(*) AS n FROM qr_long GROUP BY ALL),
qr_lev AS (SELECT 0 AS level, l, s, measure, b, n FROM qr_own UNION ALL SELECT 1, l, '*', measure, b, sum(n) FROM qr_own GROUP BY ALL UNION ALL SELECT 2, '*', '*', measure, b, sum(n) FROM qr_own GROUP BY ALL),
qr_cum AS (SELECT *, sum(n) OVER (PARTITION BY level, l, s, measure ORDER BY b) AS below, sum(n) OVER (PARTITION BY level, l, s, measure) AS total FROM qr_lev),
qr_q AS (SELECT level, l, s, measure, min(CASE WHEN below * 4 >= total THEN b END) AS lo, min(CASE WHEN below * 4 >= total * 3 THEN b END) AS hi, max(total) AS n FROM qr_cum GROUP BY ALL
  HAVING level = 2 OR max(total) >= {MIN_GROUP}),
qr_f AS (SELECT k.l, k.s, {", ".join(f"coalesce({', '.join(_limit_sql(k, lv) for lv in range(3))}) AS x_{k}" for k in SLACK)}
  FROM (SELECT DISTINCT l, s FROM qr_s) k LEFT JOIN qr_q q ON (q.level = 0 AND q.l = k.l AND q.s = k.s) OR (q.level = 1 AND q.l = k.l) OR q.level = 2 GROUP BY k.l, k.s),
qr_verdict AS (SELECT qr_s.*, NOT base_failed {" ".join(f"AND coalesce(m_{k} <= x_{k}, true)" for k in SLACK)} AS kept FROM qr_s JOIN qr_f USING (l, s))
"""

SQL = f"WITH {CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM qr_verdict"
