"""Answers of language models, parsed by folds over columns and by a plain loop."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from boxtide.functions import text as T


def load(t):
    try:
        v = json.loads(t)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def all_objects(t):
    """Outermost objects: at each brace the shortest prefix that parses, then on behind it."""
    out, i = [], 0
    while (j := t.find("{", i)) >= 0:
        end = next((e for e in range(j + 1, len(t) + 1) if t[e - 1] == "}" and load(t[j:e]) is not None), None)
        if end:
            out.append(load(t[j:end]))
        i = end or j + 1
    return out


def first_rule(t):
    a, b = t.find("{"), t.rfind("}")
    if a < 0 or b < a:
        return None
    span = t[a : b + 1]
    repaired = re.sub(r'"[A-Za-z_]+":\s*(?="[A-Za-z_]+":)', "", re.sub(r",\s*([}\]])", r"\1", span))
    for s in (span, repaired):
        if load(s) is not None:
            return load(s)
    return next(reversed(all_objects(t)), None)


def second_rule(t):
    hit, i = None, 0
    while (a := t.find("{", i)) >= 0 and (b := t.find("}", a)) >= 0:
        hit = load(t[a : b + 1]) if load(t[a : b + 1]) is not None else hit
        i = b + 1
    if hit is None and "{" in t and t.rfind("}") > t.find("{"):
        return load(t[t.find("{") : t.rfind("}") + 1])
    return hit


FIXED = [
    "no object at all", "", None, "{", "}", "}{", "{}", "{}{}", "{x} {}", '{"a": {"b": 1}} wait {"a": {"b": 2}}', 'He said "{" and {"a": "}"} then "', '{"a": "\\"}{", "b": [1, {"c": 2}]} end', '{"box": [1, 2], "label": "who": "x", }', "```json\n{\"a\": 1,}\n```",
    '{not json {"a": 1}}', '\\{"a": 1}', '{"a": 1} {"b": ', '{"a": "line\nbreak"}', "{'a': 1}", '{"a": 01}', '{"a": NaN, "a": 2}', '{"日本": "é{"} {"z": "\U0001f600"}', '{"a": "\\u007b\\\\"} {"b": "\\\\\\""}', '{"a": nul}', '[{"a": 1}, {"b": 2}]', '{"deep": ' * 30 + "1" + "}" * 30,
]
PIECES = ["{", "}", '"a"', ":", "1", ",", "[", "]", '"b c"', "null", '{"x": 1}', '{"y": {"z": "}"}}', " ", '"q\\"w"', '"', "\\", '"a": 1', "\n", "so ", '"k": "l": 2', "\\{"]


@pytest.fixture(scope="module")
def answers(spark):
    r = random.Random(5)
    made = ["".join(r.choice(PIECES) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    half = [f'note "{r.choice(PIECES)}" {{"v": {r.choice(PIECES)}}} or {{"v": {{"w": {r.choice(PIECES)}}}}}{r.choice(PIECES)}' for _ in range(1500)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*FIXED, *made, *half])], "id int, t string").repartition(4)


@pytest.mark.parametrize(("column", "rule"), [(T.whole_or_last, first_rule), (T.last_flat_object, second_rule)])
def test_rules(answers, column, rule):
    n = 0
    for r in answers.select("t", column(F.col("t")).alias("got")).collect():
        want = rule(r.t) if r.t else None
        got = None if r.got is None else json.loads(r.got)
        assert str(got) == str(want), r
        n += want is not None
    assert n > 1000


def test_all_objects(answers):
    for r in answers.filter("t IS NOT NULL").select("t", T.objects(F.col("t")).alias("got")).collect():
        assert str([json.loads(x) for x in r.got]) == str(all_objects(r.t)), r


def test_long_answer(spark):
    t = 'think { ' * 300 + '{"verdict": "Real_Person", "note": "' + '\\" {' * 3000 + '"}' + " words" * 20000
    got = spark.createDataFrame([(t,)], "t string").select(T.verdict(F.col("t"))["verdict"], F.length(T.whole_or_last(F.col("t")))).first()
    assert got[0] is None and got[1] == len('{"verdict": "Real_Person", "note": "' + '\\" {' * 3000 + '"}')


def test_verdict(spark):
    cases = {
        None: None, "": None, "not an object": None, '{"gender": "man"}': None, '{"verdict": null}': ("none", "unknown", "unknown", "good", "unknown", None, None, None, None),
        'So {"verdict": "x"} no: {"verdict": " Real_Person ", "gender": "WOMAN", "age_group": "Adult", "highlight_quality": "Bad", "confidence": "High", "estimated_age": "31", "apparent_race": " Asian ", "head_covering": null, "exposed_body_parts": ["Face", " ", "ARMS"]}':
            ("real_person", "woman", "adult", "bad", "high", "Asian", None, 31.0, ["face", "arms"]),
        '{"verdict": "depiction", "verdict_confidence": "Low", "estimated_age": "old", "exposed_body_parts": " None "}': ("depiction", "unknown", "unknown", "good", "low", None, None, None, ["None"]),
        '{"verdict": "a", "verdict": "b", "estimated_age": 4.5, "exposed_body_parts": []}': ("b", "unknown", "unknown", "good", "unknown", None, None, 4.5, []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.verdict(F.col("t")).alias("v"))
    for r in df.collect():
        assert (None if r.v is None else tuple(r.v)) == cases[r.t], r
