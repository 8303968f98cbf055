"""Tolerant JSON, schema coercion and text rendering as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a strict parser takes; a text that goes on behind its object passes too, so callers look where the object ends.
_STRICT = {"allowSingleQuotes": "false"}
#: Fixed patterns of the two repairs: a comma before a closing bracket, and a key that another key follows.
_TRAILING_COMMA = r",\s*([}\]])"
_ORPHAN_KEY = r'"[A-Za-z_]+":\s*(?="[A-Za-z_]+":)'


def _parsed(text: Column) -> Column:
    return F.from_json(text, "map<string,string>", _STRICT)


def objects(text: Column) -> Column:
    """Every JSON object of a text that no other one holds, in order, as JSON text; braces that open none are passed over.

    One fold over the text's braces, quotes and escapes. Outside objects quotes mean nothing; a brace opens an object if a strict
    parse from there on succeeds, and from then strings, escapes and depth are followed to its closing brace."""
    at_rest = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, token: Column) -> Column:
        end = state["pos"] + F.length(token)
        brace = end - 1  # an escaped brace outside objects opens one as well
        opens = (state["depth"] == 0) & F.endswith(token, F.lit("{"))
        opens = opens & F.when(opens, _parsed(F.substring(text, brace, F.length(text))).isNotNull()).otherwise(False)
        inside = state["depth"] > 0
        quoted = F.when(inside & (token == '"'), ~state["quoted"]).otherwise(state["quoted"])
        turn = F.when(opens, 1).when(inside & ~state["quoted"] & (token == "{"), 1).when(inside & ~state["quoted"] & (token == "}"), -1).otherwise(0)
        depth = state["depth"] + turn
        start = F.when(opens, brace).otherwise(state["start"])
        closed = inside & (depth == 0)
        found = F.when(closed, F.concat(state["found"], F.array(F.substring(text, start, end - start)))).otherwise(state["found"])
        return F.struct(end.alias("pos"), depth.alias("depth"), (quoted & (depth > 0)).alias("quoted"), start.alias("start"), found.alias("found"))

    tokens = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["{}\\]|[^"{}\\]+'), F.lit(0))
    return F.aggregate(tokens, at_rest, step, lambda state: state["found"])


def _whole(span: Column) -> Column:
    """The span if it is one strict JSON object and nothing else."""
    return F.when(F.try_element_at(objects(span), F.lit(1)) == span, span)


def _span(text: Column) -> Column:
    """From the first brace to the last; empty where there is none."""
    return F.regexp_extract(text, r"(?s)(\{.*\})", 1)


def last_flat_object(text: Column) -> Column:
    """Of the stretches from a brace to the next closing one, the last that parses; else the whole span, if it does; else null."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0))
    return F.coalesce(F.try_element_at(F.filter(blocks, lambda b: _parsed(b).isNotNull()), F.lit(-1)), _whole(_span(text)))


def whole_or_last(text: Column) -> Column:
    """The span from the first to the last brace, then the same repaired (trailing commas, keys without a value), then the last
    object of the text (the answer's own correction of an earlier one); null where nothing parses."""
    span = _span(text)
    repaired = F.regexp_replace(F.regexp_replace(span, _TRAILING_COMMA, "$1"), _ORPHAN_KEY, "")
    return F.coalesce(_whole(span), _whole(repaired), F.try_element_at(objects(span), F.lit(-1)))


def coerced(value: Column) -> Column:
    """Trimmed text; missing or empty is 'unknown'."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit("unknown"))


def member(o: Column, key: str, missing: str | None = None) -> Column:
    """The value of a key of an object (the last of equal keys) as text; `missing` without the key, 'None' for a JSON null."""
    own = F.filter(F.map_entries(_parsed(o)), lambda e: e["key"] == key)
    return F.when(F.size(own) > 0, F.coalesce(F.try_element_at(own, F.lit(-1))["value"], F.lit("None"))).otherwise(F.lit(missing))


def verdict(raw: Column) -> Column:
    """T4: a raw answer -> the normalised verdict struct, null where it holds no object with a verdict.

    Lists keep their non-empty members in lower case; a text in a list's place is a list of itself, and a list in a text's place is
    kept as JSON text. Missing fields have the defaults below, missing lists and analysis fields are null."""
    o = last_flat_object(raw)
    low = lambda *values: F.lower(F.trim(F.coalesce(*values)))
    text = lambda k: F.trim(F.nullif(member(o, k), F.lit("None")))
    parts = member(o, "exposed_body_parts")
    listed = F.filter(F.transform(F.from_json(parts, "array<string>", _STRICT), lambda p: F.lower(F.trim(F.coalesce(p, F.lit("None"))))), lambda p: p != "")
    return F.when(
        member(o, "verdict").isNotNull(),
        F.struct(
            low(member(o, "verdict")).alias("verdict"), low(member(o, "gender", "unknown")).alias("gender"), low(member(o, "age_group", "unknown")).alias("age_group"), low(member(o, "highlight_quality", "good")).alias("highlight_quality"),
            low(member(o, "confidence"), member(o, "verdict_confidence", "unknown")).alias("confidence"), text("apparent_race").alias("apparent_race"), text("head_covering").alias("head_covering"),
            F.trim(member(o, "estimated_age")).try_cast("double").alias("estimated_age"), F.when(F.startswith(F.trim(parts), F.lit("[")), listed).when(parts != "None", F.array(F.trim(parts))).alias("exposed_body_parts"),
        ),
    )


def flattened(*maps: Column) -> Column:
    """T5: one map of several, later keys winning, whatever the session's map policy."""
    def without(m: Column, later: Column) -> Column:
        return F.map_filter(m, lambda k, _: ~F.map_contains_key(later, k))

    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(without(out, m), m)
    return out


def canonical(pairs: list[tuple[str, Column]]) -> Column:
    """T6: 'name: value' of what is known, in order."""
    parts = [F.when(~F.coalesce(v, F.lit("")).isin("", "unknown", "none"), F.concat(F.lit(f"{k}: "), v)) for k, v in pairs]
    return F.concat_ws("; ", *parts)


def safe_name(s: Column) -> Column:
    """T7."""
    return F.regexp_replace(s, r"[/ ]", "_")


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Dollars at rates per million tokens; null where a rate is."""
    return (tokens_in * rate_in + tokens_out * rate_out) / F.lit(1e6)


def shard(key: Column, n: int) -> Column:
    """A stable shard by crc32."""
    return F.crc32(key.cast("binary")) % n


def md5_shard(key: Column, n: int) -> Column:
    """The 128-bit md5 as a number, mod n, folded digit by digit."""
    digits = F.split(F.md5(key.cast("binary")), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda a, d: (a * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1) % n)
