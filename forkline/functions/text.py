"""Column functions over choice texts: disciplines, conditions, random-table rules, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the books' rules.
DISCIPLINE = r"(?i)\b(?:(?:Kai|Magnakai|Grand Master)\s+)?Discipline of\s+(.+?)(?=\s+(?:and|or|on|to|if|when|then|at|in)\b|[,.;:]|$)"
ITEM = r"(?i)\b(?:possess|have)\s+(?:a|an)\s+(.+?)(?=\s+and\b|[,.;:]|$)"
GOLD = r"(?i)\b(?:have|possess)\s+(\d+)\s+Gold Crowns?\b"
ENDURANCE = r"(?i)\b(\d+)\s+or\s+more\s+ENDURANCE\s+points?\b"
NEGATED = ("if not", "if you do not", "if you do not possess", "if you do not have")
NEGATED_STATE = (*NEGATED, "if you now have less than")
DRAW_WARNINGS = ("first choice", "last chance", "implicit dead end")


def mentions(text: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def disciplines(text: Column) -> Column:
    """The disciplines a text names, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DISCIPLINE), F.lit(1)), lambda x: F.trim(x)))


def kai_fallback(text: Column) -> Column:
    return mentions(text, NEGATED)


def condition_fallback(text: Column) -> Column:
    return mentions(text, NEGATED_STATE)


def state_condition(text: Column) -> Column:
    """STRUCT<kind, value> of a persistent-state condition, or null."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    item = F.trim(F.regexp_extract(text, ITEM, 1))
    named = text.rlike(ITEM) & ~F.lower(item).contains("discipline") & ~F.lower(item).contains("skill")
    return (
        F.when(condition_fallback(text), F.lit(None))
        .when(text.rlike(ENDURANCE), one("endurance_at_least", F.regexp_extract(text, ENDURANCE, 1)))
        .when(text.rlike(GOLD), one("gold_crowns_at_least", F.regexp_extract(text, GOLD, 1)))
        .when(named, one("has_item", item))
    )


def random_outcomes(rule: Column) -> Column:
    """How many of the digits 0 to 9 satisfy a rule; null where its wording isn't known."""
    low = F.regexp_replace(F.lower(rule), "[–—−]", "-")
    # The wordings of a draw, in order of precedence.
    digit = lambda pattern, k=1: F.regexp_extract(low, pattern, k).try_cast("int")
    interval, lower, higher, single = r"\b([0-9])\s*-\s*([0-9])\b", r"\b([0-9])\s+or\s+lower\b", r"\b([0-9])\s+or\s+higher\b", r"\bpick(?:ed)?\s+(?:a\s+)?([0-9])\b"
    width = digit(interval, 2) - digit(interval, 1) + 1
    return (
        F.when(low.rlike(interval) & (width > 0), width)
        .when(low.rlike(lower), digit(lower) + 1)
        .when(low.rlike(higher), 10 - digit(higher))
        .when(low.rlike(single), F.lit(1))
    )


def joined_note(*parts: Column) -> Column:
    return F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))


def quoted(text: Column) -> Column:
    """A text between double quotes, with quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def edge_key(source: Column, target: Column) -> Column:
    return F.concat_ws("->", source.cast("string"), target.cast("string"))


def provenance(origin: str, line: Column) -> Column:
    """Where a row came from: its file, or how it was made, and the line or key."""
    return F.concat_ws(":", F.lit(origin), line.cast("string"))


def comes_from(reference: Column, origin: str) -> Column:
    return reference.startswith(f"{origin}:")


def edge_id(n: Column) -> Column:
    return F.format_string("e%04d", n)


def is_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_-]+$")


def is_close(a: Column, b: Column, absolute: float = 0.0, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_probability(x: Column) -> Column:
    return is_finite(x) & x.between(0.0, 1.0)


def is_positive(x: Column) -> Column:
    return is_finite(x) & (x > 0)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def format_g(x: float, digits: int = 15) -> str:
    """A number for export, without trailing zeros."""
    return f"{x:.{digits}g}"


def rate_interval(losses: Column, attempts: Column) -> dict[str, Column]:
    """A binomial rate with its normal 95 % interval, clamped; rate 0 without attempts."""
    rate = F.when(attempts > 0, losses / attempts).otherwise(0.0)
    half = F.when(attempts > 0, 1.96 * F.sqrt(rate * (1 - rate) / attempts))
    return {"loss_probability": rate, "ci95_low": F.greatest(F.lit(0.0), rate - half), "ci95_high": F.least(F.lit(1.0), rate + half)}


def prompt(paragraph: Column, instructions: str) -> Column:
    """A chat prompt of instructions and a JSON paragraph, for a pluggable annotator."""
    start = "<|im_start|>"
    stop = "<|im_end|>\n"
    return F.concat(F.lit(f"{start}system\n{instructions}{stop}{start}user\n"), F.to_json(paragraph), F.lit(f"{stop}{start}assistant\n"))


def model_edges(answer: Column) -> Column:
    """The edges of a model's JSON answer; an empty list where it can't be read."""
    kind = "edges array<struct<source_id:string,target_id:string,edge_text:string,transition_type:string,realisation_value:string,semantic_risk:string,semantic_morality:string,semantic_action:string,warnings:string>>"
    return F.coalesce(F.from_json(answer, kind)["edges"], F.array())
