"""Choices to annotated edges.

The default annotator is declarative: rules over each choice and its siblings. A model can take
its place through ``annotate_with`` (a function from batches of prompts to answers). Semantic axes
can't be read from the wording, so the rules mark them neutral, the value without effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forkline import schemas
from forkline.functions import text as fx


def rule_annotator(choices: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (columns of ``schemas.EDGES`` and ``position``) from choices and their pages' texts.

    In order: an only choice is forced; a page that mentions the random number table and whose
    choices cover the ten digits is stochastic; a choice that names a discipline, or negates one
    that a sibling names, is conditional, as is one with a state condition and its negation; what
    is left is an explicit choice.
    """
    page = nodes.select(F.col("node_id").alias("source_id"), "text_content")
    w = Window.partitionBy("source_id")
    d = choices.join(page, "source_id", "left").withColumn("n", F.count("*").over(w))
    d = d.withColumn("digits", fx.random_outcomes(F.col("edge_text"))).withColumn("covered", F.sum("digits").over(w)).withColumn("known", F.count("digits").over(w))
    named = F.size(fx.disciplines(F.col("edge_text"))) > 0
    state = fx.state_condition(F.col("edge_text")).isNotNull()
    d = d.withColumn("named", named).withColumn("state", state).withColumn("any_named", F.max("named").over(w)).withColumn("any_state", F.max("state").over(w))
    negated = fx.condition_fallback(F.col("edge_text"))
    chance = F.lower("text_content").contains("random number table") & (F.col("covered") == 10) & (F.col("known") == F.col("n"))
    kind = (
        F.when(F.col("n") == 1, "forced")
        .when(chance, "stochastic")
        .when(F.col("named") | (F.col("any_named") & negated), "conditional")
        .when(~F.col("any_named") & (F.col("state") | (F.col("any_state") & negated)), "conditional")
        .otherwise("explicit_choice")
    )
    d = d.withColumn("transition_type", kind)
    d = d.withColumn("realisation_value", F.when(F.col("transition_type").isin("stochastic", "conditional"), F.col("edge_text")).otherwise(""))
    axis = F.when(F.col("transition_type") == "explicit_choice", "neutral").otherwise("")
    for a in schemas.AXES:
        d = d.withColumn(a, axis)
    return d.withColumn("warnings", F.lit("")).select(*schemas.EDGES.names, "position")


def annotate_with(paragraphs: DataFrame, instructions: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Edges from a model's JSON answers to one prompt a paragraph, in Arrow batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame({"id": b["id"], "answer": model(b["prompt"].tolist())})

    asked = paragraphs.select("id", fx.prompt(F.struct("id", "text"), instructions).alias("prompt"))
    answers = asked.mapInPandas(run, "id string, answer string")
    edges = answers.select("id", F.posexplode(fx.model_edges(F.col("answer"))).alias("position", "e"))
    return edges.select("e.*", "position").select(*(F.coalesce(c, F.lit("")).alias(c) for c in schemas.EDGES.names), "position")


def pending(paragraphs: DataFrame, done: DataFrame) -> DataFrame:
    """Paragraphs that no stored answer (id) is there for: a run that was broken off goes on with these."""
    return paragraphs.join(done.select("id").distinct(), "id", "left_anti")


def quarantine(answers: DataFrame) -> DataFrame:
    """Answers that hold no readable list of edges: (id, answer, error)."""
    parsed = F.from_json("answer", "edges array<struct<source_id:string>>")
    return answers.where(parsed.isNull() | parsed["edges"].isNull()).select("id", "answer", F.lit("no list of edges").alias("error"))
