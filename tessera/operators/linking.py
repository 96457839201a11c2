"""Names of entities in questions: as words, as written, or as a model gave them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .matching import longest, substring_spans, word_spans


def keyword_seeds(questions: DataFrame, names: DataFrame, every: bool = False) -> DataFrame:
    """names (node, name): (question_id, node) of names that occur in the question as whole words.

    Read from left to right, the longest name at a place counts and covers shorter ones within it; with `every` these count as well.
    """
    keys = names.select("node", fold("name").alias("label"))
    spans = word_spans(questions.select(F.col("question_id").alias("text_id"), F.col("question").alias("text")), keys)
    met = (spans if every else longest(spans)).select(F.col("text_id").alias("question_id"), "label").distinct()
    return met.join(keys, "label").select("question_id", "node").distinct()


def entity_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Names that are contained in the question as they are written, within words too: an automaton of the folded names finds where they may be, the exact test follows."""
    asked = questions.select("question_id", "question")
    rows = names.where("name IS NOT NULL AND name <> ''").withColumn("label", fold("name"))
    found = substring_spans(asked.select(F.col("question_id").alias("text_id"), F.col("question").alias("text")), rows)
    met = found.select(F.col("text_id").alias("question_id"), "label").distinct().join(rows, "label").join(asked, "question_id")
    return met.where(F.col("question").contains(F.col("name"))).select("question_id", "node", "name").distinct()


def resolved_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """asked (question_id, name) as a model or a rule gave them, names (node, name): (question_id, node) of equal names without regard to case and accents."""
    left = asked.select("question_id", fold("name").alias("_key"))
    return left.join(names.select("node", fold("name").alias("_key")), "_key").select("question_id", "node").distinct()
