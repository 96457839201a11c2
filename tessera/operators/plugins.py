"""Language models, embedders and other outside functions: injected callables over Arrow batches, with rules as defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repaired_json
from .ledger import ask, tried
from .linking import entity_names, keyword_seeds

#: (system, user, schema) to (answer text, prompt tokens, completion tokens).
Model = Callable[[str, str, str | None], tuple[str | None, int, int]]

AUGMENTATIONS = ("cognition", "awareness", "trustworthiness", "understanding", "reasoning")


def call(prompts: DataFrame, model: Model, retries: int = 0, response_schema: str | None = None, at_once: int = 1, pause: float = 1.0, ledger: str | None = None, name: str = "") -> DataFrame:
    """prompts (id, system, user): adds response, prompt_tokens, completion_tokens, error.

    Up to `at_once` calls of a batch run at the same time. A failed call is tried again after pauses that double from
    `pause` seconds, then its response is null. With the path of a `ledger`, equal prompts are asked once, and answers that it has are not asked for.
    """
    if ledger is not None:
        return ask(prompts, model, ledger, response_schema, name, retries, at_once, pause)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for b in batches:
                out = list(pool.map(lambda x: tried(model, x, response_schema, retries, pause), zip(b["system"], b["user"])))
                yield b.assign(**{c: [x[k] for x in out] for k, c in enumerate(("response", "prompt_tokens", "completion_tokens", "error"))})

    return prompts.mapInPandas(run, f"{kinds}, response string, prompt_tokens bigint, completion_tokens bigint, error string")


def prompted(rows: DataFrame, system: str, user, model: Model, schema: str, **how) -> DataFrame:
    """Rows with `answer`, a model's JSON answer of the given type, null where it has none; token counts and error stay."""
    kept = rows.columns
    out = call(rows.withColumns({"system": F.lit(system), "user": user}), model, **how)
    return out.withColumn("answer", F.from_json(repaired_json("response"), schema)).select(*kept, "answer", "prompt_tokens", "completion_tokens", "error")


def linked_entities(questions: DataFrame, listed: DataFrame, model: Model | None = None, names: DataFrame | None = None, **how) -> DataFrame:
    """(question_id, name) of the entities a question names: by a model that sees the question and listed (question_id, rnk, ontology), `$` signs gone;
    without one the names (node, name) that occur in the question as words or as written."""
    if model is None:
        found = keyword_seeds(questions, names).join(names, "node").select("question_id", "name")
        return found.union(entity_names(questions, names).select("question_id", "name")).distinct()
    lines = listed.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "ontology"))), lambda x: x["ontology"]), "\n").alias("_lines"))
    user = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nEntities:\n"), F.coalesce("_lines", F.lit("")))
    system = "Name the listed entities that the question speaks of. Reply in JSON: entity_appeared_in_query, a list of names."
    out = prompted(questions.join(lines, "question_id", "left"), system, user, model, "entity_appeared_in_query array<string>", **how)
    found = out.select("question_id", F.explode("answer.entity_appeared_in_query").alias("name"))
    return found.withColumn("name", F.trim(F.replace("name", F.lit("$"), F.lit("")))).where("name <> ''").distinct()


def extraction(docs: DataFrame, model: Model, examples: str = "", **how) -> DataFrame:
    """docs (doc, text, ...): adds `response`, a model's entity layer as JSON text, to be parsed by `build.extracted`."""
    system = "Extract the entities and relations of the text with the times in which they hold. Reply in JSON: nodes (id, name, type, description, aliases, is_temporal_entity, valid_time), edges (source_node_id, target_node_id, relationship_name, valid_time)."
    out = call(docs.withColumns({"system": F.lit(system + examples), "user": F.col("text")}), model, **how)
    return out.drop("system", "user")


def judged_clusters(clusters: DataFrame, model: Model, complete: bool = False, **how) -> DataFrame:
    """clusters (cluster, entities: JSON text): merge instructions (cluster, base, members), or with `complete` predicted pairs (cluster, entity_1, entity_2)."""
    if complete:
        system, schema = "Which pairs of these entities are related? Reply in JSON: relation_predictions, a list of entity_1_id and entity_2_id.", "relation_predictions array<struct<entity_1_id:string,entity_2_id:string>>"
        out = prompted(clusters, system, F.col("entities"), model, schema, **how)
        return out.select("cluster", F.explode("answer.relation_predictions").alias("x")).select("cluster", F.col("x.entity_1_id").alias("entity_1"), F.col("x.entity_2_id").alias("entity_2"))
    system, schema = "Which of these entities are the same? Reply in JSON: merge_instruction, a list of base_node_id and merge_node_ids.", "merge_instruction array<struct<base_node_id:string,merge_node_ids:array<string>>>"
    out = prompted(clusters, system, F.col("entities"), model, schema, **how)
    return out.select("cluster", F.explode("answer.merge_instruction").alias("x")).select("cluster", F.col("x.base_node_id").alias("base"), F.col("x.merge_node_ids").alias("members"))


def answered(rows: DataFrame, model: Model, most: int = 15, **how) -> DataFrame:
    """rows (question, passages array): adds answer (answer, evidence, reasoning, confidence) from the first `most` passages; `prediction` is its text, Unknown without one."""
    user = F.concat(F.lit("Context:\n"), F.array_join(F.slice("passages", 1, most), "\n\n"), F.lit("\nQuestion: "), F.col("question"))
    system = "Answer from the context alone. Reply in JSON: answer, evidence, reasoning, confidence."
    out = prompted(rows, system, user, model, "answer string, evidence string, reasoning string, confidence string", **how)
    return out.withColumn("prediction", F.coalesce("answer.answer", F.lit("Unknown")))


def judged(rows: DataFrame, model: Model, **how) -> DataFrame:
    """rows (question, groundtruth, prediction): adds llm_evaluation (explain, predict); predict is false without a readable verdict."""
    out = call(judge_prompts(rows), model, **how)
    verdict = F.from_json(repaired_json("response"), "explain string, predict boolean")
    seen = F.struct(verdict["explain"].alias("explain"), F.coalesce(verdict["predict"], F.lit(False)).alias("predict"))
    return out.withColumn("llm_evaluation", seen).drop("system", "user", "response")


def short_answers(rows: DataFrame, model: Model, **how) -> DataFrame:
    """rows (question, prediction): adds short_answer, the prediction itself where the model gives none."""
    out = call(short_answer_prompts(rows), model, **how)
    return out.withColumn("short_answer", F.coalesce(F.nullif(F.trim("response"), F.lit("")), F.col("prediction"))).drop("system", "user", "response")


def usage(calls: DataFrame) -> DataFrame:
    total = F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))
    return calls.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), total.alias("total_tokens"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "text", column: str = "embedding") -> DataFrame:
    """Adds a vector for each text, a batch at a time."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{column: embedder(b[text].fillna("").tolist()) if len(b) else []})

    return rows.mapInPandas(run, f"{kinds}, `{column}` array<float>")


def resolved_texts(rows: DataFrame, resolver: Callable[[list[str]], list[str]] | None = None, text: str = "text") -> DataFrame:
    """Coreference: the resolver's texts, or the originals without one or where it fails."""
    if resolver is None:
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield b.assign(**{text: resolver(b[text].tolist())})
            except Exception:  # the original texts stay, as a model may fail on any batch
                yield b

    return rows.mapInPandas(run, rows.schema)


def augmented(questions: DataFrame, model: Model | None = None, kinds=AUGMENTATIONS, **how) -> DataFrame:
    """Each question in five variants; without an answer the original stays and the row is marked."""
    rows = questions.withColumn("original_question", F.col("question")).withColumn("augmentation_type", F.explode(F.array(*map(F.lit, kinds))))
    if model is None:
        return rows.withColumn("augmentation_failed", F.lit(True))
    asked = rows.withColumns({"system": F.concat(F.lit("Rewrite the question to test "), "augmentation_type"), "user": F.col("question")})
    out = call(asked, model, **how)
    answer = F.nullif(F.trim("response"), F.lit(""))
    return out.withColumns({"question": F.coalesce(answer, "original_question"), "augmentation_failed": answer.isNull()}).drop("system", "user", "response", "prompt_tokens", "completion_tokens", "error")


def judge_prompts(rows: DataFrame) -> DataFrame:
    """(system, user) of a judge for question, groundtruth, prediction."""
    user = F.format_string("Question: %s\nGround truth: %s\nPrediction: %s", "question", "groundtruth", "prediction")
    return rows.withColumns({"system": F.lit("Does the prediction answer the question as the ground truth does? Reply in JSON: explain, predict."), "user": user})


def short_answer_prompts(rows: DataFrame) -> DataFrame:
    user = F.format_string("Question: %s\nAnswer: %s", "question", "prediction")
    return rows.withColumns({"system": F.lit("Give the shortest span of the answer that answers the question."), "user": user})
