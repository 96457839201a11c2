"""Readers and writers of documents, questions, graphs, vectors and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON array (or lines) of objects with a declared schema; malformed rows are null."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.CONTEXTS)


def titled_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.TITLED)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """question, answer array: a scalar answer is wrapped."""
    raw = read_json(spark, path, S.QA)
    listed = F.from_json("answer", "array<string>")
    return raw.select("question", F.when(F.col("answer").startswith("["), listed).otherwise(F.array("answer")).alias("answer"))


def temporal_questions(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, S.TEMPORAL_QA)


def read_graph(spark: SparkSession, path: str) -> S.Graph:
    """A whole-graph JSON file as four tables; positions in its lists are kept in `pos`."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", S.GRAPH).alias("g"))

    def layer(column: str) -> DataFrame:
        return raw.select(F.posexplode(column).alias("pos", "x")).select("pos", "x.*")

    return S.Graph(layer("g.entity_layer.nodes"), layer("g.entity_layer.edges"), layer("g.passage_layer.passages"), layer("g.sentence_layer.sentences"))


def write_graph(graph: S.Graph, path: str) -> None:
    """One Parquet table a layer."""
    for name in ("nodes", "edges", "passages", "sentences"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> S.Graph:
    return S.Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "passages", "sentences")))


def write_entity_layer(graph: S.Graph, path: str) -> None:
    for name in ("nodes", "edges"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}")


def llm_extracted(rows: DataFrame) -> DataFrame:
    """Rows whose properties mark them as extracted by a model."""
    return rows.where(F.col("properties")["llm_extracted"] == "true")


def statistics(graph: S.Graph, times: DataFrame) -> DataFrame:
    """One row: counts of the layers and the sorted distinct context times."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.lit(0).alias("_k"))
    out = count(graph.nodes, "nodes").join(count(graph.edges, "edges"), "_k").join(count(graph.passages, "passages"), "_k").join(count(graph.sentences, "sentences"), "_k")
    listed = times.agg(F.array_sort(F.collect_set("context_time")).alias("context_times"), F.lit(0).alias("_k"))
    return out.join(listed, "_k").drop("_k")


def write_vectors(chunks: DataFrame, path: str) -> None:
    """chunks (chunk_idx, doc_idx, embedding), by coarse cell if there is one."""
    writer = chunks.write.mode("overwrite")
    (writer.partitionBy("cell") if "cell" in chunks.columns else writer).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_incorrect(rows: DataFrame, path: str) -> None:
    rows.where(~F.col("llm_evaluation.predict")).write.mode("overwrite").json(path)
