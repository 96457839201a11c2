"""Declared types of the graph's tables and of what is exchanged with language models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INTERVAL = "struct<start:string,end:string,confidence:double>"
EXPRESSION = "struct<text:string,type:string,start:string,end:string,span_start:int,span_end:int>"
NODES = f"id string, name string, type array<string>, description string, aliases array<string>, properties map<string,string>, valid_time {INTERVAL}, is_temporal_entity boolean"
EDGES = f"edge_id string, source_node_id string, target_node_id string, relationship_name string, properties map<string,string>, valid_time {INTERVAL}, temporal_relation string"
PASSAGES = f"passage_id string, text string, node_map array<string>, sentence_map array<string>, primary_time {INTERVAL}, temporal_expressions array<{EXPRESSION}>"
SENTENCES = f"sentence_id string, passage_id string, text string, node_map array<string>, temporal_expressions array<{EXPRESSION}>"
EXTRACTION = (
    "struct<nodes:array<struct<id:string,name:string,type:array<string>,description:string,aliases:array<string>,is_temporal_entity:boolean,"
    "valid_time:struct<start:string,end:string>>>,edges:array<struct<source_node_id:string,target_node_id:string,relationship_name:string,valid_time:struct<start:string,end:string>>>>"
)
CONTEXTS = "text string"
TITLED = "title string, content string"
RAW_CONTEXTS = "title string, contexts string"
QA = "question string, answer string"
TEMPORAL_QA = "question string, temporal_data array<struct<timestamp:string,context:string,ground_truth_answers:array<string>>>"
#: A whole graph as one JSON object of three layers.
GRAPH = (
    "struct<entity_layer:struct<nodes:array<struct<" + NODES.replace(" struct", ":struct").replace(", ", ",").replace(" ", ":") + ">>,"
    "edges:array<struct<" + EDGES.replace(", ", ",").replace(" ", ":") + ">>>,"
    "passage_layer:struct<passages:array<struct<" + PASSAGES.replace(", ", ",").replace(" ", ":") + ">>>,"
    "sentence_layer:struct<sentences:array<struct<" + SENTENCES.replace(", ", ",").replace(" ", ":") + ">>>>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Graph:
    """The three layers: entities (nodes, edges), passages and sentences."""

    nodes: DataFrame
    edges: DataFrame
    passages: DataFrame
    sentences: DataFrame
