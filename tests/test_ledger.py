"""Calls are counted in a file, as models run in other processes."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import ledger, plugins

PROMPTS = "id int, system string, user string"


def counting(folder, dies_at=None):
    """A model that notes each call; at a call of that number its process ends."""
    log = str(folder / "calls")

    def model(system, user, schema):
        with open(log, "a") as f:
            f.write(f"{user}\n")
        if dies_at is not None and len(open(log).readlines()) == dies_at:
            os._exit(1)
        if user.startswith("bad"):
            raise ValueError("refused")
        return f"{system}:{user}".upper(), 2, 3

    return model


def calls(folder):
    return open(folder / "calls").read().split("\n")[:-1]


def test_equal_prompts_are_asked_once_and_answers_stay(spark, tmp_path):
    rows = [(k, "s", f"q{k % 7}") for k in range(50)] + [(90, None, None), (91, "s", "bad")]
    prompts, path = spark.createDataFrame(rows, PROMPTS).withColumn("key", F.lit("x")).repartition(3), str(tmp_path / "ledger")
    for again in range(2):
        got = {r["id"]: r for r in plugins.call(prompts, counting(tmp_path), ledger=path, at_once=3).collect()}
        assert len(got) == 52 and got[8].response == "S:Q1" and got[8].prompt_tokens == 2 and got[90].response == ":"
        assert got[91].response is None and got[91].error == "refused" and got[8].error is None
        # Seven prompts and the empty one once; the refused one once a run.
        assert len(calls(tmp_path)) == 9 + again
    paid = ledger.answers(spark, path)
    assert paid.count() == 8 and paid.agg(F.sum("completion_tokens")).first()[0] == 24
    other = plugins.call(prompts.where("id < 7"), counting(tmp_path), ledger=path, name="another model")
    assert other.count() == 7 and len(calls(tmp_path)) == 17
    assert plugins.call(prompts.limit(0), counting(tmp_path), ledger=path).collect() == []


def test_a_lost_task_repeats_no_answered_call(spark, tmp_path):
    prompts, path = spark.createDataFrame([(k, "s", f"q{k}") for k in range(60)], PROMPTS), str(tmp_path / "ledger")
    with pytest.raises(Exception):
        ledger.ask(prompts, counting(tmp_path, dies_at=25), path, flush=1).collect()
    before = ledger.answers(spark, path).count()
    assert 15 <= before < 60
    got = ledger.ask(prompts, counting(tmp_path), path, flush=1).collect()
    assert sorted(r.response for r in got) == sorted(f"S:Q{k}" for k in range(60))
    # Calls under way when the process ended are the only ones that were made twice.
    assert len(calls(tmp_path)) - 60 <= 4 and set(calls(tmp_path)) == {f"q{k}" for k in range(60)}


def test_what_is_made_once_a_worker(spark, tmp_path):
    made = str(tmp_path / "made")

    def make():
        with open(made, "a") as f:
            f.write("x\n")
        return lambda texts: [[float(len(t))] for t in texts]

    embedder = ledger.OncePerWorker("lengths", make)
    rows = spark.range(400).select(F.repeat(F.lit("a"), F.col("id").cast("int") % 9).alias("text")).repartition(40)
    for _ in range(2):
        assert plugins.embed(rows, embedder).agg(F.sum(F.col("embedding")[0])).first()[0] == sum(k % 9 for k in range(400))
    assert len(open(made).readlines()) <= 8  # tasks: 80


def test_documents_are_added_without_asking_again(spark, tmp_path):
    """A build whose documents grow equals one of all documents, and asks for the new ones alone."""
    from tessera.plans import staged

    def model(system, user, schema):
        with open(tmp_path / "asked", "a") as f:
            f.write(f"{user}\n")
        nodes = ", ".join(f'{{"id": "{w}", "name": "{w}", "type": ["P"], "description": "", "aliases": [], "is_temporal_entity": false, "valid_time": {{"start": "", "end": ""}}}}' for w in user.strip(".").split(" met "))
        return f'{{"nodes": [{nodes}], "edges": []}}', 1, 1

    docs = [("a", 1, "Ada met Bob."), ("b", 2, "Bob met Cy."), ("c", 3, "Cy met Ada."), ("d", 4, "Di met Bob.")]
    table = lambda n: spark.createDataFrame(docs[:n], "doc string, pos int, text string")
    grown = str(tmp_path / "grown")
    for n in (2, 2, 4):
        rows = staged.extract(spark, table(n), grown, model, ledger=str(tmp_path / "ledger"))
        got = staged.align(spark, rows, grown)
    assert len(open(tmp_path / "asked").readlines()) == 4
    whole = staged.align(spark, staged.extract(spark, table(4), str(tmp_path / "whole"), model), str(tmp_path / "whole"))
    names = lambda x: sorted((r["name"], r["id"]) for r in x["nodes"].collect())
    links = lambda x: sorted(map(tuple, x["links"].collect()))
    assert names(got) == names(whole) and links(got) == links(whole) and [n for n, _ in names(got)] == ["Ada", "Bob", "Cy", "Di"]


def test_fingerprints_tell_tables_apart(spark):
    from tessera.sources.stages import fingerprint

    a = spark.createDataFrame([(1, {"k": "v"}), (2, None)], "x int, m map<string,string>")
    assert fingerprint(a) == fingerprint(a.orderBy("x", ascending=False).repartition(3)) != fingerprint(a.limit(1))
    assert fingerprint(a.limit(0)) == "0-0"
