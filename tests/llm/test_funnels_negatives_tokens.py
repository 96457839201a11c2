"""Ordered funnels, hard negatives and token files against plain loops."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import funnels, hard_negatives, token_files
from tessera.llm.common import shared_path
from tessera.llm.packing import tokenizer_path

CLICKS = "client_id bigint, kind string, arrived_at timestamp_ntz"
ZERO = datetime(2024, 3, 10, 1, 59, 30)


def plain_funnels(rows, limit=funnels.LIMIT):
    """Each attempt walked by itself."""
    own = defaultdict(set)
    for client, kind, at in rows:
        if None not in (client, kind, at):
            own[client].add((at, kind))
    out = {}
    for name, (steps, bad) in funnels.FUNNELS.items():
        for client, found in own.items():
            found, reached, gaps = sorted(found), [0] * 4, [[], [], [], []]
            for first, kind in found:
                if kind != steps[0]:
                    continue
                reached[0] += 1
                now = first
                for k in range(1, 4):
                    later = [t for t, x in found if x == steps[k] and t > now]
                    if not later or (later[0] - first) > timedelta(microseconds=limit) or any(x == bad and now < t <= later[0] for t, x in found):
                        break
                    reached[k] += 1
                    gaps[k].append((later[0] - now) // timedelta(microseconds=1))
                    now = later[0]
            if reached[0]:
                t = [sorted(g)[-(-25 * len(g) // 100) - 1] if g else None for g in gaps[1:]]
                out[name, client] = (*reached, sum(n > 0 for n in reached), *t)
    depth = defaultdict(int)
    for (name, _), x in out.items():
        depth[name, x[4]] += 1
    return {k: (*x, depth[k[0], x[4]]) for k, x in out.items()}


def as_dict(df):
    assert df.columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2:] for r in rows}


def test_funnels_against_a_walk_of_each_attempt(spark):
    random.seed(5)
    kinds = ["view", "click", "purchase", "signup", "error", "other", None]
    weights = [8, 6, 4, 2, 1, 1, 1]
    rows = []
    for k in range(2500):
        client = random.choice([1, 1, 1, 2, 3, None])  # one client has half of the rows
        at = ZERO + timedelta(seconds=random.choice([0, 900, 1790, 86_400]) + random.randrange(700), microseconds=random.choice([0, 0, 1, 999_999]))
        rows.append((client, random.choices(kinds, weights)[0], random.choice([at, at, at, None])))
    rows += rows[:300]
    table = spark.createDataFrame(rows, CLICKS)
    # Other columns, whatever their names.
    table = table.withColumns({c: F.lit("x") for c in ("time", "slice", "next", "funnel", "gap", "first", "n", "step", "cell", "rank")})
    got = as_dict(funnels.funnel_counts(table.repartition(5)))
    assert got == plain_funnels(rows)
    assert max(x[4] for x in got.values()) == 4


def test_funnel_limits_and_exclusions(spark):
    def client(n, *events):
        return [(n, kind, ZERO + timedelta(microseconds=at)) for kind, at in events]

    limit = funnels.LIMIT
    rows = [
        *client(1, ("view", 0), ("click", limit)),  # in time
        *client(2, ("view", 0), ("click", limit + 1)),  # one microsecond late
        *client(3, ("view", 0), ("click", 5), ("error", 5)),  # the excluded row stands with the next
        *client(4, ("view", 0), ("error", 0), ("click", 5)),  # or with the step before
        *client(5, ("view", 0), ("click", 0)),  # no later row
        *client(6, ("view", 0), ("click", 1), ("view", limit - 1), ("purchase", limit)),
        *client(7, ("view", 0), ("click", 1), ("view", limit), ("purchase", limit + 1)),
        *client(8, ("error", 0)),
    ]
    got = as_dict(funnels.funnel_counts(spark.createDataFrame(rows, CLICKS)))
    assert got == plain_funnels(rows)
    assert [got["A", k][4] for k in range(1, 8)] == [2, 1, 1, 2, 1, 4, 3] and ("A", 8) not in got
    assert as_dict(funnels.funnel_counts(spark.createDataFrame([], CLICKS))) == {}


def test_percentiles_over_cells_of_gaps(spark):
    """Gaps that fall into many cells, and several in one."""
    random.seed(2)
    rows = []
    for k in range(400):
        at = ZERO + timedelta(minutes=20 * k)
        rows += [(9, "view", at), (9, "click", at + timedelta(microseconds=random.choice([7, 8, random.randrange(1, funnels.LIMIT)])))]
    assert as_dict(funnels.funnel_counts(spark.createDataFrame(rows, CLICKS))) == plain_funnels(rows)


def test_times_do_not_depend_on_the_zone(spark):
    rows = [(1, "view", ZERO), (1, "click", ZERO + timedelta(minutes=4)), (2, "view", datetime(1969, 12, 31, 23, 59, 59, 999_999)), (2, "click", datetime(1970, 1, 1, 0, 0, 0, 1))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:00 to 03:00 of that day is missing there
        assert as_dict(funnels.funnel_counts(spark.createDataFrame(rows, CLICKS))) == plain_funnels(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


VECTORS = "vec_id bigint, label int, vector array<bigint>, anchor boolean"


def plain_negatives(rows, positives=5, negatives=3, low=50, high=95):
    rows = {(i, label, tuple(v), bool(a)) for i, label, v, a in rows if None not in (i, label, v) and None not in v}
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v, anchor in rows:
        if not anchor:
            continue
        near = sorted(((-dot(v, w), j) for j, other, w, _ in rows if other == label and j != i))[:positives]
        for score, j in near:
            far = sorted((-dot(v, w), k) for k, other, w, _ in rows if other != label and low * -score <= 100 * dot(v, w) <= high * -score)[:negatives]
            out += [(i, j, n + 1, k, -score, -s) for n, (s, k) in enumerate(far)]
    return sorted(out)


def test_hard_negatives_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.choice([1, 1, 1, 2, 3, -4])), [int(x) for x in rng.integers(-6, 9, rng.choice([7, 7, 7, 3, 0]))], bool(i % 5 == 0)) for i in range(400)]
    rows += rows[:40]  # repeated rows
    rows += [(7, 1, [1, 2, 3], False), (7, 2, [3, 2, 1], True), (10, 1, [4] * 7, True)]  # an id with several rows
    rows += [(None, 1, [1], True), (1000, None, [1], True), (1005, 1, None, True), (1010, 1, [1, None], True), (1015, 1, [0] * 7, None)]
    table = spark.createDataFrame(rows, VECTORS)
    table = table.withColumns({c: F.lit(1) for c in ("part", "block", "width", "a", "b", "ids", "chunk", "wants")})
    want = plain_negatives(rows)
    for blocks in ((64, 16, 3), (4096, 256, 2)):
        got = hard_negatives.hard_negatives(table, rows_a_block=blocks[0], anchors_a_block=blocks[1], chunks=blocks[2])
        assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert dict(got.dtypes)["rank"] == "int"


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []
    rows = [(0, 1, [3, 0], True), (1, 1, [2, 0], False)]
    assert hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(i, v, x, False) for i, v, x, _ in rows], VECTORS)).collect() == []
    # Beyond what doubles hold exactly, and without any component.
    big = [(0, 1, [2**30, 1], True), (1, 1, [2**30, 3], False), (2, 2, [2**29, 2], False), (3, 2, [2**29, 1], False), (4, 2, [2**29 + 2**28, 7], False)]
    assert sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(big, VECTORS)).collect())) == plain_negatives(big)
    none = [(0, 1, [], True), (1, 1, [], False), (2, 2, [], False)]
    assert [tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(none, VECTORS)).collect()] == [(0, 1, 1, 2, 0, 0)]


def test_whole_components(spark):
    rows = [([0.5, -0.001, 1.0],), ([float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(hard_negatives.whole(F.col("v"))).collect()
    assert [r[0] for r in got] == [[128, -1, 256], None, None, None, None, []]


def plain_tokens(rows, end=0):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return [np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4") for _, text in rows]


DOCS = "doc_id bigint, text string"


def test_token_files_hold_texts_in_order(spark):
    random.seed(4)
    words = ["alpha", "beta  gamma", "\n", "é", "<|endoftext|>", "0"]
    rows = [(k * 3, random.choice([None, "", " ".join(random.choices(words, k=random.randrange(1, 40)))])) for k in range(3000)]
    rows[7] = (21, "long " * 120_000)
    random.shuffle(rows)
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("shard", "ids", "docs", "tokens", "path")}).repartition(6)
    folder = shared_path(spark, "tokens")
    manifest = token_files.write_tokens(table, tokenizer_path(), folder)
    got = sorted(map(tuple, token_files.read_tokens(manifest, folder).collect()))
    want, start = [], 0
    for (ident, _), ids in zip(sorted(rows), plain_tokens(sorted(rows))):
        want.append((ident, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert got == want and manifest.count() > 1
    # Shards can be opened one by one, and a document read by its number.
    last = manifest.orderBy(F.desc("shard")).first()
    shard = token_files.Shard(folder, last["path"], last["kind"])
    assert last["base_docs"] + len(shard) == len(rows) and last["kind"] == "<u2"
    assert shard[len(shard) - 1].tolist() == plain_tokens([max(rows)])[0].tolist()


def test_token_files_of_repeated_null_and_no_ids(spark):
    rows = [(5, f"same id {k}") for k in range(2500)] + [(None, f"no id {k}") for k in range(2500)] + [(k, "x") for k in range(10)] + [(2**62, "far"), (-3, None)] * 2
    folder = shared_path(spark, "tokens")
    manifest = token_files.write_tokens(spark.createDataFrame(rows, DOCS).repartition(3), tokenizer_path(), folder, shard_rows=500)
    got = [tuple(r) for r in token_files.read_tokens(manifest, folder).orderBy("start").collect()]
    every = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in every]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r[0], r[3]) for r in got), key=key) == sorted(((i, zlib.crc32(x)) for (i, _), x in zip(rows, plain_tokens(rows))), key=key)
    # An id with thousands of rows is in several shards.
    assert manifest.agg(F.max("docs")).first()[0] < 1200
    empty = token_files.write_tokens(spark.createDataFrame([], DOCS), tokenizer_path(), shared_path(spark, "tokens"))
    assert empty.count() == 0 and token_files.read_tokens(empty, folder).collect() == []


def test_bases_are_sums_over_blocks_of_shards(spark):
    n = 3 * token_files.BLOCK + 5
    rows = spark.range(n).selectExpr("cast(id as int) as shard", "id % 7 as docs", "id % 11 as tokens")
    got = token_files.based(rows).orderBy("shard").collect()
    assert [r["base_docs"] for r in got] == np.cumsum([0, *(k % 7 for k in range(n))])[:-1].tolist()
    assert [r["base_tokens"] for r in got] == np.cumsum([0, *(k % 11 for k in range(n))])[:-1].tolist()
