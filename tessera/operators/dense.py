"""Vector search: exact distances, document scores from chunks, an optional coarse-cell index."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import address, folder, written
from .fusion import Ranking, places

#: Rows and queries that are compared at a time; pairs of query and cell that are sent to all tasks at a time.
ROWS, QUERIES, MOST_PAIRS = 1024, 64, 2_000_000
#: Of a full ranking: rows that one task ranks (more are shuffled and sorted by a window), distances that it holds, rows that it gives away at a time.
RANKED, HELD, GIVEN = 8_000_000, 8_000_000, 200_000


def doubles(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(a) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(doubles(a), lambda x: F.try_divide(x, norm))


def rounded(x: Column) -> Column:
    """To six digits, halves away from zero: the arithmetic of `_rounded`, so that keys made here and there are equal."""
    return F.when(F.abs(x) < 1e9, F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6).otherwise(x)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 1e9, np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def _values(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rounded squared distances, or negative inner products, of queries q and rows v, as if components were added in their order, as `squared_distance` and `dot` do.

    A matrix product has them but for `slack`, a bound of what both ways of adding can be off. Only where the sixth digit hangs on it are components added in order.
    """
    size_v, size_q = (v * v).sum(axis=1), (q * q).sum(axis=1)
    slack = 8e6 * (v.shape[1] + 8) * 2.0**-53 * (size_v.max(initial=0) + size_q.max(initial=0))
    if not slack < 0.01:
        return _in_order(v, q, metric)
    total = q @ v.T
    if metric == "l2":
        total *= -2.0
        total += size_q[:, None]
        total += size_v[None, :]
    else:
        np.negative(total, out=total)
    scaled = np.abs(total)
    scaled *= 1e6
    near = np.floor(scaled + 0.5)
    scaled -= near
    doubt = np.flatnonzero(np.abs(scaled, out=scaled) >= 0.5 - slack - near.max(initial=0) * 2.0**-50)
    if len(doubt) * 10 > total.size or near.max(initial=0) >= 1e15:
        return _in_order(v, q, metric)
    near /= 1e6
    out = np.copysign(near, total, out=total)
    if len(doubt):
        a, b = q[doubt // len(v)], v[doubt % len(v)]
        sums = np.zeros(len(doubt))
        for x, y in zip(a.T, b.T):
            sums += (x - y) ** 2 if metric == "l2" else x * y
        out.ravel()[doubt] = _rounded(sums if metric == "l2" else -sums)
    return out + 0.0


def _in_order(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The same, all by adding in order."""
    total, part = np.zeros((len(q), len(v))), np.empty((len(q), len(v)))
    for x, y in zip(q.T, v.T):
        (np.subtract if metric == "l2" else np.multiply)(x[:, None], y[None, :], out=part)
        if metric == "l2":
            part *= part
        total += part
    return _rounded(total if metric == "l2" else -total) + 0.0


def _vectors(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow list column: which rows are vectors of dim components without nulls, and those as a matrix."""
    import pyarrow.compute as pc

    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa_array(good)).flatten()
    if flat.null_count:
        lacking = np.isin(np.arange(good.sum()), np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) // max(dim, 1))
        good[np.flatnonzero(good)[lacking]] = False
        flat = column.filter(pa_array(good)).flatten()
    return good, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(good.sum()), dim)


def pa_array(values):
    import pyarrow as pa

    return pa.array(values)


def _sets(queries: DataFrame, most: int) -> list[DataFrame]:
    """The queries, or sets of them by hash, each of some `most` at most."""
    count = queries.count()
    if count <= most:
        return [queries]
    sets = -(-count // max(1, most // 2))
    dealt = F.pmod(F.xxhash64("question_id"), F.lit(sets))
    return [queries.where(dealt == k) for k in range(sets)]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over several tasks a core: a small file of vectors is much work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _sent(queries: DataFrame):
    """The queries of one set as Arrow, sent to all tasks; and their places by number of components (-1: null)."""
    table = queries.select("question_id", doubles("query").alias("query")).toArrow().combine_chunks()
    listed = table.column("query").to_pylist()
    places: dict[int, list[int]] = {}
    for k, q in enumerate(listed):
        places.setdefault(-1 if q is None or None in q else len(q), []).append(k)
    matrices = {n: np.array([listed[k] for k in at], dtype=np.float64).reshape(len(at), n) for n, at in places.items() if n >= 0}
    ids = table.column("question_id").combine_chunks()
    return queries.sparkSession.sparkContext.broadcast((ids, {n: np.array(at) for n, at in places.items()}, matrices))


def distances(chunks: DataFrame, queries: DataFrame, metric: str = "l2", most_queries: int = 10_000) -> DataFrame:
    """chunks (chunk, doc, embedding) against queries (question_id, query): question_id, chunk, doc, dist; null where a vector is null or the lengths differ.

    A stated query set against all rows: the queries are counted; up to `most_queries` are one broadcast matrix, and chunks are read
    once. More are dealt by hash into sets of that size, and chunks are read once a set. Blocks of ROWS rows and QUERIES queries are computed at a time.
    """
    return reduce(DataFrame.unionByName, [_distances(chunks, q, metric) for q in _sets(queries, most_queries)])


def _distances(chunks: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
    import pyarrow as pa

    sent = _sent(queries)
    sign = 1 if metric == "l2" else -1

    def run(batches):
        ids, places, matrices = sent.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                block = b.slice(at, ROWS)
                for n, every in places.items():
                    good, v = _vectors(block.column("embedding"), n) if n >= 0 else (np.zeros(block.num_rows, bool), None)
                    for k in range(0, len(every), QUERIES):
                        some = every[k : k + QUERIES]
                        dist, known = np.zeros((len(some), block.num_rows)), np.zeros((len(some), block.num_rows), bool)
                        if good.any():
                            dist[:, good], known[:, good] = sign * _values(v, matrices[n][k : k + QUERIES], metric) + 0.0, True
                        rows = pa.array(np.tile(np.arange(block.num_rows), len(some)))
                        asked = ids.take(pa.array(np.repeat(some, block.num_rows)))
                        yield pa.record_batch([asked, block.column("chunk").take(rows), block.column("doc").take(rows), pa.array(dist.ravel(), mask=~known.ravel())], ["question_id", "chunk", "doc", "dist"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"question_id {kind(queries, 'question_id')}, chunk {kind(chunks, 'chunk')}, doc {kind(chunks, 'doc')}, dist double"
    return _dealt(chunks.select("chunk", "doc", "embedding")).mapInArrow(run, schema)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "l2", cells: DataFrame | None = None, most_queries: int = 10_000) -> DataFrame:
    """The first k rows of `ranked(distances(...), k)`, ties by document, then chunk: question_id, chunk, doc, dist, rnk. Of all pairs a task gives away k a query alone.

    With cells (question_id, cell) chunks have a `cell`, and only those of a query's cells are compared with it. Pairs of query and cell are counted; MOST_PAIRS are sent at a time.
    """
    if cells is not None:
        most_queries = max(1, min(most_queries, most_queries * MOST_PAIRS // max(MOST_PAIRS, cells.count())))
    found = reduce(DataFrame.unionByName, [_nearest(chunks, q, k, metric, cells) for q in _sets(queries, most_queries)])
    order = Window.partitionBy("question_id").orderBy(F.asc_nulls_last("dist") if metric == "l2" else F.desc_nulls_last("dist"), "doc", "chunk")
    return found.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def _nearest(chunks: DataFrame, queries: DataFrame, k: int, metric: str, cells: DataFrame | None) -> DataFrame:
    import pyarrow as pa

    sent = _sent(queries)
    names = ["chunk", "doc", "embedding"] + (["cell"] if cells is not None else [])
    chosen = None
    if cells is not None:
        number = {q: n for n, q in enumerate(sent.value[0].to_pylist())}
        wanted: dict[int, list[int]] = {}
        for q, c in cells.join(F.broadcast(queries.select("question_id")), "question_id", "left_semi").select("question_id", "cell").toLocalIterator():
            wanted.setdefault(c, []).append(number[q])
        chosen = queries.sparkSession.sparkContext.broadcast({c: np.array(sorted(x)) for c, x in wanted.items()})
    sign = 1 if metric == "l2" else -1

    def first(asked, dist, doc, chunk):
        """The k first of each query, ordered."""
        codes = [np.unique(x.astype(object) if x.dtype == object else x, return_inverse=True)[1] for x in (doc, chunk)]
        order = np.lexsort((codes[1], codes[0], dist, asked))
        a = asked[order]
        begin = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
        at = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        order = order[at < k]
        return asked[order], dist[order], doc[order], chunk[order]

    def run(batches):
        ids, places, matrices = sent.value
        size = len(ids)
        bound = np.full(size, np.inf)  # of each query the k-th value so far
        kept = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                block = b.slice(at, ROWS)
                doc, chunk = (block.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "chunk"))
                cell = np.zeros(block.num_rows, int) if chosen is None else block.column("cell").to_numpy(zero_copy_only=False)
                more = []
                for n, every in places.items():
                    good, v = _vectors(block.column("embedding"), n) if n >= 0 else (np.zeros(block.num_rows, bool), None)
                    rows = np.flatnonzero(good)
                    for c in np.unique(cell):
                        own = np.arange(len(every)) if chosen is None else np.flatnonzero(np.isin(every, chosen.value.get(c, ())))
                        here = np.flatnonzero(cell[rows] == c)
                        # Vectors that cannot be compared come last, as nulls do.
                        odd = np.flatnonzero(~good & (cell == c))
                        if len(odd) and len(own):
                            more.append((np.repeat(every[own], len(odd)), np.full(len(own) * len(odd), np.nan), np.tile(odd, len(own))))
                        for j in range(0, len(own) if len(here) else 0, QUERIES):
                            some = own[j : j + QUERIES]
                            value = _values(v[here], matrices[n][some], metric)
                            limit = bound[every[some]]
                            if len(here) > k:
                                limit = np.fmin(limit, np.partition(value, k - 1, axis=1)[:, k - 1])
                            x, y = np.nonzero(value <= limit[:, None])
                            more.append((every[some][x], value[x, y], rows[here[y]]))
                if not more:
                    continue
                asked, dist, y = (np.concatenate(z) for z in zip(*more))
                held = (asked, dist, doc[y], chunk[y])
                kept = first(*(held if kept is None else [np.concatenate(z) for z in zip(kept, held)]))
                last = np.flatnonzero(np.append(kept[0][1:] != kept[0][:-1], True))
                full = np.bincount(kept[0], minlength=size)[kept[0][last]] == k
                bound[kept[0][last][full]] = np.where(np.isnan(kept[1][last][full]), np.inf, kept[1][last][full])
        if kept is not None:
            asked, dist, doc, chunk = kept
            lost = np.isnan(dist)
            types = [b.schema.field(c).type for c in ("chunk", "doc")]
            yield pa.record_batch([ids.take(pa.array(asked)), pa.array(chunk, types[0]), pa.array(doc, types[1]), pa.array(np.where(lost, 0.0, sign * dist + 0.0), mask=lost)], ["question_id", "chunk", "doc", "dist"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"question_id {kind(queries, 'question_id')}, chunk {kind(chunks, 'chunk')}, doc {kind(chunks, 'doc')}, dist double"
    return _dealt(chunks.select(*names)).mapInArrow(run, schema)


def by_document(scored: DataFrame, keep: str = "max") -> DataFrame:
    """A document's distance from its chunks': the largest, or the least."""
    return scored.groupBy("question_id", "doc").agg((F.max if keep == "max" else F.min)("dist").alias("dist"))


def ranked(scored: DataFrame, k: int | None = None, descending: bool = False) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("dist") if descending else F.asc_nulls_last("dist"), "doc")
    out = scored.withColumn("rnk", F.row_number().over(order))
    return out if k is None else out.where(F.col("rnk") <= k)


def full_ranking(chunks: DataFrame, queries: DataFrame, keep: str | None = None) -> DataFrame:
    """Every row's rank for every query: `ranked(distances(...))`, or with keep (max or min) `ranked(by_document(distances(...), keep))`: question_id, doc, dist, rnk.

    Rows are written once, in order of doc. Queries are dealt over the tasks, and a task reads all rows for as many queries at a time as HELD distances allow, sorts each query's and
    gives the ranks away: no pair is shuffled or spilled. Rows are counted; more than RANKED are ranked by a window.
    """
    import pyarrow as pa

    if chunks.count() > RANKED:
        scored = distances(chunks, queries)
        return ranked(scored if keep is None else by_document(scored, keep)).select("question_id", "doc", "dist", "rnk")
    spark = chunks.sparkSession
    path = folder(spark, "dense-rows") + "/rows"
    chunks.select("doc", "embedding").repartitionByRange("doc").sortWithinPartitions("doc").write.parquet(path)
    place, tasks = address(spark, path), 4 * spark.sparkContext.defaultParallelism

    def rows(columns):
        import pyarrow.parquet as pq
        from pyarrow import fs

        source, base = fs.FileSystem.from_uri(place)
        for name in sorted(f.path for f in source.get_file_info(fs.FileSelector(base)) if f.path.endswith(".parquet")):
            with source.open_input_file(name) as f:
                yield from pq.ParquetFile(f).iter_batches(2 * ROWS, columns=columns)

    def run(batches):
        docs = first = None
        for asked in batches:
            if docs is None:
                listed = [b.column(0) for b in rows(["doc"])]
                if not listed:
                    return
                docs = pa.chunked_array(listed).combine_chunks()
                size = len(docs)
                if keep is not None:
                    code = docs.dictionary_encode("encode").indices.to_numpy()
                    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                    docs = docs.take(pa.array(first))
            for at in range(0, asked.num_rows, held := max(1, HELD // size)):
                some = asked.slice(at, held)
                dist, known = measured(some.column(1), size)
                if first is not None:
                    dist[~known] = -np.inf if keep == "max" else np.nan
                    dist = (np.maximum if keep == "max" else np.fmin).reduceat(dist, first, axis=1)
                    known = np.logical_or.reduceat(known, first, axis=1)
                for n in range(some.num_rows):
                    order = np.argsort(dist[n], kind="stable") if known[n].all() else np.lexsort((dist[n], ~known[n]))
                    for k in range(0, len(order), GIVEN):
                        part = order[k : k + GIVEN]
                        ranks = pa.array(np.arange(k + 1, k + len(part) + 1, dtype=np.int32))
                        columns = [pa.repeat(some.column(0)[n], len(part)), docs.take(pa.array(part)), pa.array(dist[n][part], mask=~known[n][part]), ranks]
                        yield pa.record_batch(columns, ["question_id", "doc", "dist", "rnk"])

    def measured(queries, size):
        """Distances of a few queries from all rows, and where there are any."""
        listed = queries.to_pylist()
        dist, known = np.zeros((len(listed), size)), np.zeros((len(listed), size), bool)
        by_length: dict[int, list[int]] = {}
        for n, q in enumerate(listed):
            if q is not None and None not in q:
                by_length.setdefault(len(q), []).append(n)
        done = 0
        for b in rows(["embedding"]):
            for length, every in by_length.items():
                good, v = _vectors(b.column(0), length)
                at = done + np.flatnonzero(good)
                for k in range(0, len(every) if len(at) else 0, QUERIES):
                    cell = np.ix_(every[k : k + QUERIES], at)
                    dist[cell], known[cell] = _values(v, np.array([listed[n] for n in every[k : k + QUERIES]], dtype=np.float64).reshape(-1, length), "l2"), True
            done += b.num_rows
        return dist, known

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"question_id {kind(queries, 'question_id')}, doc {kind(chunks, 'doc')}, dist double, rnk int"
    return queries.select("question_id", doubles("query").alias("query")).repartition(tasks).mapInArrow(run, schema)


def ranking(chunks: DataFrame, queries: DataFrame, metric: str = "l2", most_queries: int = 10_000) -> Ranking:
    """The ranking of all documents (one chunk each) for each query, of which only what is asked for is made: distances are never sorted whole."""
    sign = 1 if metric == "l2" else -1
    every = distances(chunks, queries, metric, most_queries)
    key = lambda: F.struct((F.col("dist") * sign).alias("s"), F.col("doc").alias("d"))

    def top(k: int) -> DataFrame:
        return nearest(chunks, queries, k, metric, most_queries=most_queries).withColumnRenamed("doc", "item")

    def ranks(wanted: DataFrame) -> DataFrame:
        value = squared_distance("embedding", "query") if metric == "l2" else dot("embedding", "query")
        rows = wanted.withColumnRenamed("item", "doc").join(chunks, "doc").join(queries, "question_id").select("question_id", "doc", rounded(value).alias("dist"))
        rows = written(rows.withColumn("key", key()), "dense-wanted")
        before = places(every.select("question_id", key().alias("key")), rows.select("question_id", "key"))
        return rows.join(before, ["question_id", "key"]).select("question_id", F.col("doc").alias("item"), (F.col("before") + 1).alias("rnk"))

    return Ranking(top, ranks)


def cells(chunks: DataFrame, nlist: int = 100, seed: int = 7):
    """Coarse cells by k-means: chunks with `cell`, and the centres (cell, centre)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = chunks.sparkSession
    rows = chunks.withColumn("_v", array_to_vector(doubles("embedding")))
    model = KMeans(k=nlist, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(rows)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    return model.transform(rows).drop("_v"), centres


def probe(celled: DataFrame, centres: DataFrame, queries: DataFrame, nprobe: int = 10, k: int = 10) -> DataFrame:
    """The k nearest rows within each query's nprobe nearest cells; with nprobe = all cells they are those of all rows."""
    near = nearest(centres.select(F.col("cell").alias("chunk"), F.col("cell").alias("doc"), F.col("centre").alias("embedding")), queries, nprobe)
    chosen = written(near.select("question_id", F.col("chunk").alias("cell")), "probed")
    return nearest(celled, queries, k, cells=chosen)
