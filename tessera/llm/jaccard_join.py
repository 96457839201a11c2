"""Operator 8, n-gram Jaccard join: documents whose sets of word shingles are nearly equal, and their groups.

1. Every text's distinct shingles are hashed to 64 bits (numpy over Arrow bytes). A chunk of documents sends each of
   its shingles once, with its count of documents, packed by hash range, to range tasks: a shingle of every document is one
   number a chunk. A range task adds up the counts and sends back the shingles that two or more documents have. A pair that links shares only such shingles, so a document goes
   on only if these make up the threshold's share of its set; all others are groups of their own.
2. Documents with equal sets are one class; classes go on with their shared shingles ordered by
   (documents, hash), the global order. A linked pair shares a shingle within the prefixes of both
   (prefix filter), so classes that share none are in different families: connected components of
   prefix postings. Frequent shingles, such as those of common passages, are last in the order and so hardly
   ever in a prefix.
3. Each family is joined by a prefix tree: sets, most common shingle first, share the paths of their
   common beginnings; a probe walks the tree, adding up the overlap once for all sets below a node,
   and leaves a subtree when overlap so far plus the most that remains can't reach the threshold. A family over
   `block` sets is cut by size level and hash into blocks. First each block is joined within itself, then the least sets of
   the components found, among themselves, and only then pairs of blocks that are not of one component alone: of a large group of near
   copies nothing is left for that, so that its work grows with its size and not with its square. No task holds a family of any size; each
   returns a spanning forest of its links, never all pairs.
4. Components of the links name the groups by their least id.

Exact up to collisions of 64-bit hashes. Null and empty texts, and texts of white space, have an empty set and link
with nothing. Fewer words than `width`: one shingle of all words. Repeated rows are each returned,
with the same component; rows that share an id count as one document. Rows without an id are
returned without a set and group. An empty table gives an empty result. Other columns are not read. The
input must be re-readable in the same order (a file scan is), as chunks are numbered within partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import small_batches, table, trimmed, written
from .shingles import mix, shingle_hashes, slices, text_bytes

WIDTH, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Shingles in a chunk of documents, documents that share a range task's share, sets in a block.
CHUNK, DOCS_A_RANGE, BLOCK = 1 << 19, 1500, 256
#: Documents in a chunk (an Arrow batch more at most): their numbers have 16 bits. Rows of names that are broadcast.
MOST_DOCS, FEW = 60_000, 200_000
#: The pipeline's stage: five words and a similarity of 0.8; op8's contract binds the query alone.
STAGE = {"width": 5, "numerator": 80, "denominator": 100}


def packed(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, then compressed."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


RANGED = "bucket bigint, chunk bigint, kind int, a binary, b binary, c binary"
NAMES = ["bucket", "chunk", "kind", "a", "b", "c"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], NAMES)


def _chunks(width: int, bits: int, chunk_size: int):
    """Task of step 1: for each chunk a row of its documents, and a row of shingles for each hash range."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        docs = held = 0

        def flush():
            nonlocal ids, hashes, owners, docs, held, seq
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            d = np.concatenate(owners).astype(np.uint32) if owners else np.zeros(0, np.uint32)
            order = np.argsort(h, kind="stable")  # documents ascend within equal hashes
            h, d = h[order], d[order]
            if len(h):
                keep = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
                h, d = h[keep], d[keep]
            n = np.bincount(d, minlength=docs).astype(np.int64)
            sums = np.zeros((2, docs), np.uint64)
            np.add.at(sums[0], d, mix(h))
            np.add.at(sums[1], d, mix(h ^ np.uint64(0x5851F42D4C957F2D)))
            chunk = part << 24 | seq
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            times, h = np.diff(np.append(first, len(h))).astype(np.uint32), h[first]
            head = np.concatenate([np.concatenate(ids), n, sums[0].view(np.int64), sums[1].view(np.int64)])
            out = [(1 << 40 | chunk, chunk, 1, packed(head), packed(times), packed(d.astype(np.uint16)))]
            cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            for r in np.flatnonzero(np.diff(cuts)):
                x, y = h[cuts[r] : cuts[r + 1]], times[cuts[r] : cuts[r + 1]]
                out.append((int(r), chunk, 0, packed(np.diff(x, prepend=np.uint64(0))), packed(y), int(cuts[r]).to_bytes(8, "little")))
            ids, hashes, owners, docs, held, seq = [], [], [], 0, 0, seq + 1
            return _rows(out)

        for batch in batches:
            key = np.asarray(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            raw, ends = text_bytes(batch.column(1))
            for low, high in slices(ends):
                h, d = shingle_hashes(raw[ends[low] : ends[high]], ends[low : high + 1] - ends[low], width)
                ids.append(key[low:high])
                hashes.append(h)
                owners.append(d + docs)
                docs, held = docs + high - low, held + len(h)
                if held >= chunk_size or docs >= MOST_DOCS:
                    yield flush()
        if docs:
            yield flush()

    return run


def _counted(group: pa.Table) -> pa.Table:
    """Task of step 1 for a hash range: for each chunk its shingles that other documents have too: place in the chunk's order, hash, count. A chunk's own row passes."""
    rows = list(zip(*(group.column(k).to_pylist() for k in NAMES)))
    out = [r for r in rows if r[2]]
    rows = [r for r in rows if not r[2]]
    if rows:
        hs = [np.cumsum(unpacked(r[3], np.uint64), dtype=np.uint64) for r in rows]
        h, times = np.concatenate(hs), np.concatenate([unpacked(r[4], np.uint32) for r in rows]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        df = np.empty(len(h), np.uint32)
        df[order] = np.repeat(np.minimum(np.add.reduceat(times[order], first), (1 << 32) - 1), np.diff(np.append(first, len(s))))
        at = 0
        for r, x in zip(rows, hs):
            f = df[at : at + len(x)]
            at += len(x)
            keep = np.flatnonzero(f > 1)
            if len(keep):
                place = (keep + int.from_bytes(r[5], "little")).astype(np.uint32)
                out.append((r[0], r[1], 0, packed(np.diff(x[keep], prepend=np.uint64(0))), packed(np.diff(place, prepend=np.uint32(0))), packed(f[keep])))
    return pa.Table.from_batches([_rows(out)])


DOCS = "doc_id bigint, n bigint, s1 bigint, s2 bigint, prefix int, shared binary"


def _live(numerator: int, denominator: int):
    """Task of step 1 for a chunk: its documents; those that may link, with their shared shingles in the global order."""

    def run(group: pa.Table) -> pa.Table:
        head, hs, places, fs = None, [], [], []
        for kind, a, b, c in zip(*(group.column(k).to_pylist() for k in NAMES[2:])):
            if kind:
                head, times, docs = unpacked(a, np.int64).reshape(4, -1), unpacked(b, np.uint32).astype(np.int64), unpacked(c, np.uint16)
            else:
                hs.append(np.cumsum(unpacked(a, np.uint64), dtype=np.uint64))
                places.append(np.cumsum(unpacked(b, np.uint32), dtype=np.uint32))
                fs.append(unpacked(c, np.uint32))
        ids, n, s1, s2 = head
        place, h, f = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((places, np.uint32), (hs, np.uint64), (fs, np.uint32)))
        runs, starts = times[place], (np.cumsum(times) - times)[place]
        d = docs[np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())].astype(np.int32)
        h, f = np.repeat(h, runs), np.repeat(f, runs)
        m = np.bincount(d, minlength=len(ids))
        live = (m > 0) & (denominator * m >= numerator * n)
        prefix = n + numerator * n // -denominator + 1 - (n - m)  # of the shared ones
        keep = live[d] if len(d) else np.zeros(0, bool)
        h, d, f = h[keep], d[keep], f[keep]
        order = np.lexsort((h, f, d))
        h, cuts = h[order], np.concatenate([[0], np.cumsum(np.where(live, m, 0))])
        shared = [h[cuts[k] : cuts[k + 1]].tobytes() if live[k] else None for k in range(len(ids))]
        cols = [ids, n, s1, s2, pa.array(np.where(live, prefix, 0), pa.int32()), pa.array(shared, pa.binary())]
        return pa.table(cols, ["doc_id", "n", "s1", "s2", "prefix", "shared"])

    return run


def _postings(batches):
    for b in batches:
        cid, prefix = b.column(0).to_numpy(), b.column(1).to_numpy()
        lists = [np.frombuffer(x, np.int64)[:k] for x, k in zip(b.column(2).to_pylist(), prefix)]
        if lists:
            yield pa.record_batch([pa.array(np.concatenate(lists)), pa.array(np.repeat(cid, [len(x) for x in lists]))], ["h", "cid"])


class Trie:
    """A compressed prefix tree of ascending rank sequences, as arrays over its nodes in depth-first order."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        """seqs must be in lexicographic order; sizes: whole set sizes."""
        parent, low, owner, last = [], [], [], []
        self.same: dict[int, int] = {}
        stack: list[list[int]] = []  # [end of depth, node]
        depth_end: list[int] = []
        prior = np.zeros(0, np.uint32)

        def add(up: int, start: int, stop: int, k: int) -> int:
            parent.append(up)
            low.append(start)
            depth_end.append(stop)
            owner.append(k)
            last.append(-1)
            return len(parent) - 1

        for k, s in enumerate(seqs):
            width = min(len(prior), len(s))
            differ = np.flatnonzero(prior[:width] != s[:width])
            common = int(differ[0]) if len(differ) else width
            below = -1
            while stack and stack[-1][0] > common:
                below = stack.pop()[1]
            at = stack[-1][0] if stack else 0
            up = stack[-1][1] if stack else -1
            if below >= 0 and common > at:  # the path to `below` is cut where s leaves it
                middle = add(up, at, common, owner[below])
                parent[below], low[below] = middle, common
                stack.append([common, middle])
                up, at = middle, common
            if len(s) > at or not stack:
                node = add(up, at, len(s), k)
                stack.append([len(s), node])
            else:
                node = stack[-1][1]
            # Equal sequences end at one node; the chain keeps all of them.
            self.same[k], last[node] = last[node], k
            prior = s
        self.parent, self.low, self.high = (np.array(x, np.int64) for x in (parent, low, depth_end))
        self.end_of = np.array(last, np.int64)
        self.flat = np.concatenate([seqs[o][a:b] for o, a, b in zip(owner, low, depth_end)]) if parent else np.zeros(0, np.uint32)
        self.cut = np.concatenate([[0], np.cumsum(self.high - self.low)])
        self.rank = np.array([seqs[o][b - 1] if b else 0 for o, b in zip(owner, depth_end)], np.int64)
        count = len(parent)
        self.most, self.least, self.latest = np.zeros(count, np.int64), np.full(count, 1 << 60), np.full(count, -1)
        children: list[list[int]] = [[] for _ in range(count)]
        roots = []
        for node in range(count):
            (children[parent[node]] if parent[node] >= 0 else roots).append(node)
        pending, order = list(roots), []
        while pending:
            node = pending.pop()
            order.append(node)
            pending.extend(children[node])
        for node in reversed(order):
            k = last[node]
            while k >= 0:
                self.least[node] = min(self.least[node], sizes[k])
                self.latest[node] = max(self.latest[node], k)
                k = self.same[k]
            for c in children[node]:
                self.most[node] = max(self.most[node], self.most[c] + self.high[c] - self.low[c])
                self.least[node] = min(self.least[node], self.least[c])
                self.latest[node] = max(self.latest[node], self.latest[c])
        self.sizes = sizes
        self.kids = [np.array(x, np.int64) for x in children]
        self.roots = np.array(roots, np.int64)

    def near(self, probe: np.ndarray, size: int, ranks: int, after: int, numerator: int, denominator: int) -> list[int]:
        """Sets numbered over `after` whose Jaccard similarity to the probe reaches the threshold."""
        has = np.zeros(ranks + 1, np.int64)
        has[probe] = 1
        upto = np.cumsum(has)
        sums = np.concatenate([[0], np.cumsum(has[self.flat])])
        gain = sums[self.cut[1:]] - sums[self.cut[:-1]]
        found, level, overlap = [], self.roots, np.zeros(len(self.roots), np.int64)
        while len(level):
            overlap = overlap + gain[level]
            most = overlap + np.minimum(len(probe) - upto[self.rank[level]], self.most[level])
            fits = (self.latest[level] > after) & ((numerator + denominator) * most >= numerator * (size + self.least[level]))
            level, overlap = level[fits], overlap[fits]
            deeper, carried = [], []
            for node, o in zip(level.tolist(), overlap.tolist()):
                k = int(self.end_of[node])
                while k >= 0:
                    if k > after and (numerator + denominator) * o >= numerator * (size + int(self.sizes[k])):
                        found.append(k)
                    k = self.same[k]
                if len(self.kids[node]):
                    deeper.append(self.kids[node])
                    carried.append(np.full(len(self.kids[node]), o))
            level = np.concatenate(deeper) if deeper else np.zeros(0, np.int64)
            overlap = np.concatenate(carried) if carried else level
        return found


def linked(ids: list[int], sides: list[int], sizes: list[int], sets: list[np.ndarray], numerator: int, denominator: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of side 0 and side 1 (or all sets, if all are of side 0); known: labels of components found before."""
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(where)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -often))] = np.arange(len(tokens))
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    seqs = [np.sort(rank[where[cuts[k] : cuts[k + 1]]]) for k in range(len(sets))]
    two = max(sides) > 0
    tree = sorted((k for k in range(len(ids)) if sides[k] == 0), key=lambda k: seqs[k].astype(">u4").tobytes())
    probes = [(k, -1) for k in range(len(ids)) if sides[k]] if two else [(k, j) for j, k in enumerate(tree)]
    if not tree or not probes:
        return []
    trie = Trie([seqs[k] for k in tree], np.array([sizes[k] for k in tree], np.int64))
    root = list(range(len(ids)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    forest, groups, first = [], len(ids), {}
    for k, label in enumerate(known or []):
        if (j := first.setdefault(label, k)) != k:
            root[k] = j
            groups -= 1
    for k, after in probes:
        if groups == 1:
            break
        for j in trie.near(seqs[k], sizes[k], len(tokens), after, numerator, denominator):
            x, y = top(k), top(tree[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                groups -= 1
                forest.append((ids[k], ids[tree[j]]))
    return forest


def _joined(numerator: int, denominator: int):
    """Task of step 3: links of a family or of a pair of its blocks."""

    def run(group: pa.Table) -> pa.Table:
        rows = list(dict.fromkeys(zip(*(group.column(k).to_pylist() for k in ("cid", "side", "n", "shared", "comp")))))
        forest = []
        if len(rows) > 1:
            ids, sides, sizes, sets, comps = (list(x) for x in zip(*rows))
            forest = linked(ids, sides, sizes, [np.frombuffer(x, np.uint64) for x in sets], numerator, denominator, comps)
        return pa.table([pa.array([x for x, _ in forest], pa.int64()), pa.array([y for _, y in forest], pa.int64())], ["a", "b"])

    return run


def blocked(members: DataFrame, block: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """members (fid, cid, n, comp) with level and name of their block, and (fid, level, groups) with the blocks of each level.

    Linked sets' sizes are within the threshold's ratio, so their levels differ by one at most. A component with `block`
    sets or more in a level has blocks of its own; all others share blocks.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(denominator / numerator)))
    # Two such levels make one, so that rounding can't part linked sets by more than one.
    rows = members.withColumn("level", F.floor(level * F.lit(0.5)).cast("long"))
    sizes = rows.groupBy("fid", "level", "comp").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("grp", F.when(F.col("_n") >= block, F.col("comp").cast("string")).otherwise("shared"))
    groups = sizes.groupBy("fid", "level", "grp").agg(F.ceil(F.sum("_n") / block).cast("int").alias("blocks"))
    groups = written(groups, "jj-groups")
    own = sizes.where("grp <> 'shared'").select("fid", "level", "comp", "grp")
    rows = rows.join(own, ["fid", "level", "comp"], "left").withColumn("grp", F.coalesce("grp", F.lit("shared"))).join(groups, ["fid", "level", "grp"])
    rows = rows.withColumn("own", F.concat_ws(":", "level", "grp", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    return rows.select("fid", "cid", "n", "comp", "level", "grp", "own"), groups.groupBy("fid", "level").agg(F.collect_list(F.struct("grp", "blocks")).alias("groups"))


def block_pairs(members: DataFrame, block: int, numerator: int, denominator: int, within: bool = False) -> DataFrame:
    """members (fid, cid, n, comp): a row (pair, side, cid, comp) for each pair of blocks that the member is in; within: each block with itself alone.

    Blocks of one component are not paired.
    """
    rows, levels = blocked(members, block, numerator, denominator)
    if within:
        return rows.select(F.concat_ws("/", "fid", "own").alias("pair"), F.lit(0).alias("side"), "cid", "comp")
    none = F.array().cast("array<struct<grp:string,blocks:int>>")
    for name, shift in (("_same", 0), ("_above", 1), ("_below", -1)):
        rows = rows.join(levels.select("fid", (F.col("level") - shift).alias("level"), F.col("groups").alias(name)), ["fid", "level"], "left")
    alone = F.col("grp") != "shared"

    def names(column: str, shift: int):
        fits = F.filter(F.coalesce(column, none), lambda g: ~(alone & (g["grp"] == F.col("grp"))))
        return F.flatten(F.transform(fits, lambda g: F.transform(F.sequence(F.lit(0), g["blocks"] - 1), lambda j: F.concat_ws(":", F.col("level") + shift, g["grp"], j))))

    rows = rows.withColumn("other", F.explode(F.concat(names("_same", 0), names("_above", 1), names("_below", -1))))
    pair = F.concat_ws("/", F.col("fid"), F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(pair.alias("pair"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "cid", "comp")


def family_links(members: DataFrame, sets: DataFrame, block: int, numerator: int, denominator: int) -> DataFrame:
    """members (fid, cid, n), sets (cid, n, shared): (a, b), a spanning forest of each family's links at least."""

    def joined(pairs: DataFrame) -> DataFrame:
        # Sets are wide: they are moved once a block, when it is known which of them meet; until then ids stand for them.
        pairs = written(pairs.select("pair", "side", "cid", "comp"), "jj-pairs")
        met = F.broadcast(pairs) if pairs.count() <= FEW else pairs
        return sets.join(met, "cid").groupBy("pair").applyInArrow(_joined(numerator, denominator), "a bigint, b bigint")

    members = members.withColumn("comp", F.col("cid"))
    large = written(members.groupBy("fid").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > block).select("fid"), "jj-large")
    count = large.count()
    marked = F.broadcast(large) if count <= FEW else large
    links = joined(members.join(marked, "fid", "left_anti").select(F.col("fid").cast("string").alias("pair"), F.lit(0).alias("side"), "cid", "comp"))
    if not count:
        return links
    inside = members.join(marked, "fid", "left_semi")

    def labelled(found: DataFrame) -> DataFrame:
        names = components(found).withColumnsRenamed({"node": "cid", "component": "_c"})
        return inside.drop("comp").join(names, "cid", "left").select("fid", "cid", "n", F.coalesce("_c", "cid").alias("comp"))

    found = written(joined(block_pairs(inside, block, numerator, denominator, within=True)), "jj-links")
    leaders = labelled(found).where("cid = comp")
    found = written(found.union(joined(block_pairs(leaders, block, numerator, denominator))), "jj-links")
    rest = labelled(found)
    parted = rest.groupBy("fid").agg(F.min("comp").alias("_a"), F.max("comp").alias("_z")).where("_a <> _z").select("fid")
    if parted.isEmpty():
        return links.union(found)
    rest = written(rest.join(parted, "fid", "left_semi"), "jj-rest")
    return links.union(found).union(joined(block_pairs(rest, block, numerator, denominator)))


def sets_of(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Step 1, written: every row of docs (doc_id, text) with n, its set's 128-bit name (s1, s2), prefix and shared shingles."""
    small_batches(docs.sparkSession)
    rows = docs.count()
    bits = max(6, int(np.ceil(np.log2(max(1, rows) / DOCS_A_RANGE))))
    ranged = docs.select("doc_id", "text").mapInArrow(trimmed(_chunks(width, bits, CHUNK)), RANGED)
    counted = ranged.groupBy("bucket").applyInArrow(_counted, RANGED)
    return written(counted.groupBy("chunk").applyInArrow(_live(numerator, denominator), DOCS), "jj-sets")


def join(docs: DataFrame, width: int = WIDTH, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, block: int = BLOCK) -> DataFrame:
    """docs (doc_id long, text): per row doc_id, n_shingles, component_id."""
    nameless = docs.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    rows = sets_of(docs.where("doc_id IS NOT NULL"), width, numerator, denominator)
    live = rows.where("prefix > 0")
    classes = written(live.groupBy("s1", "s2").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n")), "jj-classes")
    postings = live.select("doc_id", "prefix", "shared").mapInArrow(_postings, "h bigint, cid bigint")
    postings = written(postings.join(classes.select("cid").distinct(), "cid").select("h", "cid"), "jj-postings")
    stars = postings.groupBy("h").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select("h", "a")
    edges = postings.join(stars, "h").select("a", F.col("cid").alias("b")).where("a <> b")
    families = components(edges).withColumnsRenamed({"node": "cid", "component": "fid"})
    members = written(families.join(classes.groupBy("cid").agg(F.min("n").alias("n")), "cid").select("fid", "cid", "n"), "jj-members")
    links = family_links(members, live.select(F.col("doc_id").alias("cid"), "n", "shared"), block, numerator, denominator)
    groups = components(links).withColumnsRenamed({"node": "cid", "component": "component_id"})
    named = classes.join(groups, "cid", "left").select("s1", "s2", F.coalesce("component_id", "cid").alias("component_id"))
    # Documents that link with nothing, empty ones among them, need no join.
    out = live.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"], "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = rows.where("prefix = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumnRenamed("n", "n_shingles").union(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document of the least id stays, and one row of it."""
    groups = join(docs.select("doc_id", "text"), **STAGE)
    # The documents that go are far fewer than those that stay.
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    again = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    marked = gone.withColumn("_gone", F.lit(True)).unionByName(again.withColumn("_gone", F.lit(False)))
    gone = written(marked.groupBy("doc_id").agg(F.max("_gone").alias("_gone")), "jj-gone")
    out = docs.join(gone, "doc_id", "left").where("_gone IS NULL OR NOT _gone")
    twice = out.where("NOT _gone").drop("_gone")
    return out.where("_gone IS NULL").select(docs.columns).unionByName(twice.dropDuplicates(["doc_id", "text"]).select(docs.columns))
