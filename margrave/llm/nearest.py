"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Nearness is the inner product.  Equal vectors are one node.  Nodes are compared on vectors that get one more component, so that all have
the largest norm there is: the inner products of those order pairs as distances do, which NN-descent relies on.  The component is kept
as its difference from the largest norm, which is small and so exact where the norms are; distances are those of the differences.
Components are 32-bit floats while the graph is built and walked; the final scores are double-precision products of the original
vectors, taken of every node of a query's state that the rounding's bound doesn't rule out.

* Start: a few orders by the signs of random projections, cut into blocks, within which all pairs are compared.
* A round of NN-descent: every node's list of neighbours and a sample of those that list it are joined with their vectors; of each such
  list, pairs with a new entry that improve a member's own list go back to that member.  The samples bound what a hub receives; the hub
  stays in the lists of all others.  Rounds end when few entries of the lists are new.  Members are rows of their own, sorted by node and
  put together in Python, so that no task holds more than a batch of them and one node's.
* Search: a query's state is a list of scored nodes: first its own and the entries, which are the longest vectors (large inner products
  are theirs, wherever the query lies) and some others.  Each round expands the best nodes not yet expanded, by a join with the adjacency
  table, which stays partitioned by node, until each query's best BEAM nodes are all expanded.  So a query costs about BEAM times the
  nodes around one, however many vectors there are, and a component of the graph that is cut off is reached by its own queries and, from
  the entries, the others are reached from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_rows, fingerprint

#: Neighbours a node keeps; orders and block of the start; pairs a list returns to one of its members.
NEIGHBOURS, ORDERS, BLOCK, RETURNED = 32, 8, 512, 6
#: NN-descent ends when a smaller share of the lists' entries is new.
CHANGED = 0.01
#: Nodes that a query expands in a round; its best nodes, all of which it expands; scored nodes that it keeps; entries of either kind.
EXPANDED, BEAM, KEPT, ENTRIES = 64, 128, 640, 32
PLANES = 24
LOWEST = float("-inf")


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, e): vectors of finite components, not all zero, of the commonest length; the least where a vec_id repeats."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    rows = embeddings.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), e.alias("e")).filter(good)
    common = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("e") == (common["n"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("e").alias("e"))


def _bytes(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1].tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A binary column without nulls, of equal lengths, as rows of 32-bit floats."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, width)


def _laid_out(nodes: DataFrame, norm: float, width: int, mean: np.ndarray) -> DataFrame:
    """(id, v, p, square): the vector with the added component as 32-bit floats, the signs of the random projections of each order, the length.

    The scale is the largest norm, so that no square overflows.  Projections are of the vector's direction from the mean.
    """
    planes = np.random.Generator(np.random.PCG64(7)).standard_normal((ORDERS, width - 1, PLANES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
                codes = [(((x - mean) / norm @ planes[t] > 0) @ (1 << np.arange(PLANES)[::-1])).astype(np.int64) for t in range(ORDERS)]
                x = x / norm
                square = (x * x).sum(1)
                added = square / (1 + np.sqrt(np.clip(1 - square, 0, None)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ORDERS * len(x) + 1, ORDERS), pa.int32()), pa.array(np.stack(codes, 1).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), _bytes(np.hstack([x, added[:, None]]).astype(np.float32)), lists, pa.array(square)], names=["id", "v", "p", "square"])

    return nodes.select("id", "e").mapInArrow(run, "id long, v binary, p array<long>, square double")


def _nearness(x: np.ndarray) -> np.ndarray:
    """Of (groups of) rows: minus the squared distance of each pair; they are taken from the shortest row, so that near ones stay apart and none loses digits."""
    x = x - np.take_along_axis(x, np.argmin((x * x).sum(-1), axis=-1)[..., None, None], -2)
    square = (x * x).sum(-1)
    return 2 * (x @ np.swapaxes(x, -1, -2)) - square[..., :, None] - square[..., None, :]


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by the key, cut anew where it changes: no key's rows are parted, and no more than a batch and a key's rows are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.concat_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    change = np.ones(len(columns[0]), bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(change)


def _lists_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _scores(u: np.ndarray, counts: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Rows of SCORES: to each u as many scored nodes as counted, none known before."""
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), _lists_of(v, counts, pa.int64()), _lists_of(s.astype(np.float32), counts), _lists_of(np.zeros(len(v), bool), counts)], names=["u", "v", "s", "known"])


#: Scored nodes of u, best first in a list or a state; known: a list's entry of an earlier round, or a state's expanded node.
SCORES = "u long, v array<long>, s array<float>, known array<boolean>"


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
            edges = [*_firsts(batch.column("t").to_numpy()), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for at in range(a, b, BLOCK):
                    stop = min(at + BLOCK, b)
                    at = max(a, stop - BLOCK)  # the last block reaches back, so that none is small
                    k = min(NEIGHBOURS, stop - at - 1)
                    if k > 0:
                        g = _nearness(x[at:stop])
                        np.fill_diagonal(g, -np.inf)
                        best = np.argpartition(-g, k - 1, axis=1)[:, :k]
                        here = ids[at:stop]
                        yield _scores(here, np.full(len(here), k), here[best].reshape(-1), np.take_along_axis(g, best, 1).reshape(-1))

    return run


def _improved(width: int):
    """Rows (pivot, id, v, radius, new), sorted by pivot, to SCORES: pairs of a pivot's members, of which one is new there, that enter a member's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, "pivot"):
            ids, radius, x = rows.column("id").to_numpy(), rows.column("radius").to_numpy(), _matrix(rows.column("v"), width)
            fresh = rows.column("new").to_numpy(zero_copy_only=False)
            starts = _firsts(rows.column("pivot").to_numpy())
            counts = np.diff([*starts, len(ids)])
            for at in range(0, len(counts), 256):
                first, n = starts[at : at + 256], counts[at : at + 256]
                size = int(n.max(initial=0))
                if size < 2:
                    continue
                there = np.arange(size) < n[:, None]
                index = np.where(there, first[:, None] + np.arange(size), first[:, None])
                names, news = ids[index], fresh[index]
                g = _nearness(x[index])
                g[~there[:, :, None] | ~there[:, None, :] | (names[:, :, None] == names[:, None, :]) | ~(news[:, :, None] | news[:, None, :])] = -np.inf
                k = min(RETURNED, size - 1)
                best = np.argpartition(-g, k - 1, axis=2)[:, :, :k]
                s = np.take_along_axis(g, best, 2)
                hit = (s > radius[index][:, :, None]) & (s > -np.inf)
                i, j, l = np.nonzero(hit)
                each = hit.sum(2)
                if len(i):
                    yield _scores(names[each > 0], each[each > 0], names[i, best[i, j, l]], s[i, j, l])

    return run


def _best(keep: int, at: int, walk: bool = False):
    """Rows of SCORES, sorted by u, to one for each u: its ``keep`` best nodes, best first; radius: the score at place ``at``, if there is one.

    Scores of one pair differ by rounding where they were taken in different groups; the greatest counts.  A walk has a query vector in
    one of the rows of u, and gets pivots: of the best BEAM nodes the first EXPANDED that aren't known, which then are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole(batches, "u"):
            owner = rows.column("u").to_numpy()
            u = owner[_firsts(owner)]
            group = np.repeat(np.searchsorted(u, owner), np.diff(rows.column("v").offsets.to_numpy()))
            v, s, known = (rows.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("v", "s", "known"))
            if len(v):
                order = np.lexsort((v, group))
                group, v, s, known = group[order], v[order], s[order], known[order]
                first = _firsts(group, v)
                group, v, s, known = group[first], v[first], np.maximum.reduceat(s, first), np.logical_or.reduceat(known, first)
                order = np.lexsort((v, -s, group))
                group, v, s, known = group[order], v[order], s[order], known[order]
            place = np.arange(len(group)) - np.searchsorted(group, group)
            group, v, s, known, place = (c[place < keep] for c in (group, v, s, known, place))
            counts = np.bincount(group, minlength=len(u))
            radius = np.full(len(u), LOWEST, np.float32)
            radius[group[place == at - 1]] = s[place == at - 1]
            more, names = [pa.array(np.bincount(group, ~known, len(u)).astype(np.int32))], ["fresh"]
            if walk:
                ahead = ~known & (place < BEAM)
                turn = np.cumsum(ahead)
                starts = np.searchsorted(group, np.arange(len(u)))
                now = ahead & (turn - np.concatenate([[0], turn])[starts][group] <= EXPANDED)
                query = rows.column("query")
                more, names = [query.filter(query.is_valid()), _lists_of(v[now], np.bincount(group[now], minlength=len(u)), pa.int64())], ["query", "pivots"]
                known = known | now
            yield pa.RecordBatch.from_arrays([pa.array(u), _lists_of(v, counts, pa.int64()), _lists_of(s, counts), _lists_of(known, counts), pa.array(radius), *more], names=["u", "v", "s", "known", "radius", *names])

    return run


def _lists(scores: DataFrame) -> DataFrame:
    """Each node's list of its best neighbours; fresh: how many of them are new.  A node's scores number at most a few lists' worth."""
    return scores.repartition("u").sortWithinPartitions("u").mapInArrow(_best(NEIGHBOURS, NEIGHBOURS), f"{SCORES}, radius float, fresh int")


def _around(lists: DataFrame, salt: int) -> DataFrame:
    """(pivot, member, new): each node's neighbours and a sample, as large at most, of the nodes that list it, those with new entries first."""
    forward = lists.select(F.col("u").alias("pivot"), F.explode(F.arrays_zip("v", "known")).alias("x")).select("pivot", F.col("x.v").alias("member"), (~F.col("x.known")).alias("new"))
    back = forward.select(F.col("member").alias("pivot"), F.col("pivot").alias("member"), "new")
    order = Window.partitionBy("pivot").orderBy(F.desc("new"), F.xxhash64(F.lit(salt), "member"), "member")
    back = back.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= NEIGHBOURS).drop("rank")
    return forward.unionByName(back).groupBy("pivot", "member").agg(F.max("new").alias("new"))


def build_graph(scratch: Scratch, nodes: DataFrame, width: int) -> DataFrame:
    """The lists (u, v, s, known, radius, fresh) by NN-descent; nodes: (id, v, p)."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A task with less than a few blocks would leave its nodes few others to start with, or none.
    tasks = max(1, min(parts, nodes.count() * ORDERS // (4 * BLOCK)))
    laid = nodes.select("id", "v", F.posexplode("p").alias("t", "code")).repartitionByRange(tasks, "t", "code", "id").sortWithinPartitions("t", "code", "id")
    first = laid.select("id", "v", "t").mapInArrow(_blocks(width), SCORES)
    lists, turn = scratch.write(_lists(first), "lists"), 0
    while True:
        known = nodes.select(F.col("id"), "v").join(lists.select(F.col("u").alias("id"), "radius"), "id", "left").fillna(LOWEST, ["radius"])
        members = _around(lists, turn).join(known.withColumnRenamed("id", "member"), "member").select("pivot", F.col("member").alias("id"), "v", "radius", "new")
        fresh = members.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(_improved(width), SCORES)
        old = lists.select("u", "v", "s", F.transform("known", lambda x: F.lit(True)).alias("known"))
        new = scratch.write(_lists(old.unionByName(fresh)), "lists")
        scratch.drop(lists)
        lists, turn = new, turn + 1
        seen = lists.agg(F.sum(F.size("v")).alias("n"), F.sum("fresh").alias("new")).first()
        if (seen["new"] or 0) <= CHANGED * (seen["n"] or 0):
            return lists


def _scored(width: int):
    """Rows (q, query, radius, near: list of (id, v)) to SCORES of q: the neighbours scored, those at the radius or beyond it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                near = rows.column("near")
                counts = np.diff(near.offsets.to_numpy())
                flat = near.flatten()
                ids, x = flat.field("id").to_numpy(), _matrix(flat.field("v"), width)[:, :-1]
                row = np.repeat(np.arange(len(counts)), counts)
                s = np.einsum("ij,ij->i", x, _matrix(rows.column("query"), width)[row, :-1])
                hit = s >= rows.column("radius").to_numpy()[row]
                each = np.bincount(row[hit], minlength=len(counts))
                yield _scores(rows.column("q").to_numpy()[each > 0], each[each > 0], ids[hit], s[hit])

    return run


def _entered(entries: list, width: int):
    """Rows (q, query) to SCORES with the query: its own node, to be expanded first, and the entries, scored."""
    ids = np.array([r["id"] for r in entries], dtype=np.int64)
    x = np.stack([np.frombuffer(r["v"], np.float32) for r in entries])[:, :-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("q").to_numpy()
            s = np.hstack([np.full((len(own), 1), np.inf, np.float32), _matrix(batch.column("query"), width)[:, :-1] @ x.T])
            v = np.hstack([own[:, None], np.broadcast_to(ids, (len(own), len(ids)))])
            hit = v != own[:, None]
            hit[:, 0] = True
            rows = _scores(own, hit.sum(1), v[hit], s[hit])
            yield pa.RecordBatch.from_arrays([*rows.columns, batch.column("query")], names=[*rows.schema.names, "query"])

    return run


def _walk(scratch: Scratch, lists: DataFrame, nodes: DataFrame, starts: DataFrame, width: int) -> DataFrame:
    """(q, v, s): the nodes each query has scored best; starts: (q), nodes to search from and for."""
    spark = nodes.sparkSession
    queries = starts.join(nodes.select(F.col("id").alias("q"), F.col("v").alias("query")), "q")
    entries = {r["id"]: r for order in (F.desc("square"), F.xxhash64("id")) for r in nodes.select("id", "v", "square").orderBy(order, "id").limit(ENTRIES).collect()}
    if not entries:
        return queries.select("q", F.col("q").alias("v"), F.lit(0.0).cast("float").alias("s"))
    around = _around(lists, -1).join(nodes.select(F.col("id").alias("member"), "v"), "member")
    near = around.groupBy("pivot").agg(F.collect_list(F.struct(F.col("member").alias("id"), "v")).alias("near"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Kept where it can be made again from the tables written, should an executor go.
    near = near.repartition(parts, "pivot").sortWithinPartitions("pivot").persist(StorageLevel.MEMORY_AND_DISK)

    def next_state(scores: DataFrame) -> DataFrame:
        return scratch.write(scores.repartition("u").sortWithinPartitions("u").mapInArrow(_best(KEPT, KEPT // 2, walk=True), f"{SCORES}, radius float, query binary, pivots array<long>"), "state")

    try:
        with arrow_rows(spark, 512):  # a row holds a node's neighbours with their vectors
            state = next_state(queries.select("q", "query").mapInArrow(_entered(list(entries.values()), width), f"{SCORES}, query binary"))
            while not state.filter(F.size("pivots") > 0).isEmpty():
                # At the radius or beyond it a new node can be among those kept.
                front = state.select(F.explode("pivots").alias("pivot"), F.col("u").alias("q"), "query", "radius")
                found = front.join(near, "pivot").select("q", "query", "radius", "near").mapInArrow(_scored(width), SCORES)
                new = next_state(state.select("u", "v", "s", "known", "query").unionByName(found, allowMissingColumns=True))
                scratch.drop(state)
                state = new
    finally:
        near.unpersist()
    return state.select(F.col("u").alias("q"), F.explode(F.arrays_zip("v", "s")).alias("x")).select("q", "x.v", "x.s")


def search(embeddings: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that the condition ``queries`` on vec_id selects.

    A query's own row is no candidate; equal scores go to smaller vec_ids.  Vectors that are null, zero, of an uncommon length or that
    hold null or non-finite components take no part.  A table with fewer candidates gives all of them; an empty one gives no rows.
    """
    scratch = Scratch(embeddings.sparkSession, "nearest")
    rows = scratch.write(usable(embeddings.select("vec_id", "embedding")), "vectors")
    facts = rows.agg(F.max(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"), F.max(F.size("e")).alias("n")).first()
    norm, width = float(facts["norm"] or 1.0) ** 0.5, (facts["n"] or 1) + 1
    keyed = rows.select("vec_id", "e", *fingerprint("e"))
    heads = keyed.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "e")).alias("head"))
    classes = scratch.write(keyed.select("vec_id", "h1", "h2").join(heads.select("h1", "h2", F.col("head.vec_id").alias("id")), ["h1", "h2"]).select("vec_id", "id"), "classes")
    originals = heads.select("head.*").withColumnRenamed("vec_id", "id")
    originals = scratch.write(originals, "originals")
    means = originals.select(F.posexplode("e").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect()  # a row a component
    mean = np.array([r["x"] for r in sorted(means)] or [0.0] * (width - 1))
    nodes = scratch.write(_laid_out(originals, norm, width, mean), "nodes")
    lists = build_graph(scratch, nodes, width)

    asked = classes.filter(queries)
    found = _walk(scratch, lists, nodes, asked.select(F.col("id").alias("q")).distinct(), width)
    # A score's error is at most the rounding of the components, products and sums, as a share of the norms' product.
    slack = (width + 4) * 2.0**-23
    length = F.sqrt(F.aggregate(F.transform("e", lambda x: x / F.lit(norm)), F.lit(0.0), lambda s, x: s + x * x))
    lengths = scratch.write(originals.select("id", length.alias("length")), "lengths")
    bounded = found.join(lengths.select(F.col("id").alias("q"), F.col("length").alias("lq")), "q").join(lengths.select(F.col("id").alias("v"), F.col("length").alias("lv")), "v")
    error = F.lit(slack) * F.col("lq") * F.col("lv") + F.lit(1e-37)
    bounded = bounded.select("q", "v", (F.col("s") - error).alias("low"), (F.col("s") + error).alias("high"))
    # The query's own node comes first, so k others are at or above the least of the k + 1 highest lower bounds.
    top = bounded.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).filter(F.col("r") <= k + 1)
    reach = top.groupBy("q").agg(F.when(F.count(F.lit(1)) > k, F.min("low")).otherwise(F.lit(LOWEST)).alias("reach"))
    short = bounded.join(reach, "q").filter("high >= reach")
    pairs = short.select("q", "v").join(originals.select(F.col("id").alias("q"), F.col("e").alias("x")), "q").join(originals.select(F.col("id").alias("v"), F.col("e").alias("y")), "v")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    # Of a class of equal vectors at most its k + 1 least vec_ids can be among a query's nearest.
    members = classes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).filter(F.col("r") <= k + 1).select(F.col("id").alias("v"), "vec_id")
    scored = scratch.write(pairs.select("q", "v", dot.alias("score")).join(members, "v").select("q", "vec_id", "score"), "scored")
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1).select("q", "vec_id", "score")
    rows = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(best, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
