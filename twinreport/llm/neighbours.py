"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search in it. Euclidean distance.

The graph starts from blocks of vectors that lie side by side in a few random projections. Each round of descent is a Spark
join of neighbours of neighbours: at every node meet the vectors that it lists and (at most DEGREE, the nearest) those that
list it; those who meet at a node learn of each other. So no node, however many list it, has a large meeting. Rounds end when few lists change. A query is an indexed row and
starts at its own node: each round it opens the best nodes of its list (BEAM long) that it has not opened yet, until none is
left. Rounds of all queries run together as joins of their open nodes with the graph, which is a bucketed table, so only the
open nodes move.

Descent and search measure in double precision on the original components, so near copies are told apart at any distance that
their type can hold, and the whole beam is ranked by them. Equal vectors are one node; their ids come back at the end, of each the smallest that
can matter. The result is approximate: recall against brute force is tested, and given in the README.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids;
equal rows are one; of rows with one id the least vector counts; other columns are ignored; vectors are neighbours of those
of their own length only, each length being a search of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import spread_join
from .common import checkpointed, pa_schema
from .grouped import grouped

DEGREE = 24
PROJECTIONS = 3
BLOCK = 128
#: Descent ends when a round changes less than this part of all list entries.
CHANGED = 0.05
#: New acquaintances that a member takes home from one meeting, and members that meet at once.
TAKES, MEETING = 10, 96
BEAM = 400
#: Nodes that a query opens in a round.
OPENS = 64
#: Files of the graph that is searched, at least, and nodes in a file.
BUCKETS, BUCKET_NODES = 32, 20_000

GRAPH = "id long, vec binary, nbrs array<long>, dists array<double>, changed int"
PAIRS = "id long, cand long, dist double"


def packed_as(kind: str) -> Callable[[np.ndarray], list[bytes]]:
    """Vectors to bytes: a letter for the type of their components, then these as they are."""
    return lambda x: [kind.encode() + r.tobytes() for r in x.astype(f"<{kind}")]


def restored(vecs: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), -1)
    kind = f"<{chr(raw[0, 0])}" if len(vecs) else "<f"
    return np.ascontiguousarray(raw[:, 1:]).view(kind).astype(np.float64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # About a common centre, so that little cancels among near copies.
    centre = a.mean(axis=0)
    a, b = a - centre, b - centre
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def nearest_pairs(ids: np.ndarray, x: np.ndarray, takes: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, cand, dist): for each of a few vectors the nearest of the others, below its bound."""
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.zeros(0)
    d = squared(x, x)
    np.fill_diagonal(d, np.inf)
    m = min(takes, n - 1)
    j = np.argpartition(d, m - 1, axis=1)[:, :m]
    v = np.take_along_axis(d, j, axis=1)
    ok = v < (np.full((n, 1), np.inf) if bound is None else bound[:, None])
    return np.repeat(ids, m)[ok.ravel()], ids[j][ok], v[ok]


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _merged(graph: DataFrame, pairs: DataFrame, degree: int) -> DataFrame:
    """The graph with each list improved by the pairs found; changed: new entries in the list."""
    empty = [F.lit(None).cast("long").alias("cand"), F.lit(None).cast("double").alias("dist")]
    rows = graph.select("id", "vec", "nbrs", "dists", *empty).unionByName(
        pairs.select("id", F.lit(None).cast("binary").alias("vec"), F.lit(None).cast("array<long>").alias("nbrs"), F.lit(None).cast("array<double>").alias("dists"), "cand", "dist")
    )

    def each(table: pa.Table) -> Iterator[dict]:
        column = lambda k: table.column(k).combine_chunks()
        ids, vec, cand = column("id").to_numpy(), column("vec"), column("cand")
        own = np.flatnonzero(~np.asarray(vec.is_null()))
        new = np.flatnonzero(~np.asarray(cand.is_null()))
        nodes = ids[own]
        nbrs = column("nbrs").take(pa.array(own))
        counts = np.asarray(nbrs.value_lengths())
        who = np.concatenate([np.repeat(nodes, counts), ids[new]])
        whom = np.concatenate([nbrs.flatten().to_numpy(zero_copy_only=False), cand.take(pa.array(new)).to_numpy()])
        dist = np.concatenate([column("dists").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False), column("dist").take(pa.array(new)).to_numpy()])
        fresh = np.arange(len(who)) >= counts.sum()
        order = np.lexsort((fresh, whom, who))
        who, whom, dist, fresh = who[order], whom[order], dist[order], fresh[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (whom[1:] != whom[:-1])
        first &= np.isin(who, nodes)
        who, whom, dist, fresh = who[first], whom[first], dist[first], fresh[first]
        order = np.lexsort((whom, dist, who))
        who, whom, dist, fresh = who[order], whom[order], dist[order], fresh[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < degree
        who, whom, dist, fresh = who[kept], whom[kept], dist[kept], fresh[kept]
        order = np.argsort(nodes, kind="stable")
        nodes = nodes[order]
        starts = np.concatenate([np.searchsorted(who, nodes), [len(who)]])
        news = np.concatenate([[0], np.cumsum(fresh)])
        yield {"id": nodes, "vec": vec.take(pa.array(own[order])), "nbrs": _lists(starts, whom, pa.int64()), "dists": _lists(starts, dist, pa.float64()), "changed": news[starts[1:]] - news[starts[:-1]]}

    return grouped(rows, "id", each, GRAPH)


def _first_pairs(nodes: DataFrame, projections: int, block: int, takes: int) -> DataFrame:
    """Pairs of vectors that lie side by side in a random projection's order of signs, and within blocks dealt by a hash, so
    that every vector meets others whatever the partitions are; all others, if they are few."""

    def coded(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = restored(batch.column("vec").to_pylist())
                    p = np.random.default_rng(seed).normal(size=(x.shape[1], 17))
                    side = x @ p
                    code = (side[:, :16] > 0) @ (1 << np.arange(16)[::-1])
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(code.astype(np.int64)), pa.array(side[:, 16])], names=["id", "vec", "code", "side"])

        return run

    fields = pa_schema(nodes.sparkSession, PAIRS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes]]] = []
        ids: list[int] = []
        vecs: list[bytes] = []

        def pairs(a: int, b: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(nearest_pairs(np.array(ids[a:b]), restored(vecs[a:b]), takes), fields, strict=True)], schema=fields)

        for batch in batches:
            ids += batch.column("id").to_pylist()
            vecs += batch.column("vec").to_pylist()
            while len(ids) >= 2 * block:  # a last block has up to twice the size, so none is tiny
                yield pairs(0, block)
                del ids[:block], vecs[:block]
        if ids:
            yield pairs(0, len(ids))

    def dealt(table: pa.Table) -> Iterator[dict]:
        keys, ids, vecs = table.column("key").to_numpy(), table.column("id").to_numpy(), table.column("vec").to_pylist()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            who, whom, dist = nearest_pairs(ids[a:b], restored(vecs[a:b]), takes)
            yield {"id": who, "cand": whom, "dist": dist}

    many = max(1, nodes.count() // block)
    out = grouped(nodes.withColumn("key", F.pmod(F.xxhash64("id"), F.lit(many))), "key", dealt, PAIRS)
    for seed in range(projections):
        rows = nodes.mapInArrow(coded(seed), "id long, vec binary, code long, side double")
        found = rows.repartitionByRange("code", "side").sortWithinPartitions("code", "side", "id").mapInArrow(blocks, PAIRS)
        out = out.unionByName(found)
    return out


def _meetings(graph: DataFrame, degree: int) -> DataFrame:
    """center, member, vec, bound: at each node those that it lists and the nearest `degree` of those that list it."""
    listed = graph.select(F.col("id").alias("by"), F.explode(F.arrays_zip("nbrs", "dists")).alias("e")).select("by", F.col("e.nbrs").alias("to"), F.col("e.dists").alias("d"))
    nearest_first = Window.partitionBy("to").orderBy("d", "by")
    back = listed.withColumn("n", F.row_number().over(nearest_first)).filter(F.col("n") <= degree).select(F.col("to").alias("center"), F.col("by").alias("member"))
    pairs = listed.select(F.col("by").alias("center"), F.col("to").alias("member")).unionByName(back).distinct()
    bound = F.when(F.size("nbrs") < degree, F.lit(float("inf"))).otherwise(F.array_max("dists")).cast("double")
    # A vector that very many list is sent to all of them from several tasks.
    sent = listed.groupBy(F.col("to").alias("member")).agg((F.count(F.lit(1)) + degree).alias("__m"))
    return spread_join(pairs, graph.select(F.col("id").alias("member"), "vec", bound.alias("bound")), ["member"], counts=sent)


def _introduced(meetings: DataFrame, takes: int, meeting: int) -> DataFrame:
    def each(table: pa.Table) -> Iterator[dict]:
        centers, members = table.column("center").to_numpy(), table.column("member").to_numpy()
        x, bound = restored(table.column("vec").to_pylist()), table.column("bound").to_numpy()
        out = []
        cuts = np.concatenate([[0], np.flatnonzero(centers[1:] != centers[:-1]) + 1, [len(centers)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            parts = -(-(b - a) // meeting)  # a crowd meets in parts, of no particular order
            for i in range(parts):
                s = slice(a + i, b, parts)
                out.append(nearest_pairs(members[s], x[s], takes, bound[s]))
        who, whom, dist = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((whom, who))
        who, whom, dist = who[order], whom[order], dist[order]
        first = np.ones(len(who), bool)
        first[1:] = (who[1:] != who[:-1]) | (whom[1:] != whom[:-1])
        yield {"id": who[first], "cand": whom[first], "dist": dist[first]}

    return grouped(meetings, "center", each, PAIRS)


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int | None = None) -> DataFrame:
    """NN-descent over nodes (id, vec): id, vec, nbrs and dists (squared, ascending), changed.

    Rounds (or only so many) go on until one changes less than the part CHANGED of all entries; lists only improve, so they end.
    """
    nodes = checkpointed(nodes)
    n = nodes.count()
    blank = nodes.select("id", "vec", F.array().cast("array<long>").alias("nbrs"), F.array().cast("array<double>").alias("dists"))
    graph = checkpointed(_merged(blank, _first_pairs(nodes, PROJECTIONS, BLOCK, degree), degree))
    while rounds is None or rounds > 0:
        graph = checkpointed(_merged(graph, _introduced(_meetings(graph, degree), TAKES, MEETING), degree))
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= CHANGED * n * degree:
            break
        rounds = rounds and rounds - 1
    return graph


def _adjacency(graph: DataFrame, degree: int) -> DataFrame:
    """node, nbrs, vecs: neighbours in either direction and their vectors in a row."""

    def each(table: pa.Table) -> Iterator[dict]:
        centers, members, vecs = table.column("center").to_numpy(), table.column("member").to_numpy(), table.column("vec").to_pylist()
        cuts = np.concatenate([[0], np.flatnonzero(centers[1:] != centers[:-1]) + 1, [len(centers)]])
        for i in range(0, len(cuts) - 1, 2000):
            own = cuts[i : i + 2001]
            yield {"node": centers[own[:-1]], "nbrs": _lists(own - own[0], members[own[0] : own[-1]], pa.int64()), "vecs": [b"".join(vecs[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)]}

    return grouped(_meetings(graph, degree), "center", each, "node long, nbrs array<long>, vecs binary")


BEAMS = "query long, vec binary, ids array<long>, dists array<double>, opened array<boolean>"


def greedy_search(graph: DataFrame, queries: DataFrame, degree: int = DEGREE, beam: int = BEAM, opens: int = OPENS) -> DataFrame:
    """query (a node's id), ids and dists: the nearest found, the query's own node among them."""
    spark = graph.sparkSession
    name = f"neighbours_{uuid.uuid4().hex}"
    buckets = max(BUCKETS, graph.count() // BUCKET_NODES)
    # Dealt by the buckets' own hash, so that a bucket is one file.
    _adjacency(graph, degree).repartition(buckets, "node").write.bucketBy(buckets, "node").saveAsTable(name)
    try:
        return _searched(graph, queries, spark.table(name), beam, opens)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _searched(graph: DataFrame, queries: DataFrame, links: DataFrame, beam: int, opens: int) -> DataFrame:
    """The beams when none has a node left to open."""
    start = graph.join(queries, graph["id"] == queries["query"]).select(
        "query", "vec", F.array("query").alias("ids"), F.array(F.lit(0.0).cast("double")).alias("dists"), F.array(F.lit(False)).alias("opened")
    )
    beams = checkpointed(start)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c = batch.to_pydict()
            for i in range(0, batch.num_rows, 512):
                vec, nbrs = c["vec"][i : i + 512], c["nbrs"][i : i + 512]
                size = np.array([len(x) for x in nbrs])
                q = restored(vec)
                width = len(vec[0])
                x = restored([v[k * width : (k + 1) * width] for v, s in zip(c["vecs"][i : i + 512], size, strict=True) for k in range(s)])
                d = ((x - np.repeat(q, size, axis=0)) ** 2).sum(axis=1)
                ok = d < np.repeat(np.array(c["bound"][i : i + 512]), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(c["query"][i : i + 512]), size)[ok]), pa.array(np.concatenate([np.array(s) for s in nbrs])[ok]), pa.array(d[ok])], names=["query", "cand", "dist"]
                )

    def each(table: pa.Table) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("query", "vec", "ids", "dists", "opened")}
        queries, cand = table.column("query").to_numpy(), table.column("cand").fill_null(-1).to_numpy()
        dist, is_state = table.column("dist").fill_null(0.0).to_numpy(), table.column("vec").is_valid().to_numpy()
        vec, ids, dists, opened = (table.column(k) for k in ("vec", "ids", "dists", "opened"))
        cuts = np.concatenate([[0], np.flatnonzero(queries[1:] != queries[:-1]) + 1, [len(queries)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = a + int(np.flatnonzero(is_state[a:b])[0])
            new = np.delete(np.arange(a, b), at - a)
            who = np.concatenate([np.array(ids[at].as_py(), np.int64), cand[new]])
            d = np.concatenate([np.array(dists[at].as_py(), np.float64), dist[new]])
            o = np.concatenate([np.array(opened[at].as_py(), bool), np.zeros(len(new), bool)])
            # The nodes opened last round are the first `opens` that were not open.
            held = len(ids[at])
            o[np.flatnonzero(~o[:held])[:opens]] = True
            order = np.lexsort((~o, who))
            who, d, o = who[order], d[order], o[order]
            first = np.ones(len(who), bool)
            first[1:] = who[1:] != who[:-1]
            who, d, o = who[first], d[first], o[first]
            order = np.lexsort((who, d))[:beam]
            for k, v in (("query", queries[a]), ("vec", vec[at].as_py()), ("ids", who[order]), ("dists", d[order]), ("opened", o[order])):
                out[k].append(v)
        yield out

    while True:  # each round opens nodes, of which there are only so many
        unopened = F.slice(F.filter(F.arrays_zip("ids", "opened"), lambda x: ~x["opened"]), 1, opens)
        bound = F.when(F.size("ids") < beam, F.lit(float("inf"))).otherwise(F.array_max("dists")).cast("double")
        front = beams.select("query", "vec", bound.alias("bound"), F.explode(unopened).alias("o")).select("query", "vec", "bound", F.col("o.ids").alias("node"))
        if front.isEmpty():
            break
        seen = links.join(front.hint("shuffle_hash"), "node").select("query", "vec", "bound", "nbrs", "vecs").mapInArrow(looked, "query long, cand long, dist double")
        rows = beams.select("*", F.lit(None).cast("long").alias("cand"), F.lit(None).cast("double").alias("dist")).unionByName(seen, allowMissingColumns=True)
        beams = checkpointed(grouped(rows, "query", each, BEAMS))
    return beams.select("query", "ids", "dists")


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), one row an id: vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every` its k nearest other rows found."""
    narrow = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = checkpointed(usable(vectors))
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()]  # a number each, few
    found = [_nearest(rows.filter(F.size("v") == n), narrow, k, every, degree, beam) for n in lengths or [0]]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(rows: DataFrame, narrow: bool, k: int, every: int, degree: int, beam: int) -> DataFrame:
    """The same over vectors (vec_id, v) of one length."""
    nodes = checkpointed(rows.groupBy("v").agg(F.min("vec_id").alias("id")))

    as_bytes = packed_as("f" if narrow else "d")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(as_bytes(x))], names=["id", "vec"])

    graph = neighbour_graph(nodes.select("id", "v").mapInArrow(packed, "id long, vec binary"), degree)
    member = rows.join(nodes, "v").select("vec_id", "id")
    asked = member.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("id").alias("query"))
    found = greedy_search(graph, asked.select("query").distinct(), degree, beam)
    pairs = found.select("query", F.explode("ids").alias("id"))
    vector = nodes.select("id", "v")
    pairs = pairs.join(vector.withColumnRenamed("v", "b"), "id").join(vector.select(F.col("id").alias("query"), F.col("v").alias("a")), "query")
    score = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = pairs.select("query", "id", score.alias("score"))
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest of a row.
    few = Window.partitionBy("id").orderBy("vec_id")
    members = member.withColumn("__n", F.row_number().over(few)).filter(F.col("__n") <= k + 1).drop("__n")
    spread = pairs.join(members, "id").select("query", "vec_id", "score")
    nearest_of = Window.partitionBy("query").orderBy("score", "vec_id")
    spread = spread.withColumn("__n", F.row_number().over(nearest_of)).filter(F.col("__n") <= k + 1).drop("__n")
    out = asked.join(spread, "query").filter("query_id != vec_id")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
