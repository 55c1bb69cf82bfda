"""Problem 2: the most similar vectors of every vector, by an inverted-list index with an adaptive dimension scan.

Vectors are normalised and turned by one random rotation, so that any first d coordinates are a random sample of the squared distance. Centroids fitted on a bounded
sample give inverted lists; neighbouring lists share a partition, so that a vector travels once for all the lists it probes there.
How many lists a query reads follows the lists there are. Without a least similarity it is a share of them. With one, two similar vectors on either side
of a border lie together no farther from it than they may lie apart, so that one of them is within half of that: it reads the other's list, and
a pair counts for both of its ends.
Inside a list the vectors lie in column blocks: the first block gives partial distances of all candidates, a
hypothesis test abandons those whose distance is surely beyond the query's bound (its k-th best so far, or the least similarity
asked for), and only the rest read the next block. A vector travels as 16-bit coordinates of its unit vector (cosines are right to 5 digits). Vectors
equal in these (cosine beyond 1 - 1e-7) are one vector throughout: they are grouped before the rotation, whose sums depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.sources.tables import materialize


@dataclass(frozen=True)
class VectorConfig:
    """width: of a valid vector; k: neighbours; floor: least cosine (None: none).

    probes, probe_share: lists a query reads at least, and share of them, where there is no floor; with a floor the borders decide (see _probed).

    list_rows: vectors a list should hold; max_lists: of them at most (bounds the broadcast: 4,096 x width floats); sample: vectors to fit
    the centroids on, at most; partition_rows: vectors a partition should hold; blocks: where the column blocks end;
    epsilon: of the test, larger is safer; border: likewise, of the test on borders, in standard deviations; seed: of rotation and centroids.
    """

    width: int = 64
    k: int = 10
    probes: int = 16
    probe_share: float = 1 / 6
    floor: float | None = None
    list_rows: int = 400
    max_lists: int = 4096
    sample: int = 50_000
    partition_rows: int = 16_000
    blocks: tuple[int, ...] = (16, 32, 64)
    epsilon: float = 2.1
    border: float = 3.3
    seed: int = 7


def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _prepare(c: VectorConfig):
    """(id, vec): the unit vectors of the rows with a valid vector, in 16 bits. All sums run within a row: equal vectors have equal bytes wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            right = np.flatnonzero((np.diff(offsets) == c.width) & np.asarray(lists.is_valid()))
            x = flat[offsets[right][:, None] + np.arange(c.width)]
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max(axis=1, initial=0)
                ok = np.isfinite(scale) & (scale > 0)
                x, right = x[ok] / scale[ok][:, None], right[ok]
            x = np.rint(x / np.linalg.norm(x, axis=1)[:, None] * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "vec"])

    return run


def _unpacked(vecs: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The unit vectors of _prepare as rows."""
    x = np.frombuffer(b"".join(vecs.to_pylist()), np.int16).reshape(-1, width).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        total = np.zeros_like(centre)
        for s in range(0, len(sample), 4096):
            part = sample[s : s + 4096]
            np.add.at(total, (part @ centre.T).argmax(axis=1), part)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-12), centre).astype(np.float32)
    return centre


def _group_lists(centre: np.ndarray, weight: np.ndarray, target: float) -> np.ndarray:
    """Partition of each list: halves along the main direction until a part holds the target or is one list."""
    part, number, todo = np.zeros(len(centre), np.int64), 0, [np.arange(len(centre))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or weight[own].sum() <= target:
            part[own] = number
            number += 1
            continue
        x = centre[own] - centre[own].mean(axis=0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        order = own[np.argsort(along, kind="stable")]
        cut = int(np.searchsorted(np.cumsum(weight[order]), weight[own].sum() / 2)) + 1
        cut = min(max(cut, 1), len(own) - 1)
        todo += [order[:cut], order[cut:]]
    return part


def _probed(x: np.ndarray, centre: np.ndarray, gap: np.ndarray, c: VectorConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, read, score): the nearest list of each vector, which lists it reads, and its cosines to the centroids; gap: distances of the centroids.

    With a floor: two vectors at a distance d, whatever its direction, lie across the border of their lists about d / sqrt(width) apart, and
    ``border`` times that at most. That is the sum of their distances to the border, so that one of them is within half of it
    and reads the other's list: this holds for any number of lists.
    """
    score = x @ centre.T
    home = score.argmax(axis=1)
    if c.floor is None:
        least = min(len(centre), max(c.probes, int(np.ceil(c.probe_share * len(centre)))))
        read = np.zeros(score.shape, bool)
        np.put_along_axis(read, np.argpartition(-score, least - 1, axis=1)[:, :least], True, axis=1)
    else:
        read = score[np.arange(len(x)), home][:, None] - score <= gap[home] * min(1.0, c.border / np.sqrt(c.width)) * np.sqrt(2 - 2 * c.floor) / 2
    read[np.arange(len(x)), home] = True
    return home, read, score


def _gaps(centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))


def _route(c: VectorConfig, index):
    """One row per vector and partition with a list it probes or lives in, and per chunk of that partition and block of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, part_of, chunks, blocks = index.value
        gap, turn = _gaps(centre), rotation(c.width, c.seed)
        inside = [np.flatnonzero(part_of == p) for p in range(len(chunks))]
        for whole in batches:
            for batch in (whole.slice(s, 2048) for s in range(0, whole.num_rows, 2048)):
                x = _unpacked(batch.column(1), c.width).astype(np.float32) @ turn
                asks = batch.column(2).to_numpy(zero_copy_only=False)
                salt = batch.column(3).to_numpy(zero_copy_only=False)
                home, read, score = _probed(x, centre, gap, c)
                if c.floor is None:
                    read &= asks[:, None]
                out: dict[str, list] = {k: [] for k in ("part", "chunk", "block", "row", "home", "many", "lists")}
                for p, own in enumerate(inside):
                    here, wanted = part_of[home] == p, read[:, own]
                    asker = wanted.any(axis=1)
                    for chunk in range(chunks[p]):
                        lives = here & (salt % chunks[p] == chunk)
                        for block in range(blocks[p]):
                            asking = asker & (salt // 997 % blocks[p] == block)
                            rows = np.flatnonzero(lives | asking)
                            if len(rows):
                                probes = wanted[rows] & asking[rows][:, None]
                                for k, v in (("part", p), ("chunk", chunk), ("block", block)):
                                    out[k].append(np.full(len(rows), v, np.int32))
                                out["row"].append(rows)
                                out["home"].append(np.where(lives[rows], home[rows], -1).astype(np.int32))
                                out["many"].append(probes.sum(axis=1))
                                of, which = np.nonzero(probes)
                                which = own[which]
                                out["lists"].append(which[np.lexsort((-score[rows[of], which], of))].astype(np.int32))  # the nearest first
                cat = lambda k: np.concatenate(out[k])
                row = pa.array(cat("row"))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cat("many"))).astype(np.int32)), pa.array(cat("lists")))
                columns = [pa.array(cat("part")), pa.array(cat("chunk")), pa.array(cat("block")), batch.column(0).take(row), batch.column(1).take(row), batch.column(2).take(row), pa.array(cat("home")), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "chunk", "block", "rep", "vec", "asks", "home", "lists"])

    return run


def adaptive_scan(query: np.ndarray, base: np.ndarray, bound: np.ndarray, c: VectorConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, squared distance) of the candidates that the test does not abandon; bound: squared distance per query."""
    ends = [e for e in c.blocks if e < c.width] + [c.width]
    i = j = partial = None
    start = 0
    for end in ends:
        slack = 1.0 if end == c.width else (1 + c.epsilon / np.sqrt(end)) ** 2 * end / c.width
        q, b = query[:, start:end], base[:, start:end]
        if partial is None or partial.ndim == 2:  # all candidates are still alive: the block at once
            block = (q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (q @ b.T)
            partial = block if partial is None else partial + block
            alive = partial <= (bound * slack)[:, None]
            if end < c.width and alive.mean() > 0.2:
                start = end
                continue
            i, j = np.nonzero(alive)
            partial = partial[i, j]
        else:
            d = q[i] - b[j]
            partial = partial + np.einsum("nd,nd->n", d, d)
            alive = partial <= bound[i] * slack
            i, j, partial = i[alive], j[alive], partial[alive]
        start = end
    return i, j, partial


def _best(q: np.ndarray, b: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest per query; a pair that was found from both of its ends counts once."""
    by = np.lexsort((d, b, q))
    by = by[np.append(True, (q[by][1:] != q[by][:-1]) | (b[by][1:] != b[by][:-1]))[: len(by)]]
    by = by[np.lexsort((b[by], d[by], q[by]))]
    q, b, d = q[by], b[by], d[by]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], b[rank < k], d[rank < k]


def _scan(c: VectorConfig):
    """The nearest vectors that this part of the lists has for the queries that probe it, and with a floor those that visit its own vectors."""

    def run(group: pa.Table) -> pa.Table:
        plain = _unpacked(group.column("vec"), c.width)
        x = plain.astype(np.float32) @ rotation(c.width, c.seed)
        home, asks = group.column("home").to_numpy(), group.column("asks").to_numpy(zero_copy_only=False)
        lists = group.column("lists").combine_chunks()
        many = np.diff(lists.offsets.to_numpy())
        asker = np.repeat(np.arange(len(x)), many)
        probed = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() :][: many.sum()]
        most = 4.0 if c.floor is None else 2 - 2 * c.floor + 1e-5
        bound = np.full(len(x), most, np.float32)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        by_home = np.argsort(home, kind="stable")
        cuts = lambda a, v: slice(*np.searchsorted(a, [v, v + 1]))
        homes = home[by_home]
        place = np.arange(len(asker)) - np.repeat(np.cumsum(many) - many, many)
        for phase in (place == 0, (place > 0) & (place < 4), place >= 4):  # a query's nearest list first: its bound is then small in the others
            q_of, l_of = asker[phase], probed[phase]
            order = np.argsort(l_of, kind="stable")
            q_of, l_of = q_of[order], l_of[order]
            news = [found]
            for number in np.unique(l_of):
                base = by_home[cuts(homes, number)]
                ask = q_of[cuts(l_of, number)]
                if not len(base):
                    continue
                step = max(1, 1_000_000 // len(base))
                for s in range(0, len(ask), step):
                    rows = ask[s : s + step]
                    if (bound[rows] > 3).any() and len(base) > c.k:  # no bound yet: the k-th best here, itself not counted
                        bound[rows] = np.minimum(bound[rows], np.partition(2 - 2 * (x[rows] @ x[base].T), c.k, axis=1)[:, c.k] + 1e-5)
                    i, j, d = adaptive_scan(x[rows], x[base], bound[rows], c)
                    i, j = rows[i], base[j]
                    other = (i != j) & asks[i]
                    news.append(_best(i[other], j[other], d[other], c.k))
                    if c.floor is not None:  # a visitor may be among the best of those it finds here
                        other = (home[i] != number) & asks[j]
                        news.append(_best(j[other], i[other], d[other], c.k))
            found = _best(*(np.concatenate([n[t] for n in news]) for t in range(3)), c.k)
            if c.floor is None:
                last = np.flatnonzero(np.append(found[0][1:] != found[0][:-1], True)) if len(found[0]) else np.zeros(0, np.int64)
                count = np.bincount(found[0], minlength=len(x))
                full = count[found[0][last]] == c.k
                bound[found[0][last][full]] = np.minimum(bound[found[0][last][full]], found[2][last][full] + 1e-6)
        rep = group.column("rep")
        q, b, _ = found
        cosine = np.minimum(np.einsum("nd,nd->n", plain[q], plain[b]), 1.0)
        keep = cosine >= (-2 if c.floor is None else c.floor)
        return pa.table({"rep": rep.take(pa.array(q[keep])), "other": rep.take(pa.array(b[keep])), "cosine": pa.array(cosine[keep])})

    return run


def nearest_vectors(df: DataFrame, id_col: str, vector_col: str, config: VectorConfig = VectorConfig(), queries: Column | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar other ids of each query id with a valid vector.

    A valid vector has ``width`` finite numbers, not all zero; all other rows, nulls and rows with a null id take no part. queries: which rows
    ask (a condition on the columns of ``df``); all of them are searched. Ties go to the smaller id. Repeated rows count once. Of a group of
    equal vectors every id gets k neighbours, whatever the size of the group. Other columns are not read.
    """
    spark, c = df.sparkSession, config
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    source = df.select(F.struct(F.col(id_col).cast("string").alias("id"), asks.alias("asks")).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id.id IS NOT NULL AND v IS NOT NULL").filter(F.size("v") == c.width)
    rows = source.mapInArrow(_prepare(c), "id struct<id: string, asks: boolean>, vec binary").select("id.id", "id.asks", "vec")
    reps = materialize(rows.groupBy("vec").agg(F.min("id").alias("rep"), F.max("id").alias("top"), F.max("asks").alias("asks"), F.count("*").alias("copies")), "vectors")
    total, asking = reps.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    lists = int(min(c.max_lists, max(1, total // c.list_rows)))
    share = min(1.0, 1.2 * c.sample / max(total, 1))
    sample = reps.select("vec").filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).limit(c.sample).toArrow()["vec"]
    sample = _unpacked(sample, c.width).astype(np.float32) @ rotation(c.width, c.seed) if len(sample) else np.eye(1, c.width, dtype=np.float32)
    centre = fit_centroids(sample, lists, c.seed)
    weight = np.bincount(np.concatenate([(sample[s : s + 4096] @ centre.T).argmax(axis=1) for s in range(0, len(sample), 4096)]), minlength=len(centre)) * max(total, 1) / len(sample)
    part_of = _group_lists(centre, weight, c.partition_rows)
    chunks = np.maximum(1, np.ceil(np.bincount(part_of, weights=weight) / (2 * c.partition_rows))).astype(np.int64)
    gap, some = _gaps(centre), sample[:5000]
    belongs = (part_of[:, None] == np.arange(len(chunks))).astype(np.float32)
    reads = sum((_probed(some[s : s + 1000], centre, gap, c)[1] @ belongs > 0).sum(axis=0) for s in range(0, len(some), 1000))
    blocks = np.maximum(1, np.ceil(reads * asking / len(some) / (8 * c.partition_rows))).astype(np.int64)
    index = spark.sparkContext.broadcast((centre, part_of, chunks, blocks))
    routed = reps.select("rep", "vec", "asks", F.pmod(F.xxhash64("rep"), F.lit(1_000_003)).alias("salt")).mapInArrow(_route(c, index), "part int, chunk int, block int, rep string, vec binary, asks boolean, home int, lists array<int>")
    edges = routed.groupBy("part", "chunk", "block").applyInArrow(_scan(c), "rep string, other string, cosine double")
    edges = edges.repartition("rep").groupBy("rep", "other").agg(F.max("cosine").alias("cosine"))  # either end may have found a pair
    first = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    edges = edges.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= c.k).drop("n")

    # Classes of equal vectors: every member gets the class's edges. Members of a large class lie in several shards, each with its own copy of those.
    several = reps.filter("rep <> top").select(F.md5("vec").alias("h"), "rep", F.ceil(F.col("copies") / c.partition_rows).cast("int").alias("shards"))
    members = rows.select("id", "asks", F.md5("vec").alias("h")).join(several, "h").groupBy("rep", "id").agg(F.max("asks").alias("asks"), F.first("shards").alias("shards"))
    members = members.select("rep", "id", "asks", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"))
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n") <= c.k + 1).select(F.col("rep").alias("other"), F.col("id").alias("neighbour"))
    classes = several.select("rep", "shards")
    alone = edges.join(classes, "rep", "left_anti").select(F.col("rep").alias("id"), "other", "cosine")
    shared = edges.join(classes, "rep").unionByName(classes.select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("cosine"), "shards"))
    shared = shared.select("rep", "other", "cosine", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).join(members.filter("asks"), ["rep", "shard"]).select("id", "other", "cosine")
    wide = alone.unionByName(shared).join(few, "other", "left")
    wide = wide.select("id", F.coalesce("neighbour", "other").alias("neighbour"), "cosine").filter("id <> neighbour")
    ranked = wide.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")))
    return ranked.filter(F.col("rank") <= c.k)
