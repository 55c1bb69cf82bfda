"""Scoping, the two search routes, their fusion and grouping. Every plan carries query_id: one query is a batch of one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import stable_key, tokens


def current(df: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in df.columns if c not in (key,)]
    latest = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return latest.select(key, *(F.col("row")[c].alias(c) for c in rest))


def one_each(df: DataFrame, key: str = "id") -> DataFrame:
    """One row of each key. Rows are moved first and sorted once: keys hardly repeat, so that to sort what a task reads as well (bodies, vectors) takes memory and saves nothing."""
    return df.repartition(key).dropDuplicates([key])


def visible_to(read_internal: bool) -> tuple[str, ...]:
    """The visibilities that a reader sees."""
    return ("public", "internal") if read_internal else ("public",)


def scoped_contexts(contexts: DataFrame, sources: DataFrame, visibilities: Sequence[str], space: str | None = None, source_ids: DataFrame | None = None) -> DataFrame:
    """Contexts of visible sources. None means no restriction; an empty frame of ids leaves nothing."""
    seen = sources.filter(F.col("visibility").isin(*visibilities)) if visibilities else sources.limit(0)
    if space is not None:
        seen = seen.filter(F.col("embedding_space") == space)
    if source_ids is not None:
        seen = seen.join(source_ids, "id", "left_semi")
    return contexts.join(seen.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def scoped_evidence(evidence: DataFrame, contexts: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence of the given contexts with its stable key."""
    keys = contexts.select(F.col("id").alias("context_id"), "source_id", F.col("key").alias("context_key")).join(sources.select(F.col("id").alias("source_id"), "source_type", "canonical_locator"), "source_id")
    return evidence.join(keys, "context_id").withColumn("stable_key", stable_key(F.col("source_type"), F.col("canonical_locator"), F.col("context_key"), F.col("key")))


def with_terms(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id_col, terms, length). Texts without terms stay, with length 0."""
    return df.select(id_col, F.coalesce(tokens(text), F.array().cast("array<string>")).alias("terms")).withColumn("length", F.size("terms"))


#: Scores (queries times documents), products of weights and terms that a task holds at once.
_CELLS = 250_000


def _runs(load: np.ndarray, rows: int, cells: int) -> Iterator[tuple[int, int]]:
    """Runs of queries with at most ``cells`` scores over ``rows`` documents and as much load (at least one query each); likewise of documents, by their terms."""
    total, first, wide = np.cumsum(load), 0, max(1, cells // max(rows, 1))
    while first < len(load):
        last = int(np.searchsorted(total, (total[first - 1] if first else 0) + cells, side="right"))
        last = min(max(last, first + 1), first + wide, len(load))
        yield first, last
        first = last


class _Leaders:
    """The k best documents of each query of a block that a task has seen, with all ties at the edge.

    floor: each query's k-th best score so far (``least`` at first); what lies below it is not kept. The leaders of all batches leave at
    the end of the task; only where ties make them many more than k a query do they leave before, and the floor stays.
    """

    def __init__(self, names: pa.Array, id_col: str, k: int, digits: int | None, least: float, cells: int):
        self.names, self.id_col, self.k, self.digits, self.least, self.cells = names, id_col, k, digits, least, cells
        self.floor = np.full(len(names), least)
        self.ids, self.seen = [], 0
        self.held, self.size, self.full, self.crowd = [], 0, cells, 4 * cells

    def documents(self, ids: pa.Array) -> None:
        """The documents that the next scores are of: copied, so that their batch can go."""
        self.base, self.seen = self.seen, self.seen + len(ids)
        self.ids.append(ids.take(pa.array(np.arange(len(ids)))))

    def add(self, first: int, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Scores of the queries from ``first`` on, one row each, over the documents."""
        low, rows = self.floor[first : first + len(score)], score.shape[1]
        if rows >= self.k and (low == self.least).any():
            low = self.floor[first : first + len(score)] = np.maximum(low, self._rounded(np.partition(score, rows - self.k, axis=1)[:, rows - self.k]))
        near = np.maximum(low - 10.0 ** -(6 if self.digits is None else self.digits), min(self.least, 0.0))
        cell = np.flatnonzero(score > near[:, None])
        query, value = cell // rows, self._rounded(score.ravel()[cell])
        keep = value >= low[query]
        if keep.any():
            self.held.append(((query[keep] + first).astype(np.int32), value[keep], (cell[keep] % rows + self.base).astype(np.int32)))
            self.size += len(self.held[-1][0])
        if self.size > self.full or self.seen > self.crowd:
            yield from self._settle(2 * self.k * len(self.names))

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self._settle(0)

    def _rounded(self, score: np.ndarray) -> np.ndarray:
        return score if self.digits is None else np.round(score, self.digits)

    def _settle(self, most: int) -> Iterator[pa.RecordBatch]:
        """Keeps the leaders alone and raises the floors; if they are more than ``most``, they leave."""
        tail = self.seen - self.base if self.ids else 0  # the documents that are being scored stay
        own, self.ids = pa.concat_arrays(self.ids) if self.ids else None, []
        query, value, row = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32))
        self.held = []
        if len(query):
            by = np.lexsort((-value, query))
            query, value, row = query[by], value[by], row[by]
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            many = np.diff(np.append(first, len(query)))
            edge = value[first + np.minimum(many, self.k) - 1]
            enough = many >= self.k
            self.floor[query[first[enough]]] = np.maximum(self.floor[query[first[enough]]], edge[enough])
            keep = value >= np.repeat(edge, many)
            query, value, row = query[keep], value[keep], row[keep]
        if len(query) > most:
            for at in range(0, len(query), 50_000):
                here = slice(at, at + 50_000)
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(query[here])), own.take(pa.array(row[here])), pa.array(value[here])], names=["query_id", self.id_col, "score"])
            query, value, row = query[:0], value[:0], row[:0]
        if own is not None:
            used = np.union1d(row, np.arange(self.base, self.seen))
            row = np.searchsorted(used, row).astype(np.int32)
            self.ids, self.seen = [own.take(pa.array(used))], len(used)
            self.base = self.seen - tail
        if len(query):
            self.held = [(query, value, row)]
        self.size = len(query)
        self.full, self.crowd = self.size + max(self.cells, self.size // 2), self.seen + 4 * self.cells


def _score_batches(sent, id_col: str, k: int | None, digits: int | None, k1: float, b: float, cells: int = _CELLS):
    """Scores of a block of queries for every batch of documents: term counts, weights and sums are array operations; the k best of a task go on, with ties.

    However many queries share a term and however long the documents are, only a run of both with some ``cells`` terms, scores and weights is in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number, place, idf, average = sent.value  # number: terms in the order of their numbers; place: term << 32 | query, sorted
        known = pa.array(list(number), pa.string())
        order = np.argsort(place & 0xFFFFFFFF, kind="stable")
        query, asked = (place & 0xFFFFFFFF)[order], (place >> 32)[order]
        begin = np.searchsorted(query, np.arange(len(names) + 1))
        best = None if k is None else _Leaders(names, id_col, k, digits, np.nextafter(0.0, 1.0), cells)
        for whole in batches:
            for a, z in _runs(pc.list_value_length(whole.column("terms")).fill_null(0).to_numpy(zero_copy_only=False), 1, cells):
                batch = whole.slice(a, z - a)
                lists = batch.column("terms")
                term = pc.index_in(lists.flatten(), value_set=known.cast(lists.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                pair, tf = np.unique((term << 32 | row)[term >= 0], return_counts=True)
                term, row = pair >> 32, pair & 0xFFFFFFFF
                length = batch.column("length").to_numpy(zero_copy_only=False)[row]
                weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
                starts = np.searchsorted(term, np.arange(len(number) + 1))
                many = np.diff(starts)
                if best:
                    best.documents(batch.column(0))
                for first, last in _runs(np.bincount(query, weights=many[asked], minlength=len(names)), len(lists), cells):
                    own = asked[begin[first] : begin[last]]
                    size = many[own]
                    at = np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    cell = np.repeat((query[begin[first] : begin[last]] - first) * len(lists), size) + row[at]
                    score = np.bincount(cell, weights=weight[at], minlength=(last - first) * len(lists)).reshape(last - first, -1)
                    if best:
                        yield from best.add(first, score)
                        continue
                    score = score if digits is None else np.round(score, digits)
                    q, d = np.nonzero(score > 0)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q + first)), batch.column(0).take(pa.array(d)), pa.array(score[q, d])], names=["query_id", id_col, "score"])
        if best:
            yield from best.rest()

    return run


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, k1: float = 1.5, b: float = 0.75, k: int | None = None, digits: int | None = None, block: int = 4096) -> DataFrame:
    """(query_id, id_col, score, rounded if ``digits`` are given) for all documents with a positive score; with ``k`` only those that may be among a query's k best.

    docs: (id_col, terms, length); queries: (query_id, terms), their terms taken as a set. N, average length and document frequencies are
    those of ``docs``, empty documents included. Documents are not shuffled: queries go out in blocks of ``block`` (a bounded broadcast
    each), every batch of documents scores a block, a run of queries at a time, and a task keeps its best. A query without known terms has no rows.
    """
    spark = docs.sparkSession
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    known = docs.select(F.explode(F.array_distinct("terms")).alias("term")).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    weighted = asked.join(known, "term").select("query_id", "term", F.ln(F.lit(1.0) + (F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    kinds = [(f.dataType.simpleString(), to_arrow_type(f.dataType)) for f in (queries.schema["query_id"], docs.schema[id_col])]
    out, rows, last, seen = None, [], object(), 0

    def scan(rows: list) -> DataFrame:
        number: dict[str, int] = {}
        term = np.array([number.setdefault(r.term, len(number)) for r in rows], dtype=np.int64)
        idf = np.zeros(len(number))
        idf[term] = [r.idf for r in rows]
        names = list(dict.fromkeys(r.query_id for r in rows))
        place = {q: n for n, q in enumerate(names)}
        query = np.array([place[r.query_id] for r in rows], dtype=np.int64)
        sent = spark.sparkContext.broadcast((pa.array(names, kinds[0][1]), number, np.sort(term << 32 | query), idf, float(stats.average or 1.0)))
        return docs.select(id_col, "terms", "length").mapInArrow(_score_batches(sent, id_col, k, digits, k1, b), f"query_id {kinds[0][0]}, {id_col} {kinds[1][0]}, score double")

    for r in weighted.orderBy("query_id").toLocalIterator():
        if r.query_id != last and seen == block:
            out = scan(rows) if out is None else out.unionByName(scan(rows))
            rows, seen = [], 0
        seen += r.query_id != last
        last = r.query_id
        rows.append(r)
    if rows or out is None:
        out = scan(rows) if out is None else out.unionByName(scan(rows))
    return out


def valid_vector(vector: Column, width: int) -> Column:
    """Of the right width, all finite, not all zero; false for null."""
    good = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: x / norm)


def _cosine_batches(sent, id_col: str, k: int, cells: int = _CELLS):
    """Cosines of a block of queries for every batch of vectors, some ``cells`` of them at a time; the k best of a task go on, with ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = sent.value
        best = _Leaders(pa.array(names, pa.string()), id_col, k, 6, -np.inf, cells)  # ties at the edge stay for the merge
        for batch in batches:
            own, lists = batch.column(0), batch.column(1)
            if not len(own):
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            best.documents(own)
            for first, last in _runs(np.zeros(len(matrix)), len(x), cells):
                yield from best.add(first, matrix[first:last] @ x.T)
        yield from best.rest()

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, id_col: str, k: int = 100, floor: float | None = None, block: int = 4096) -> DataFrame:
    """(query_id, id_col, score): the k best of each query by exact cosine, ties to the smaller id.

    vectors: (id_col, v), queries: (query_id, v), all valid. Queries go out in blocks of ``block`` (a bounded broadcast each); each
    batch of vectors multiplies a block, a task keeps its k best per query, and one window merges them.
    """
    def scan(names: list, matrix: np.ndarray) -> DataFrame:
        sent = vectors.sparkSession.sparkContext.broadcast((names, matrix))
        return vectors.select(F.col(id_col).cast("string"), "v").mapInArrow(_cosine_batches(sent, id_col, k), f"query_id string, {id_col} string, score double")

    def blocks() -> Iterator[tuple[list, np.ndarray]]:
        names, held = [], []
        for row in queries.orderBy("query_id").toLocalIterator():
            names.append(row.query_id)
            held.append(row.v)
            if len(names) == block:
                yield names, np.array(held, dtype=np.float64)
                names, held = [], []
        if names:
            yield names, np.array(held, dtype=np.float64)

    out = None
    for names, matrix in blocks():  # the driver holds one block
        one = scan(names, matrix / np.linalg.norm(matrix, axis=1, keepdims=True))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = vectors.select(F.lit("").alias("query_id"), F.col(id_col).cast("string").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    if floor is not None:
        out = out.filter(F.col("score") >= floor)
    return top_k(out, id_col, k).drop("rank")


def top_k(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k best rows of each query with their rank: score descending, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_with_ties(scored: DataFrame, k: int) -> DataFrame:
    """The rows of each query whose score is among its k best, all of equal scores included; few rows per query leave a partition."""
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return scored.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def fuse(routes: dict[str, DataFrame], id_col: str, k: int = 20, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id_col, score, ranks, route_scores): reciprocal rank fusion over each route's best rank, whose score is kept; routes: (query_id, id_col, rank, score)."""
    weights = weights or {}
    stacked = None
    for name, df in routes.items():
        one = df.select("query_id", id_col, "rank", F.col("score").alias("route_score"), F.lit(name).alias("route"), F.lit(float(weights.get(name, 1.0))).alias("w"))
        stacked = one if stacked is None else stacked.unionByName(one)
    best = stacked.groupBy("query_id", id_col, "route").agg(F.min(F.struct("rank", F.negative("route_score").alias("less"))).alias("b"), F.first("w").alias("w"))
    best = best.select("query_id", id_col, "route", "w", "b.rank", F.negative("b.less").alias("route_score"))
    entries = lambda value: F.map_from_entries(F.sort_array(F.collect_list(F.struct("route", value))))
    return best.groupBy("query_id", id_col).agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 8).alias("score"), entries("rank").alias("ranks"), entries("route_score").alias("route_scores"))


def first_ranks_by_constant(routes: dict[str, DataFrame], children: DataFrame, judged: DataFrame, queries: DataFrame, id_col: str, parent_col: str, constants: Sequence[int]) -> DataFrame:
    """(query_id, rank_<k> for each constant k): the first relevant parent's rank under several fusion constants, null where none was found; every query has a row.

    A route has an id once a query; then the ranks are those of fuse(), group_parents() and first_relevant() run once for each constant. Rows go to their parents once, whatever
    the constants, and to their query once: what is judged travels with what was found, and no map or list is made.
    """
    stacked = None
    for df in routes.values():
        one = df.select("query_id", id_col, "rank")
        stacked = one if stacked is None else stacked.unionByName(one)
    score, rank, no = (lambda k: f"score_{k}"), (lambda k: f"rank_{k}"), F.lit(None)
    found = stacked.join(children.select(id_col, parent_col), id_col).groupBy("query_id", id_col, parent_col).agg(*(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 8).alias(score(k)) for k in constants))
    found = found.select("query_id", parent_col, *map(score, constants), F.lit(False).alias("good"))
    blank = [no.cast("double").alias(score(k)) for k in constants]
    good = judged.filter("grade > 0").select("query_id", parent_col, *blank, F.lit(True).alias("good"))
    asked = queries.select("query_id", no.cast(children.schema[parent_col].dataType).alias(parent_col), *blank, F.lit(False).alias("good"))
    rows = found.unionByName(good).unionByName(asked).repartition("query_id").groupBy("query_id", parent_col).agg(*(F.max(score(k)).alias(score(k)) for k in constants), F.max("good").alias("good"))
    for k in constants:
        order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score(k)), F.asc(parent_col))
        rows = rows.withColumn(rank(k), F.row_number().over(order))
    return rows.groupBy("query_id").agg(*(F.min(F.when(F.col("good") & F.col(score(k)).isNotNull(), F.col(rank(k)))).alias(rank(k)) for k in constants))


def group_matches(fused: DataFrame, children: DataFrame, id_col: str, parent_col: str, k: int) -> DataFrame:
    """(query_id, parent_col, score, kind, matches, rank): the k first parents by their first child (score, stable key, id), with all their matches in that order.

    children: (id_col, parent_col, stable_key). kind: the routes of the first child. Scores are not summed.
    """
    of = fused.join(children.select(id_col, parent_col, "stable_key"), id_col)
    match = F.struct(F.negative("score").alias("less"), "stable_key", F.col(id_col).alias("id"), "ranks", "route_scores")
    plain = F.struct(F.negative("score").alias("less"), "stable_key", F.col(id_col).alias("id"))  # maps have no order
    first = of.groupBy("query_id", parent_col).agg(F.min(plain).alias("first"), F.collect_list(match).alias("all"))
    order = Window.partitionBy("query_id").orderBy("first.less", "first.stable_key", "first.id")
    ranked = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    by = lambda a, b: F.when((a["less"] < b["less"]) | (a["less"] == b["less"]) & ((a["stable_key"] < b["stable_key"]) | (a["stable_key"] == b["stable_key"]) & (a["id"] < b["id"])), -1).otherwise(1)
    matches = F.transform(F.array_sort("all", by), lambda m: F.struct(m["id"].alias("id"), F.negative(m["less"]).alias("score"), m["ranks"].alias("ranks"), m["route_scores"].alias("route_scores")))
    return ranked.select("query_id", parent_col, F.negative("first.less").alias("score"), F.array_join(F.map_keys(matches[0]["ranks"]), "+").alias("kind"), matches.alias("matches"), "rank")


def group_parents(fused: DataFrame, parents: DataFrame, id_col: str, parent_col: str, k: int) -> DataFrame:
    """(query_id, parent_col, score, hits, rank): parents by their best child, ties to the smaller parent; the k first."""
    of = fused.join(parents.select(id_col, parent_col), id_col)
    grouped = of.groupBy("query_id", parent_col).agg(F.max("score").alias("score"), F.count("*").alias("hits"))
    return top_k(grouped, parent_col, k)
