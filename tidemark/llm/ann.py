"""Approximate nearest neighbours: an inverted file of coarse centroids whose rows hold
product-quantised residuals, searched by asymmetric distance tables and reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, stage

#: Rows that centroids and codebooks are fitted on at most (those of least id hash); every row is
#: indexed. Cells: about the root of the rows, within these bounds, with PER_CELL rows of the sample each at least.
SAMPLE, CELLS, PER_CELL = 20_000, (1, 4096), 8
PARTS, CODES = 16, 256
#: The share of true neighbours that the visited cells must hold, among TUNE rows of the sample
#: searched by brute force; rows kept for exact reranking; rows of a shard and about the queries of a
#: block, which one task takes.
TARGET, TUNE, RERANK, SHARD, BLOCK = 0.97, 256, 200, 16_384, 2048
#: Tasks of a scan at most.
TASKS = 8192


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The index of each row's nearest centroid, in slices."""
    norm, out = (c * c).sum(1), np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (norm - 2 * (x[i : i + 4096] @ c.T)).argmin(1)
    return out


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids, fitted on distinct rows; an empty cluster takes the row farthest away."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c, np.float64)
        np.add.at(sums, at, x)
        some = n > 0
        c[some] = (sums[some] / n[some, None]).astype(np.float32)
        empty = np.flatnonzero(~some)
        if len(empty):
            far = np.argsort(-((x - c[at]) ** 2).sum(1), kind="stable")[: len(empty)]
            c[empty[: len(far)]] = x[far]
    return c


class Quantiser:
    """Coarse centroids (cells, dim) and residual codebooks (parts, codes, dim / parts), padded with zeros."""

    def __init__(self, x: np.ndarray, cells: int):
        self.dim = x.shape[1]
        parts = min(PARTS, self.dim)
        self.pad = -self.dim % parts
        self.coarse = _kmeans(x, cells, 1)
        rest = np.pad(x - self.coarse[_nearest(x, self.coarse)], ((0, 0), (0, self.pad)))
        rest = rest.reshape(len(x), parts, -1)
        self.books = [_kmeans(np.ascontiguousarray(rest[:, p]), CODES, 2 + p) for p in range(parts)]
        self.probes = self._probes(x)

    def _probes(self, x: np.ndarray, k: int = 10) -> int:
        """The fewest cells to visit for TARGET of the k nearest neighbours within the sample."""
        asked, cell = x[:TUNE], _nearest(x, self.coarse)
        far = np.stack([((self.coarse - q) ** 2).sum(1) for q in asked])
        order = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1, kind="stable")
        ranks = []
        for i, q in enumerate(asked):
            d = ((x - q) ** 2).sum(1)
            d[i] = np.inf
            ranks += order[i, cell[np.argpartition(d, min(k, len(d) - 1))[:k]]].tolist()
        return int(np.quantile(ranks, TARGET)) + 1 if ranks else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.coarse)
        rest = np.pad(x - self.coarse[cell], ((0, 0), (0, self.pad))).reshape(len(x), len(self.books), -1)
        codes = [_nearest(rest[:, p], book) for p, book in enumerate(self.books)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def error(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each row lies from what its cell and codes stand for."""
        held = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)[:, : self.dim]
        return np.sqrt(((x - self.coarse[cell] - held) ** 2).sum(1))

    def table(self, q: np.ndarray, cell: int) -> np.ndarray:
        """(parts, codes): the squared distances of a query's residual parts to every code."""
        rest = np.pad(q - self.coarse[cell], (0, self.pad)).reshape(len(self.books), -1)
        out = np.full((len(self.books), CODES), np.inf, np.float32)
        for p, book in enumerate(self.books):
            out[p, : len(book)] = ((book - rest[p]) ** 2).sum(1)
        return out


class Frame:
    """Vectors as the index holds them: single precision around the sample's mean and by its size, so that neither a
    common offset nor the unit takes the digits in which neighbours differ."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(0)
        self.scale = float(np.abs(x - self.mean).max()) or 1.0

    def put(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -1e15, 1e15).astype(np.float32)


class Index:
    def __init__(self, rows: DataFrame, vectors: DataFrame, sizes: dict[int, int], quantiser: Broadcast | None, frame: Frame | None = None):
        self.rows, self.vectors, self.sizes, self.quantiser, self.frame = rows, vectors, sizes, quantiser, frame


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: the rows that take part. Not those with a null id or vector, of length 0, all zeros,
    or with a null, infinite or undefined component."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    )


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> Index:
    """Index every usable row. The dimension is that of most rows (the larger one if two tie);
    rows of another one take no part. Rows with one id are candidates each; a query gets the
    nearest of them under that id once."""
    small_batches(vectors.sparkSession)
    v = usable(vectors, id_col, vec_col)
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        empty = v.select("id", F.lit(0).alias("cell"), F.lit(0).alias("block"), F.lit(b"").alias("code"))
        return Index(empty, v, {}, None)
    v = v.where(F.size("v") == sizes["dim"])
    cells = min(max(isqrt(sizes["n"]), CELLS[0]), CELLS[1])
    train = v.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(max(sample, PER_CELL * cells)).toPandas()["v"]
    train = np.stack(train)
    frame = Frame(train)
    quantiser = vectors.sparkSession.sparkContext.broadcast(Quantiser(frame.put(train), cells))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = frame.put(np.stack(b["v"]))
                cell, codes = quantiser.value.encode(x)
                error = quantiser.value.error(x, cell, codes)
                yield pd.DataFrame({"id": b["id"], "cell": cell, "code": [c.tobytes() for c in codes], "error": error, "x": [r.tobytes() for r in x]})

    kind = v.schema["id"].dataType.simpleString()
    rows = stage(v.mapInPandas(encode, f"id {kind}, cell int, code binary, error float, x binary"), "codes")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    return Index(rows, v, counts, quantiser, frame)


def shards(counts: dict[int, int], size: int = SHARD) -> dict[int, tuple[int, int]]:
    """cell -> (first shard, shards): small cells share a shard, a large one is split over several."""
    out, shard, held = {}, 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > size:
            shard, held = shard + 1, 0
        parts = max(1, -(-n // size))
        out[cell] = (shard, parts)
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + n)
    return out


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None, rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """Per query its k nearest candidates found: query_id, rank (from 1), vec_id, score.

    score is the Euclidean distance of the original vectors in double precision; ties go to the
    smaller id; a query is no candidate of its own. Queries must be usable as rows are. A query
    visits the nearest cells, `probes` at least (by default as many as the index was tuned to) and
    as many as hold `rerank` rows, so it gets k neighbours (or all candidates). Cells are searched in shards of about SHARD
    rows for blocks of about `block` queries, so neither side of a group grows with the input; a shard's codes are
    repeated for each block, and so are its vectors in single precision. A row is as far from a query as its code is, give or take the code's
    error. So a task measures the `rerank` rows of least code distance, and then each other row that may yet be nearer than
    the k nearest of them: codes lose no neighbour within the visited cells. It sends the best `rerank`, and the best
    of all shards are ranked again exactly, in double precision.
    """
    spark, quantiser, counts, frame = queries.sparkSession, index.quantiser, index.sizes, index.frame
    kind = index.vectors.schema["id"].dataType.simpleString()
    if quantiser is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    q = usable(queries, id_col, vec_col).dropDuplicates(["id"])
    q = q.where(F.size("v") == quantiser.value.dim)
    probes = probes or quantiser.value.probes
    where = shards(counts)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse = quantiser.value.coarse
        held = np.array([counts.get(c, 0) for c in range(len(coarse))])
        for b in batches:
            out = []
            for i, v in zip(b["id"], b["v"], strict=True):
                order = np.argsort(((coarse - frame.put(v)) ** 2).sum(1), kind="stable")
                enough = max(probes, int(np.searchsorted(np.cumsum(held[order]), rerank + 1)) + 1)
                asked: dict[int, list[int]] = {}
                for c in order[:enough].tolist():
                    first, parts = where.get(c, (0, 0))
                    for s in range(first, first + parts):
                        asked.setdefault(s, []).append(c)
                out += [(i, v, s, cells) for s, cells in asked.items()]
            yield pd.DataFrame(out, columns=["query_id", "v", "shard", "cells"])

    def scan(key, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(rows):
            rows = rows.sort_values("cell", kind="stable")
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            ids, cell, at = rows["id"].to_numpy(), rows["cell"].to_numpy(), np.arange(codes.shape[1])
            x, error = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), -1), rows["error"].to_numpy()
            for i, v, cells in zip(asked["query_id"], asked["v"], asked["cells"], strict=True):
                q = frame.put(v)
                spans = [slice(*np.searchsorted(cell, [c, c + 1])) for c in cells]
                near = np.concatenate([quantiser.value.table(q, c)[at, codes[s]].sum(1) for c, s in zip(cells, spans, strict=True)])
                place = np.concatenate([np.arange(s.start, s.stop) for s in spans])
                other = ids[place] != i
                near, place = near[other], place[other]
                first = np.argpartition(near, rerank)[:rerank] if len(near) > rerank else np.arange(len(near))
                far = np.sqrt(((x[place[first]] - q) ** 2).sum(1))
                # The distance of the k-th nearest id among those; a row that cannot be nearer by its code and error is left out.
                each = pd.Series(far).groupby(ids[place[first]]).min().to_numpy()
                most = np.partition(each, k - 1)[k - 1] if len(each) >= k else np.inf
                some = place[np.sqrt(near) - error[place] <= most * 1.001 + 1e-6]
                d, own = ((x[some] - q) ** 2).sum(1), ids[some]
                best = np.lexsort((own, d))[:rerank] if len(d) <= 4 * rerank else _least(d, own, rerank)
                found.append((np.full(len(best), i), own[best], d[best].astype(np.float64)))
        query, own, d = map(np.concatenate, zip(*found, strict=True)) if found else ([], [], [])
        return pd.DataFrame({"query_id": query, "id": own, "d": d})

    blocks = max(1, -(-q.count() // block))
    asked = q.mapInPandas(probe, f"query_id {kind}, v array<double>, shard int, cells array<int>")
    asked = asked.withColumn("block", block_of("query_id", blocks))
    # Where each cell's rows are: a table of at most CELLS rows.
    split = F.broadcast(spark.createDataFrame([(c, *w) for c, w in where.items()], "cell int, first int, parts int"))
    rows = index.rows.join(split, "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A group is little data and much work, so the number of tasks follows the groups and not the bytes.
    tasks = min(TASKS, 2 * blocks * max(first + parts for first, parts in where.values()))
    rows = repeated(rows.select("id", "cell", "shard", "code", "error", "x"), blocks).repartition(tasks, "shard", "block")
    near = (
        asked.repartition(tasks, "shard", "block").groupBy("shard", "block").cogroup(rows.groupBy("shard", "block"))
        .applyInPandas(scan, f"query_id {kind}, id {kind}, d double")
    )
    top = Window.partitionBy("query_id").orderBy("d", "id")
    near = near.withColumn("r", F.row_number().over(top)).where(F.col("r") <= rerank).select("query_id", "id").distinct()
    pairs = near.join(index.vectors, "id").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id")
    square = F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.groupBy("query_id", "id").agg(F.min(F.sqrt(square)).alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def block_of(query: str, blocks: int) -> Column:
    """The block of a query, by its id's hash."""
    return F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int")


def repeated(rows: DataFrame, blocks: int) -> DataFrame:
    """rows once for each block of queries."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _least(d: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The n least by (d, id), without sorting all."""
    some = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
    return some[np.lexsort((ids[some], d[some]))][:n]
