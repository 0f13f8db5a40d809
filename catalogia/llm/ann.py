"""Nearest neighbours by score-aware anisotropic quantisation, four-bit table scans and exact reranking.

|x - q|^2 = |x|^2 - 2 x.q + |q|^2, so nearness is the inner product of a row's direction with q, times the row's norm, which is kept as it is: rows of very uneven
norms are coded alike. Directions are quantised in blocks of DIMS dimensions with 16 centroids each, so a code takes four bits. The loss weighs the
residual's part along the vector by ETA against the part across it: errors along the vector change large inner products most. A scan adds up one table
entry a block. Each row keeps how far its code is from it, so a scan bounds every distance from below; all rows whose bound doesn't exceed the k-th
distance met so far are measured exactly on the original vectors. The result is exact however close the vectors lie; where numbers
overflow, nothing is bounded, and the row is measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from catalogia.llm import common

DIMS = 2
CENTROIDS = 16
ETA = 3.0
#: The codebooks are fitted on at most about so many vectors; every vector is indexed.
TRAIN_VECTORS = 8_000
#: Queries that are broadcast at once; more are searched in further passes.
QUERY_BLOCK = 4_096


class Quantiser:
    def __init__(self, books: np.ndarray):
        self.books = books  # (blocks, 16, DIMS)

    def encode(self, x: np.ndarray, passes: int = 3) -> np.ndarray:
        """Codes (n, blocks) by coordinate descent on the anisotropic loss."""
        n, blocks = len(x), len(self.books)
        parts = x.reshape(n, blocks, DIMS)
        unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(n, blocks, DIMS)
        plain = np.empty((blocks, n, CENTROIDS), np.float32)
        along = np.empty((blocks, n, CENTROIDS), np.float32)
        for k in range(blocks):
            d = parts[:, k, None, :] - self.books[k][None]
            plain[k] = (d * d).sum(2)
            along[k] = (d * unit[:, k, None, :]).sum(2)
        codes = plain.argmin(2)
        total = np.take_along_axis(along, codes[..., None], 2)[..., 0].sum(0)
        rows = np.arange(n)
        for _ in range(passes):
            for k in range(blocks):
                rest = total - along[k][rows, codes[k]]
                loss = plain[k] + (ETA - 1) * (rest[:, None] + along[k]) ** 2
                codes[k] = loss.argmin(1)
                total = rest + along[k][rows, codes[k]]
        return codes.T.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(blocks, 16, queries): each centroid's part of the inner product with each query."""
        parts = q.reshape(len(q), len(self.books), DIMS)
        return np.einsum("kcd,qkd->kcq", self.books, parts)

    def decode(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The first `size` dimensions of the vectors that the codes stand for."""
        return np.concatenate([self.books[k][codes[:, k]] for k in range(len(self.books))], 1)[:, :size]


def fit(x: np.ndarray, rounds: int = 6, seed: int = 7) -> Quantiser:
    """Codebooks: k-means a block, then rounds of anisotropic codes and the least-squares centroids for them (blocks in turn)."""
    rng = np.random.default_rng(seed)
    blocks = x.shape[1] // DIMS
    parts = x.reshape(len(x), blocks, DIMS)
    books = np.empty((blocks, CENTROIDS, DIMS))
    for k in range(blocks):
        p = parts[:, k]
        c = p[rng.permutation(len(p))[:CENTROIDS]].copy()
        c = np.concatenate((c, np.zeros((CENTROIDS - len(c), DIMS)))) if len(c) < CENTROIDS else c
        for _ in range(12):
            near = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
            size = np.bincount(near, minlength=CENTROIDS)
            for d in range(DIMS):
                c[:, d] = np.where(size > 0, np.bincount(near, p[:, d], CENTROIDS) / np.maximum(size, 1), c[:, d])
        books[k] = c
    q = Quantiser(books)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).reshape(len(x), blocks, DIMS)
    for _ in range(rounds):
        codes = q.encode(x, 2)
        error = np.stack([((parts[:, k] - q.books[k][codes[:, k]]) * unit[:, k]).sum(1) for k in range(blocks)])
        total = error.sum(0)
        for k in range(blocks):
            rest = total - error[k]
            u, p = unit[:, k], parts[:, k]
            # Minimise |p - c|^2 + (ETA - 1) (rest + u.(p - c))^2 over c, for the rows of each centroid.
            lhs = np.eye(DIMS)[None] + (ETA - 1) * u[:, :, None] * u[:, None, :]
            rhs = p + (ETA - 1) * (rest + (u * p).sum(1))[:, None] * u
            for c in range(CENTROIDS):
                at = codes[:, k] == c
                if at.any():
                    q.books[k, c] = np.linalg.solve(lhs[at].sum(0), rhs[at].sum(0))
            error[k] = ((p - q.books[k][codes[:, k]]) * u).sum(1)
            total = rest + error[k]
    return q


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles): rows without a null id, a null, empty or zero vector, or a null or non-finite component; repeated ids stay."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & ok)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, padded to whole blocks, and norms; x has no zero row. Dividing by the largest component first keeps squares from overflowing."""
    largest = np.abs(x).max(1, keepdims=True)
    part = x / largest
    size = np.sqrt((part * part).sum(1, keepdims=True))
    return np.concatenate((part / size, np.zeros((len(x), -x.shape[1] % DIMS))), 1), (largest * size)[:, 0]


class Nearest:
    """The k nearest rows of each query among those met so far: distances by the exact formula, ties to the smaller id. keys: the queries' own rows."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, k: int):
        self.keys, self.q, self.k = keys, q, k
        self.columns = np.ascontiguousarray(q.T)
        with np.errstate(over="ignore"):
            self.square = (q * q).sum(1)
        self.score = np.full((len(keys), k), np.inf)
        self.name = np.full((len(keys), k), np.iinfo(np.int64).max)
        self.met = np.zeros(len(keys), np.int64)

    def reach(self, upper: np.ndarray, other: np.ndarray) -> np.ndarray:
        """No more than this is the k-th distance of each query, if upper (rows, queries) bounds the distances of the next rows; NaN bounds nothing."""
        far = self.score[:, -1]
        if len(upper) >= self.k and (self.met < self.k).any():
            upper = np.where(other & ~np.isnan(upper), upper, np.inf)
            far = np.minimum(far, np.partition(upper, self.k - 1, 0)[self.k - 1])
        return far

    def add(self, keys: np.ndarray, names: np.ndarray, v: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> None:
        """Rows (keys, ids, vectors) with bounds of their distances (rows, queries) to the queries."""
        other = keys[:, None] != self.keys[None]
        open_ = ~(lower > self.reach(upper, other)) & other
        rows = np.flatnonzero(open_.any(1))
        if not len(rows):
            return
        names, v, other, open_ = names[rows], v[rows], other[rows], open_[rows]
        # One matrix product tells most of the rest; what rounding could have moved stays in.
        squares = (v * v).sum(1)[:, None] + self.square[None]
        squares[~np.isfinite(squares)] = np.nan
        apart, slack = squares - 2 * (v @ self.q.T), 1e-9 * squares
        far = self.reach(np.sqrt(np.maximum(apart + slack, 0)), other)
        i, j = np.nonzero(open_ & ~(np.sqrt(np.maximum(apart - slack, 0)) * (1 - 1e-9) > far))
        if not len(i):
            return
        score = np.empty(len(i))
        columns = np.ascontiguousarray(v.T)
        for at in range(0, len(i), 200_000):
            x, y = i[at : at + 200_000], j[at : at + 200_000]
            total = np.zeros(len(x))
            for d in range(len(columns)):
                part = columns[d][x] - self.columns[d][y]
                total += part * part
            score[at : at + 200_000] = np.sqrt(total)
        touched, own = np.unique(j, return_inverse=True)
        self.met[touched] += np.bincount(own)
        k, n = self.k, len(touched)
        own = np.concatenate((np.repeat(np.arange(n), k), own))
        score = np.concatenate((self.score[touched].ravel(), score))
        name = np.concatenate((self.name[touched].ravel(), names[i]))
        order = np.lexsort((name, score, own))
        own = own[order]
        first = order[np.arange(len(own)) - np.searchsorted(own, own) < k]
        self.score[touched], self.name[touched] = score[first].reshape(n, k), name[first].reshape(n, k)

    def rows(self) -> pa.RecordBatch:
        there = np.arange(self.k)[None] < self.met[:, None]
        cols = [np.broadcast_to(self.keys[:, None], there.shape)[there], self.name[there], self.score[there]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "vec_id", "score"])


def search(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """base, queries: row (a number of its own for each row), vec_id and v as usable() gives them, of one length.

    query_id, rank, vec_id, score (Euclidean distance), nearest first, ties to the smaller vec_id. A query's own row isn't its candidate; another row
    of its id is. Base is read to fit and to index it; its codes and vectors are read once a block of queries. Each task gives its k
    nearest of each query, so what is exchanged doesn't depend on how many rows lie near one another.
    """
    spark = base.sparkSession
    n = base.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    sample = common.sampled(base, "vec_id", TRAIN_VECTORS, n).orderBy("vec_id", "v").select("v").toPandas()["v"]
    x = np.stack(sample.to_numpy()) if len(sample) else np.stack([base.first()["v"]])
    size = x.shape[1]
    quantiser = fit(directions(x)[0])
    common.small_batches(spark, 4096)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                unit, norm = directions(v)
                codes = quantiser.encode(unit)
                with np.errstate(all="ignore"):
                    off = np.sqrt(((v - norm[:, None] * quantiser.decode(codes, size)) ** 2).sum(1))
                if codes.shape[1] % 2:
                    codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), 1)
                packed = codes[:, 0::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(norm), pa.array(off)], ["row", "vec_id", "v", "code", "norm", "off"])

    codes = common.saved(base.mapInArrow(index, "row long, vec_id long, v array<double>, code binary, norm double, off double"), "codes")
    queries = common.saved(queries, "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    near = None
    for block in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block)
        got = mine.orderBy("vec_id", "row").toPandas()
        if not len(got):
            continue
        sent = spark.sparkContext.broadcast((got["row"].to_numpy(), np.stack(got["v"].to_numpy())))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            tables = quantiser.tables(np.concatenate((q, np.zeros((len(q), quantiser.books.shape[0] * DIMS - size))), 1))
            best = Nearest(keys, q, k)
            for b in batches:
                if not b.num_rows:
                    continue
                packed = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                rows, names, norm, off, v = *(b.column(c).to_numpy() for c in ("row", "vec_id", "norm", "off")), _matrix(b.column("v"))
                for at in range(0, len(names), 512):
                    part = packed[at : at + 512]
                    picked = [part[:, j // 2] >> 4 * (j % 2) & 15 for j in range(len(tables))]
                    with np.errstate(all="ignore"):
                        s = np.zeros((len(part), len(keys)))
                        for table, c in zip(tables, picked):
                            s += table[c]
                        r = norm[at : at + 512, None]
                        code = quantiser.decode(np.stack(picked, 1), size)
                        squares = r * r * (code * code).sum(1)[:, None] + best.square[None]
                        squares[~np.isfinite(squares)] = np.nan
                        far, slack = squares - 2 * r * s, 1e-9 * squares
                        away = off[at : at + 512, None] * (1 + 1e-9)
                        best.add(rows[at : at + 512], names[at : at + 512], v[at : at + 512], np.sqrt(np.maximum(far - slack, 0)) - away, np.sqrt(np.maximum(far + slack, 0)) + away)
            yield best.rows()

        found = common.saved(codes.mapInArrow(scan, "query long, vec_id long, score double"), "nearest")
        near = found if near is None else near.union(found)
    if near is None:
        return spark.createDataFrame([], out)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id")))
    of = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.filter(F.col("rank") <= k).join(of, "query").select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest of each vector whose id is divisible by `every`, among all other rows of its length; see search.

    Rows of a repeated id are vectors of their own: each is a candidate of the others, and each is a query if its id is. Null ids, and null, empty, zero or
    non-finite vectors, take no part. Other columns don't matter; an empty table has no rows. Each length with a query is fitted and searched by itself.
    """
    found = usable(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("n"))
    base = common.saved(found, "usable")
    asks = F.col("vec_id") % every == 0
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in base.filter(asks).select("n").distinct().orderBy("n").collect():
        mine = base.filter(F.col("n") == r["n"]).drop("n")
        out = out.union(search(mine, mine.filter(asks), k))
    return out
