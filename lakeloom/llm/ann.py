"""Maximum inner product search by score-aware quantisation, four-bit table scans and exact reranking.

The codebooks are fitted on a bounded sample with the anisotropic loss |r|^2 + (eta - 1) <r, x/|x|>^2, which weighs the
part of a residual r along its vector eta times as much as the part across it, as only the former changes the inner products
of near queries. Codes are assigned by coordinate descent over the subspaces, centers by the loss's normal equations. Every
vector is coded; blocks of codes are scanned with the tables of blocks of queries, and the best of each block, and all whose
table score comes within the measured error of these of the k-th best, are scored exactly in double precision on the original vectors. Queries meet all rows in blocks by an equi-join on a
group number, so no side is broadcast and a block pair is one bounded piece of work.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, vectors of another
length than the commonest (the shorter of equally common ones) and rows with a null id take no part; rows with the query's
id are not its candidates; of repeated ids each counts once with its best score, and as a query with its smallest
vector; equal scores go by the smaller id; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, map_arrow

#: Components of a subspace and centers of its codebook (four bits).
SUB, CENTERS = 2, 16
#: Vectors that the codebooks are fitted on, at most: those whose hashed id is smallest.
SAMPLE = 16_000
#: Inner products from this share of the norms on count: sets the weight of parallel residuals.
THRESHOLD = 0.2
ROUNDS = 8
#: Vectors of a coded block, queries of a query block, exactly scored vectors of a block for each query.
BLOCK, QUERY_BLOCK, RERANK = 4096, 256, 96


@dataclass
class Quantiser:
    books: np.ndarray  # subspace, center, component
    eta: float

    @property
    def dim(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the score-aware loss, from the nearest centers."""
        return _assign(self.padded(x.astype(np.float64)), self.books, self.eta, sweeps)[0]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with pairs of centers: query, pair of subspaces, byte of two codes."""
        q = self.padded(q.astype(np.float64)).reshape(len(q), len(self.books), -1)
        single = np.einsum("qms,mcs->qmc", q, self.books)
        return (single[:, 0::2, :, None] + single[:, 1::2, None, :]).reshape(len(q), -1, CENTERS * CENTERS).astype(np.float32)

    @staticmethod
    def packed(codes: np.ndarray) -> np.ndarray:
        return (codes[:, 0::2] * CENTERS + codes[:, 1::2]).astype(np.uint8)


def _assign(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int):
    n, m = len(x), len(books)
    parts = x.reshape(n, m, -1)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, m, -1)
    dist = np.stack([((parts[:, j, None] - books[j]) ** 2).sum(-1) for j in range(m)], axis=1)
    along = np.stack([(parts[:, j] * unit[:, j]).sum(-1)[:, None] - unit[:, j] @ books[j].T for j in range(m)], axis=1)
    codes = dist.argmin(axis=2)
    at = np.arange(n)
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[at, j, codes[:, j]]
            codes[:, j] = (dist[:, j] + (eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
            total = rest + along[at, j, codes[:, j]]
    return codes, total, along


def fit(x: np.ndarray, rounds: int = ROUNDS, threshold: float = THRESHOLD, seed: int = 7) -> Quantiser:
    """Codebooks of a sample of vectors."""
    d = x.shape[1]
    m = -(-d // SUB)
    m += m % 2
    x = np.pad(x.astype(np.float64), ((0, 0), (0, m * SUB - d)))
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    parts = x.reshape(len(x), m, SUB)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), m, SUB)
    books = np.stack([parts[rng.integers(0, len(x), CENTERS), j] + rng.normal(0, 1e-6, (CENTERS, SUB)) for j in range(m)])
    for r in range(rounds):
        codes, total, along = _assign(x, books, eta if r >= 2 else 1.0, 1)
        weight = (eta if r >= 2 else 1.0) - 1
        for j in range(m):
            u, p = unit[:, j], parts[:, j]
            rest = total - along[np.arange(len(x)), j, codes[:, j]]
            pull = p + weight * u * (rest + (p * u).sum(-1))[:, None]
            count = np.bincount(codes[:, j], minlength=CENTERS).astype(np.float64)
            left = np.zeros((CENTERS, SUB, SUB))
            right = np.zeros((CENTERS, SUB))
            for a in range(SUB):
                right[:, a] = np.bincount(codes[:, j], pull[:, a], CENTERS)
                for b in range(SUB):
                    left[:, a, b] = weight * np.bincount(codes[:, j], u[:, a] * u[:, b], CENTERS) + (a == b) * count
            some = count > 0
            books[j, some] = np.linalg.solve(left[some], right[some][:, :, None])[:, :, 0]
            for c in np.flatnonzero(~some):
                books[j, c] = p[rng.integers(0, len(x))]
    return Quantiser(books, eta)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of double) of the rows that take part, but for their length."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(bad, F.lit(True)).alias("bad"))
    return rows.filter("id is not null and not bad and exists(v, c -> c <> 0)").drop("bad")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim, total = common["d"], common["count"]
    rows = rows.filter(F.size("v") == dim)
    fitted = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(sample).toArrow()  # `sample` rows at most
    held = spark.sparkContext.broadcast(fit(_matrix(fitted.column("v").combine_chunks(), dim)))
    groups = max(12, -(-total // (8 * block)))

    def code_blocks(batches):
        def packed(ids, x):
            quantiser = held.value
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], np.ascontiguousarray(x[order])
            _, first, member = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
            by = np.argsort(member, kind="stable")  # ids of one vector stay in order
            counts = np.bincount(member)
            begins = np.r_[0, np.cumsum(counts)[:-1]]
            nth = np.arange(len(ids)) - np.repeat(begins, counts)
            some = nth <= k  # no more of one vector can be among the k best
            u = x[first]
            codes = quantiser.packed(quantiser.encode(u))
            row = [u.tobytes(), codes.tobytes(), ids[by][some].tobytes(), np.minimum(counts, k + 1).astype(np.int64).tobytes()]
            g = int(ids[0]) * 2654435761 % groups
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *(pa.array([c], pa.binary()) for c in row)], ["g", "u", "codes", "ids", "counts"])

        ids, x = np.empty(0, np.int64), np.empty((0, dim))
        for b in batches:
            ids, x = np.r_[ids, np.asarray(b.column(0))], np.r_[x, _matrix(b.column(1), dim)]
            while len(ids) >= block:
                yield packed(ids[:block], x[:block])
                ids, x = ids[block:], x[block:]
        if len(ids):
            yield packed(ids, x)

    def query_blocks(batches):
        for b in batches:
            ids, x = np.asarray(b.column(0)), _matrix(b.column(1), dim)
            for i in range(0, len(ids), query_block):
                part = [ids[i : i + query_block].tobytes(), x[i : i + query_block].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in part], ["qids", "q"])

    coded = scratch.write(rows.mapInArrow(code_blocks, "g int, u binary, codes binary, ids binary, counts binary"), "codes")
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = scratch.write(queries.mapInArrow(query_blocks, "qids binary, q binary"), "queries")
    asked = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def scan(batch: pa.RecordBatch):
        quantiser = held.value
        for r in range(batch.num_rows):
            u, codes, ids, counts, qids, q = (batch.column(c)[r].as_py() for c in range(6))
            qids, q = np.frombuffer(qids, np.int64), np.frombuffer(q, np.float64).reshape(-1, dim)
            u, ids, counts = np.frombuffer(u, np.float64).reshape(-1, dim), np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int64)
            codes = np.frombuffer(codes, np.uint8).reshape(len(u), -1)
            begins = np.r_[0, np.cumsum(counts)[:-1]]
            out = [[], [], []]
            tables = quantiser.tables(q)
            for i in range(0, len(q), 32):
                approx = np.zeros((len(q[i : i + 32]), len(u)), np.float32)
                for j in range(codes.shape[1]):
                    approx += tables[i : i + 32, j].take(codes[:, j], axis=1)
                few = np.argpartition(-approx, rerank - 1, axis=1)[:, :rerank] if len(u) > rerank else np.broadcast_to(np.arange(len(u)), approx.shape)
                exact = (u[few] * q[i : i + 32, None, :]).sum(axis=-1)
                for n in range(len(few)):
                    best, scores = few[n], exact[n]
                    if len(u) > rerank:
                        # what the tables put within their measured error of the k-th best so far is scored, too
                        error = np.abs(scores - approx[n, best]).max()
                        enough = min(k + 1, len(scores))
                        near = np.flatnonzero(approx[n] >= np.partition(scores, -enough)[-enough] - error)
                        best = np.union1d(best, near)
                        scores = (u[best] * q[i + n]).sum(axis=-1)
                    order = np.lexsort((ids[begins[best]], -scores))[: k + 1]
                    pick = best[order]
                    size = counts[pick]
                    at = np.repeat(begins[pick] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                    vid, score = ids[at], np.repeat(scores[order], size)
                    keep = vid != qids[i + n]
                    vid, score = vid[keep], score[keep]
                    order = np.lexsort((vid, -score))[:k]
                    out[0].append(np.full(len(order), qids[i + n]))
                    out[1].append(vid[order])
                    out[2].append(score[order])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_id", "vec_id", "score"])

    pairs = coded.join(asked, "g").select("u", "codes", "ids", "counts", "qids", "q")
    found = map_arrow(pairs, scan, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
