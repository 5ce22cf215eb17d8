"""Nearest neighbours by additive quantisation.

A vector, scaled to length one, is coded as a sum of one codeword from each of
`books` full-dimensional codebooks. Codebooks start as k-means on residuals of
a bounded sample and are then fitted together by least squares to the codes
that a beam search finds. Every vector is coded by beam search; its code and
the norm of the sum of its codewords are stored. A query's products with all
codewords are a lookup table; a vector's score is the sum of its codewords'
entries over its stored norm.

Queries meet codes in blocks of bounded size. What looks best there by the
codes, `candidates` over all blocks, is ranked by its exact cosine, and the k-th
of these is what others have to beat. A vector's code also tells how far from it
the vector is: no angle to a query is smaller than the query's to the code less
the vector's to the code. Each row of the block whose code leaves it a chance is
ranked exactly too, so a block's k best are the true ones on any table, however
badly the codebooks fit it; a bad fit only makes more rows to check. A block
sends k rows a query.

Equal vectors are equally near, and ties go to the smaller vec_id, so of more
than k + 1 equal ones only the k + 1 smallest vec_ids can be among the k nearest
of any query; the others are left out before the search, whatever their number.

Defined results. Vectors that are null, zero, hold null or non-finite
components, or are not of the table's most frequent length take no part, nor do
rows whose vec_id is null, which no result could name. A query's own row is that
with its vec_id; of rows that repeat a query's vec_id the smallest vector is the
query. Rows that repeat a vec_id are candidates of others each for itself. Empty
table: no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import unit, written


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = 4) -> np.ndarray:
    """Codes of the rows of x: a beam search over the codebooks, one after the other, for the least residual."""
    m, k, _ = books.shape
    out = np.zeros((len(x), m), np.int64)
    norms = (books**2).sum(2)
    for a in range(0, len(x), 1024):
        part = x[a : a + 1024]
        n = len(part)
        left, codes = part[:, None, :], np.zeros((n, 1, 0), np.int64)
        for j in range(m):
            base = (left**2).sum(2)
            cost = base[:, :, None] - 2 * (left @ books[j].T) + norms[j]
            flat = cost.reshape(n, -1)
            width = min(beam if j < m - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, width - 1, 1)[:, :width]
            of, word = best // k, best % k
            left = np.take_along_axis(left, of[:, :, None], 1) - books[j][word]
            codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], 1), word[:, :, None]], 2)
        out[a : a + 1024] = codes[:, 0]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def codebooks(x: np.ndarray, books: int = 32, words: int = 64, rounds: int = 2, seed: int = 1) -> np.ndarray:
    """Codebooks (book, word, dimension) fitted to the rows of x."""
    rng = np.random.default_rng(seed)
    found, left = [], x.copy()
    for _ in range(books):
        c = _means(left, words, rng)
        left = left - c[np.argmax(left @ c.T - 0.5 * (c**2).sum(1), 1)]
        found.append(c)
    found = np.array(found)
    for _ in range(rounds):  # all codewords at once: ridge least squares on the codes' indicators
        codes = encode(x, found) + np.arange(books) * words
        gram, sums = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(sums, codes[:, i], x)
            for j in range(books):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1)
        found = np.linalg.solve(gram + 0.1 * np.eye(len(gram)), sums + 0.1 * found.reshape(-1, x.shape[1])).reshape(found.shape)
    return found


def _vectors(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """x with rows by powers of two, so that no square overflows or vanishes; cosines stay exactly."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / _norms(x)[:, None]


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = table.select("vec_id", v.alias("embedding")).where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0))


def pruned(rows: DataFrame, k: int) -> DataFrame:
    """rows without those that k + 1 equal vectors of smaller vec_id rule out of all results."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth")


def fit(rows: DataFrame, sample: int = 8192, seed: int = 7, **options) -> np.ndarray | None:
    """Codebooks learnt from about `sample` of the vectors."""
    n = rows.count()
    if not n:
        return None
    part = rows.where(unit(seed, "vec_id", "embedding") < min(1.0, sample / n)).select("embedding").toArrow()
    if not part.num_rows:
        part = rows.select("embedding").limit(1).toArrow()
    x = _vectors(part.column(0), len(part.column(0)[0]))
    x = _unit(x)
    return codebooks(x[np.lexsort(x.T)], **options)


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, norm, near, embedding): a byte per codebook, the norm of the sum of the codewords, its cosine to the
    vector, and the vector for the exact check."""
    size = books.shape[2]

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(1), size)
            x = _unit(x)
            codes = encode(x, books)
            sums = decode(codes, books)
            norms = _norms(sums)
            near = np.clip((x * sums).sum(1) / np.maximum(norms, 1e-12), -1, 1)
            blobs = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs, pa.array(norms.astype(np.float32)), pa.array(near), batch.column(1)], ["vec_id", "code", "norm", "near", "embedding"])

    return rows.mapInArrow(run, "vec_id long, code binary, norm float, near double, embedding array<double>")


def _nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k nearest rows of v, ties to the smaller id."""
    score = (v * q).sum(1) / (_norms(v) * _norms(q[None])[0])
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    some = some[np.lexsort((ids[some], -score[some]))][:k]
    return some, score[some]


def _met(queries: pa.Table, codes: pa.Table, books: np.ndarray, most: int, k: int) -> pa.Table:
    """The k nearest rows of a block for each query of a block: the best `most` by lookup tables, and all whose codes
    leave them a chance to be nearer than those, ranked exactly."""
    names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
    found: list[list] = [[], [], []]
    if queries.num_rows and codes.num_rows:
        m, words, size = books.shape
        q, v = _scaled(_vectors(queries.column("embedding"), size)), _scaled(_vectors(codes.column("embedding"), size))
        ids = codes.column("vec_id").to_numpy()
        places = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(len(ids), m).T.astype(np.int64) + words * np.arange(m)[:, None]
        scale = 1 / np.maximum(codes.column("norm").to_numpy(), 1e-12)
        near = codes.column("near").to_numpy()
        far = np.sqrt(1 - near * near)
        unit_q = q / _norms(q)[:, None]
        tables = (unit_q @ books.reshape(m * words, size).T).astype(np.float32)
        # what rounding in single precision may cost a row's score
        slack = 1e-6 + m * m * 6e-8 * np.abs(tables).max() * scale
        for i, (query, table) in enumerate(zip(queries.column("vec_id").to_pylist(), tables, strict=True)):
            rough = table[places[0]]
            for j in range(1, m):
                rough += table[places[j]]
            rough *= scale
            own = ids == query
            rough[own] = -np.inf
            n = min(most, len(ids))
            first = np.argpartition(rough, len(ids) - n)[len(ids) - n :]
            first = first[~own[first]]
            if not len(first):
                continue
            some, score = _nearest(q[i], v[first], ids[first], k)
            if n < len(ids):
                chance = np.ones(len(ids), bool)
                if len(some) == k:
                    t = min(1.0, max(-1.0, score[-1] - 1e-9))
                    # the cosine of the sum of both angles; beyond half a turn any row has a chance
                    chance = (rough >= t * near - (1 - t * t) ** 0.5 * far - slack) | (near <= 1e-6 - t)
                chance &= ~own
                first = np.flatnonzero(chance)
                some, score = _nearest(q[i], v[first], ids[first], k)
            found[0].append(np.full(len(some), query))
            found[1].append(ids[first[some]])
            found[2].append(score)
    return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, kinds, strict=True)], names)


def search(index: DataFrame, vectors: DataFrame | None, queries: DataFrame, books: np.ndarray, k: int = 5, candidates: int = 128, block: int = 1 << 16, block_queries: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query (vec_id, embedding) by cosine.

    index has the rows of coded(); with vectors, only rows whose vec_id is in them are results. candidates is the number
    that is ranked exactly before the check, for each query over the whole table. block is the number of rows of up to 64
    components that meet at a time, fewer of longer ones; as every block of queries gets all rows, these blocks are large.
    """
    size, parallel = books.shape[2], int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, min(block, (1 << 22) // size))
    block_queries = max(1, min(block_queries, (1 << 22) // size))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    if vectors is not None:
        index = index.join(vectors.select("vec_id").distinct(), "vec_id", "left_semi")
    n_index, n_queries = index.count(), queries.count()
    rows_in, sets_in = max(1, -(-n_index // block), min(parallel, n_index // 4096)), max(1, -(-n_queries // block_queries))
    share = min(candidates, n_index) / rows_in
    most = max(k + 1, min(candidates, math.ceil(share + 6 * share**0.5 + 16)))
    cell = lambda c, n: F.pmod(F.xxhash64(F.lit(c), "vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = index.withColumn("rows", cell(1, rows_in)).withColumn("set", each(sets_in))
    left = queries.withColumn("set", cell(2, sets_in)).withColumn("rows", each(rows_in))
    met = left.groupBy("rows", "set").cogroup(right.groupBy("rows", "set")).applyInArrow(lambda a, b: _met(a, b, books, most, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    books = fit(rows)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    left = written(pruned(rows, 5), "vectors")
    # a query may be one of the copies that were left out
    return search(written(coded(left, books), "codes"), None, rows.where(F.col("vec_id") % 50 == 0), books)
