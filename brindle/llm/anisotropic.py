"""Approximate nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are cut into subspaces of two dimensions with 16 codewords each, four
bits a subspace.  The quantiser is fitted on a bounded sample under the
anisotropic loss: the part of the residual that is parallel to the vector
counts PARALLEL times the orthogonal part, as it is what moves large inner
products.  Every row is encoded, and keeps the length of its residual.

Rows are filed in lists by their nearest centroid, and a query probes the lists
whose centroids are nearest.  How many it probes is measured, not set: on the
sample, so many that RECALL of exact neighbours lie in probed lists.  Vectors
that gather in clusters need few lists, unstructured ones nearly all of them.
Queries whose lists hold fewer than k candidates are asked again, of all lists.

Lists are dealt into blocks of rows and blocks of queries of bounded size, and
every two blocks of a list meet in one task, so a hot list (many copies of one
vector) is many tasks, and neither rows nor queries pass through the driver.  A
block of queries scans the codes of a block of rows through tables of 16 partial
products.  The best by table are scored exactly, which gives the k-th best so
far; then every row whose table score comes within REACH standard deviations of
its own residual to that is scored exactly too.  So the number of rows that are
reranked follows the data and is not capped: in a dense group of near copies all
are.

Exact scores are cosines in double precision, each computed by the same
row-wise sum, so equal vectors tie exactly; ties go to the smaller vec_id.

Vectors of each length are indexed and searched among themselves; between
lengths there is no cosine.  Rows with null vec_id, and vectors that are null,
empty, zero, or hold null or non-finite components take no part.  Rows that
repeat a vec_id are one candidate, by its best score; a query that repeats is
asked once, with its least vector, of the shortest length.  With fewer
candidates than k all are returned; an empty table gives no rows.  Columns
beside vec_id and embedding are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialise

#: Dimensions of a subspace, codewords, weight of the parallel residual, rounds of the fit.
WIDTH, CODES, PARALLEL, ROUNDS = 2, 16, 4.0, 6
#: Vectors of each length that the quantiser is fitted on, and the lists, at most; numbers in the vectors of a sample, at most.
SAMPLE, LIST_SAMPLE, SAMPLE_NUMBERS = 8_192, 32_768, 1 << 21
#: Share of exact neighbours on the sample that probed lists must hold; sample vectors that are asked for it; rounds of the lists' fit.
RECALL, ASKED, LIST_ROUNDS = 0.995, 512, 8
#: Standard deviations of the residual's share in a score that the rerank reaches; tables' best that are scored first.
REACH, FIRST = 4.0, 8
#: Numbers in a block of rows and in a block of queries, on average; queries and rows scanned at once.
ROW_BLOCK, QUERY_BLOCK, SCAN_QUERIES, SCAN_ROWS = 1 << 21, 1 << 20, 128, 2_048
#: Probes that a worker sends on at once.
PROBED = 8_192


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, whatever their length."""
    good = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(good)


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1), np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, safe from overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantiser:
    """books[j]: the 16 codewords of subspace j."""

    def __init__(self, books: np.ndarray, dim: int):
        self.books, self.dim = books, dim

    def parts(self, x: np.ndarray) -> np.ndarray:
        pad = -self.dim % WIDTH
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, WIDTH)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (n, subspaces) that lower the anisotropic loss by coordinate descent; x has unit rows."""
        p, books = self.parts(x), self.books
        n, subspaces, _ = p.shape
        gap = p[:, :, None, :] - books[None]  # n, subspaces, codes, width
        square, along = (gap * gap).sum(-1), (gap * p[:, :, None, :]).sum(-1)
        codes = square.argmin(-1)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for j in range(subspaces):  # the parallel residual is a sum over subspaces: choose each given the others
            rest = total - along[rows, j, codes[:, j]]
            loss = square[:, j] + (PARALLEL - 1) * (rest[:, None] + along[:, j]) ** 2
            codes[:, j] = loss.argmin(1)
            total = rest + along[rows, j, codes[:, j]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(codes.shape[1])[None], codes].reshape(len(codes), -1)[:, : self.dim]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Partial products (queries, subspaces, codes)."""
        return np.einsum("qsw,scw->qsc", self.parts(q), self.books)


def fit(x: np.ndarray) -> Quantiser:
    """Alternate between codes and codewords on unit rows x."""
    dim = x.shape[1]
    rng = np.random.Generator(np.random.PCG64(11))
    subspaces = -(-dim // WIDTH)
    own = Quantiser(np.zeros((subspaces, CODES, WIDTH)), dim)
    p = own.parts(x)
    own.books = np.stack([p[rng.choice(len(x), CODES, replace=len(x) < CODES), j] for j in range(subspaces)])
    own.books = own.books + rng.normal(0, 1e-4, own.books.shape)
    for _ in range(ROUNDS):
        codes = np.concatenate([own.encode(x[i : i + SCAN_ROWS]) for i in range(0, len(x), SCAN_ROWS)])
        left = x - own.decode(codes)
        along = (left * x).sum(1)
        for j in range(subspaces):
            # least squares of a codeword c over its rows: |p - c|^2 + (w - 1) * (rest + p . (p - c))^2
            old = own.books[j][codes[:, j]]
            rest = along - ((p[:, j] - old) * p[:, j]).sum(1)
            for c in range(CODES):
                m = codes[:, j] == c
                if m.any():
                    a = p[m, j]
                    t = rest[m] + (a * a).sum(1)
                    left_side = m.sum() * np.eye(WIDTH) + (PARALLEL - 1) * a.T @ a
                    own.books[j, c] = np.linalg.solve(left_side, a.sum(0) + (PARALLEL - 1) * (a * t[:, None]).sum(0))
            along = rest + ((p[:, j] - own.books[j][codes[:, j]]) * p[:, j]).sum(1)
    return own


class Lists:
    """centroids: unit rows; probes: how many lists a query asks."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists of each unit row, nearest first."""
        out = np.empty((len(x), n), np.int64)
        for i in range(0, len(x), SCAN_ROWS):
            near = x[i : i + SCAN_ROWS] @ self.centroids.T
            out[i : i + SCAN_ROWS] = near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
        return out


def fit_lists(x: np.ndarray, rows: int, k: int = 5) -> Lists:
    """Lists for a table of `rows` rows, about a quarter of its root, from unit rows x, and the probes that reach RECALL on them."""
    rng = np.random.Generator(np.random.PCG64(5))
    n = int(max(1, min(round(np.sqrt(rows) / 4), len(x) // 64)))
    c = x[np.sort(rng.choice(len(x), n, replace=False))]
    for _ in range(LIST_ROUNDS if n > 1 else 0):
        at = Lists(c, n).nearest(x, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    own = Lists(c, n)
    if n == 1:
        return own
    of = own.nearest(x, 1)[:, 0]
    asked = np.sort(rng.choice(len(x), min(ASKED, len(x)), replace=False))
    place = np.argsort(own.nearest(x[asked], n), axis=1)  # the place of each list in a query's order
    found = []
    for i in range(0, len(asked), 32):
        some = asked[i : i + 32]
        score = x[some] @ x.T
        score[np.arange(len(some)), some] = -np.inf
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        found.append(place[i : i + 32][np.arange(len(some))[:, None], of[top]].ravel())
    found = np.sort(np.concatenate(found))
    own.probes = int(found[min(len(found) - 1, int(np.ceil(RECALL * len(found))) - 1)]) + 1
    return own


def build_index(embeddings: DataFrame) -> tuple[DataFrame, dict[int, tuple[Quantiser, Lists]]]:
    """(dim, list, vec_id, v, codes: four bits a subspace, error, row: a number) of every row that takes part, and for each length the quantiser and the lists.

    The samples are drawn by a hash of vec_id, at most LIST_SAMPLE rows of each length and SAMPLE_NUMBERS numbers.
    """
    rows = valid(embeddings).withColumn("dim", F.size("v"))
    own: dict[int, tuple[Quantiser, Lists]] = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        most = max(1, min(LIST_SAMPLE, SAMPLE_NUMBERS // r.dim))
        sample = rows.where(F.col("dim") == r.dim).orderBy(F.xxhash64(F.lit("ann"), "vec_id"), "vec_id", "v").limit(most).select("v").toArrow()
        x = unit(matrix(sample["v"].combine_chunks()))
        own[r.dim] = (fit(x[:SAMPLE]), fit_lists(x, r.n))
    held = embeddings.sparkSession.sparkContext.broadcast(own)

    def run(batches):
        for batch in batches:
            for dim in set(batch.column(2).to_pylist()):
                part = batch.filter(pa.array([d == dim for d in batch.column(2).to_pylist()], pa.bool_()))
                (q, lists), x = held.value[dim], unit(matrix(part.column(1)))
                codes = np.concatenate([q.encode(x[i : i + SCAN_ROWS]) for i in range(0, len(x), SCAN_ROWS)])
                error = np.sqrt(((x - q.decode(codes)) ** 2).sum(1))
                even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = even[:, ::2] << 4 | even[:, 1::2]
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), pa.array(lists.nearest(x, 1)[:, 0], pa.int32()), part.column(0), part.column(1), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(error)],
                    names=["dim", "list", "vec_id", "v", "codes", "error"],
                )

    index = rows.select("vec_id", "v", "dim").mapInArrow(run, "dim int, list int, vec_id long, v array<double>, codes binary, error double")
    return materialise(index.withColumn("row", F.monotonically_increasing_id()), "ann-index"), own


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise cosines in double precision, the same for a pair wherever it stands; scaled first, against overflow."""
    q, x = q / np.abs(q).max(axis=1, keepdims=True), x / np.abs(x).max(axis=1, keepdims=True)
    return (q * x).sum(axis=1) / np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1))


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.k = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64), k

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Of pairs (query, id) the better score counts."""
        if not len(rows):
            return
        some = np.unique(rows)
        old = self.score[some] > -np.inf
        q = np.concatenate([rows, np.repeat(some, old.sum(1))])
        i, s = np.concatenate([ids, self.id[some][old]]), np.concatenate([scores, self.score[some][old]])
        order = np.lexsort((-s, i, q))  # the first of each pair is its best
        q, i, s = q[order], i[order], s[order]
        first = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))
        q, i, s = q[first], i[first], s[first]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        top = place < self.k
        self.score[some] = -np.inf
        self.score[q[top], place[top]], self.id[q[top], place[top]] = s[top], i[top]


def scan(own: Quantiser, queries: pa.Table, rows: pa.Table, k: int) -> Best:
    """The k best of a block of rows for each query of a block."""
    qids, q = queries["query_id"].to_numpy(), matrix(queries["q"].combine_chunks())
    best, tables = Best(len(q), k), own.tables(unit(q))
    subspaces = tables.shape[1]
    for a in range(0, rows.num_rows, SCAN_ROWS):
        part_of = rows.slice(a, SCAN_ROWS)
        x, ids, error = matrix(part_of["v"].combine_chunks()), part_of["vec_id"].to_numpy(), part_of["error"].to_numpy()
        packed = np.frombuffer(b"".join(part_of["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        codes = np.ascontiguousarray(np.stack([packed >> 4, packed & 15], axis=2).reshape(len(ids), -1)[:, :subspaces].T)
        reach = (REACH / np.sqrt(own.dim)) * error
        for b in range(0, len(q), SCAN_QUERIES):
            part = tables[b : b + SCAN_QUERIES]
            s = np.zeros((len(part), len(ids)))
            for j in range(subspaces):
                s += part[:, j].take(codes[j], axis=1)
            s[qids[b : b + SCAN_QUERIES, None] == ids[None]] = -np.inf
            n = min(max(FIRST, k), len(ids))
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            at, cols = np.repeat(np.arange(len(part)), n), top.ravel()
            ok = s[at, cols] > -np.inf
            rerank(best, q, x, qids, ids, at[ok] + b, cols[ok])
            s[at, cols] = -np.inf
            at, cols = np.nonzero(s + reach[None] >= best.score[b : b + SCAN_QUERIES, k - 1 :])
            ok = s[at, cols] > -np.inf
            rerank(best, q, x, qids, ids, at[ok] + b, cols[ok])
    return best


def rerank(best: Best, q, x, qids, ids, rows, cols, strip: int = 65_536) -> None:
    for i in range(0, len(rows), strip):
        r, c = rows[i : i + strip], cols[i : i + strip]
        s = cosine(q[r], x[c])
        hope = s >= best.score[r, best.k - 1]
        best.add(r[hope], ids[c[hope]], s[hope])


def probes(asked: DataFrame, held, every_list: bool) -> DataFrame:
    """dim, list, query_id, q for every list that a query (query_id, dim, q) asks."""

    def run(batches):
        for batch in batches:
            for dim in set(batch.column(1).to_pylist()):
                own = batch.filter(pa.array([d == dim for d in batch.column(1).to_pylist()], pa.bool_()))
                lists = held.value[dim][1]
                n = len(lists.centroids) if every_list else lists.probes
                step = max(1, PROBED // n)
                for a in range(0, own.num_rows, step):
                    part = own.slice(a, step)
                    near = lists.nearest(unit(matrix(part.column(2))), n)
                    at = pa.array(np.repeat(np.arange(part.num_rows), n))
                    yield pa.RecordBatch.from_arrays([part.column(1).take(at), pa.array(near.ravel(), pa.int32()), part.column(0).take(at), part.column(2).take(at)], names=["dim", "list", "query_id", "q"])

    return asked.mapInArrow(run, "dim int, list int, query_id long, q array<double>")


def blocks(df: DataFrame, numbers: int, name: str) -> DataFrame:
    """dim, list and into how many blocks its rows are dealt: one row a list, of which there are at most LIST_SAMPLE / 64 for each length."""
    return df.groupBy("dim", "list").agg(F.ceil(F.count("*") * F.first("dim") / numbers).cast("int").alias(name))


def search(index: DataFrame, asked: DataFrame, held, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of every pair of blocks of a list, for queries (dim, list, query_id, q)."""
    size = blocks(index, ROW_BLOCK, "row_blocks").join(blocks(asked, QUERY_BLOCK, "query_blocks"), ["dim", "list"])
    size = F.broadcast(materialise(size, "ann-blocks"))
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.join(size, ["dim", "list"]).withColumn("row_block", F.pmod(F.xxhash64("row"), "row_blocks").cast("int"))
    rows = rows.select("dim", "list", "row_block", every_block("query_blocks").alias("query_block"), "vec_id", "v", "codes", "error")
    queries = asked.join(size, ["dim", "list"]).withColumn("query_block", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int"))
    queries = queries.select("dim", "list", every_block("row_blocks").alias("row_block"), "query_block", "query_id", "q")

    def meet(key, one: pa.Table, other: pa.Table) -> pa.Table:
        if not (one.num_rows and other.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = scan(held.value[key[0].as_py()][0], one, other, k)
        r, c = np.nonzero(best.score > -np.inf)
        return pa.table({"query_id": one["query_id"].to_numpy()[r], "vec_id": best.id[r, c], "score": best.score[r, c]})

    group = ["dim", "list", "row_block", "query_block"]
    found = queries.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(meet, "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    index, own = build_index(embeddings)
    if not own:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = spark.sparkContext.broadcast(own)
    least = index.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "v")).alias("least"))
    asked = materialise(least.select("query_id", "least.dim", F.col("least.v").alias("q")), "ann-queries")
    found = materialise(search(index, materialise(probes(asked, held, False), "ann-probes"), held, k), "ann-found")
    if any(lists.probes < len(lists.centroids) for _, lists in own.values()):
        few = found.groupBy("query_id").agg(F.count("*").alias("n"))
        few = materialise(asked.join(few, "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).drop("n"), "ann-few")
        if not few.isEmpty():
            more = search(index, materialise(probes(few, held, True), "ann-probes"), held, k)
            found = found.join(few.select("query_id"), "query_id", "left_anti").union(more)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
