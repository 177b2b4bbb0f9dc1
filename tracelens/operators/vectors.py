"""Vector statistics, the spread of scores and a centred principal-component projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, small


def stats(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda s, x: s + f(x))
    return vectors.select(key, F.size(vector).alias("dim"), F.bround(F.sqrt(total(lambda x: x * x)), 6).alias("l2_norm"), F.bround(total(lambda x: x) / F.size(vector), 6).alias("mean"), F.bround(F.array_min(v), 6).alias("least"), F.bround(F.array_max(v), 6).alias("most"), F.size(F.filter(v, lambda x: x != 0)).alias("nonzero"))


def project(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """key, point: k coordinates scaled by the largest absolute one, and the share of variance each explains.

    Vectors are centred first (the library's projection doesn't); each axis' sign is set so that its largest loading is positive.
    queries(key, vector), if given, are placed by the vectors' mean, axes and scale, and come after them.
    """
    dim = vectors.select(F.size(vector)).first()
    if dim is None:
        return vectors.select(key, F.array().cast("array<double>").alias("point"), F.array().cast("array<double>").alias("explained"))
    means = vectors.agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim[0])]).first()
    centre = lambda df: df.select(key, array_to_vector(F.zip_with(F.transform(vector, lambda x: x.cast("double")), F.array(*[F.lit(float(m)) for m in means]), lambda x, m: x - m)).alias("v"))
    centred = centre(vectors)
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    place = lambda df: model.transform(df).select(key, F.zip_with(vector_to_array("p"), F.array(*[F.lit(s) for s in signs]), lambda x, s: x * s).alias("p"))
    placed = place(centred)
    most = placed.agg(F.max(F.array_max(F.transform("p", F.abs))).alias("m")).first()["m"] or 1.0
    explained = F.array(*[F.lit(float(x)) for x in model.explainedVariance.toArray()])
    placed = placed if queries is None else placed.union(place(centre(queries)))
    return placed.select(key, F.transform("p", lambda x: x / most).alias("point"), explained.alias("explained"))


#: Vectors and queries of a block on average; scores are counted in ranges of these many millionths, one after the other.
VECTORS, QUERIES, WIDTHS = 2048, 256, (1 << 14, 1 << 7, 1)
#: Queries scored at once, so that sums stay in a core's cache; the first range, below any score.
TILE, FLOOR = 16, -(1 << 20)
#: In millionths: what stands for no score, which comes before all, and for a score that is no number, which comes after.
NONE, NAN = -(1 << 40), 1 << 30


def spread(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, most, middle, least, n of the cosines, to six places, of each of queries(query_id, scope, embedding) with all of
    vectors(vec_id, scope, embedding) in its scope; the middle one is the upper median. Vectors of unequal dimensions have no score.

    Every pair is scored, and only counts are kept: how many scores of a query are in a range of WIDTHS[0], then, in the range that
    has the middle one, in those of WIDTHS[1], and so on. Blocks of vectors meet blocks of queries, so a task holds one of either."""
    ship(vectors.sparkSession)
    tasks = 3 * vectors.sparkSession.sparkContext.defaultParallelism
    held = cut(_blocked(vectors.select("vec_id", "scope", "embedding"), "vec_id", VECTORS, F.struct("embedding")).repartition(tasks))
    asked, low, out = queries.select("query_id", "scope", "embedding"), F.lit(0).cast("long"), None
    kind = queries.schema["query_id"].dataType.simpleString()
    for width, of in zip(WIDTHS, (None, *WIDTHS), strict=False):
        if out is not None:
            asked = asked.join(small(out.select("query_id", "at"), 100_000), "query_id")
        put = _blocked(asked.select("query_id", "scope", "embedding", low.alias("low")), "query_id", QUERIES, F.struct("query_id", "low", "embedding"))
        met = held.join(small(cut(put), 256).withColumnsRenamed({"block": "asked"}), "scope").select("block", "asked")
        counts = met.mapInArrow(_counts(width, of), f"query_id {kind}, at long, n long, least long, most long").groupBy("query_id", "at").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        line = Window.partitionBy("query_id")
        counts = counts.withColumn("upto", F.sum("n").over(line.orderBy("at")))
        if out is None:
            counts = counts.select("*", *[f(c).over(line).alias(x) for f, c, x in ((F.sum, "n", "all"), (F.min, "least", "lowest"), (F.max, "most", "highest"))])
        else:
            counts = counts.join(small(out.drop("at"), 100_000), "query_id")
        before = F.lit(0).cast("long") if out is None else F.col("below")
        first = counts.where(before + F.col("upto") > F.floor(F.col("all") / 2)).withColumn("r", F.row_number().over(line.orderBy("at"))).where("r = 1")
        out = cut(first.select("query_id", "at", "all", "lowest", "highest", (before + F.col("upto") - F.col("n")).alias("below")))
        asked, low = queries.select("query_id", "scope", "embedding"), F.col("at")
    score = lambda c: F.when(F.col(c) == NAN, F.lit(float("nan"))).when(F.col(c) != NONE, F.col(c) / 1e6)
    return out.select("query_id", score("highest").alias("most"), score("at").alias("middle"), score("lowest").alias("least"), F.col("all").alias("n"))


def _blocked(rows: DataFrame, key: str, size: int, what: Column) -> DataFrame:
    """scope, block: the rows of a scope in lists of `size` on average, dealt by their key, as equal vectors can be many."""
    parts = rows.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = rows.join(small(cut(parts)), "scope").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
    return dealt.groupBy("scope", "part").agg(F.collect_list(what).alias("block")).select("scope", "block")


def _matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: the rows of vectors that are whole, these as columns of doubles, and their norms, 1 for none."""
    out, size = {}, pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == d)
        flat = column.take(pa.array(rows)).flatten()
        nulls = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), d).any(axis=1)
        x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), d)[~nulls].T.copy()
        norm = np.sqrt(sum((c * c for c in x), np.zeros(x.shape[1])))
        out[int(d)] = rows[~nulls], x, np.where(norm == 0, 1.0, norm)
    return out


def _millionths(vectors: pa.ListArray, queries: pa.ListArray) -> np.ndarray:
    """The score of each query (row) with each vector (column); products are summed up in the order of dimensions, as SQL does it."""
    out = np.full((len(queries), len(vectors)), NONE, np.int64)
    v, q = _matrix(vectors), _matrix(queries)
    for d in v.keys() & q.keys():
        (at, x, nx), (of, y, ny) = v[d], q[d]
        for i in range(0, len(of), TILE):
            few = slice(i, i + TILE)
            dot, product = np.zeros((2, len(of[few]), len(at)))
            for j in range(d):
                np.multiply(y[j, few, None], x[j], out=product)
                dot += product
            dot /= ny[few, None] * nx
            score = np.rint(dot * 1e6)
            out[of[few, None], at] = np.where(np.isnan(score), NAN, score).astype(np.int64)
    return out


def _counts(width: int, of: int | None):
    """Of rows with a block of vectors and one of queries: how many of a query's scores each range of `width` from `at` has, and the
    least and most of all of them; in later rounds of those only that are in the range of `of` from `low`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, asked = batch.column("block")[i].values, batch.column("asked")[i].values
                scores, low = _millionths(block.field("embedding"), asked.field("embedding")), asked.field("low").to_numpy(zero_copy_only=False)
                odd = (scores == NONE) | (scores == NAN)
                base = np.full(len(scores), FLOOR) if of is None else low
                inside = ~odd if of is None else (scores >= low[:, None]) & (scores < low[:, None] + of)
                places = ((of or -2 * FLOOR) - 1) // width + 1
                k, r = np.nonzero(inside)
                if len(k):
                    flat = k * places + (scores[k, r] - base[k]) // width
                    full = np.bincount(flat, minlength=len(scores) * places).reshape(-1, places)
                    row, r = np.nonzero(full)
                    rows = [(row, base[row] + r * width, full[row, r])]
                else:
                    rows = []
                for x in (NONE, NAN) if of is None else ():
                    n = (scores == x).sum(axis=1)
                    rows.append((np.flatnonzero(n), np.full((n > 0).sum(), x), n[n > 0]))
                k, at, n = (np.concatenate([r[c] for r in rows] or [np.zeros(0, np.int64)]) for c in range(3))
                least, most = np.where(scores == NONE, NAN, scores).min(axis=1), scores.max(axis=1)
                known = (scores != NONE).any(axis=1)
                ends = [pa.array(x[k], mask=~known[k]) for x in (least, most)]
                yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(k)), pa.array(at), pa.array(n), *ends], ["query_id", "at", "n", "least", "most"])

    return run
