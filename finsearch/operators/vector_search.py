"""Nearest neighbours by cosine distance: exact, through cells, through bands, within a key."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from finsearch.functions.vectors import distances, matrix, nearest_places, unit_rows
from finsearch.operators.ranking import small_side, top_k
from finsearch.session import written

PACK_ROWS = 1024
BLOCK_ROWS = 4096


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _arrow(kind: T.DataType) -> pa.DataType:
    return to_arrow_type(kind)


def _numbers(ids: pa.Array | pa.ChunkedArray | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and, for each, a number in the same order, so that ties are broken alike for numbers and texts."""
    if isinstance(ids, np.ndarray):
        values = ids
    else:
        values = ids.to_numpy() if isinstance(ids, pa.ChunkedArray) else ids.to_numpy(zero_copy_only=False)
    if values.dtype != object:
        return values, values
    order = np.argsort(values, kind="stable")
    numbers = np.empty(len(values), dtype=np.int64)
    numbers[order] = np.cumsum(np.concatenate([[0], values[order][1:] != values[order][:-1]])) if len(values) else []
    return values, numbers


class Nearest:
    """The k nearest rows so far of each of some queries, equal distances in order of id."""

    def __init__(self, vectors: pa.Array | pa.ChunkedArray, k: int, cutoff: float | None):
        self.vectors, self.k = matrix(vectors), k
        self.cutoff = np.inf if cutoff is None else cutoff
        self.reach = np.full(len(vectors), np.inf)  # the k-th distance; what is farther cannot enter
        self.found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(vectors)

    def far(self, rows: pa.Array) -> np.ndarray:
        """The distance of every query and row."""
        return distances(self.vectors, matrix(rows))

    def meet(self, ids: pa.Array, rows: pa.Array, asked: np.ndarray | None = None) -> None:
        """Rows for all queries, or for those that ``asked`` (queries by rows) has."""
        if not len(ids) or not len(self.vectors):
            return
        names, numbers = _numbers(ids)
        dist = self.far(rows)
        near = (dist < self.cutoff) & (dist <= self.reach[:, None])
        if asked is not None:
            near &= asked
        for query in np.flatnonzero(near.any(axis=1)):
            places = np.flatnonzero(near[query])
            places = places[nearest_places(dist[query, places], numbers[places], self.k)]
            own, far = names[places], dist[query, places]
            if self.found[query] is not None:
                own, far = np.concatenate([self.found[query][0], own]), np.concatenate([self.found[query][1], far])
                best = nearest_places(far, _numbers(own)[1], self.k)
                own, far = own[best], far[best]
            self.found[query] = (own, far)
            if len(far) == self.k:
                self.reach[query] = far[-1]

    def rows(self, query_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch:
        held = [(q, *f) for q, f in enumerate(self.found) if f is not None and len(f[0])]
        places = np.concatenate([np.full(len(own), q) for q, own, _ in held]) if held else np.zeros(0, np.int64)
        ids = np.concatenate([own for _, own, _ in held]) if held else []
        far = np.concatenate([d for _, _, d in held]) if held else np.zeros(0)
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(places)), pa.array(ids, id_type), pa.array(far)], names=["query_id", "id", "distance"])


def _mask(lists: pa.Array, query_ids: pa.Array) -> np.ndarray:
    """Which queries, by their place, each row is asked by; queries elsewhere do not count."""
    asked = np.zeros((len(query_ids), len(lists)), bool)
    places = pc.index_in(lists.flatten(), value_set=query_ids)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    known = places.is_valid().to_numpy(zero_copy_only=False)
    asked[places.drop_null().to_numpy(zero_copy_only=False), rows[known]] = True
    return asked


def _nearest(rows: DataFrame, queries: DataFrame, k: int, cutoff: float | None, pack_rows: int, kind: type[Nearest] = Nearest, *given) -> DataFrame:
    """The k nearest of ``rows(id, embedding[, asked])`` per query, ``(query_id, id, distance, rn)``.

    ``kind`` tells how far rows are; ``embedding`` is whatever it reads.

    ``asked`` lists the queries that a row is for; without it, rows are for all. Up to ``pack_rows``
    queries go to the tasks, and the rows stay where they are. More of them meet the rows in a grid of packs
    of queries and slabs of rows: a task per cell holds one pack and lets one slab stream by, so the work is
    even, whatever the numbers on either side, and a slab is copied once per pack. Each task sends k rows per query.
    """
    spark = rows.sparkSession
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    listed = "asked" in rows.columns
    id_type, query_type = _arrow(rows.schema["id"].dataType), _arrow(queries.schema["query_id"].dataType)
    schema = f"query_id {_type(queries, 'query_id')}, id {_type(rows, 'id')}, distance double"
    n_queries = asked.count()
    if n_queries <= pack_rows:
        few = asked.toArrow().combine_chunks()  # pack_rows of them at most
        query_ids, vectors = (pa.concat_arrays(few.column(c).chunks or [pa.array([], few.schema.field(c).type)]) for c in (0, 1))

        def scan(batches):
            near = kind(vectors, k, cutoff, *given)
            for batch in batches:
                near.meet(batch.column(0), batch.column(1), _mask(batch.column(2), query_ids) if listed else None)
            yield near.rows(query_ids, id_type)

        columns = ["id", "embedding", *(["asked"] if listed else [])]
        return top_k(rows.select(*columns).mapInArrow(scan, schema), ["query_id"], [F.asc("distance"), F.asc("id")], k)

    packs = -(-n_queries // pack_rows)
    slabs = max(2, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // packs))
    payload = _type(rows, "embedding")
    pack_of = lambda query: F.pmod(F.xxhash64(query), F.lit(packs)).cast("int")
    lists = F.col("asked") if listed else F.lit(None).cast(f"array<{_type(queries, 'query_id')}>")
    # a query goes to all slabs of its pack, a row to the packs that it is for
    left = asked.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))).select(
        (F.col("slab") * packs + pack_of(F.col("query_id"))).alias("cell"), F.lit(0).alias("side"), "query_id",
        F.lit(None).cast(_type(rows, "id")).alias("id"), "vector", F.lit(None).cast(payload).alias("row"), F.lit(None).cast(f"array<{_type(queries, 'query_id')}>").alias("asked"),
    )
    own_packs = F.array_distinct(F.transform("asked", pack_of)) if listed else F.sequence(F.lit(0), F.lit(packs - 1))
    right = rows.withColumn("pack", F.explode(own_packs)).select(
        (F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int") * packs + F.col("pack")).alias("cell"), F.lit(1).alias("side"),
        F.lit(None).cast(_type(queries, "query_id")).alias("query_id"), "id", F.lit(None).cast(_type(queries, "vector")).alias("vector"),
        F.col("embedding").alias("row"), lists.alias("asked"),
    )
    cells = left.unionByName(right).repartitionById(packs * slabs, F.col("cell")).sortWithinPartitions("side")

    def meet(batches):
        ids, vectors, near = [], [], None
        for batch in batches:
            first = int(np.searchsorted(batch.column(1).to_numpy(), 1))
            if first:
                ids.append(batch.column(2).slice(0, first))
                vectors.append(batch.column(4).slice(0, first))
            if first < batch.num_rows and ids:
                near = near or kind(pa.concat_arrays(vectors), k, cutoff, *given)
                query_ids, part = pa.concat_arrays(ids), batch.slice(first)
                for at in range(0, part.num_rows, BLOCK_ROWS):
                    block = part.slice(at, BLOCK_ROWS)
                    near.meet(block.column(3), block.column(5), _mask(block.column(6), query_ids) if listed else None)
        if near is not None:
            yield near.rows(pa.concat_arrays(ids).cast(query_type), id_type)

    return top_k(cells.mapInArrow(meet, schema), ["query_id"], [F.asc("distance"), F.asc("id")], k)


def vector_search(
    corpus: DataFrame, queries: DataFrame, k: int = 50, cutoff: float | None = 0.5, pack_rows: int = PACK_ROWS
) -> DataFrame:
    """Exact k nearest rows of ``corpus(id, embedding)`` per query as ``(query_id, id, distance, rn)``.

    ``queries(query_id, vector)`` may be few or many: see ``_nearest``. Rows and queries without a vector have no neighbours.
    """
    return _nearest(corpus.where(F.col("embedding").isNotNull()).select("id", "embedding"), queries, k, cutoff, pack_rows)


@dataclass(frozen=True)
class CellIndex:
    """Vectors stored in one folder per cell, and the cell centres."""

    path: str
    centres: np.ndarray


def build_ivf(corpus: DataFrame, nlist: int, path: str, seed: int = 7) -> CellIndex:
    """Cluster ``corpus(id, embedding)`` into cells, learned from all rows, and store it by cell.

    Rows are ranged over cell and id, so a crowded cell fills several files.
    """
    vectors = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    points = vectors.select("id", "embedding", array_to_vector("embedding").alias("features"))
    model = KMeans(k=nlist, distanceMeasure="cosine", seed=seed, predictionCol="cell").fit(points.select("features"))
    (
        model.transform(points)
        .select("id", "embedding", "cell")
        .repartitionByRange("cell", "id")
        .write.partitionBy("cell")
        .parquet(path)
    )
    return CellIndex(path, unit_rows(np.array(model.clusterCenters(), dtype=np.float64)))


def ivf_search(
    spark: SparkSession, index: CellIndex, queries: DataFrame, nprobe: int, k: int = 50, cutoff: float | None = 0.5
) -> DataFrame:
    """Nearest rows within the ``nprobe`` cells closest to each query; exact with all cells.

    Queries are sent to their cells in the tasks, and each cell is a key of ``knn_within``, so crowded
    cells are split and query tables may have any size. Only the numbers of the probed cells come to
    the driver, as the filter on the stored folders.
    """
    schema = pa.schema([("id", _arrow(queries.schema["query_id"].dataType)), ("embedding", _arrow(queries.schema["vector"].dataType)), ("cell", pa.int32())])

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            far = distances(matrix(batch.column("vector")), index.centres)
            order = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), order.shape[1]))
            columns = [batch.column("query_id").take(rows), batch.column("vector").take(rows), pa.array(order.reshape(-1))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    sent = asked.mapInArrow(probe, f"id {_type(queries, 'query_id')}, embedding {_type(queries, 'vector')}, cell int")
    sent = written(sent, "probes")
    cells = [row["cell"] for row in sent.select("cell").distinct().collect()]  # nlist of them at most
    stored = spark.read.parquet(index.path).where(F.col("cell").isNotNull() & F.col("cell").isin(cells))
    near = knn_within(sent, stored.select("id", "embedding", F.col("cell").cast("int").alias("cell")), "cell", k, same_table=False)
    near = near.withColumnRenamed("scored_id", "query_id")
    return near if cutoff is None else near.where(F.col("distance") < cutoff)


@dataclass(frozen=True)
class CodeIndex:
    """Vectors as product-quantised codes by cell, the vectors themselves beside them, and what the codes mean.

    A code has a byte per part: the number of the part's nearest centre to the vector's difference from its cell's centre.
    """

    path: str
    centres: np.ndarray  # (cells, dim)
    books: np.ndarray  # (parts, centres of a part, dim of a part)

    @property
    def row_bytes(self) -> tuple[int, int]:
        """What a row costs to look at: its code, and its vector in single precision."""
        return len(self.books), 4 * self.centres.shape[1]


def _lloyd(rows: DataFrame, start: np.ndarray, read, turns: int) -> np.ndarray:
    """Centres ``(parts, n, width)`` of what ``read`` makes of batches, ``(rows, parts, width)``, learned from all rows.

    Sums and counts per centre come to the driver, whatever the number of rows.
    """
    centres = start
    parts, number, width = start.shape
    for _ in range(turns):

        def add(batches, centres=centres):
            sums = np.zeros((parts, number, width + 1))
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    values = read(batch.slice(at, BLOCK_ROWS))
                    for part in range(parts):
                        best = _closest(values[:, part], centres[part])
                        np.add.at(sums[part], best, np.concatenate([values[:, part], np.ones((len(values), 1))], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["cell", "value"])

        found = rows.mapInArrow(add, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        sums = np.zeros(parts * number * (width + 1))
        sums[found.column("cell").to_numpy()] = found.column("value").to_numpy()
        sums = sums.reshape(parts, number, width + 1)
        centres = np.where(sums[:, :, -1:] > 0, sums[:, :, :-1] / np.maximum(sums[:, :, -1:], 1), centres)
    return centres


def _closest(values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * values @ centres.T, axis=1)


def build_codes(corpus: DataFrame, nlist: int, path: str, parts: int = 16, centres: int = 64, turns: int = 6, seed: int = 7) -> CodeIndex:
    """Cells and codes of ``corpus(id, embedding)``, learned from all rows; ``parts`` divides the dimension, a part has 256 centres at most.

    Codes are stored by cell, ranged over cell and id; vectors once, for the rows that a search looks at exactly.
    """
    spark = corpus.sparkSession
    corpus.where(F.col("embedding").isNotNull()).select("id", "embedding").write.parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    first = vectors.orderBy(F.xxhash64("id", F.lit(seed))).limit(max(nlist, centres)).select("embedding").toArrow()
    if not first.num_rows:
        raise ValueError("no vectors to learn cells and codes from")
    start = np.nan_to_num(matrix(first.column(0)))
    cells = _lloyd(vectors.select("embedding"), start[None, :nlist], lambda b: np.nan_to_num(matrix(b.column("embedding")))[:, None], turns)[0]

    def differences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        units = np.nan_to_num(matrix(batch.column("embedding")))
        cell = _closest(units, cells)
        return cell, (units - cells[cell]).reshape(len(units), parts, -1)

    begun = (start[:centres] - cells[_closest(start[:centres], cells)]).reshape(-1, parts, start.shape[1] // parts).swapaxes(0, 1)
    books = _lloyd(vectors.select("embedding"), begun, lambda b: differences(b)[1], turns)

    def encode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                cell, values = differences(part)
                codes = np.stack([_closest(values[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])

    coded = vectors.mapInArrow(encode, f"id {_type(vectors, 'id')}, cell int, code binary")
    coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/codes")
    return CodeIndex(path, cells, books)


class NearestCodes(Nearest):
    """Rows as ``struct<cell, code>``: distances are sums of looked-up parts, for the queries that probe the cell."""

    def __init__(self, vectors: pa.Array, k: int, cutoff: float | None, centres: np.ndarray, books: np.ndarray, nprobe: int):
        super().__init__(vectors, k, None)
        self.centres, self.books = centres, books
        units = np.nan_to_num(self.vectors)
        order = np.argsort(distances(units, unit_rows(centres)) if len(units) else np.zeros((0, len(centres))), axis=1, kind="stable")[:, :nprobe]
        self.probed = np.zeros((len(units), len(centres)), bool)
        self.probed[np.arange(len(units))[:, None], order] = True

    def far(self, rows: pa.Array) -> np.ndarray:
        cells, codes = rows.field("cell").to_numpy(), rows.field("code").to_pylist()
        codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        out = np.full((len(self.vectors), len(cells)), np.inf)
        parts, _, width = self.books.shape
        for cell in np.unique(cells):
            asking, places = np.flatnonzero(self.probed[:, cell]), np.flatnonzero(cells == cell)
            apart = (self.vectors[asking] - self.centres[cell]).reshape(len(asking), parts, width)
            sums = np.zeros((len(asking), len(places)))
            for p in range(parts):
                table = ((apart[:, p, None] - self.books[p][None]) ** 2).sum(axis=2)
                sums += table[:, codes[places, p]]
            out[np.ix_(asking, places)] = sums / 2  # unit vectors: half the squared distance is the cosine distance
        return out


def codes_search(
    spark: SparkSession, index: CodeIndex, queries: DataFrame, nprobe: int, k: int = 50, cutoff: float | None = 0.5, short_list: int = 8, pack_rows: int = PACK_ROWS
) -> DataFrame:
    """The k nearest rows per query among the ``short_list * k`` best by code in the ``nprobe`` closest cells, with exact distances."""
    coded = spark.read.parquet(f"{index.path}/codes").select("id", F.struct(F.col("cell").cast("int").alias("cell"), "code").alias("embedding"))
    best = _nearest(coded, queries, k * short_list, None, pack_rows, NearestCodes, index.centres, index.books, nprobe)
    met = best.groupBy("id").agg(F.collect_list("query_id").alias("asked"))
    rows = spark.read.parquet(f"{index.path}/vectors").join(met, "id").select("id", "embedding", "asked")
    return _nearest(rows, queries, k, cutoff, pack_rows)


@dataclass(frozen=True)
class BandIndex:
    """Ids stored by ``(band, signature)`` and the vectors beside them, and what the signatures are made of."""

    path: str
    dim: int
    bands: int
    bits: int
    seed: int
    probes: int

    def planes(self) -> np.ndarray:
        """The hyperplanes, a row each; they follow from the seed."""
        return np.random.default_rng(self.seed).standard_normal((self.bands * self.bits, self.dim))


BAND_ROWS = 64  # rows that share a signature, on average
BANDS = 4  # a vector takes as many ids beside itself, whatever the number of rows
RECALL, REACH = 0.9, 0.5  # the share of the neighbours at this cosine distance that the probes find


def _subsets(costs: np.ndarray) -> np.ndarray:
    """The sum of every subset of some costs, the subset's bits as its place."""
    sums = np.zeros(1)
    for cost in costs:
        sums = np.concatenate([sums, sums + cost])
    return sums


def probes_for(bits: int, bands: int = BANDS, recall: float = RECALL, distance: float = REACH, samples: int = 500) -> int:
    """The buckets of each band that find ``recall`` of the neighbours at ``distance`` in some band.

    Query and neighbour fall on either side of a plane as two normal variables with the cosine as
    correlation do. The neighbour's bucket differs by some bits; its turn is the number of cheaper sets of bits.
    """
    rng = np.random.default_rng(3)
    cosine = 1 - distance
    turns = np.empty((samples, bands))
    for i in range(samples):
        for band in range(bands):
            own = rng.standard_normal(bits)
            other = cosine * own + np.sqrt(1 - cosine**2) * rng.standard_normal(bits)
            costs = own**2
            limit = costs[(own >= 0) != (other >= 0)].sum()
            half = np.sort(_subsets(costs[: bits // 2]))
            turns[i, band] = np.searchsorted(half, limit - _subsets(costs[bits // 2 :]) - 1e-12).sum()
    return int(np.quantile(turns.min(axis=1), recall, method="higher")) + 1


def probe_order(costs: np.ndarray, number: int) -> list[int]:
    """The ``number`` cheapest sets of bits, as masks, cheapest first: each set grows by, or shifts to, its next dearer bit."""
    order = np.argsort(costs, kind="stable")
    ranked = costs[order].tolist()
    masks, heap = [0], [(ranked[0], 1 << int(order[0]), 0)] if len(ranked) else []
    while heap and len(masks) < number:
        cost, mask, last = heapq.heappop(heap)
        masks.append(mask)
        if last + 1 < len(ranked):
            bit, before = 1 << int(order[last + 1]), 1 << int(order[last])
            heapq.heappush(heap, (cost + ranked[last + 1], mask | bit, last + 1))
            heapq.heappush(heap, (cost + ranked[last + 1] - ranked[last], mask ^ before | bit, last + 1))
    return masks


def _signatures(vectors: DataFrame, index: BandIndex, probes: int) -> DataFrame:
    """``vectors(id, embedding)`` as ``(id, band, signature)``: a row per band and probe, the own bucket first."""
    weights = 1 << np.arange(index.bits, dtype=np.int64)
    bands, bits, planes = index.bands, index.bits, index.planes()
    id_type = _arrow(vectors.schema["id"].dataType)

    def sign(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                sides = (np.nan_to_num(matrix(part.column("embedding"))) @ planes.T).reshape(part.num_rows, bands, bits)
                own = (sides >= 0) @ weights
                if probes == 1:
                    found = own[:, :, None]
                else:
                    masks = [[probe_order(costs, probes) for costs in row] for row in sides**2]
                    found = own[:, :, None] ^ np.array(masks, dtype=np.int64)
                rows, names, _ = np.indices(found.shape)
                ids = part.column("id").take(pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([ids.cast(id_type), pa.array(names.ravel().astype(np.int32)), pa.array(found.ravel())], names=["id", "band", "signature"])

    return vectors.select("id", "embedding").mapInArrow(sign, f"id {_type(vectors, 'id')}, band int, signature long")


def build_lsh(
    corpus: DataFrame, path: str, dim: int, bands: int = BANDS, bits: int | None = None, seed: int = 7, probes: int | None = None, reach: float = REACH
) -> BandIndex:
    """Random-hyperplane signatures (Charikar 2002) of ``corpus(id, embedding)``: ids by band and signature, and the vectors once.

    The number of bits follows from the number of rows unless it is given, so that a signature keeps about
    as many rows as ``BAND_ROWS`` at any size. The number of probes follows from the bits unless it is
    given, so that longer signatures lose no neighbours, while storage stays what it is: a vector and an id per band.
    ``reach`` is the distance up to which neighbours count; beyond it more of them are lost.
    """
    vectors = corpus.where(F.col("embedding").isNotNull()).select("id", "embedding")
    if bits is None:
        bits = max(1, round(np.log2(max(vectors.count(), 1) / BAND_ROWS)))
    index = BandIndex(path, dim, bands, bits, seed, min(1 << bits, probes_for(bits, bands, distance=reach) if probes is None else probes))
    vectors.write.parquet(f"{path}/vectors")
    ids = _signatures(vectors.sparkSession.read.parquet(f"{path}/vectors"), index, 1)
    ids.repartitionByRange("band", "signature", "id").sortWithinPartitions("band", "signature", "id").write.partitionBy("band").parquet(f"{path}/buckets")
    return index


def lsh_search(spark: SparkSession, index: BandIndex, queries: DataFrame, k: int = 50, cutoff: float | None = 0.5, pack_rows: int = PACK_ROWS) -> DataFrame:
    """The k nearest rows among those whose bucket a query probes in some band, scored exactly.

    A query probes its own bucket of every band and the next ones by the squared distances to the planes
    between (Lv et al. 2007). Buckets give ids; each candidate's vector is fetched once, for all queries that met it.
    """
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").alias("id"), F.col("vector").alias("embedding"))
    probes = _signatures(asked, index, index.probes).withColumnRenamed("id", "query_id")
    buckets = spark.read.parquet(f"{index.path}/buckets").select("id", F.col("band").cast("int").alias("band"), "signature")
    met = buckets.join(probes, ["band", "signature"]).groupBy("id").agg(F.collect_set("query_id").alias("asked"))
    rows = spark.read.parquet(f"{index.path}/vectors").join(met, "id").select("id", "embedding", "asked")
    return _nearest(rows, queries, k, cutoff, pack_rows)


def knn_within(
    scored: DataFrame,
    history: DataFrame,
    partition: str,
    k: int = 10,
    as_of: str | None = None,
    block_rows: int = BLOCK_ROWS,
    same_table: bool = True,
) -> DataFrame:
    """For each row of ``scored``, the k nearest *other* rows of ``history`` with the same key.

    With ``same_table=False`` the ids of the two sides are unrelated and equal ids may be neighbours.

    Both sides hold ``id``, ``embedding``, the key and, with ``as_of``, an order column that
    limits neighbours to earlier rows. Keys with more than ``block_rows`` rows on a side are cut
    into blocks, counted beforehand, and every pair of blocks is one bounded task-side matrix
    product that returns k rows per scored row. No pair of rows is ever written out. With ``as_of``
    blocks are ranges of time and rows of other keys are not copied, see ``_nearest_earlier``.

    The block counts are written once, so their exact number decides whether they are broadcast; then
    the history is shuffled once, straight to its blocks and reduced to the keys that are scored.
    """
    if as_of:
        return _nearest_earlier(scored, history, partition, k, as_of, block_rows, same_table)
    cols = ["id", partition, "embedding"]
    sides = {}
    for name, df in (("s", scored), ("h", history)):
        side = df.where(F.col("embedding").isNotNull() & F.col(partition).isNotNull()).select(*cols)
        sizes = side.groupBy(partition).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias(f"n_{name}"))
        sides[name] = (side, sizes)
    sizes = written(sides["s"][1].join(sides["h"][1], partition), "block-counts")
    sizes = small_side(sizes, sizes.count())

    def blocks(name: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.col(f"n_{name}")).cast("int").alias(f"block_{name}")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"block_{other}")
        # fresh aliases, since both sides may come from the same table
        return sides[name][0].join(sizes, partition).select(*[F.col(c).alias(c) for c in cols], own, copies)

    schema = pa.schema([("scored_id", _arrow(scored.schema["id"].dataType)), ("id", _arrow(history.schema["id"].dataType)), ("distance", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ours, (theirs, numbers) = _numbers(left["id"])[0], _numbers(right["id"])
        dist = distances(matrix(left["embedding"]), matrix(right["embedding"]))
        if same_table:
            dist[ours[:, None] == theirs[None, :]] = np.inf
        best = [nearest_places(line, numbers, k) for line in dist]
        rows = np.repeat(np.arange(len(ours)), [len(b) for b in best])
        places = np.concatenate(best)
        columns = [left["id"].take(pa.array(rows)), right["id"].take(pa.array(places)), pa.array(dist[rows, places])]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    keys = [partition, "block_s", "block_h"]
    pairs = blocks("s", "h").groupBy(*keys).cogroup(blocks("h", "s").groupBy(*keys)).applyInArrow(
        compare, f"scored_id {_type(scored, 'id')}, id {_type(history, 'id')}, distance double"
    )
    return top_k(pairs, ["scored_id"], [F.asc("distance"), F.asc("id")], k)


def _time_blocks(rows: DataFrame, partition: str, as_of: str, block_rows: int) -> DataFrame:
    """``(key, no, first, last, ids, times, embeddings)``: rows of one key that follow each other in time, ``block_rows`` of them at most.

    Rows are ranged over key and time, so a busy key lies in several tasks, and packed where they lie. The
    table is written: the numbers of its blocks stay as they are.
    """
    held = rows.where(F.col("embedding").isNotNull() & F.col(partition).isNotNull() & F.col(as_of).isNotNull())
    held = held.select(F.col(partition).alias("key"), F.col(as_of).alias("time"), "id", "embedding")
    ranged = held.repartitionByRange("key", "time", "id").sortWithinPartitions("key", "time", "id")

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            same = pc.equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], 1 + np.flatnonzero(~same)])
            sizes = np.diff(starts, append=batch.num_rows)
            number = -(-sizes // block_rows)
            at = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            cuts = np.repeat(starts, number) + at * block_rows
            ends = pa.array(np.append(cuts, batch.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in (2, 1, 3)]
            firsts, lasts = (batch.column(1).take(pa.array(i)) for i in (cuts, np.append(cuts[1:], batch.num_rows) - 1))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cuts)), firsts, lasts, *lists], names=["key", "first", "last", "ids", "times", "embeddings"])

    key, time = _type(held, "key"), _type(held, "time")
    schema = f"key {key}, first {time}, last {time}, ids array<{_type(held, 'id')}>, times array<{time}>, embeddings array<{_type(held, 'embedding')}>"
    return written(ranged.mapInArrow(pack, schema).withColumn("no", F.monotonically_increasing_id()), "time-blocks")


def block_pairs(scored: DataFrame, history: DataFrame) -> DataFrame:
    """``(scored_no, history_no)`` of the time blocks that can hold neighbours: those of a key whose history begins before the scored rows end."""
    ours = scored.select("key", "last", F.col("no").alias("scored_no"))
    theirs = history.select(F.col("key").alias("_key"), "first", F.col("no").alias("history_no"))
    return ours.join(theirs, (F.col("key") == F.col("_key")) & (F.col("first") < F.col("last"))).select("scored_no", "history_no")


def _nearest_earlier(scored: DataFrame, history: DataFrame, partition: str, k: int, as_of: str, block_rows: int, same_table: bool) -> DataFrame:
    """The k nearest earlier rows of the same key.

    Keys with up to ``block_rows`` rows on either side go to buckets, some thousand rows of whole keys each: their rows are
    shuffled once and not written. Of the busier keys both sides are blocks of time, see ``_nearest_of_blocks``. Rows are
    counted per key beforehand. Rows without a time are before none and after none.
    """
    held = lambda df: df.where(F.col("embedding").isNotNull() & F.col(partition).isNotNull() & F.col(as_of).isNotNull())
    sides = [held(df).select("id", partition, as_of, "embedding") for df in (scored, history)]
    counts = [side.groupBy(F.col(partition).alias("key")).agg(F.count("*").alias("n")).withColumn("side", F.lit(i)) for i, side in enumerate(sides)]
    sizes = written(counts[0].unionByName(counts[1]), "key-sizes")
    busy = sizes.where(F.col("n") > block_rows).select(F.col("key").alias(partition)).distinct()
    n_busy = busy.count()
    total = sizes.where(F.col("n") <= block_rows).groupBy("side").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * parts, -(-total // block_rows))
    few = [side.join(small_side(busy, n_busy), partition, "left_anti") if n_busy else side for side in sides]
    # fresh aliases, since both sides may come from the same table
    left, right = (side.select(F.pmod(F.xxhash64(partition), F.lit(buckets)).alias("bucket"), *[F.col(c).alias(n) for c, n in ((partition, "key"), (as_of, "time"), ("id", "id"), ("embedding", "embedding"))]) for side in few)
    schema = pa.schema([("scored_id", _arrow(scored.schema["id"].dataType)), ("id", _arrow(history.schema["id"].dataType)), ("distance", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        codes = pa.concat_arrays([*left["key"].chunks, *right["key"].chunks]).dictionary_encode().indices.to_numpy()
        ours, theirs = codes[: left.num_rows], codes[left.num_rows :]
        (own_ids, _), (ids, numbers) = _numbers(left["id"]), _numbers(right["id"])
        own_times, times, own_vectors, vectors = left["time"].to_numpy(), right["time"].to_numpy(), matrix(left["embedding"]), matrix(right["embedding"])
        order, other = np.argsort(ours, kind="stable"), np.argsort(theirs, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(ours[order], prepend=-1)), len(order))
        rows, places, far = [], [], []
        for a, b in zip(cuts, cuts[1:]):
            mine, some = order[a:b], other[slice(*np.searchsorted(theirs[other], ours[order[a]] + np.arange(2)))]
            if not len(some):
                continue
            dist = distances(own_vectors[mine], vectors[some])
            dist[~(times[some][None, :] < own_times[mine][:, None])] = np.inf
            if same_table:
                dist[own_ids[mine][:, None] == ids[some][None, :]] = np.inf
            for row, line in zip(mine, dist):
                best = nearest_places(line, numbers[some], k)
                rows.append(np.full(len(best), row))
                places.append(some[best])
                far.append(line[best])
        rows, places = (np.concatenate(c or [np.zeros(0, np.int64)]) for c in (rows, places))
        columns = [left["id"].take(pa.array(rows)), right["id"].take(pa.array(places)), pa.array(np.concatenate(far or [np.zeros(0)]))]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(compare, f"scored_id {_type(scored, 'id')}, id {_type(history, 'id')}, distance double")
    if n_busy:
        ours = scored.join(small_side(busy, n_busy), partition, "left_semi")
        theirs = ours if scored is history else history.join(small_side(busy, n_busy), partition, "left_semi")
        found = found.unionByName(_nearest_of_blocks(ours, theirs, partition, k, as_of, block_rows, same_table))
    return top_k(found, ["scored_id"], [F.asc("distance"), F.asc("id")], k)


def _nearest_of_blocks(scored: DataFrame, history: DataFrame, partition: str, k: int, as_of: str, block_rows: int, same_table: bool) -> DataFrame:
    """The k nearest earlier rows of the same key and block, ``(scored_id, id, distance)``.

    Both sides are blocks of time, and blocks that lie wholly later are never sent: of a busy key's pairs about
    half are left. A block is packed into one row before it is copied to its pairs, which are dealt by
    block, not by key. Rows without a time are before none and after none.
    """
    theirs = _time_blocks(history, partition, as_of, block_rows)
    ours = theirs if scored is history else _time_blocks(scored, partition, as_of, block_rows)
    pairs = written(block_pairs(ours, theirs), "block-pairs")
    met = pairs.join(theirs.select(F.col("no").alias("history_no"), "ids", "times", "embeddings"), "history_no")
    left = ours.select(F.col("no").alias("scored_no"), F.col("ids").alias("scored_ids"), F.col("times").alias("scored_times"), F.col("embeddings").alias("scored_embeddings"))
    met = met.join(left, "scored_no").select("scored_ids", "scored_times", "scored_embeddings", "ids", "times", "embeddings")
    schema = pa.schema([("scored_id", _arrow(scored.schema["id"].dataType)), ("id", _arrow(history.schema["id"].dataType)), ("distance", pa.float64())])

    def compare(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                own, own_times, own_vectors, names, times, vectors = (batch.column(c)[at].values for c in range(6))
                (own_ids, _), (ids, numbers) = _numbers(own), _numbers(names)
                dist = distances(matrix(own_vectors), matrix(vectors))
                dist[~(times.to_numpy(zero_copy_only=False)[None, :] < own_times.to_numpy(zero_copy_only=False)[:, None])] = np.inf
                if same_table:
                    dist[own_ids[:, None] == ids[None, :]] = np.inf
                best = [nearest_places(line, numbers, k) for line in dist]
                rows, places = np.repeat(np.arange(len(own_ids)), [len(b) for b in best]), np.concatenate(best)
                columns = [own.take(pa.array(rows)), names.take(pa.array(places)), pa.array(dist[rows, places])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return met.mapInArrow(compare, f"scored_id {_type(scored, 'id')}, id {_type(history, 'id')}, distance double")
