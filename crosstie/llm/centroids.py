"""Lloyd's clustering with the dimensions dealt over shards.

The vectors are cut twice: into groups of rows (``chunk``) and into blocks of columns
(``block``). One tile is a chunk's part of a block; the tiles are stored bucketed by both, so
they never move again. A block's task holds its slice of the centroids only. It computes the
exact squared distances of its tiles to that slice; the partial distances of a chunk are
brought together and added, and the least one names the cluster. The assignments go back to
the tiles, and every block adds up and divides its own slice. Per round and vector only the
partial distances (``clusters`` numbers a block) and one assignment a block are shuffled.

Vectors are integers (``floor(scale * x)``), so distances, sums and means are exact.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crosstie.llm.common import grouped, sorted_groups
from crosstie.session import shared_dir, stored

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64.0
# Columns of a block and rows of a chunk.
BLOCK = 16
CHUNK = 1024
# Bound of an integer component: 64 squared differences of such numbers fit in 63 bits.
MOST = 1 << 27
# Values of all centroids up to which their slices are broadcast; above it they are shuffled to the tiles.
MOST_BROADCAST = 1 << 22


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """``vec_id`` and ``ints`` of the vectors with exactly ``dimensions`` finite components."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size(e) == dimensions) & finite)
    return kept.select(F.col(vec_id).alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("ints"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> DataFrame:
    """``cluster``, ``dim``, ``value``: the vectors with the least SHA-256 of ``<seed>:<vec_id>``.

    Equal ids are told apart by their vectors; vectors without id come last.
    """
    named = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "ints")
    few = named.orderBy(F.col("h").asc_nulls_last(), "ints").limit(clusters)
    key = F.struct(F.col("h").isNull().alias("missing"), "h", "ints")
    listed = few.agg(F.array_sort(F.collect_list(key)).alias("l")).select(F.posexplode("l").alias("cluster", "c"))
    return listed.select("cluster", F.posexplode("c.ints").alias("dim", "value"))


def tiles(rows: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``chunk``, ``block``, ``ids`` (block 0 only) and ``tile`` (32-bit integers, row by row), bucketed on chunk and block.

    ``rows`` must be a stored table, as a rerun task has to find the same rows in a chunk. The
    tiles are shuffled here, so that a bucket is one file, and never again.
    """
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    names = ["chunk", "block", "ids", "tile"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                values = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                if values.max() > MOST or values.min() < -MOST:
                    raise ValueError(f"a component has more than {MOST} steps; squared distances would not fit in 64 bits")
                own = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                blocks = range(0, values.shape[1], block)
                ids = pa.concat_arrays([own, pa.nulls(len(blocks) - 1, own.type)])
                data = [np.ascontiguousarray(values[:, b:b + block], "<i4").tobytes() for b in blocks]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()),
                                                  ids, pa.array(data, pa.binary())], names)
                number += 1

    made = rows.select("vec_id", "ints").mapInArrow(work, f"chunk bigint, block int, ids array<{kind}>, tile binary")
    name = f"tiles_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (made.repartition(buckets, "chunk", "block").write.bucketBy(buckets, "chunk", "block").sortBy("chunk", "block").format("parquet")
     .option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    return spark.table(name)


def slices(centroids: DataFrame, block: int = BLOCK) -> DataFrame:
    """``block``, its ``slice`` (the values of all centroids in its columns, centroid by centroid) and their number ``k``."""
    one = F.struct("cluster", "dim", "value")
    return (centroids.groupBy(F.floor(F.col("dim") / block).cast("int").alias("block"))
            .agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: c["value"]).alias("slice"),
                 F.count_distinct("cluster").cast("int").alias("k")))


def _partials(tile: bytes, centres: np.ndarray) -> np.ndarray:
    """Squared distances of a tile's rows to the centroids' slices, one column a centroid."""
    rows = np.frombuffer(tile, "<i4").reshape(-1, centres.shape[1]).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)


def _packed(numbers: np.ndarray) -> bytes:
    """The numbers (none negative) with a leading byte for their width, as narrow as they allow."""
    top = int(numbers.max(initial=0))
    width = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def assigned(table: DataFrame, centroids: DataFrame, small: bool, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Per chunk the number of the nearest centroid of every row, and the distances (``clusters``, ``distances``: packed).

    Block tasks send partial distances; a chunk's are added and the first least one counts.
    ``small`` says that the centroids are few enough to broadcast their slices.
    """
    ids_type = to_arrow_type(table.schema["ids"].dataType)
    ids = f", ids {table.schema['ids'].dataType.simpleString()}" if with_ids else ""
    keep = ["chunk", *(["ids"] if with_ids else [])]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent, ks = [], batch.column(2).to_pylist()
            for tile, values, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ks, strict=True):
                sent.append(_packed(_partials(tile, np.array(values, np.int64).reshape(k, -1)).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(ks, pa.int32()), pa.array(sent, pa.binary()), *batch.columns[4:]],
                                             ["chunk", "k", "partial", *keep[1:]])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (chunk,), rows in sorted_groups(batches, ["chunk"]):
            total = sum(_unpacked(r["partial"]) for r in rows).reshape(-1, rows[0]["k"])
            nearest = total.argmin(axis=1)
            columns = [pa.array([chunk], pa.int64()), pa.array([_packed(nearest)], pa.binary()),
                       pa.array([_packed(total[np.arange(len(total)), nearest])], pa.binary())]
            if with_ids:
                columns.append(pa.array([r["ids"] for r in rows if r["ids"] is not None], ids_type))
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "clusters", "distances", *keep[1:]])

    cut = slices(centroids, block)
    ready = table.join(F.broadcast(cut) if small else cut, "block")
    parts = ready.select("tile", "slice", "k", *keep).mapInArrow(partial, f"chunk bigint, k int, partial binary{ids}")
    return grouped(parts, ["chunk"]).mapInArrow(reduced, f"chunk bigint, clusters binary, distances binary{ids}")


def moved(table: DataFrame, centroids: DataFrame, nearest: DataFrame, blocks: int, block: int = BLOCK) -> DataFrame:
    """The centroids after every block has divided the sums of its columns by the counts; empty ones stay.

    The assignments are sent once per block to the bucketed tiles. A task adds up whatever
    tiles it has, so it returns at most ``clusters`` times ``dimensions`` rows.
    """
    sent = nearest.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "clusters")
    joined = table.select("chunk", "block", "tile").join(sent, ["chunk", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts: Counter = Counter()
        for batch in batches:
            for b, tile, clusters in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _unpacked(clusters)
                rows = np.frombuffer(tile, "<i4").reshape(len(own), -1).astype(np.int64)
                order = np.argsort(own, kind="stable")
                found, first, n = np.unique(own[order], return_index=True, return_counts=True)
                for c, total, k in zip(found.tolist(), np.add.reduceat(rows[order], first), n.tolist(), strict=True):
                    sums[b, c] = sums.get((b, c), 0) + total
                    counts[b, c] += k
        for (b, c), total in sums.items():
            dims = np.arange(len(total), dtype=np.int32) + np.int32(b * block)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), c, np.int32)), pa.array(dims), pa.array(total),
                                              pa.array(np.full(len(total), counts[b, c], np.int64))], ["cluster", "dim", "s", "n"])

    added = (joined.select("block", "tile", "clusters").mapInArrow(add, "cluster int, dim int, s bigint, n bigint")
             .groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    floor = F.expr("(s - pmod(s, n)) div n")
    return centroids.join(added, ["cluster", "dim"], "left").select("cluster", "dim", F.coalesce(floor, "value").alias("value"))


def clusters(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS,
             n_clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: float = SCALE, seed: int = 1,
             block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``vec_id``, ``cluster``, ``distance`` per kept vector, and the final ``cluster``, ``dim``, ``value``.

    Vectors that are missing, of another length, or with a missing, NaN or infinite component
    are left out. Equal rows, also with equal or missing ids, count each. Ties go to the lower
    centroid. With fewer vectors than clusters there are as many centroids as vectors; an
    empty table gives empty results. Other columns are ignored. Components of more than
    ``MOST`` steps raise an error, as distances would not fit in 64 bits.
    """
    rows = stored(integer_vectors(vectors, vec_id, embedding, dimensions, scale), "vectors")
    table = tiles(rows, block, chunk)
    small, blocks = n_clusters * dimensions <= MOST_BROADCAST, -(-dimensions // block)
    centres = stored(first_centroids(rows, n_clusters, seed), "centroids")
    for _ in range(rounds):
        nearest = stored(assigned(table, centres, small, block), "nearest")
        centres = stored(moved(table, centres, nearest, blocks, block), "centroids")
    last = assigned(table, centres, small, block, with_ids=True)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (own, far) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 1).flatten(), pa.array(_unpacked(own).astype(np.int32)),
                                                  pa.array(_unpacked(far))], ["vec_id", "cluster", "distance"])

    found = last.select("clusters", "distances", "ids").mapInArrow(rows_of, f"vec_id {kind}, cluster int, distance bigint")
    return stored(found, "clustered"), centres


def report(vectors: DataFrame) -> DataFrame:
    """Per kept vector its cluster, distance, the sums of distances and the digest of its centroid.

    The totals have one row per cluster, so they are broadcast.
    """
    found, centres = clusters(vectors)
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # One row per cluster.
    sums = sums.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    values = F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda c: c["value"].cast("string"))
    digests = centres.groupBy("cluster").agg(F.sha2(F.array_join(values, ","), 256).alias("centroid_sha256"))
    totals = sums.join(digests, "cluster")
    return found.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
