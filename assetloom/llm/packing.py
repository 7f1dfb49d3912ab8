"""Best-fit packing of documents into fixed-length sequences, with conflicts.

A bin holds ``capacity`` words. It takes no two documents of one duplicate cluster and at most
``per_source`` of one source. Documents are dealt at random (by hash) to shards of about ``shard_rows``
pieces, so copies and hot sources spread evenly and each shard is packed by itself: longest piece
first, into the compatible bin with the least room that is enough. Bins stand in lists by their
residual; a bitmap of the residuals in use gives the successor of any size. Each bin carries bitmaps of
its sources (a plane for each further document of a source) and clusters; the successor search goes on,
bin by bin and residual by residual, until the tightest compatible bin is found.

A document longer than the capacity is cut into full pieces, which fill bins of their own, and a rest
that is packed like any other.

Defined results: null, empty or blank text has no words and no bin; a null source or cluster conflicts
with nothing; repeated rows are packed each; ties go to the lower id, then to the older bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, text_bytes

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ROWS = 4096


class Bins:
    """Open bins by residual, with bitmaps of what they hold."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]  # the oldest bin first
        self.in_use = 0  # bit r: some bin has residual r
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) of a piece; source and cluster are bits, 0 if they don't matter."""
        left = self.in_use >> need
        residual = need
        while left:
            skip = (left & -left).bit_length() - 1
            residual += skip
            for number in self.by_residual[residual]:
                if not (self.clusters[number] & cluster or self.sources[number][-1] & source):
                    self._fill(number, residual, need, source, cluster)
                    return number, self.capacity - residual
            left >>= skip + 1
            residual += 1
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self._fill(len(self.sources) - 1, None, need, source, cluster)
        return len(self.sources) - 1, 0

    def _fill(self, number: int, residual: int | None, need: int, source: int, cluster: int) -> None:
        if residual is None:
            residual = self.capacity
        else:
            same = self.by_residual[residual]
            del same[bisect_left(same, number)]
            if not same:
                self.in_use &= ~(1 << residual)
        if residual > need:
            insort(self.by_residual[residual - need], number)
            self.in_use |= 1 << (residual - need)
        self.clusters[number] |= cluster
        planes = self.sources[number]
        for k in range(self.per_source):
            if not planes[k] & source:
                planes[k] |= source
                break


def by_id(own) -> tuple:
    """Sorts ids of any one type, null last."""
    return (True, 0) if own is None else (False, own)


def pack_shard(pieces: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int]]:
    """(place in ``pieces``, bin, offset) of pieces (id, words, source, cluster), each within the capacity."""
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i][1], *by_id(pieces[i][0]), pieces[i][3] or 0, i))
    often = Counter(p[3] for p in pieces)
    source_bits: dict = {None: 0}
    cluster_bits: dict = {c: 0 for c, n in often.items() if n == 1} | {None: 0}
    shared = 0
    bins, out = Bins(capacity, per_source), []
    for i in order:
        _, need, source, cluster = pieces[i]
        if source not in source_bits:
            source_bits[source] = 1 << (len(source_bits) - 1)
        if cluster not in cluster_bits:
            cluster_bits[cluster] = 1 << shared
            shared += 1
        out.append((i, *bins.place(need, source_bits[source], cluster_bits[cluster])))
    return out


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, n_words, cluster): the cluster is a hash of the words in lower case, so copies share it."""

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words = [raw.lower().split() for raw in text_bytes(batch.column(2))]
            cluster = [xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, words), pa.int64()), pa.array([c - ((c >> 63) << 64) for c in cluster], pa.int64())], ["id", "source", "n_words", "cluster"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")).mapInArrow(measure, f"id {kind}, source string, n_words long, cluster long")


def pack(rows: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, piece, start_word, n_words, bin_id, bin_offset) of rows (id, source, n_words, cluster)."""
    if capacity < 1 or per_source < 1 or shard_rows < 1:
        raise ValueError("capacity, per_source and shard_rows must be positive")
    rows = cut(rows, "packing-rows")
    shards = max(1, -(-rows.count() // shard_rows))
    spread = F.coalesce(F.when(F.col("id").isNotNull(), F.xxhash64("id")), F.monotonically_increasing_id())  # rows with null ids spread too
    number = F.pmod(F.xxhash64(spread, "cluster"), F.lit(shards))
    dealt = rows.select(number.alias("shard"), "id", "source", "n_words", "cluster")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")

    def fill(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        last = None

        def done():
            rests, out = [], []
            held.sort(key=lambda r: (*by_id(r[0]), r[3] or 0, r[1] or "", r[2] or 0))
            for own, source, words, cluster in held:
                full, rest = divmod(words or 0, capacity)
                for piece in range(full):
                    out.append([own, piece, piece * capacity, capacity, None, 0])
                if rest:
                    rests.append((own, rest, source, cluster, full))
                elif not full:
                    out.append([own, 0, 0, 0, None, None])
            used = 0
            for i, number, offset in pack_shard([r[:4] for r in rests], capacity, per_source):
                own, rest, _, _, full = rests[i]
                out.append([own, full, full * capacity, rest, number, offset])
                used = max(used, number + 1)
            for row in out:
                if row[4] is None and row[3]:
                    row[4] = used
                    used += 1
            base = last << 32
            names = ["id", "piece", "start_word", "n_words", "bin_id", "bin_offset"]
            columns = [pa.array([r[0] for r in out], kind), *(pa.array([r[k] for r in out], pa.int64()) for k in (1, 2, 3)), pa.array([None if r[4] is None else base + r[4] for r in out], pa.int64()), pa.array([r[5] for r in out], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            for shard, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if shard != last and held:
                    yield done()
                    held = []
                last = shard
                held.append(tuple(row))
        if held:
            yield done()

    kind = rows.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(fill, f"id {kind}, piece long, start_word long, n_words long, bin_id long, bin_offset long")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(measured(documents(spark, sf_dir))).withColumnRenamed("id", "doc_id")
