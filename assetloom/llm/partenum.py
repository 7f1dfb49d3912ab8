"""N-gram Jaccard join with PartEnum signatures, and its connected components.

A document's set holds its distinct word n-grams. Sets of sizes a and b with a Jaccard similarity of
p/q or more differ in (a + b)(q - p)/(q + p) elements at most. Sizes are cut into bands; for the sets
of a band (and those just below that can reach into it) that bound is one number k. The domain of
n-grams is partitioned by hashing in two levels; a signature is the content of a subset of partitions:

* k <= 4: one first-level partition, k + 2 parts, each subset of two of them (k parts may differ);
* else: first-level partitions of two parts each, k + 1 parts in all and some to spare; each part alone
  (k of them may differ).

So similar sets of a band share a signature, without exception. Empty subsets would be shared by many
sets that aren't alike, so they aren't signed. Two sets can agree on empty parts alone only if at most k
of their parts hold anything: such a set signs again with another hashing (the last of ``SCHEMES`` signs
the empty subsets too). The spare parts make that rare.

More than that: similar sets share at least ``parts - k`` parts, less those that are empty. A set of whose
parts fewer than so many are shared with any other document is like none, so its signatures go before
documents are tied together; a passage that many documents share doesn't tie them. Of equal sets one takes part.

Two rounds verify what signatures tie, both exactly and with an inverted index. First each document meets the
one that most of its signatures point to (the smallest that shares them), in stars that are cut into blocks of bounded size:
near copies hang together after that. Then only signatures count that documents of different components
still share, and of them only those of documents that have enough such in one band and hashing (a slot). Signatures that few documents
have are told as pairs, and a pair that shares enough of them in a slot is compared. Documents that are tied by
others make groups, slot by slot; a group's largest component meets the others, and the others meet each other, in pairs of blocks
of bounded size. A pair shares enough among its few alone, or shares one of the others, so none is left out; and documents that chance ties to
each other in a chain of unlike ones do not all meet. Nor is a large group of near copies compared pair by pair. Only spanning links leave a task.

Defined results: null, empty or blank text has an empty set and links with nothing; fewer words than n
are one element, the whole sequence; rows with a null id link with nothing and have no component; rows
that share an id are one document that links by any of its texts; the smallest id wins ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetloom.sources.shared import passing

from .common import cut, documents, hash_words, join_skewed, mix, ngram_hashes, signed, text_bytes

#: Shingles of a block of a star, and of a block in the second round.
STAR, BLOCK = 50_000, 200_000

#: A signature that so many documents have at most is told as their pairs in the second round.
FEW = 32

#: A signature that ``OFTEN`` documents of one part in ``PARTS`` share is dealt over ``SALTS`` tasks; so many signatures at most (the most frequent).
PARTS, OFTEN, SALTS, MOST_HOT = 64, 16, 64, 100_000

#: Hashings of the domain that a set with empty subsets goes through.
SCHEMES = 8

_PART, _SUM, _KEY = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0xD1342543DE82EF95)
_EMPTY = np.zeros(0, np.uint64)


def shingle_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of the text's words, A-Z in lower case."""
    words = raw.lower().split()
    if not words:
        return _EMPTY
    hashes = hash_words(words)
    if len(words) < n:
        return ngram_hashes(hashes, len(words)) + np.uint64(len(words))
    return np.unique(ngram_hashes(hashes, n))


class Bands:
    """Size bands for a similarity of p/q, and each set's signatures."""

    def __init__(self, p: int, q: int):
        if not 0 < p < q:
            raise ValueError("the similarity must lie between 0 and 1")
        self.p, self.q = p, q
        self.upper = [(p + q - 1) // (2 * (q - p))]  # up to here, sets that are similar are equal

    def of(self, size: int) -> list[tuple[int, int]]:
        """(band, k) that a set of this size signs for."""
        p, q, upper = self.p, self.q, self.upper
        while upper[-1] < size:
            u = upper[-1]
            upper.append(max(u + 1, u * 3 // 2, u * q // p))
        own = next(i for i, u in enumerate(upper) if u >= size)
        if own + 1 == len(upper):
            u = upper[own]
            upper.append(max(u + 1, u * 3 // 2, u * q // p))
        bands = [own] if own else []
        if size * q >= p * (upper[own] + 1):
            bands.append(own + 1)
        return [(b, 2 * upper[b] * (q - p) // (q + p)) for b in bands]

    def parts(self, band: int, k: int) -> int:
        """Parts of the domain; beyond k + 1 as many as the band's smallest sets may leave empty."""
        if k <= 4:
            return k + 2
        least = (self.upper[band - 1] + 1) * self.p / self.q
        parts = k + 1
        for _ in range(4):
            parts = k + 2 + int(1.3 * parts * math.exp(-least / parts))
        return parts + parts % 2

    def signatures(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, codes) of a set for all bands that it signs for.

        A code says the band and hashing, and below bit 32 how many of their signatures the set must share to be like another.
        """
        found, codes = [_EMPTY], []
        bands = self.of(len(elements))
        if bands:
            value = mix(elements ^ _SUM)
            low, high = (value & np.uint64(0xFFFFFFFF)).astype(float), (value >> np.uint64(32)).astype(float)
        for band, k in bands:
            parts = self.parts(band, k)
            for scheme in range(SCHEMES):
                place = mix(elements ^ (_PART + np.uint64(scheme))) >> np.uint64(32)
                part = (place * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                sums = [np.bincount(part, x, parts) for x in (None, low, high)]
                need = np.count_nonzero(sums[0]) - k
                if k <= 4:
                    first, second = np.array(list(combinations(range(parts), 2))).T
                    sums = [s[first] + s[second] for s in sums]
                slot = band << 8 | scheme
                number = np.arange(len(sums[0]), dtype=np.uint64) + np.uint64(slot << 32)
                own = mix(mix(sums[1].astype(np.uint64) + (number << np.uint64(1))) + sums[2].astype(np.uint64) * _KEY + number)
                last = scheme == SCHEMES - 1
                found.append(own if last else own[sums[0] > 0])
                codes += [slot << 32 | (1 if k <= 4 or last else max(1, need))] * len(found[-1])
                if need > 0:
                    break
        return np.concatenate(found), np.array(codes, np.int64)


def sets(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, k1, k2): k1 and k2 tell sets apart."""

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            size, k1, k2 = [], [], []
            for raw in text_bytes(batch.column(1)):
                elements = shingle_set(raw, n)
                size.append(len(elements))
                k1.append(mix(elements ^ _KEY).sum(dtype=np.uint64))
                k2.append(mix(elements ^ _SUM).sum(dtype=np.uint64))
            keys = [pa.array(signed(np.array(k, np.uint64))) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *keys], ["id", "n_shingles", "k1", "k2"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(measure, f"id {kind}, n_shingles long, k1 long, k2 long")


def signature_rows(docs: DataFrame, n: int, p: int, q: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(signature, id, code); of documents of a batch that have equal sets one signs."""

    def sign(batches: Iterator[pa.RecordBatch]):
        bands = Bands(p, q)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows, found, codes, seen = [], [_EMPTY], [np.zeros(0, np.int64)], set()
                for i, raw in enumerate(text_bytes(part.column(1))):
                    elements = shingle_set(raw, n)
                    same = mix(elements ^ _KEY).sum(dtype=np.uint64)
                    if len(elements) and same not in seen:
                        seen.add(same)
                        own, code = bands.signatures(elements)
                        rows.append(np.full(len(own), i))
                        found.append(own)
                        codes.append(code)
                at = pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), part.column(0).take(at), pa.array(np.concatenate(codes))], ["signature", "id", "code"])

    kind = docs.schema[key].dataType.simpleString()
    usable = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return usable.mapInArrow(sign, f"signature long, id {kind}, code long")


def hot_signatures(docs: DataFrame, n: int, p: int, q: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(signature, hot): signatures that very many documents share, as a part of the documents shows.

    This only says where rows go: every row of every document takes part, whether its signature is listed here or not.
    """
    some = signature_rows(docs.where(F.pmod(F.xxhash64(key), F.lit(PARTS)) == 0), n, p, q, key, text)
    met = some.groupBy("signature").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= OFTEN) & (F.col("least") < F.col("most")))
    return met.orderBy(F.desc("n"), "signature").limit(MOST_HOT).select("signature", F.lit(True).alias("hot"))


def need(code: str) -> Column:
    """Of a code, how many signatures a set must share."""
    return F.col(code).bitwiseAND(F.lit(0xFFFFFFFF))


def enough(rows: DataFrame, label: str) -> DataFrame:
    """Of rows (signature, id, code, ...), those of sets that have as many as they need."""
    known = rows.groupBy("id", "code").agg(F.count(F.lit(1)).alias("had")).where(F.col("had") >= need("code")).select("id", "code")
    return cut(rows.join(known, ["id", "code"]), label, kept=True)


def shared_signatures(rows: DataFrame, owner: DataFrame, hot: DataFrame) -> DataFrame:
    """(signature, id, code): signatures that several documents have, of documents that share enough of theirs; the smallest stands for equal sets.

    That a hot signature is shared is known before, so its rows needn't meet in one task.
    """
    known = F.coalesce("hot", F.lit(False))
    rows = rows.join(F.broadcast(hot), "signature", "left").withColumn("salt", F.when(known, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0))
    bucket = Window.partitionBy("signature", "salt")
    shared = rows.withColumn("least", F.min("id").over(bucket)).withColumn("most", F.max("id").over(bucket)).where(known | (F.col("least") < F.col("most")))
    with passing(rows.sparkSession):
        shared = cut(shared.select("signature", "id", "code"), "jaccard-met")  # by itself: the shuffle of all signatures is the largest of all
        shared = shared.join(owner, "id").select("signature", F.col("class").alias("id"), "code").distinct()
        return enough(cut(shared, "jaccard-shared"), "jaccard-tied")


def stars(tied: DataFrame) -> DataFrame:
    """(id, hub): of the smallest documents that share a signature, the one that shares most (of equals the smallest)."""
    least = tied.groupBy("signature").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ways = join_skewed(tied, cut(least, "jaccard-hubs"), ["signature"], "n").where("id <> hub")
    counted = ways.groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("id").agg(F.max_by("hub", F.struct("n", F.negative("hub"))).alias("hub"))


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root): for each node of the edges (a, b), the smallest node that it hangs together with.

    Large and small stars in turn: each node's neighbours are hung on the smallest of them until
    nothing changes. Neither a hub nor a component has to fit into a task: the busiest hubs go by broadcast.
    """

    def hang(pairs: DataFrame, only_smaller: bool) -> DataFrame:
        ways = pairs.where("a > b") if only_smaller else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "least").alias("least"), "n")
        moved = join_skewed(ways, least, ["a"], "n")
        if only_smaller:
            hung = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        else:
            hung = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return hung.where("a <> b").distinct()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = cut(hang(cut(hang(now, False), label), True), label)  # a table after each step keeps the plans small
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()


def _links(ids: list, known: list, found: list[np.ndarray], block: list[int], apart: bool, p: int, q: int) -> list[tuple]:
    """(a, b): spanning links among the components ``known`` of the sets; ``apart``: only across the two blocks."""
    number_of = {c: i for i, c in enumerate(dict.fromkeys(known))}
    names, own_root = list(number_of), [number_of[c] for c in known]
    root = list(range(len(names)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(x) for x in found])
    _, number = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), size)
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number))
    begins = np.concatenate([[0], ends[:-1]])
    shared = (ends - begins)[number] > 1
    owners, at, blocks, groups = owner[order], np.concatenate([[0], np.cumsum(size)]), np.array(block), np.array(own_root)
    for i in range(len(ids)):
        own = number[at[i] : at[i + 1]][shared[at[i] : at[i + 1]]]
        if not len(own) or apart and blocks[i] != blocks.max():
            continue
        lengths = (ends - begins)[own]
        places = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owners[places], minlength=len(ids))
        alike = (q * both >= p * (size + size[i] - both)) & (groups != groups[i])
        if apart:
            alike &= blocks != blocks[i]
        for j in np.flatnonzero(alike):
            a, b = top(own_root[i]), top(own_root[int(j)])
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(names[i], names[top(i)]) for i in range(len(names)) if top(i) != i]


def verified_links(dealt: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """(a, b): spanning links between the components of each task of (task, apart, block, id, known, text).

    ``known`` is the component that a document is known to belong to; ``apart``: only documents of different blocks are compared.
    """
    dealt = dealt.select("task", "id", "known", "block", "apart", "text").repartition("task").sortWithinPartitions("task", "id")

    def verify(batches: Iterator[pa.RecordBatch]):
        held: dict[tuple, tuple] = {}
        last = None

        def done():
            ids, known, block, apart, sets = zip(*held.values(), strict=True)
            out = _links(ids, known, sets, block, apart[0], p, q)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i in (0, 1)], ["a", "b"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for task, *row, raw in zip(*columns, text_bytes(batch.column(5)), strict=True):
                if task != last:
                    if len(held) > 1:
                        yield done()
                    held, last = {}, task
                elements = shingle_set(raw, n)
                held[row[0], int(mix(elements ^ _KEY).sum(dtype=np.uint64))] = (*row, elements)  # repeated rows once
        if len(held) > 1:
            yield done()

    kind = dealt.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(verify, f"a {kind}, b {kind}")


def star_tasks(star: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tasks of ``verified_links``, without texts: the documents of each star (id, hub) in blocks of ``STAR`` shingles, each with the hub."""
    sized = cut(star.join(sizes, "id"), "jaccard-sized")
    blocks = sized.groupBy("hub").agg(F.ceil(F.sum("n") / STAR).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = join_skewed(sized, blocks, ["hub"], "blocks").select("id", "hub", block.alias("block"))
    hubs = blocks.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return members.unionByName(hubs).select("id", F.col("id").alias("known"), F.concat_ws(":", "hub", "block").alias("task"), F.lit(0).alias("block"), F.lit(False).alias("apart"))


def apart_signatures(tied: DataFrame, roots: DataFrame) -> DataFrame:
    """(signature, id, code, known, n): what documents of different components (id, root) still share, of those that share enough; n documents have it."""
    with passing(tied.sparkSession):
        placed = cut(tied.join(roots, "id", "left").select("signature", "id", "code", F.coalesce("root", "id").alias("known")), "jaccard-placed")
        apart = placed.groupBy("signature").agg(F.min("known").alias("least"), F.max("known").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
        apart = cut(apart.select("signature", "n"), "jaccard-apart")
        return enough(cut(join_skewed(placed, apart, ["signature"], "n"), "jaccard-open"), "jaccard-rivals")


def candidates(rivals: DataFrame) -> DataFrame:
    """(id, hub): pairs of different components that share enough of the signatures that few documents have."""
    every = rivals.where(F.col("n") <= FEW).groupBy("signature").agg(F.collect_list(F.struct("id", "known", "code")).alias("all"))
    one = every.select(F.explode("all").alias("x"), "all")
    pairs = one.select("x", F.explode(F.filter("all", lambda y: (y["id"] > F.col("x.id")) & (y["known"] != F.col("x.known")))).alias("y"))
    pairs = pairs.select(F.col("x.id").alias("hub"), F.col("y.id").alias("id"), F.shiftright("x.code", 32).alias("slot"), F.greatest(need("x.code"), need("y.code")).alias("need"))
    counted = pairs.groupBy("hub", "id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    return counted.where("n >= need").select("id", "hub").distinct()


def block_tasks(rivals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tasks of ``verified_links``, without texts: documents tied by the signatures that more than ``FEW`` have."""
    node = lambda c: F.struct("slot", F.col(c).alias("id"))
    often = rivals.where(F.col("n") > FEW).withColumn("slot", F.shiftright("code", 32))
    first = cut(often.groupBy("signature").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "jaccard-often")
    ties = join_skewed(often.drop("n"), first, ["signature"], "n")
    ties = cut(ties.select("slot", "id", "known", "first").distinct(), "jaccard-ties")
    groups = components(ties.select(node("id").alias("a"), node("first").alias("b")), "jaccard-groups")
    members = ties.select(node("id").alias("node"), "id", "known").distinct().join(groups.select(F.col("id").alias("node"), "root"), "node").join(sizes, "id")
    members = cut(members.select("id", "known", "n", F.concat_ws(":", "root.id", "root.slot").alias("group")), "jaccard-members")
    parts = members.groupBy("group", "known").agg(F.sum("n").alias("n"))
    groups = parts.groupBy("group").agg(F.max_by("known", F.struct("n", "known")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    groups = groups.select("group", "largest", blocks(F.col("most")).alias("large"), blocks(F.col("all") - F.col("most")).alias("small"), "all")
    # blocks from 0 hold what isn't in the largest component and meet all; blocks from -1 down hold the largest and meet the others
    dealt = join_skewed(members, cut(groups, "jaccard-parts"), ["group"], "all")
    inside = F.col("known") == F.col("largest")
    block = F.when(inside, -1 - F.pmod(F.xxhash64("id"), F.col("large"))).otherwise(F.pmod(F.xxhash64("id"), F.col("small"))).cast("int")
    lowest = F.when(inside, F.lit(0)).otherwise(-F.col("large"))
    dealt = dealt.select("group", "id", "known", block.alias("block"), F.explode(F.sequence(lowest, F.col("small") - 1)).alias("other"))
    task = F.concat_ws(":", "group", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select("id", "known", task.alias("task"), "block", (F.col("block") != F.col("other")).alias("apart"))


def pair_tasks(tied: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tasks of ``verified_links``, without texts, for documents of different components (id, root) that still share signatures."""
    rivals = apart_signatures(tied, roots)
    pairs = star_tasks(candidates(rivals), sizes).drop("known").join(roots, "id", "left")
    pairs = pairs.select("id", F.coalesce("root", "id").alias("known"), F.concat("task", F.lit("*")).alias("task"), "block", "apart")
    return pairs.unionByName(block_tasks(rivals, sizes))


def jaccard_components(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id): documents link when their sets' Jaccard similarity is p/q or more."""
    spark = docs.sparkSession
    known = cut(sets(docs, n, key, text), "jaccard-sets")
    with passing(spark):
        usable = known.where("n_shingles > 0 and id is not null")
        classes = cut(usable.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")), "jaccard-classes")
        owner = cut(join_skewed(usable, classes, ["k1", "k2"], "copies").select("id", "class").distinct(), "jaccard-owners")
        tied = shared_signatures(signature_rows(docs, n, p, q, key, text), owner, hot_signatures(docs, n, p, q, key, text))

        nodes = tied.select("id").distinct()
        sizes = cut(usable.select("id", "n_shingles").distinct().join(nodes, "id").groupBy("id").agg(F.sum("n_shingles").alias("n")), "jaccard-sizes")
        # whole texts are dealt by id once, at any size of the corpus, and those that take part kept
        texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
        texts = cut(texts.join(sizes.select("id").hint("merge"), "id"), "jaccard-texts")

        several = owner.groupBy("id").agg(F.min("class").alias("b"), F.max("class").alias("most")).where("b < most")
        own = owner.join(several, "id").where("class <> b").select(F.col("class").alias("a"), "b")  # sets of one document hang together
        first = cut(verified_links(star_tasks(stars(tied), sizes).join(texts, "id"), n, p, q), "jaccard-stars")
        roots = cut(components(first.unionByName(own), "jaccard-first"), "jaccard-roots")
        second = cut(verified_links(pair_tasks(tied, roots, sizes).join(texts, "id"), n, p, q), "jaccard-pairs")
        further = components(second, "jaccard-second").select(F.col("id").alias("root"), F.col("root").alias("further"))
        placed = owner.join(roots.withColumnRenamed("id", "class"), "class", "left").select("id", F.coalesce("root", "class").alias("root"))
        whole = placed.join(further, "root", "left").groupBy("id").agg(F.min(F.coalesce("further", "root")).alias("component"))
        whole = cut(whole, "jaccard-components", kept=True)
    rows = known.join(whole, "id", "left")
    return rows.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op3_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), n=3, p=90, q=100)
