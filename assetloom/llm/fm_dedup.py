"""Substring deduplication with FM-index shards.

A window is ``window`` consecutive words of a document; it goes when the same words also start in a
document with a smaller id. Equal windows have the same anchor (the least hash among their word
``GRAM``-grams), so only stretches around anchors that several documents hold are compared, and each
anchor's stretches meet in one shard. A shard is a compressed FM-index: the Burrows-Wheeler transform of its
stretches and their documents as bit-packed wavelet matrices, and every ``SAMPLED``-th entry of the suffix array.
Stretches are streamed against it by backward search that keeps only intervals with an occurrence in a smaller
document. Where the search of a window dies at
word j, no window that starts at or before j can match, so the next one starts behind it; where it
lives, the match is compared on to its end. So all stretches of at least ``window`` words of matching
statistics are found with little more than one search each.

Whole copies are settled before by a hash of all words: only the smallest document of equal ones takes
part. An anchor with more than ``shard`` words would make a shard large, so its stretches are reduced first:
windows whose hash no other document has go, what is left is cut into pieces of ``PIECE`` windows, and of equal pieces only
the smallest document's are searched (the others go whole). If they still hold more words, they are cut into blocks,
and each pair of blocks makes a shard.

Defined results: null or blank text has no words; fewer words than a window are all kept; of rows with
a null id nothing goes and nothing goes because of them; rows with the same id are no reason for each
other's removal; kept words are joined by one space; windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, hash_words, join_skewed, mix, ngram_hashes, signed, text_bytes

WINDOW = 50
GRAM = 20
#: Words of a shard; an anchor of more is reduced before and parted.
SHARD = 200_000
#: Windows of a piece of such an anchor's stretches.
PIECE = 32
#: Words from one kept entry of the suffix array to the next.
SAMPLED = 16

#: Windows that one cursor of the search looks at.
SPAN = 16

#: Bits below each place of a word of 64.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def content_keys(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell word sequences apart."""
    place = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64))
    once = mix(hashes + place)
    return int(once.sum(dtype=np.uint64)), int(mix(once ^ place).sum(dtype=np.uint64))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchor_runs(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, first window, last window) of the runs of windows that share an anchor."""
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    gram = min(GRAM, window)
    least = sliding_min(ngram_hashes(hashes, gram), window - gram + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[starts], starts, np.append(starts[1:], len(least)) - 1


class WaveletMatrix:
    """Bit-packed wavelet matrix of a sequence of small numbers."""

    def __init__(self, values: np.ndarray):
        self.size, self.levels = len(values), []
        for shift in range(max(1, int(values.max(initial=0)).bit_length()) - 1, -1, -1):
            bit = (values >> shift & 1).astype(bool)
            words = np.packbits(np.pad(bit, (0, 64 + -len(bit) % 64)), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((shift, words, ones, len(bit) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _rank(words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return ones.take(word) + np.bitwise_count(words.take(word) & _BELOW.take(at & 63))

    def descend(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of ``at`` below the matrix, along the values' bits; differences count the value."""
        for shift, words, ones, zeros in self.levels:
            rank = self._rank(words, ones, at)
            at = np.where(values >> shift & 1, zeros + rank, at - rank)
        return at

    def look(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values at ``at``, their places below the matrix)."""
        values = np.zeros(len(at), np.int64)
        for _, words, ones, zeros in self.levels:
            rank = self._rank(words, ones, at)
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            values = values << 1 | bit
            at = np.where(bit, zeros + rank, at - rank)
        return values, at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest value between ``low`` and ``high`` (none empty)."""
        values = np.zeros(len(low), np.int64)
        for _, words, ones, zeros in self.levels:
            first, last = self._rank(words, ones, low), self._rank(words, ones, high)
            some = high - last > low - first  # a zero bit is there
            values = values << 1 | ~some
            low, high = np.where(some, low - first, zeros + first), np.where(some, high - last, zeros + last)
        return values

    def find(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A place of the value between ``low`` and ``high``, where it is: the first."""
        before, high = self.descend(values, low), high.copy()
        low = low.copy()
        while (high - low > 1).any():
            middle = (low + high) >> 1
            there = self.descend(values, middle) > before
            high, low = np.where(there, middle, high), np.where(there, low, middle)
        return low


class FMIndex:
    """Backward search for patterns over separated stretches.

    ``text``: symbols from 1, with 0 after each stretch; ``owner``: the number of each place's document.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        self.text, self.size = text.astype(np.uint32), len(text)
        rank, step = text, 1
        while True:  # suffixes are ordered by twice as many words each time
            after = np.concatenate([rank[step:] + 1, np.zeros(min(step, len(rank)), rank.dtype)])
            _, rank = np.unique(rank * (self.size + 2) + after, return_inverse=True)
            step *= 2
            if int(rank.max()) == self.size - 1:
                break
        suffixes = np.empty(self.size, np.int64)
        suffixes[rank] = np.arange(self.size)
        self.transform = WaveletMatrix(text[suffixes - 1])
        self.documents = WaveletMatrix(owner[suffixes])
        counts = np.bincount(text)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])  # first row of each symbol
        self.first = first - self.transform.descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        separators = np.flatnonzero(text == 0)
        begins = np.concatenate([[0], separators[:-1] + 1])
        offset = np.arange(self.size) - np.repeat(begins, np.diff(np.append(begins, self.size)))
        kept = offset[suffixes] % SAMPLED == 0  # so no search for a place leaves its stretch
        self.kept, self.places = WaveletMatrix(kept.astype(np.int64)), suffixes[kept].astype(np.uint32)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of symbol + pattern, given the rows of the patterns."""
        count = len(low)
        both = self.transform.descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        first = self.first[symbols]
        return first + both[:count], first + both[count:]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the rows' suffixes: back word by word to a kept entry."""
        places, steps, at = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        none = self.size - len(self.places)
        while len(at):
            kept, below = self.kept.look(rows)
            here = kept == 1
            places[at[here]] = self.places[below[here] - none] + steps[here]
            at, rows, steps = at[~here], rows[~here], steps[~here] + 1
            symbols, below = self.transform.look(rows)
            rows = self.first[symbols] + below
        return places


def matched(index: FMIndex, begin: np.ndarray, length: np.ndarray, own: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, stop) of the words covered by windows that a smaller document has.

    Stretches lie in the index's text at ``begin``; ``own`` are the numbers of their documents.
    """
    text = index.text
    found: list[tuple] = []
    # a cursor looks at SPAN windows of a stretch at most, so that long stretches don't go on alone
    windows = np.maximum(length - window + 1, 0)
    cursors = -(-windows // SPAN)
    row = np.repeat(np.arange(len(length)), cursors)
    at = SPAN * (np.arange(len(row)) - np.repeat(np.cumsum(cursors) - cursors, cursors))  # the window that is looked at
    end = np.minimum(at + SPAN, windows[row])
    word = at + window - 1  # the word that comes next, from right to left
    low, high = np.zeros(len(row), np.int64), np.full(len(row), index.size)
    asks = False  # for the smallest document: where a window is whole, and else in every other step
    while len(row):
        low, high = index.extend(text[begin[row] + word], low, high)
        alive = low < high
        document = np.zeros(len(row), np.int64)
        asked, asks = alive if asks else alive & (word == at), not asks
        if asked.any():
            document[asked] = index.documents.least(low[asked], high[asked])
            alive &= document < own[row]
        whole = alive & (word == at)
        goes_on = np.where(whole, at, word) + 1  # the next window to look at, where a search ends
        if whole.any():
            w = np.flatnonzero(whole)
            place = index.locate(index.documents.find(document[w], low[w], high[w]))
            here, there, last = begin[row[w]] + at[w] + window, place + window, begin[row[w]] + length[row[w]]
            more, run = np.zeros(len(w), np.int64), np.arange(len(w))
            while len(run):  # compare on, 64 words at a time
                x = here[run] + more[run]
                steps = np.arange(64)
                same = text[np.minimum(x[:, None] + steps, index.size - 1)] == text[np.minimum(there[run, None] + more[run, None] + steps, index.size - 1)]
                same &= x[:, None] + steps < last[run, None]
                equal = np.where(same.all(1), 64, same.argmin(1))
                more[run] += equal
                run = run[equal == 64]
            found.append((row[w], at[w], at[w] + window + more))
            goes_on[w] += more
        ended = whole | ~alive
        at = np.where(ended, goes_on, at)
        word = np.where(ended, at + window - 1, word - 1)
        low, high = np.where(ended, 0, low), np.where(ended, index.size, high)
        keep = at < end
        row, at, end, word, low, high = row[keep], at[keep], end[keep], word[keep], low[keep], high[keep]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search_shard(ids: np.ndarray, stretches: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, stop): covered words of each stretch of word hashes; ids: the stretches' documents."""
    _, number = np.unique(ids, return_inverse=True)
    seen: dict[bytes, int] = {}
    original = np.array([seen.setdefault(s.tobytes(), i) for i, s in enumerate(stretches)])
    # equal stretches: the smallest document's stands for all
    least = np.full(len(ids), len(ids))
    np.minimum.at(least, original, number)
    kept = np.unique(original)
    length = np.array([len(s) for s in stretches])
    wide = length[kept] + 1
    begin = np.concatenate([[0], np.cumsum(wide)[:-1]])
    text = np.zeros(int(wide.sum()), np.int64)
    inner = np.ones(len(text), bool)
    inner[begin + length[kept]] = False
    _, symbols = np.unique(np.concatenate([stretches[i] for i in kept]), return_inverse=True)
    text[inner] = symbols + 1
    own = least[kept]
    row, start, stop = matched(FMIndex(text, np.repeat(own, wide)), begin, length[kept], own, window)
    copies = np.flatnonzero(number > least[original])
    # the document that stands for equal stretches has what was found; the others go whole
    holders = np.flatnonzero(number == least[original])
    order = np.argsort(row, kind="stable")
    row, start, stop = row[order], start[order], stop[order]
    rank = np.searchsorted(kept, original[holders])
    first, after = np.searchsorted(row, rank), np.searchsorted(row, rank, "right")
    hits = after - first
    pick = np.repeat(first - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum()) if len(hits) else first
    return np.concatenate([copies, np.repeat(holders, hits)]), np.concatenate([np.zeros(len(copies), np.int64), start[pick]]), np.concatenate([length[copies], stop[pick]])


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """(id, content, n_words, k1, k2, sha, anchors, sizes: the words of their stretches) of (id, content, text)."""

    def look(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                counts, keys, shas, anchors, sizes = [], [], [], [], []
                for raw in text_bytes(part.column(2)):
                    words = raw.split()
                    hashes = hash_words(words)
                    counts.append(len(words))
                    keys.append(content_keys(hashes))
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    found, starts, stops = anchor_runs(hashes, window)
                    own, number = np.unique(found, return_inverse=True)
                    anchors.append(own)
                    sizes.append(np.bincount(number, stops - starts + window, len(own)).astype(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (signed(np.concatenate(anchors)), np.concatenate(sizes))]
                k = signed(np.array(keys, np.uint64).reshape(-1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(shas), *lists], ["id", "content", "n_words", "k1", "k2", "sha", "anchors", "sizes"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(look, f"id {kind}, content long, n_words long, k1 long, k2 long, sha string, anchors array<long>, sizes array<long>")


def _stretches(held: DataFrame, window: int) -> DataFrame:
    """(anchor, hot, id, k1, start, words): stretches of shared anchors of (id, text, cold, hot)."""

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                rows: list[list] = [[], [], [], [], [], []]
                for i, (raw, cold, hot) in enumerate(zip(text_bytes(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    hashes = hash_words(raw.split())
                    k1 = content_keys(hashes)[0]
                    k1 -= (k1 >> 63) << 64
                    anchors, starts, stops = anchor_runs(hashes, window)
                    anchors = signed(anchors)
                    of_hot = np.isin(anchors, np.array(hot, np.int64))
                    for j in np.flatnonzero(of_hot | np.isin(anchors, np.array(cold, np.int64))):
                        a, b = int(starts[j]), int(stops[j]) + window
                        for held, x in zip(rows, (i, int(anchors[j]), bool(of_hot[j]), k1, a, hashes[a:b].tobytes()), strict=True):
                            held.append(x)
                ids = part.column(0).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_()), ids, pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.binary())], ["anchor", "hot", "id", "k1", "start", "words"])

    kind = held.schema["id"].dataType.simpleString()
    return held.select("id", "text", "cold", "hot").mapInArrow(deal, f"anchor long, hot boolean, id {kind}, k1 long, start long, words binary")


def _pieces(hot: DataFrame, window: int) -> DataFrame:
    """(anchor, id, k1, start, words): what hot anchors' stretches (anchor, id, k1, start, words) share with other documents, in pieces."""
    last = (F.length("words") / 8 - window).cast("int")
    at = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.xxhash64(F.substring(F.col("words"), i * 8 + 1, F.lit(window * 8))).alias("h")))
    windows = hot.select("anchor", "id", "k1", "start", F.explode(at).alias("x")).select("anchor", "id", "k1", "start", "x.at", "x.h")
    shared = windows.groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most").select("h", "n")
    kept = join_skewed(windows, shared, ["h"], "n").groupBy("anchor", "id", "k1", "start").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    rows = hot.join(kept, ["anchor", "id", "k1", "start"]).select("anchor", "id", "k1", "start", "words", "ats")

    def part(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                rows = batch.slice(first, 200)
                at, start, words = [], [], []
                for i, (begin, raw, ats) in enumerate(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), rows.column(5).to_numpy(zero_copy_only=False), strict=True)):
                    run = np.concatenate([[0], np.cumsum(np.diff(ats) > 1)])
                    place = np.arange(len(ats)) - np.searchsorted(run, run)  # within its run
                    heads = np.flatnonzero(place % PIECE == 0)
                    for a, b in zip(heads, np.append(heads[1:], len(ats)), strict=True):
                        at.append(i)
                        start.append(begin + int(ats[a]))
                        words.append(raw[int(ats[a]) * 8 : (int(ats[b - 1]) + window) * 8])
                taken = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(rows.column(k).take(taken) for k in range(3)), pa.array(start, pa.int64()), pa.array(words, pa.binary())], ["anchor", "id", "k1", "start", "words"])

    kind = hot.schema["id"].dataType.simpleString()
    return rows.mapInArrow(part, f"anchor long, id {kind}, k1 long, start long, words binary")


def _hot(hot: DataFrame, window: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(copies (id, k1, start, stop), dealt (shard, id, k1, start, words)) of the stretches of anchors that have too many words for a shard."""
    pieces = cut(_pieces(hot, window).withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(1), "words")}), "dedup-pieces")
    keys = ["anchor", "h1", "h2"]
    owners = pieces.groupBy(*keys).agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n"))
    told = join_skewed(pieces, owners, keys, "n")
    copies = told.where("id > owner").select("id", "k1", "start", (F.col("start") + F.length("words") / 8).cast("long").alias("stop"))
    lead = told.where("id = owner").drop("n", "owner")
    blocks = lead.groupBy("anchor").agg(F.ceil(F.sum(F.length("words")) / 8 / shard).cast("int").alias("blocks"))
    block = F.pmod("h1", F.col("blocks")).cast("int")
    dealt = join_skewed(lead, blocks, ["anchor"], "blocks").withColumns({"block": block, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    return copies, dealt.select(F.xxhash64("anchor", F.least("block", "other"), F.greatest("block", "other")).alias("shard"), "id", "k1", "start", "words")


def _search(stretches: DataFrame, window: int, shard: int) -> DataFrame:
    """(id, k1, start, stop): words covered by windows of smaller documents, from stretches (shard, id, k1, start, words).

    Small shards are searched together, ``shard`` words at a time.
    """

    def search(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        words = 0

        def done():
            table = pa.Table.from_batches(held)
            found = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
            row, start, stop = search_shard(table.column("id").to_numpy(), found, window)
            at = table.column("start").to_numpy()[row]
            rows = pa.array(row)
            return pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(rows), table.column("k1").combine_chunks().take(rows), pa.array(at + start), pa.array(at + stop)], ["id", "k1", "start", "stop"])

        for batch in batches:
            anchors = batch.column(0).to_numpy()
            sizes = np.cumsum(pc.binary_length(batch.column(4)).to_numpy() // 8)
            ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
            begin = 0
            if held and batch.num_rows and held[-1].column(0)[-1].as_py() != anchors[0] and words >= shard:
                yield done()
                held, words = [], 0
            before = 0
            for end in ends:
                if end > begin and words + int(sizes[end - 1]) - before >= shard and end < len(anchors):
                    held.append(batch.slice(begin, end - begin))
                    yield done()
                    held, words, begin, before = [], 0, end, int(sizes[end - 1])
            if begin < len(anchors):
                held.append(batch.slice(begin))
                words += int(sizes[-1]) - before
        if held:
            yield done()

    kind = stretches.schema["id"].dataType.simpleString()
    dealt = stretches.select("shard", "id", "k1", "start", "words").repartition("shard").sortWithinPartitions("shard", "id", "start")
    return dealt.mapInArrow(search, f"id {kind}, k1 long, start long, stop long")


def _cut_out(marked: DataFrame) -> DataFrame:
    """(id, content, n_removed, new_sha, kept) of (id, content, text, k1, spans): the texts without the spanned words."""

    def remove(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                at, removed, shas, texts = [], [], [], []
                for i, (raw, own, spans) in enumerate(zip(text_bytes(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)):
                    words = raw.split()
                    k1 = content_keys(hash_words(words))[0]
                    if k1 - ((k1 >> 63) << 64) != own:  # the spans of another text with this id
                        continue
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [x["start"] for x in spans], 1)
                    np.add.at(change, [x["stop"] for x in spans], -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                    at.append(i)
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["id", "content", "n_removed", "new_sha", "kept"])

    kind = marked.schema["id"].dataType.simpleString()
    return marked.select("id", "content", "text", "k1", "spans").mapInArrow(remove, f"id {kind}, content long, n_removed long, new_sha string, kept string")


def removals(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scan, changed): for each row (id, content, n_words, sha, copy: is it a copy of a smaller document as a whole?), and for other texts that lose words (id, content, n_removed, new_sha, kept).

    ``content`` tells texts of one id apart; it is ``content_of`` the text.
    """
    plain = docs.select(F.col(key).alias("id"), content_of(F.col(text)).alias("content"), F.col(text).cast("string").alias("text"))
    scan = cut(_scan(plain, window), "dedup-scan")
    long = scan.where((F.col("n_words") >= window) & F.col("id").isNotNull())
    copies = cut(long.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")), "dedup-copies")
    first = long.join(copies.select(F.col("class").alias("id"), "k1", "k2"), ["id", "k1", "k2"])
    anchors = first.select("id", F.explode(F.arrays_zip("anchors", "sizes")).alias("x")).select("id", F.col("x.anchors").alias("anchor"), F.col("x.sizes").alias("size"))
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.sum("size").alias("n")).where("least < most").select("anchor", "n", (F.col("n") > shard).alias("hot"))
    shared = cut(shared, "dedup-shared")
    own = join_skewed(anchors, shared, ["anchor"], "n").groupBy("id").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    stretches = cut(_stretches(plain.join(own.hint("merge"), "id"), window), "dedup-stretches")
    whole, dealt = _hot(stretches.where("hot").drop("hot"), window, shard)
    dealt = stretches.where("not hot").select(F.col("anchor").alias("shard"), "id", "k1", "start", "words").unionByName(dealt)
    spans = _search(dealt, window, shard).unionByName(whole).groupBy("id", "k1").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    changed = cut(_cut_out(plain.join(spans.hint("merge"), "id")), "dedup-changed")
    told = join_skewed(long.select("id", "content", "n_words", "sha", "k1", "k2"), copies, ["k1", "k2"], "n")  # each of these has its row in ``copies``
    short = scan.where((F.col("n_words") < window) | F.col("id").isNull())
    rows = told.select("id", "content", "n_words", "sha", (F.col("class") < F.col("id")).alias("copy")).unionByName(short.select("id", "content", "n_words", "sha", F.lit(False).alias("copy")))
    return rows, changed.dropDuplicates(["id", "content"])


def content_of(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def deduplicated(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of each row."""
    scan, changed = removals(docs, window, shard, key, text)
    rows = scan.join(changed.drop("kept"), ["id", "content"], "left")
    whole = F.col("copy")
    return rows.select(F.col("id").alias(key), "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(whole, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"))


def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, less the repeated words (what is left is joined by single spaces); rows that lose all their words go."""
    scan, changed = removals(docs, window, key=key, text=text)
    gone = scan.where("copy").select("id", "content").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"), content_of(F.col(text)).alias("content"))  # whatever the columns are called
    rows = rows.join(gone, ["id", "content"], "left_anti").join(changed.select("id", "content", "kept"), ["id", "content"], "left").where("kept is null or kept <> ''")
    own = F.col("row")
    return rows.select(*[(F.coalesce("kept", own[c]) if c == text else own[c]).alias(c) for c in docs.columns])


def op6_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir))


#: The query in DuckDB: every window by its own hash.
OP6_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, s, md5(array_to_string(list_slice(words, s, s + 49), ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM h JOIN m USING (h) WHERE least < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
x AS (SELECT w.doc_id, w.words, unnest(range(1, len(w.words) + 1)) AS i FROM w JOIN g USING (doc_id)),
k AS (SELECT x.doc_id, string_agg(words[x.i], ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g.doc_id IS NULL THEN array_to_string(w.words, ' ') ELSE coalesce(k.kept, '') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""
