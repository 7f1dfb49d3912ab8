"""Scores of a class-based bigram language model whose classes come from exchange clustering.

Training counts every word and every pair of neighbours of all training documents. Exchange clustering first moves the
``CLUSTERED`` most frequent words and ``SHAPES`` groups of all other words by their ending, one after another, each to
the class that gains most likelihood of the class bigrams. From there the exchange goes on over words, all at once: in each
of ``ROUNDS`` rounds every listed word and ending is counted with the classes of its neighbours on both sides, and in
``SWEEPS`` sweeps each that occurs ``ENOUGH`` times moves to the class under which what comes before and after it is most
likely. A listed word that is rarer has the class of its ending. So there is one class to a word, the same whether it
comes before or after.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Transitions are smoothed towards the classes'
frequencies. A word that is listed has its share of its class; any other word has its group's share of
the class times (c + 1) / (n + v + 1) within the group (n tokens, v distinct words), so unseen words
have a probability too. A text begins after, and ends with, the end token, a class of its own.

The most frequent words of up to ``LONGEST`` bytes, ``LISTED`` at most, are looked up in a broadcast of that bounded size. Texts
are cut into words twice: to count them, and to write the numbers of their tokens, which all later passes read. All
other tokens, added up for each document, meet their counts by a join whose busiest words go by broadcast, so every count is exact however many words there are.

Defined results: null text counts as empty (an end alone); a null id counts as the empty string when
documents are dealt to training; repeated rows are trained on and scored each; without training
documents N = V = 0 and every unit is unseen; whole texts count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, join_skewed, most_frequent, text_bytes

CLUSTERED = 768
SHAPES = 256
CLASSES = 48
LISTED, LONGEST = 200_000, 64
ROUNDS, SWEEPS = 2, 2
#: Occurrences from which a word's own contexts say more than its ending.
ENOUGH = 2
SMOOTHING = 20.0

#: Distinct words that a worker counts before it starts afresh.
HELD = 400_000
_ROWS = 400
#: Units of which a task sends its counts together.
PACKED = 32


def shape(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SHAPES


def shape_column(word: Column) -> Column:
    return (F.crc32(F.when(F.length(word) < 2, word).otherwise(F.substring(word, -2, 2))) % SHAPES).cast("int")


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 7 == 2


def word_counts(training: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n): tokens of all texts, added up in each task before the shuffle."""

    def count(batches):
        held: Counter = Counter()

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                held.update(raw.lower().split())
                if len(held) > HELD:
                    yield emit()
        yield emit()

    return training.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Units:
    """Numbers of words: their place in ``listed``, or ``len(listed)`` + their shape."""

    def __init__(self, listed: list[bytes]):
        self.listed = {w: i for i, w in enumerate(listed)}
        self.endings: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.listed.get, words, repeat(-1)), np.int64, len(words))
        base, endings = len(self.listed), self.endings
        at = np.flatnonzero(out < 0)
        own = []
        for i in at.tolist():
            ending = words[i][-2:]
            if ending not in endings:
                endings[ending] = base + shape(ending)
            own.append(endings[ending])
        out[at] = own
        return out


def _tokens(raw: list[bytes], units: _Units, end: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts, all tokens' units with an end after each text, and the ends' places."""
    split = [r.lower().split() for r in raw]
    words = [w for s in split for w in s]
    ends = np.cumsum([len(s) + 1 for s in split]) - 1
    tokens = np.full(len(words) + len(raw), end, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = units.of(words)
    return words, tokens, ends


def numbered(rows: DataFrame, listed: list[bytes]) -> DataFrame:
    """(row, units, words, times) of (row, text): the units of all tokens, the end too, as 32-bit integers, and the words that aren't listed, each once."""
    shared = rows.sparkSession.sparkContext.broadcast(listed)
    names = ["row", "units", "words", "times"]

    def number(batches):
        units = _Units(shared.value)
        first_rare = len(units.listed)
        end = first_rare + SHAPES
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                words, tokens, ends = _tokens(text_bytes(part.column(1)), units, end)
                places = np.concatenate([[0], ends + 1]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(places * 4), pa.py_buffer(tokens.astype(np.int32))])
                at = np.flatnonzero((tokens >= first_rare) & (tokens < end))
                row = np.searchsorted(ends, at)
                times = Counter(zip(row.tolist(), [words[i] for i in (at - row).tolist()], strict=True))  # each word of a document once, by documents
                lists = pa.array(np.searchsorted([i for i, _ in times], np.arange(part.num_rows + 1)), pa.int32())
                held = [pa.array([w for _, w in times], pa.binary()), pa.array(times.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), packed, *(pa.ListArray.from_arrays(lists, x) for x in held)], names)

    return rows.mapInArrow(number, f"row {rows.schema['row'].dataType.simpleString()}, units binary, words array<binary>, times array<long>")


def _units(column: pa.Array) -> Iterator[np.ndarray]:
    """Units of all tokens of some texts at a time, from a column of ``numbered``."""
    for start in range(0, len(column), _ROWS):
        yield np.frombuffer(b"".join(column.slice(start, _ROWS).to_pylist()), np.int32)


def unit_bigrams(units: DataFrame, clustered_of: np.ndarray) -> DataFrame:
    """(pair, n): neighbours among clustered units and the end; pair = before * (units + 1) + after. ``clustered_of``: the clustered unit of each unit, the end's last."""
    side = int(clustered_of[-1]) + 1
    shared = units.sparkSession.sparkContext.broadcast(clustered_of)

    def pairs(batches):
        clustered_of = shared.value
        sums = np.zeros(side * side, np.int64)
        for batch in batches:
            for found in _units(batch.column(0)):
                tokens = clustered_of[found]
                before = np.concatenate([[side - 1], tokens[:-1]])
                np.add.at(sums, before * side + tokens, 1)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["pair", "n"])

    return units.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 10) -> np.ndarray:
    """Class of each unit; the last unit (the end) is class ``classes`` alone.

    Starts with the most frequent units in classes of their own and the others in the last class;
    then each unit in turn moves to the class where the class bigrams' likelihood is highest.
    """
    count = len(bigrams) - 1
    weight = bigrams[:count].sum(1) + bigrams[:, :count].sum(0)
    order = np.argsort(-weight, kind="stable")
    own = np.full(count + 1, classes)
    own[order] = np.minimum(np.arange(count), classes - 1)
    side = classes + 1
    f = lambda x: x * np.log(np.maximum(x, 1))
    table = np.zeros((side, side))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not weight[u]:
                break
            right, left = bigrams[u].astype(float), bigrams[:, u].astype(float)
            itself = right[u]
            right[u] = left[u] = 0
            after, before = np.bincount(own, right, side), np.bincount(own, left, side)
            here = own[u]
            table[here] -= after
            table[:, here] -= before
            table[here, here] -= itself
            rows, columns = table[:classes], table[:, :classes].T
            gain = (f(rows + after) - f(rows)).sum(1) + (f(columns + before) - f(columns)).sum(1)
            same = table[diagonal, diagonal]
            gain += f(same + after[:classes] + before[:classes] + itself) - f(same + after[:classes]) - f(same + before[:classes]) + f(same)
            out, into = table.sum(1)[:classes], table.sum(0)[:classes]
            gain -= f(out + after.sum() + itself) - f(out) + f(into + before.sum() + itself) - f(into)
            best = int(np.argmax(gain))
            if gain[best] <= gain[here] + 1e-9:
                best = here
            own[u] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += itself
            moved += best != here
        if not moved:
            break
    return own


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 P(class | history), smoothed towards the classes' own frequencies, of counts (history, class)."""
    share = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + SMOOTHING * share) / (table.sum(1, keepdims=True) + SMOOTHING))


def class_table(bigrams: np.ndarray, own: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)
    return table


def best_classes(contexts: np.ndarray, table: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The class of each word that makes its contexts most likely; of equals the first.

    ``contexts``: how often each class comes before the word, then how often each comes after; ``table``: counts (class, class).
    """
    before, after = transitions(table)[:, : len(mass)], transitions(table)[: len(mass)].T
    gain = contexts @ np.concatenate([before, after]) - contexts[:, : len(table)].sum(1, keepdims=True) * np.log10(np.maximum(mass, 1))
    return np.argmax(np.round(gain, 6), 1)


def word_contexts(units: DataFrame, class_of: np.ndarray) -> DataFrame:
    """(unit, at, n: arrays): how often each class comes before (at = class) and after (at = classes + 1 + class) each listed word, ending and end.

    A task counts in one table of bounded size (listed words times classes) and sends what it found in packed stretches of ``PACKED``
    units, which meet by stretch.
    """
    wide = 2 * (CLASSES + 1)
    room, end = PACKED * wide, len(class_of) - 1
    shared = units.sparkSession.sparkContext.broadcast(class_of)

    def count(batches):
        class_of = shared.value
        table, counted = np.zeros(len(class_of) * wide, np.int32), 0

        def packed():
            at = np.flatnonzero(table)
            stretch = at // room
            heads = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]])) if len(at) else at
            places = np.append(heads, len(at)).astype(np.int32)
            columns = [pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(places * x.itemsize), pa.py_buffer(x)]) for x in ((at % room).astype(np.uint16), table[at])]
            return pa.RecordBatch.from_arrays([pa.array(stretch[heads]), *columns], ["stretch", "at", "n"])

        for batch in batches:
            for tokens in _units(batch.column(0)):
                classes = class_of[tokens]
                before, after = np.concatenate([[CLASSES], classes[:-1]]), np.concatenate([classes[1:], [CLASSES]])
                after[tokens == end] = CLASSES  # what follows an end is another text
                key = tokens.astype(np.int64) * wide
                np.add.at(table, key + before, np.int32(1))
                np.add.at(table, key + (after + CLASSES + 1), np.int32(1))
                counted += len(tokens)
                if counted > 1 << 30:  # before a number of 32 bits can be too small
                    yield packed()
                    table[:], counted = 0, 0
        yield packed()

    def add(batches):
        last, sums = None, np.zeros(room, np.int64)

        def done():
            at = np.flatnonzero(sums)
            unit, place = np.divmod(at, wide)
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            lists = [pa.ListArray.from_arrays(pa.array(np.append(heads, len(at)), pa.int32()), x) for x in (pa.array(place, pa.int32()), pa.array(sums[at]))]
            return pa.RecordBatch.from_arrays([pa.array(last * PACKED + unit[heads]), *lists], ["unit", "at", "n"])

        for batch in batches:
            for stretch, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if stretch != last:
                    if last is not None:
                        yield done()
                    last = stretch
                    sums[:] = 0
                sums[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)
        if last is not None:
            yield done()

    packed = units.mapInArrow(count, "stretch long, at binary, n binary").repartition("stretch").sortWithinPartitions("stretch")
    return packed.mapInArrow(add, "unit long, at array<int>, n array<long>")


def _dense(batch: pa.RecordBatch) -> np.ndarray:
    """Contexts (unit, class before and class after) of a batch of ``word_contexts``."""
    at, n = batch.column(1), batch.column(2)
    row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
    out = np.zeros((batch.num_rows, 2 * (CLASSES + 1)))
    np.add.at(out, (row, at.flatten().to_numpy()), n.flatten().to_numpy())
    return out


def followed(contexts: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts (class before, class) of all tokens: those before by the classes of the round's beginning, the others by ``classes``."""
    side = CLASSES + 1
    shared = contexts.sparkSession.sparkContext.broadcast(classes)

    def add(batches):
        table = np.zeros((side, side))
        for batch in batches:
            np.add.at(table.T, shared.value[batch.column(0).to_numpy()], _dense(batch)[:, :side])
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table.ravel()[at].astype(np.int64))], ["at", "n"])

    found = contexts.mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(side * side)
    table[found["at"].to_numpy(np.int64)] = found["n"]
    return table.reshape(side, side)


def sweep(contexts: DataFrame, units: int, table: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The best class of each unit but the end (-1 where it doesn't occur); as many numbers as there are units come to the driver."""

    def choose(batches):
        for batch in batches:
            unit = batch.column(0).to_numpy()
            own = best_classes(_dense(batch), table, mass)
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(own.astype(np.int64))], ["unit", "own"])

    found = contexts.where(F.col("unit") < units).mapInArrow(choose, "unit long, own long").toPandas()
    own = np.full(units, -1)
    own[found["unit"].to_numpy(np.int64)] = found["own"]
    return own


def class_pairs(units: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """Counts (class, class) of all neighbours."""
    side = CLASSES + 1
    shared = units.sparkSession.sparkContext.broadcast(class_of)

    def count(batches):
        class_of, sums = shared.value, np.zeros(side * side, np.int64)
        for batch in batches:
            for tokens in _units(batch.column(0)):
                classes = class_of[tokens]
                sums += np.bincount(np.concatenate([[CLASSES], classes[:-1]]) * side + classes, minlength=side * side)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["at", "n"])

    found = units.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(side * side)
    table[found["at"].to_numpy(np.int64)] = found["n"]
    return table.reshape(side, side)


def score(docs: DataFrame, is_training: Column, key: str = "doc_id", text: str = "text", clustered: int = CLUSTERED, listed: int = LISTED, enough: int = ENOUGH) -> DataFrame:
    """(key, is_training, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key), F.col(text).cast("string").alias("text"), is_training.alias("is_training"))
    training = docs.where("is_training")
    counts = cut(word_counts(training), "lm-counts")
    ends = training.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    top = sorted(((bytes(w), n) for w, n in most_frequent(counts.where(F.length("word") <= LONGEST), listed).collect()), key=lambda x: (-x[1], x[0]))

    words, shapes = [w for w, _ in top], np.array([shape(w) for w, _ in top], np.int64)
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), "is_training").alias("row"), "text")
    table = cut(numbered(rows, words), "lm-units")  # texts are cut into words once
    units = table.where("row.is_training").select("units")

    clustered = len(top[:clustered])
    listed_unit = np.where(np.arange(len(top)) < clustered, np.arange(len(top)), clustered + shapes)
    bigram_rows = unit_bigrams(units, np.concatenate([listed_unit, clustered + np.arange(SHAPES + 1)]).astype(np.int64)).toPandas()
    side = clustered + SHAPES + 1
    bigrams = np.zeros(side * side, np.int64)
    bigrams[bigram_rows["pair"]] = bigram_rows["n"]
    bigrams = bigrams.reshape(side, side)
    own = exchange(bigrams)

    listed_frame = spark.createDataFrame(pa.table({"word": pa.array([w for w, _ in top], pa.binary())}).to_pandas(), "word binary") if top else None
    rare = counts.join(listed_frame, "word", "left_anti") if top else counts
    group_tokens, group_words = np.zeros(SHAPES), np.zeros(SHAPES)
    for s, n, v in rare.groupBy(shape_column(F.col("word")).alias("shape")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        group_tokens[s], group_words[s] = n, v

    listed_n = np.array([n for _, n in top], float)
    listed_class = own[listed_unit] if top else np.zeros(0, np.int64)
    shape_class = own[clustered : clustered + SHAPES]
    whole = lambda: np.concatenate([listed_class, shape_class, [CLASSES]]).astype(np.int64)
    masses = lambda: np.bincount(listed_class, listed_n, CLASSES) + np.bincount(shape_class, group_tokens + 1, CLASSES)
    for _ in range(ROUNDS):
        contexts = cut(word_contexts(units, whole()), "lm-contexts")
        for _ in range(SWEEPS):
            best = sweep(contexts, len(top) + SHAPES, followed(contexts, whole()), masses())
            shape_class = np.where(best[len(top) :] >= 0, best[len(top) :], shape_class)
            listed_class = np.where(listed_n >= enough, best[: len(top)], shape_class[shapes])
    mass, class_of = masses(), whole()
    emit = np.concatenate([np.log10(listed_n / mass[listed_class]) if top else [], np.log10((group_tokens + 1) / mass[shape_class]), [0.0]])
    base = np.concatenate([np.log10((listed_n + 1) / (total + distinct + 1)), np.zeros(SHAPES), [np.log10((ends + 1) / (total + distinct + 1))]])
    steps = transitions(class_pairs(units, class_of))
    shared = spark.sparkContext.broadcast((class_of, emit, base, steps))
    known_end, first_rare = int(ends > 0), len(top)
    names = ["row", "n_tokens", "n_known", "base_score", "score"]

    def tally(batches):
        class_of, emit, base, steps = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                (tokens,) = _units(part.column(1))
                n = pc.binary_length(part.column(1)).to_numpy() // 4
                begins = np.cumsum(n) - n
                classes = class_of[tokens]
                before = np.concatenate([[CLASSES], classes[:-1]])
                sums = [np.add.reduceat(x, begins) for x in ((tokens < first_rare).astype(np.int64), base[tokens], emit[tokens] + steps[before, classes])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sums[0] + known_end), pa.array(sums[1]), pa.array(sums[2])], names)

    kind = table.schema["row"].dataType.simpleString()
    tallied = table.select("row", "units").mapInArrow(tally, f"row {kind}, n_tokens long, n_known long, base_score double, score double")
    groups = spark.createDataFrame([(i, float(group_tokens[i] + group_words[i] + 1)) for i in range(SHAPES)], "shape int, room double")
    spelled = table.select("row.id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("id", F.col("x.words").alias("word"), "x.times")
    held = spelled.groupBy("word").agg(F.count(F.lit(1)).alias("held")).join(counts, "word", "left").select("word", "held", F.coalesce("n", F.lit(0)).alias("c"))
    spelled = join_skewed(spelled, cut(held, "lm-held"), ["word"], "held")  # a word that no training document has may be busy too
    spelled = spelled.select("id", "times", shape_column(F.col("word")).alias("shape"), "c").join(F.broadcast(groups), "shape")
    sum_of = lambda each: F.sum(F.col("times") * each)
    spelled = spelled.groupBy("id").agg(sum_of((F.col("c") > 0).cast("long")).alias("more_known"), sum_of(F.log10((F.col("c") + 1) / F.lit(float(total + distinct + 1)))).alias("more_base"), sum_of(F.log10((F.col("c") + 1) / F.col("room"))).alias("more_score"))
    done = tallied.select("row.*", "n_tokens", "n_known", "base_score", "score").join(spelled, "id", "left")
    more = lambda name, extra: (F.col(name) + F.coalesce(extra, F.lit(0))).alias(name)
    return done.select(F.col("key").alias(key), "is_training", "n_tokens", more("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), more("base_score", "more_base"), more("score", "more_score"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir), ~held_out(F.col("doc_id")))
    return found.select("doc_id", (~F.col("is_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
