"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The words that occur most often in the corpus (counted over all documents, ``lexicon_size`` of them)
are compiled into a minimal deterministic acyclic automaton that shares prefixes and suffixes. Each
transition carries the number of smaller words, so the sum along a word's path is its ordinal, which
points to the word's token ids. The compiled automaton travels as one broadcast of bounded size; each
Python worker puts it into an unlinked file and maps it into memory. Words that it doesn't hold are
merged exactly, pair by pair in rank order. So the ids never depend on the lexicon.

Defined results: null text counts as empty (no ids, empty decoded text); rows are independent, so
ties, repeated rows, clashing extra columns and empty tables need no care; very long texts are
encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, most_frequent

#: Distinct white-space-free chunks that a worker remembers, and counts that it holds before it emits them.
CHUNK_CACHE = 200_000
COUNT_CACHE = 400_000

#: Fixed values of the vocabulary file's format: its pre-tokenizer's pattern and its end-of-word mark.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"

#: Beyond all ids and all ranks.
PAD, NO_RANK = (1 << 20) - 1, 1 << 30

#: Code points that Python's split() takes as white space and the vocabulary's normalizer doesn't.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
WHITE = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    names = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [names[b] for b in range(256)]


def normalize(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # each character by itself: no final form
        return "".join(map(str.lower, text))
    return text.lower()


def chunks(normal: str) -> list[str]:
    if SEPARATORS.search(normal):
        return WHITE.findall(normal)
    return normal.split()


class Vocabulary:
    """Vocabulary and merges of a word-end BPE file (as bytes of JSON)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None
        self.symbols = byte_symbols()
        self.tables = None

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-token: the best-ranked pair first, of equals the leftmost.

        A heap of pairs over a linked list, so long words take n log n steps.
        """
        parts = [self.symbols[b] for b in word]
        parts[-1] += WORD_END
        count, ranks = len(parts), self.ranks
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(count - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= count or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = k = after[j]
            if k < count:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [self.ids[p] for p in parts if p in self.ids]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words at once: short ones in step, a merge of each at a time."""
        found: list = [None] * len(words)
        for low, high in ((0, 6), (6, 12), (12, 24)):
            at = [i for i, w in enumerate(words) if low < len(w) <= high]
            if at:
                for i, ids in zip(at, self._merge_in_step([words[i] for i in at], high), strict=True):
                    found[i] = ids
        return [self.merge(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _tables(self):
        """Ids of bytes inside and at the end of words; sorted pairs of ids with their ranks and results."""
        ids = self.ids
        inner = np.array([ids[s] for s in self.symbols], np.int32)
        last = np.array([ids[s + WORD_END] for s in self.symbols], np.int32)
        keys = np.array([ids[a] << 20 | ids[b] for a, b in self.ranks], np.int64)
        results = np.array([ids[a + b] for a, b in self.ranks], np.int32)
        order = np.argsort(keys)
        ranks = np.array(list(self.ranks.values()), np.int32)[order]
        return inner, last, np.append(keys[order], 1 << 62), np.append(ranks, np.int32(NO_RANK)), np.append(results[order], np.int32(-1))

    def _merge_in_step(self, words: list[bytes], width: int) -> list[list[int]]:
        if self.tables is None:
            self.tables = self._tables()
        inner, last, keys, ranks, results = self.tables
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        row = np.arange(len(words))
        ids = inner[raw]
        ids[row, size - 1] = last[raw[row, size - 1]]
        ids[np.arange(width) >= size[:, None]] = PAD
        ids = np.concatenate([ids, np.full((len(words), 1), PAD, np.int32)], 1)

        def look(a, b):
            wanted = a.astype(np.int64) << 20 | b
            at = np.searchsorted(keys, wanted)
            return np.where(keys[at] == wanted, at, len(keys) - 1).astype(np.int32)

        pair = look(ids[:, :-1], ids[:, 1:])
        rank = ranks[pair]
        place = np.arange(width + 1)
        out: list = [None] * len(words)
        while True:
            best = rank.argmin(1)
            going = rank[np.arange(len(row)), best] < NO_RANK
            for i, x in zip(row[~going].tolist(), ids[~going].tolist(), strict=True):
                out[i] = x[: x.index(PAD)]
            if not going.any():
                return out
            row, ids, pair, rank, best = row[going], ids[going], pair[going], rank[going], best[going]
            at = np.arange(len(row))
            ids[at, best] = results[pair[at, best]]
            shift = np.minimum(place + (place > best[:, None]), width)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = PAD
            pair = np.take_along_axis(pair, shift[:, :-1] - (shift[:, :-1] == width), 1)
            pair[:, -1] = len(keys) - 1
            pair[at, best] = look(ids[at, best], ids[at, best + 1])
            left = np.maximum(best - 1, 0)
            pair[at, left] = look(ids[at, left], ids[at, left + 1])
            rank = ranks[pair]

    def decode(self, ids) -> str:
        """The vocabulary file has no decoder: tokens are joined by spaces."""
        return " ".join(self.tokens[int(i)] for i in ids)


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer of the words, as bytes: words in order, equal tails shared."""
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path = [0]  # states along the last word
    previous = b""

    def settle(depth: int) -> None:
        """Replace the states below ``depth`` of the last word by registered equals."""
        while len(path) > depth + 1:
            state = path.pop()
            key = (final[state], tuple(edges[state].items()))
            same = register.setdefault(key, state)
            edges[path[-1]][previous[len(path) - 1]] = same

    ordered = sorted(entries)
    for word in ordered:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        settle(common)
        for label in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][label] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        previous = word
    settle(0)

    number, stack, order = {}, [0], []
    while stack:  # states that are still reachable, numbered
        state = stack.pop()
        if state not in number:
            number[state] = len(order)
            order.append(state)
            stack.extend(edges[state].values())
    reach: dict[int, int] = {}  # words below each state, its targets first
    for start in order:
        waiting = [start]
        while waiting:
            state = waiting[-1]
            missing = [t for t in edges[state].values() if t not in reach]
            if missing:
                waiting.extend(missing)
            else:
                reach[state] = final[state] + sum(reach[t] for t in edges[state].values())
                waiting.pop()

    first, labels, targets, outputs = [0], bytearray(), [], []
    for state in order:
        below = int(final[state])
        for label in sorted(edges[state]):
            target = edges[state][label]
            labels.append(label)
            targets.append(number[target])
            outputs.append(below)
            below += reach[target]
        first.append(len(labels))
    ids = [entries[w] for w in ordered]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    blocks = [
        np.array(first, np.uint32).tobytes(),
        np.array(targets, np.uint32).tobytes(),
        np.array(outputs, np.uint32).tobytes(),
        offsets.astype(np.uint32).tobytes(),
        np.array([i for x in ids for i in x], np.uint32).tobytes(),
        bytes(final[s] for s in order),
        bytes(labels),
    ]
    return struct.pack("<7I", *map(len, blocks)) + b"".join(blocks)


class Lexicon:
    """A compiled transducer, mapped from an unlinked file of this worker."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(compiled)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes, at, views = struct.unpack_from("<7I", self.map), 28, []
        for size in sizes[:5]:
            views.append(memoryview(self.map)[at : at + size].cast("I"))
            at += size
        self.first, self.targets, self.outputs, self.offsets, self.ids = views
        self.final = memoryview(self.map)[at : at + sizes[5]]
        self.labels_at = at + sizes[5]
        self.steps = None

    def get(self, word: bytes) -> list[int] | None:
        state, ordinal, at, find = 0, 0, self.labels_at, self.map.find
        for i in range(len(word)):
            edge = find(word[i : i + 1], at + self.first[state], at + self.first[state + 1]) - at
            if edge < 0:
                return None
            ordinal += self.outputs[edge]
            state = self.targets[edge]
        if not word or not self.final[state]:
            return None
        return list(self.ids[self.offsets[ordinal] : self.offsets[ordinal + 1]])

    def get_many(self, words: list[bytes]) -> list[list[int] | None]:
        """``get`` of many words at once: all walk in step, a byte of each at a time."""
        if self.steps is None:
            first = np.frombuffer(self.first, np.uint32).astype(np.int64)
            labels = np.frombuffer(self.map, np.uint8, len(self.targets), self.labels_at)
            keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) << 8 | labels  # in order: states, and labels of a state
            self.steps = np.append(keys, 1 << 62), *(np.append(np.frombuffer(x, np.uint32).astype(np.int64), 0) for x in (self.targets, self.outputs))
        keys, targets, outputs = self.steps
        size = np.fromiter(map(len, words), np.int64, len(words))
        row = np.argsort(-size, kind="stable")
        raw, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, ordinal = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        depth = 0
        row = row[size[row] > 0]
        while len(row):
            wanted = state[row] << 8 | raw[begin[row] + depth]
            edge = np.searchsorted(keys, wanted)
            there = keys[edge] == wanted
            state[row[~there]] = -1
            row, edge = row[there], edge[there]
            ordinal[row] += outputs[edge]
            state[row] = targets[edge]
            depth += 1
            row = row[size[row] > depth]
        final = np.frombuffer(self.final, np.uint8)
        held = (state >= 0) & (size > 0)
        held[held] = final[state[held]] > 0
        ids, offsets = self.ids, self.offsets
        return [ids[offsets[o] : offsets[o + 1]].tolist() if h else None for o, h in zip(ordinal.tolist(), held.tolist(), strict=True)]


class Numbers(dict):
    """Numbers of chunks and pieces; what is asked for the first time gets the next."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self)
        self.fresh.append(name)
        return number


class Codec:
    """Encodes whole texts; remembers a bounded number of chunks."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids: list[bytes] = []
        self.decoded: list[str] = []

    def learn(self) -> None:
        """Encode what has a number and no ids yet; a piece that makes up a chunk or comes again has one number."""
        known, ids, decoded = self.known, self.ids, self.decoded
        fresh, start = known.fresh, len(ids)
        alone, several = [], []
        for number, chunk in enumerate(fresh, start):  # pieces of chunks are numbered meanwhile, and come later
            if chunk.isascii() and chunk.isalpha():
                alone.append(number)
                continue
            pieces = PATTERN.findall(chunk)
            if len(pieces) == 1:
                alone.append(number)
            else:
                several.append((number, [known[p] for p in pieces]))
        words = [fresh[i - start].encode() for i in alone]
        found = self.lexicon.get_many(words) if self.lexicon else [None] * len(words)
        rest = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(rest, self.vocabulary.merge_many([words[i] for i in rest]), strict=True):
            found[i] = x
        ids += [b""] * len(fresh)
        decoded += [""] * len(fresh)
        token = self.vocabulary.tokens.__getitem__
        for number, x in zip(alone, found, strict=True):
            ids[number] = struct.pack(f"<{len(x)}I", *x)
            decoded[number] = token(x[0]) if len(x) == 1 else " ".join(map(token, x))
        for number, pieces in several:
            ids[number] = b"".join([ids[i] for i in pieces])
            decoded[number] = " ".join(filter(None, [decoded[i] for i in pieces]))
        fresh.clear()

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, text decoded from the ids) of each text."""
        vocabulary = self.vocabulary
        if len(self.known) > CHUNK_CACHE:
            self.forget()
        number = self.known.__getitem__
        split = []
        for text in texts:
            if vocabulary.special_split and "<|" in text:
                parts = [p for p in vocabulary.special_split.split(text) if p]
            else:
                parts = [text]
            split.append([(p, None) if p in vocabulary.special else (None, list(map(number, chunks(normalize(p))))) for p in parts])
        self.learn()
        all_ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        out = []
        for parts in split:
            ids, words = [], []
            for special, numbers in parts:
                if special:
                    ids.append(struct.pack("<I", vocabulary.special[special]))
                    words.append(special)
                else:
                    ids += map(all_ids, numbers)
                    words += map(decoded, numbers)
            out.append((b"".join(ids), " ".join(filter(None, words))))
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_many([text])[0]


_codecs: dict[str, Codec] = {}


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): pre-tokens of all texts; each task adds up its own before anything is shuffled."""

    def count(batches):
        held: Counter = Counter()

        def emit():
            pieces: Counter = Counter()
            for chunk, n in held.items():
                for piece in PATTERN.findall(chunk):
                    pieces[piece] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pieces.keys(), pa.string()), pa.array(pieces.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.update(chunks(normalize(value.as_py() or "")))
                if len(held) > COUNT_CACHE:
                    yield emit()
        yield emit()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, vocabulary: Vocabulary, lexicon_size: int, text: str = "text") -> bytes:
    """Compile the most frequent words of all documents, ``lexicon_size`` at most."""
    top = most_frequent(cut(word_counts(docs, text), "lexicon-counts"), lexicon_size).select("word").collect()
    return compile_lexicon({w.encode(): vocabulary.merge(w.encode()) for (w,) in top})


def encode_documents(docs: DataFrame, vocabulary_path: str, lexicon_size: int = 32768, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded): ids are little-endian unsigned 32-bit integers."""
    return _run(docs, vocabulary_path, lexicon_size, key, text, "ids binary, decoded string", lambda ids, decoded: (ids, decoded))


def encode_digests(docs: DataFrame, vocabulary_path: str, lexicon_size: int = 32768, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each document."""

    def digest(ids: bytes, decoded: str):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _run(docs, vocabulary_path, lexicon_size, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _run(docs, vocabulary_path, lexicon_size, key, text, schema, row):
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as file:
        raw = file.read()
    shared = spark.sparkContext.broadcast((raw, fit_lexicon(docs, Vocabulary(raw), lexicon_size, text)))
    token = uuid.uuid4().hex
    out_schema = f"{key} {docs.schema[key].dataType.simpleString()}, {schema}"
    types = [f.dataType.simpleString() for f in spark.createDataFrame([], out_schema).schema][1:]
    arrow = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def encode(batches):
        codec = _codecs.get(token)
        if codec is None:
            _codecs.clear()
            raw, compiled = shared.value
            codec = _codecs[token] = Codec(Vocabulary(raw), Lexicon(compiled))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [row(*x) for x in codec.encode_many([t or "" for t in part.column(1).to_pylist()])]
                columns = [pa.array([r[i] for r in rows], arrow[t]) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, *names])

    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select(F.col(key), F.col(text).cast("string").alias("text_to_encode")).mapInArrow(encode, out_schema)


def op10_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
