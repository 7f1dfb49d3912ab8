"""Two tokenizers over the same texts, aligned by a dangling-suffix transducer.

Both token sequences spell the same bytes. The transducer reads them in turn and remembers only which side leads and by
which bytes: the residual. The side that lags reads its next token, which takes from the residual, ends it, or
overtakes it; then the lead changes. When the residual is empty both sides have ended at one place: a group is closed.
A state is an interned residual with its side, so there are no more of them than suffixes of tokens; transitions are memoised
by state and next token, so frequent pairs cost a look-up.

The last tokens of a group end together: they are linked. ``pair_counts`` counts each pair of ids over the corpus;
``link_totals`` meets each document's links with these counts: the ``KNOWN`` most frequent pairs go to the workers as a
broadcast of that bounded size, all others by a join in which none of them is frequent.

Defined results: null and empty texts have no tokens; so do texts that a tokenizer doesn't give back byte for byte (one
that replaces characters, say), since their tokens can't be aligned. Rows with null keys are kept, repeated rows give
repeated results (and count twice), whole texts of any length are encoded, other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, documents, most_frequent

#: Most frequent pairs that go by broadcast.
KNOWN = 131_072
#: Transitions that a worker remembers.
MEMO = 200_000
#: Characters that are encoded at a time (a longer text by itself), and rows that are aligned at a time.
PART_CHARS, PART_ROWS = 1 << 18, 250
#: Rows that Spark hands to a worker at a time.
BATCH_ROWS = 1000

#: Letters, numbers and white space up to U+024F, and further characters that are neither.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t\n\r"
PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u205e]*")
#: Fixed value: how byte-level tokenizers cut a text into words.
BYTE_LEVEL_WORDS = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
TWO_BYTES = re.compile("[\x01-\u07ff]*")

GROUPS = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"

_sides: dict[str, tuple] = {}


class Mismatch(Exception):
    """The two sequences don't spell the same bytes."""


class _Moves(dict):
    """Where each next token leads from one state; what isn't known is worked out."""

    __slots__ = ("state", "of")

    def __init__(self, state: int, of: Transducer):
        self.state, self.of = state, of

    def __missing__(self, token: int) -> int:
        return self.of.move(self.state, token)


class _States(dict):
    """The moves of each state that was ever reached."""

    def __init__(self, of: Transducer):
        self.of = of

    def __missing__(self, state: int) -> _Moves:
        self[state] = moves = _Moves(state, self.of)
        return moves


class Transducer:
    """States: 0 when nothing is left over, else even numbers where A leads and odd ones where B leads."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], memo: int = MEMO):
        if not all(a_bytes) or not all(b_bytes):
            raise ValueError("every token must have bytes")
        self.a, self.b, self.memo, self.remembered = a_bytes, b_bytes, memo, 0
        self.residual: list[bytes] = [b"", b""]
        self.moves = _States(self)
        self.interned: dict[bytes, int] = {}
        self.first = [self.state(token, 0) for token in a_bytes]

    def state(self, residual: bytes, side: int) -> int:
        if not residual:
            return 0
        number = self.interned.get(residual)
        if number is None:
            number = self.interned[residual] = len(self.residual)
            self.residual += [residual, residual]
        return number + side

    def move(self, state: int, token: int) -> int:
        """Where the lagging side's next token leads."""
        side = state & 1
        held, read = self.residual[state], (self.a if side else self.b)[token]
        if held.startswith(read):
            after = self.state(held[len(read) :], side)
        elif read.startswith(held):
            after = self.state(read[len(held) :], 1 - side)
        else:
            raise Mismatch
        if self.remembered >= self.memo:  # each state forgets the older half
            for known in self.moves.values():
                for old in list(islice(known, (len(known) + 1) // 2)):
                    del known[old]
            self.remembered = sum(map(len, self.moves.values()))
        self.moves[state][token] = after
        self.remembered += 1
        return after

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """(tokens of A, tokens of B) up to the end of each group; ``Mismatch`` if the bytes differ."""
        moves, first = self.moves, self.first
        a_ends, b_ends = [], []
        end_a, end_b = a_ends.append, b_ends.append
        j = state = 0
        try:
            for i, token in enumerate(a, 1):
                state = moves[state][token] if state else first[token]
                while state and not state & 1:
                    state = moves[state][b[j]]
                    j += 1
                if not state:
                    end_a(i)
                    end_b(j)
        except IndexError:  # B ends while A has bytes left
            raise Mismatch from None
        if state or j < len(b):
            raise Mismatch
        return a_ends, b_ends


def byte_level_bytes(entries: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    found = [b""] * (max(entries.values()) + 1)
    for entry, number in entries.items():
        found[number] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return found


def byte_level(file: bytes) -> tuple[Callable, list[bytes]]:
    """(encode texts after a space: (ids, are their bytes the text's for sure?), bytes of each id) of a byte-level tokenizer; strings of special tokens are plain text.

    Texts of ``PLAIN`` characters, whose kinds no version of Unicode disputes, go through a faster engine for the same ids: it merges
    the pair of the lowest id, which is the pair of the first merge, since each entry is what its own bytes are merged to
    (a test holds this for every entry). All other texts, and files whose merges aren't numbered in order, go through the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(file.decode())
    own.no_padding()
    own.no_truncation()
    own.encode_special_tokens = True
    entries, merges = own.get_vocab(with_added_tokens=False), json.loads(file)["model"]["merges"]
    spelled = byte_level_bytes(own.get_vocab(with_added_tokens=True))
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    ordered = [entries["".join(p)] for p in pairs]
    fast = None
    if ordered == sorted(ordered) and min(ordered, default=0) >= 256:
        ranks = {spelled[i]: i for entry, i in entries.items() if entry not in special}
        fast = tiktoken.Encoding(uuid.uuid4().hex, pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def each(texts: list[str]) -> list[tuple[list[int], bool]]:
        return [(fast(" " + t), True) if fast and PLAIN.fullmatch(t) else (own.encode(" " + t, add_special_tokens=False).ids, False) for t in texts]

    return each, spelled


def pieces(file: bytes) -> tuple[Callable, list[bytes]]:
    """(encode texts, bytes of each id) of a piece model, which puts the space before the text itself.

    Such a model merges the pair of neighbours whose joined piece scores best, beginning with characters; characters without a piece
    are bytes. Texts of characters of up to two bytes go through a faster engine that does the same from bytes, with the characters' own
    bytes merged before all else; that needs a model that changes no text, whose pieces score in order and have a space only in front
    (but for pieces of spaces alone, which may tie: texts with two spaces in a row go elsewhere).
    All other texts and models go through the library itself.
    """
    import sentencepiece
    import tiktoken

    own = sentencepiece.SentencePieceProcessor(model_proto=file)
    size = own.get_piece_size()
    byte_id = {int(own.id_to_piece(i)[3:5], 16): i for i in range(size) if own.is_byte(i)}
    spelled = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
    said = lambda ids: b"".join(map(spelled.__getitem__, ids))
    normal = sorted((i for i in range(size) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i))), key=lambda i: (-own.get_score(i), i))
    short = {c: i for i in normal for c in [own.id_to_piece(i).replace("▁", " ")] if len(c) == 1 and ord(c) < 0x800}
    probes = [chr(c) for c in range(1, 0x800) if c not in (0x2581,)] + ["a  b", " a", "a ", "\n\n", "\t \r", "x   "]
    longer = [i for i in normal if len(own.id_to_piece(i)) > 1 and spelled[i].strip(b" ")]
    scores = [own.get_score(i) for i in longer]
    fit = len(byte_id) == 256 and not any(re.search(b"[^ ] ", s) for s in spelled) and len(set(scores)) == len(scores) and all(said(own.encode(p)) == b" " + p.encode() for p in probes)
    if not fit:
        return lambda texts: own.encode(texts, num_threads=1), spelled
    ranks, ids = {}, []
    for byte in range(256):
        ranks[bytes([byte])] = len(ids)
        ids.append(short.get(chr(byte), byte_id[byte]) if byte < 128 else byte_id[byte])
    for c, i in short.items():
        if ord(c) > 127:
            ranks[c.encode()] = len(ids)
            ids.append(i)
    for i in longer:
        ranks[spelled[i]] = len(ids)
        ids.append(i)
    fast = tiktoken.Encoding(uuid.uuid4().hex, pat_str=" +[^ ]*", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    told = ids.__getitem__

    def each(texts: list[str]) -> list[list[int]]:
        return [list(map(told, fast(" " + t))) if t and "  " not in t and t[0] != " " and TWO_BYTES.fullmatch(t) else own.encode(t) for t in texts]

    return each, spelled


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > PART_CHARS:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def align_texts(texts: list[str], sides: tuple) -> Iterator[tuple]:
    """(ids of A, ids of B, ends of the groups in A, in B) of each text; all empty where the tokens don't spell a space and the text."""
    (encode_a, bytes_a), (encode_b, _), transducer = sides
    for part in _parts(texts):
        for text, (a, sure), b in zip(part, encode_a(part), encode_b(part), strict=True):
            try:
                if text and (sure or b"".join(map(bytes_a.__getitem__, a)) == b" " + text.encode()):
                    yield (a, b, *transducer.align(a, b))
                    continue
            except Mismatch:
                pass
            yield [], [], [], []


def _lists(rows: tuple[list[int], ...]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))))


def _sizes(ends: pa.ListArray) -> pa.ListArray:
    """How far each end of a list is from the one before."""
    flat, offsets = ends.values.to_numpy(), ends.offsets.to_numpy()
    sizes = np.diff(flat, prepend=np.int32(0))
    heads = offsets[:-1][np.diff(offsets) > 0]
    sizes[heads] = flat[heads]
    return pa.ListArray.from_arrays(ends.offsets, pa.array(sizes, pa.int32()))


def token_groups(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a_ids, b_ids, a_sizes, b_sizes): the tokens of a text and how many of them are in each group.

    ``a_path``: a byte-level tokenizer's file, ``b_path``: a piece model's; their content travels by broadcast.
    """
    spark, contents = docs.sparkSession, []
    for path in (a_path, b_path):
        with open(path, "rb") as file:
            contents.append(file.read())
    shared, token = spark.sparkContext.broadcast(contents), uuid.uuid4().hex
    names = [key, "a_ids", "b_ids", "a_sizes", "b_sizes"]

    def work(batches: Iterator[pa.RecordBatch]):
        if token not in _sides:
            a, b = byte_level(shared.value[0]), pieces(shared.value[1])
            _sides.clear()
            _sides[token] = (a, b, Transducer(a[1], b[1]))
        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                columns = [_lists(c) for c in zip(*align_texts([t or "" for t in part.column(1).to_pylist()], _sides[token]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns[:2], *map(_sizes, columns[2:])], names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text_to_align")).mapInArrow(work, f"`{key}` {kind}, {GROUPS}")


def links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(a << 32 | b of each link, where each row's links end) of a batch with the columns of ``token_groups``."""
    flat = lambda name: np.asarray(batch.column(name).flatten(), np.int64)
    a, b = (flat(f"{side}_ids")[np.cumsum(flat(f"{side}_sizes")) - 1] for side in "ab")
    sizes = np.asarray(batch.column("a_sizes").value_lengths().fill_null(0), np.int64)
    return a << 32 | b, np.cumsum(sizes)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(start, PART_ROWS)


def _pair_columns(pairs: np.ndarray) -> list[pa.Array]:
    return [pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32))]


def pair_counts(groups: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links hold the pair, and whether no other partner of ``b`` has more."""

    def count(batches):
        for part in _slices(batches):
            pairs, n = np.unique(links(part)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([*_pair_columns(pairs), pa.array(n, pa.int64())], ["a", "b", "n"])

    counted = groups.select("a_ids", "b_ids", "a_sizes", "b_sizes").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))  # no more rows to a ``b`` than A has ids


class Digests:
    """Hashes of rows' groups, written as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self):
        self.ends = np.zeros(0, object)  # each number with a comma, a bar, a semicolon after it

    def of(self, batch: pa.RecordBatch) -> list[str]:
        ids, sizes = ([np.asarray(batch.column(f"{side}_{what}").flatten(), np.int64) for side in "ab"] for what in ("ids", "sizes"))
        if not len(ids[0]):
            return [""] * batch.num_rows
        most = int(max(x.max() for x in ids)) + 1
        if most * 3 > len(self.ends):
            self.ends = np.array([f"{number}{mark}" for number in range(most) for mark in ",|;"], object)
        before = [np.cumsum(x) - x for x in sizes]
        code = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k in (0, 1):  # a token's place: those of its group before it, and both sides' of all groups before
            group = np.repeat(np.arange(len(sizes[k])), sizes[k])
            shift = before[1 - k] + (sizes[0] if k else 0)
            last = np.zeros(len(ids[k]), np.int64)
            last[np.cumsum(sizes[k]) - 1] = k + 1
            code[np.arange(len(group)) + shift[group]] = ids[k] * 3 + last
        written = self.ends[code].tolist()
        stops = np.cumsum(sum(np.asarray(batch.column(f"{side}_ids").value_lengths(), np.int64) for side in "ab")).tolist()
        return [hashlib.sha256("".join(written[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip([0, *stops], stops, strict=False)]


def link_totals(groups: DataFrame, counts: DataFrame, key: str = "doc_id", known: int = KNOWN) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of groups with a column ``row`` that is different in each row."""
    spark = groups.sparkSession
    frequent = most_frequent(counts, known).select("a", "b", "n", "best").toArrow()  # ``known`` pairs at most
    pairs = frequent["a"].to_numpy().astype(np.int64) << 32 | frequent["b"].to_numpy()
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], frequent["n"].to_numpy()[order], frequent["best"].to_numpy()[order]))

    def look_up(pairs: np.ndarray):
        own, n, best = shared.value
        if not len(own):
            return np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = np.minimum(np.searchsorted(own, pairs), len(own) - 1)
        hit = own[at] == pairs
        return hit, np.where(hit, n[at], 0), (hit & best[at]).astype(np.int64)

    names = [key, "row", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups_sha256", "rare"]

    def total(batches):
        digests = Digests()
        for part in _slices(batches):
            found, ends = links(part)
            hit, n, best = look_up(found)
            sums = [np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]])) for x in (best, n)]
            sizes = [part.column(c).value_lengths().cast(pa.int64()) for c in ("a_ids", "b_ids", "a_sizes")]
            left = np.concatenate([[0], np.concatenate([[0], np.cumsum(~hit)])[ends]]).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(left), pa.array(found[~hit]))
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("row"), *sizes, *(pa.array(x, pa.int64()) for x in sums), pa.array(digests.of(part), pa.string()), rare], names)

    kind = groups.schema[key].dataType.simpleString()
    totals = cut(groups.mapInArrow(total, f"`{key}` {kind}, row long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string, rare array<long>"), "alignment-totals")
    others = totals.select("row", F.explode("rare").alias("pair")).select("row", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b")).join(counts, ["a", "b"])
    others = others.groupBy("row").agg(F.sum("n").alias("more"), F.count_if("best").alias("more_best"))
    more = lambda column, extra: (F.col(column) + F.coalesce(extra, F.lit(0))).alias(column)
    return totals.join(others, "row", "left").select(key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), more("n_best", F.col("more_best")), more("count_sum", F.col("more")), "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_groups(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    with arrow_rows(spark, BATCH_ROWS):  # a row holds all tokens of a document
        groups = cut(found.withColumn("row", F.monotonically_increasing_id()), "alignment-groups")
        return link_totals(groups, cut(pair_counts(groups), "alignment-counts"))
