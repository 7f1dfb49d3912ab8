"""Token counts per section or field by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' spans are joined with the spans of its sections
(an interval join in the task: both are sorted, so each token finds its section by binary search).
A token that crosses a section's end goes by an explicit rule:

* ``first``: to the section that holds its first character (a character split over several tokens
  counts for each of them), so sections add up to the document's tokens;
* ``last``: to the section that holds its last character;
* ``share``: to each section the fraction of the token's bytes that lie in it.

Sections are lines with their line feed; fields are joined by a separator that belongs to the field
before it. Defined results: null or empty text has one empty section 0 without tokens; a null field
counts as empty; rows with null keys are kept; repeated rows give repeated results; whole texts count.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

RULES = ("first", "last", "share")

_encoders: dict[str, tuple] = {}


def build_encoder(ranks_file: bytes, pattern: str):
    """(encoding, byte length of each token id) of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding(uuid.uuid4().hex, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_ends(text: str, encoder) -> np.ndarray:
    """Byte offsets of the tokens' ends in the UTF-8 of the text."""
    encoding, lengths = encoder
    if not text:
        return np.zeros(0, np.int64)
    return np.cumsum(lengths[encoding.encode_to_numpy(text, disallowed_special=())])


def allocate(ends: np.ndarray, section_starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per section, tokens that begin in the section and end beyond it).

    ``ends`` are the tokens' ends, ``section_starts`` the sections' starts; both in bytes and rising,
    each covering the text without gaps. Of sections that start at one place all but the last are empty.
    """
    count = len(section_starts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(section_starts, starts, "right") - 1
    last = np.searchsorted(section_starts, ends - 1, "right") - 1
    crossing = np.bincount(first[first != last], minlength=count)
    if rule == "first":
        return np.bincount(first, minlength=count), crossing
    if rule == "last":
        return np.bincount(last, minlength=count), crossing
    inside = first == last
    shares = np.bincount(first[inside], minlength=count).astype(float)
    for a, b, x, y in zip(starts[~inside], ends[~inside], first[~inside], last[~inside], strict=True):
        cuts = np.concatenate([[a], section_starts[x + 1 : y + 1], [b]])
        shares[x : y + 1] += np.diff(cuts) / (b - a)
    return shares, crossing


def _with_encoder(spark: SparkSession, ranks_path: str, pattern: str):
    """A function that gives each Python worker its encoder; the rank file travels by broadcast."""
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    token = uuid.uuid4().hex

    def encoder():
        if token not in _encoders:
            _encoders.clear()
            _encoders[token] = build_encoder(shared.value, pattern)
        return _encoders[token]

    return encoder


def _check(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, char_start, char_end, n_tokens, n_crossing) for each line of each text."""
    _check(rule)
    encoder = _with_encoder(docs.sparkSession, ranks_path, pattern)
    number = "double" if rule == "share" else "long"
    names = [key, "section", "char_start", "char_end", "n_tokens", "n_crossing"]

    def attribute(batches):
        own = encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                columns, sizes = [[], [], [], [], []], []
                for value in part.column(1):
                    content = value.as_py() or ""
                    raw = np.frombuffer(content.encode(), np.uint8)
                    begins = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
                    if len(begins) > 1 and begins[-1] == len(raw):
                        begins = begins[:-1]
                    counts, crossing = allocate(token_ends(content, own), begins, rule)
                    chars = begins
                    if len(raw) != len(content):
                        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[begins]
                    sizes.append(len(begins))
                    for held, x in zip(columns, (np.arange(len(begins)), chars, np.append(chars[1:], len(content)), counts, crossing), strict=True):
                        held.append(x)
                keys = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                types = [np.int64, np.int64, np.int64, float if rule == "share" else np.int64, np.int64]
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(c).astype(t)) for c, t in zip(columns, types, strict=True))], names)

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, section long, char_start long, char_end long, n_tokens {number}, n_crossing long"
    return docs.select(F.col(key), F.col(text).cast("string").alias("text_to_count")).mapInArrow(attribute, schema)


def field_tokens(rows: DataFrame, fields: list[str], ranks_path: str, pattern: str, separator: str = "\n", rule: str = "first", key: str = "doc_id") -> DataFrame:
    """(key, field, n_tokens, n_crossing): the fields of a row are joined by the separator and encoded once."""
    _check(rule)
    encoder = _with_encoder(rows.sparkSession, ranks_path, pattern)
    number = "double" if rule == "share" else "long"

    def attribute(batches):
        own = encoder()
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [batch.column(k + 1)[i].as_py() or "" for k in range(len(fields))]
                parts[:-1] = [p + separator for p in parts[:-1]]
                sizes = [len(p.encode()) for p in parts]
                counts, crossing = allocate(token_ends("".join(parts), own), np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64), rule)
                keys = batch.column(0).take(pa.array(np.zeros(len(fields), np.int64) + i))
                yield pa.RecordBatch.from_arrays([keys, pa.array(fields), pa.array(counts), pa.array(crossing)], [key, "field", "n_tokens", "n_crossing"])

    texts: list[Column] = [F.col(f).cast("string").alias(f"field_{k}") for k, f in enumerate(fields)]
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, field string, n_tokens {number}, n_crossing long"
    return rows.select(F.col(key), *texts).mapInArrow(attribute, schema)


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
