"""Groups, links and counts against byte offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assetloom.llm import alignment
from assetloom.llm.alignment import Mismatch, Transducer

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spelled_a(entries):
    """By the rule in which printable bytes stand for themselves."""
    chars, extra = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            chars[chr(byte)] = byte
        else:
            chars[chr(256 + extra)] = byte
            extra += 1
    return {i: bytes(chars[c] for c in entry) for entry, i in entries.items() if i < 50256}


@pytest.fixture(scope="module")
def own():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    of_a = spelled_a(a.get_vocab())
    of_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(32000)]
    return a, b, of_a, of_b


def cuts(tokens):
    ends, at = [], 0
    for t in tokens:
        at += len(t)
        ends.append(at)
    return ends


def brute_force(docs, own):
    a, b, of_a, of_b = own
    rows, count, by_b = [], Counter(), defaultdict(int)
    for doc, text in docs:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or not b"".join(of_a[i] for i in x) == b"".join(of_b[i] for i in y) == (" " + text).encode():
            rows.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = cuts([of_a[i] for i in x]), cuts([of_b[i] for i in y])
        both = sorted(set(ends_a) & set(ends_b))
        links = [(x[ends_a.index(e)], y[ends_b.index(e)]) for e in both]
        groups, before = [], 0
        for e in both:
            groups.append((",".join(str(t) for t, z in zip(x, ends_a, strict=True) if before < z <= e), ",".join(str(t) for t, z in zip(y, ends_b, strict=True) if before < z <= e)))
            before = e
        count.update(links)
        rows.append((doc, x, y, groups, links))
    for (_, t), n in count.items():
        by_b[t] = max(by_b[t], n)
    out = []
    for doc, x, y, groups, links in rows:
        text = ";".join("|".join(g) for g in groups)
        out.append((doc, len(x), len(y), len(groups), len(links), sum(count[k] == by_b[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "▁x y"), (6, "tab\tand\n\nlines  "), (7, "<|endoftext|> and </s> <s> <unk> <0x41>"), (8, "naïve 你好 \U0001f600 ١"),
    (9, " 　 x"), (9, "same id, other text"), (None, "no id"), (10, "x" * 5000), (11, "the cat " * 3000), (12, "\x00\x01 control"), (13, "é ﬁ Å"), (14, "the cat"), (14, "the cat"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit("x"), "row": F.lit(1), "n": F.lit(None)})


def totals(spark, docs, known, key="doc_id"):
    groups = alignment.cut(alignment.token_groups(docs, A_PATH, B_PATH, key).withColumn("row", F.monotonically_increasing_id()), "test")
    return alignment.link_totals(groups, alignment.cut(alignment.pair_counts(groups), "test"), key, known)


def test_whole_table(spark, own):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op11_alignment(spark, SF)
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(docs, own)


@pytest.mark.parametrize("known", [0, 5, 100_000])
def test_odd_texts(spark, own, known):
    """The same whether pairs come by broadcast, by the join or by both."""
    assert sorted(map(tuple, totals(spark, frame(spark, ODD), known).collect()), key=str) == brute_force(ODD, own)


def test_text_keys_and_empty_table(spark):
    docs = spark.createDataFrame([("k", "some words"), ("", None)], "name string, text string")
    found = {r["name"]: r["n_a"] for r in totals(spark, docs, 10, "name").collect()}
    assert found["k"] > 0 and found[""] == 0
    assert totals(spark, frame(spark, []), 10).collect() == []


def test_groups_are_the_operators_output(spark, own):
    _, _, of_a, of_b = own
    for r in alignment.token_groups(frame(spark, ODD), A_PATH, B_PATH).collect():
        i = j = 0
        for n, m in zip(r["a_sizes"], r["b_sizes"], strict=True):
            assert b"".join(of_a[t] for t in r["a_ids"][i : i + n]) == b"".join(of_b[t] for t in r["b_ids"][j : j + m])
            i, j = i + n, j + m
        assert (i, j) == (len(r["a_ids"]), len(r["b_ids"]))


def test_fast_engines_give_the_tokenizers_own_ids(own):
    """Texts of all kinds of characters against the libraries on whole texts."""
    a, b, _, _ = own
    rng = random.Random(8)
    alphabets = ["ab 'st", "ab  \n\t\r", "aé'ß ²½1-", "a… “x” — ", "a\u00a0\u0085\u2028 b", "x\x1c\x1d y", "你 ▁a", "'ll've'd're A1 ", "!?.,;' aB9", "éÈñÿĀſƀɏ a", "αωЖя שء", "\x01\x02\x7f\x80\x9f a", "    a", "the and of to in that is ", "eeeea aaee"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for alphabet in alphabets for _ in range(60)]
    texts += [chr(c) + "a" + chr(c) + " " + chr(c) for c in range(1, 0x810)] + ["a" * 3000, "ab" * 2000, " " * 1000, "\x00", "x\x00y"]
    for make, path, whole in ((alignment.byte_level, A_PATH, lambda t: a.encode(" " + t, add_special_tokens=False).ids), (alignment.pieces, B_PATH, b.encode)):
        with open(path, "rb") as file:
            encode, spelled = make(file.read())
        found = encode(texts)
        if path == A_PATH:
            assert {sure for _, sure in found} == {True, False}
            assert all(b"".join(spelled[i] for i in ids) == b" " + t.encode() for t, (ids, sure) in zip(texts, found, strict=True) if sure)
            found = [ids for ids, _ in found]
        assert found == [whole(t) for t in texts]


def test_every_entry_is_what_its_bytes_are_merged_to(own):
    """On which the faster engine of byte-level tokenizers relies."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import Sequence

    alone = Tokenizer.from_file(A_PATH)
    alone.pre_tokenizer = Sequence([])
    entries = {t: i for t, i in alone.get_vocab().items() if i < 50256}
    found = alone.encode_batch(list(entries), add_special_tokens=False)
    assert [e.ids for e in found] == [[i] for i in entries.values()]


def test_transducer_on_random_cuts():
    """Any two ways to cut a string, with a memo that overflows all the time."""
    rng = random.Random(5)
    vocabulary = [bytes(t) for n in (1, 2, 3) for t in __import__("itertools").product(b"ab", repeat=n)]
    number = {t: i for i, t in enumerate(vocabulary)}
    for memo in (1, 3, 1000):
        transducer = Transducer(vocabulary, vocabulary, memo)
        for _ in range(300):
            text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30)))
            sides = []
            for _ in range(2):
                at, tokens = 0, []
                while at < len(text):
                    step = rng.randrange(1, 4)
                    tokens.append(text[at : at + step])
                    at += step
                sides.append(tokens)
            a_ends, b_ends = transducer.align(*([number[t] for t in s] for s in sides))
            both = sorted(set(cuts(sides[0])) & set(cuts(sides[1])))
            assert [cuts(sides[0])[k - 1] for k in a_ends] == both == [cuts(sides[1])[k - 1] for k in b_ends]
            assert transducer.remembered == sum(map(len, transducer.moves.values())) <= max(memo, 1)


def test_transducer_refuses_other_bytes():
    transducer = Transducer([b"ab", b"c"], [b"a", b"b", b"abc", b"x"])
    assert transducer.align([0, 1], [2]) == ([2], [1])
    assert transducer.align([0], [0, 1]) == ([1], [2]) and transducer.align([], []) == ([], [])
    for a, b in (([0], [0]), ([0], [3]), ([0], [0, 1, 1]), ([], [0]), ([0, 0], [2])):
        with pytest.raises(Mismatch):
            transducer.align(a, b)
    with pytest.raises(ValueError):
        Transducer([b""], [b"a"])
