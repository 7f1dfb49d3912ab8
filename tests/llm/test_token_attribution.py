import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assetloom.llm.token_attribution import field_tokens, op1_token_attribution, section_tokens

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "\n", "one\n\n\n  two  \nthree", "no line feed", "été 🙂\n👩‍👩‍👧\n", "x" * 2000 + "\n" + "ab " * 3000, "\n\n\n\n a", "a\r\nb\r\n"]


def lines(text):
    found = (text or "").split("\n")
    found = [x + "\n" for x in found[:-1]] + [found[-1]]
    return found[:-1] if len(found) > 1 and not found[-1] else found


def brute(text, rule):
    """Token by token, with the offsets of another library's encoder of the same vocabulary."""
    tokenizer = brute.tokenizer = getattr(brute, "tokenizer", None) or Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    parts, at, spans = lines(text), 0, []
    for part in parts:
        spans.append((at, at + len(part)))
        at += len(part)
    counts = [0.0] * len(spans)
    size = [0]
    for c in text or "":
        size.append(size[-1] + len(c.encode()))
    for a, b in tokenizer.encode(text or "", add_special_tokens=False).offsets:
        b = max(b, a + 1)
        own = [i for i, (x, y) in enumerate(spans) if x < b and a < y]
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "last":
            counts[own[-1]] += 1
        else:
            for i in own:
                counts[i] += (size[min(b, spans[i][1])] - size[max(a, spans[i][0])]) / (size[b] - size[a])
    return [(i, *s, c) for i, (s, c) in enumerate(zip(spans, counts, strict=True))]


@pytest.mark.parametrize("rule", ["first", "last", "share"])
def test_sections_equal_brute_force(spark, rule):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2), (None, "a\nb", 3)], "doc_id long, text string, section int")
    got = section_tokens(docs, RANKS, P.PATTERN, rule).collect()
    expected = [(i, *row) for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "a\nb")] for row in brute(t, rule)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r.doc_id, r.section, r.char_start, r.char_end, r.n_tokens) for r in got), key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]), (a, b)
    assert section_tokens(docs.limit(0), RANKS, P.PATTERN, rule).count() == 0


def test_fields_add_up(spark):
    rows = spark.createDataFrame([(1, "A title", "Some body text."), (2, None, "x"), (3, None, None)], "doc_id long, title string, body string")
    got = {(r.doc_id, r.field): r.n_tokens for r in field_tokens(rows, ["title", "body"], RANKS, P.PATTERN).collect()}
    assert got[1, "title"] == 3 and got[1, "body"] == 4 and got[2, "title"] == 1 and got[3, "body"] == 0
    with pytest.raises(ValueError):
        field_tokens(rows, ["title"], RANKS, P.PATTERN, rule="other")


def test_query_adds_up_to_documents(spark):
    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n for r in op1_token_attribution(spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[d.doc_id] == len(tokenizer.encode(d.text, add_special_tokens=False).ids)
