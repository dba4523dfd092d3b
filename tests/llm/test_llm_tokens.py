"""SentencePiece round trip, token counts and URL rules."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from ledgerlens.llm import token_counts as TC
from ledgerlens.llm import url_filters as U
from ledgerlens.llm.sentencepiece_codec import Codec, encode_decode

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "   ", "  a  b\n c ", "▁▁x ▁", "\x00 a", "日本 語 🙂🙂  ́x", "a" * 20_000, "\n \n", "<s> </s> <unk> <0x0A>",
       "a\u2003b\u00a0c\u3000", "\ufeff x \ufffd", "word " * 20_000, "<|endoftext|>x <|endoftext|>", "don't I'll 123456 ...!!"]


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def bpe():
    return tokenizers.Tokenizer.from_file(JSON)


def docs(spark, texts):
    rows = [(i, t, [1], "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, key string")


def test_codec_equals_the_library(piece):
    codec = Codec(MODEL)
    assert codec.split
    random.seed(3)
    parts = ["a", "The", "é", " ", "  ", "▁", "\n", "\t", "🙂", "ﬁ", "日本", "\x00", "<s>", ".", "12", "\u00a0", "ñandú"]
    fuzz = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    for text in [t or "" for t in ODD] + fuzz:
        ids = piece.encode(text)
        assert codec.round_trip(text) == (ids, piece.decode(ids)), repr(text)


def test_codec_without_the_split_and_with_a_tiny_table(piece, monkeypatch):
    from ledgerlens.llm import sentencepiece_codec as S
    codec = Codec(MODEL)
    codec.split = False
    assert codec.round_trip("a b") == (piece.encode("a b"), "a b")
    monkeypatch.setattr(S, "TABLE_CHARS", 10)
    small = Codec(MODEL)
    for text in ("one two three four", "five six seven", "one two"):
        assert small.round_trip(text) == (piece.encode(text), text)


def test_encode_decode_rows(spark, piece):
    out = {r.doc_id: r for r in encode_decode(docs(spark, ODD + ["again"] * 2), MODEL, carry=["ids", "key"]).collect()}
    for i, text in enumerate(ODD):
        assert list(out[i].ids) == piece.encode(text or "") and out[i].decoded == piece.decode(piece.encode(text or ""))
        assert out[i].carried.ids == [1]
    assert len(out) == len(ODD) + 2
    assert encode_decode(docs(spark, []), MODEL).count() == 0


def test_op6_against_the_library(spark, piece):
    import __spark_entry__ as E
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in E.queries()["op6_sentencepiece"](spark, d).collect():
        ids = piece.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(piece.decode(ids).encode()).hexdigest()


def test_counts_of_runs_and_splices_equal_the_library(bpe):
    runs = TC.RunCounts(bpe)
    random.seed(1)
    parts = ["a", "B", "é", "1", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000",
             "<|endoftext|>", "🙂", "!", "日本", "\u200b", "\u0301"]
    for n in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14 if n % 10 else 900)))
        want = len(bpe.encode(text, add_special_tokens=False))
        assert runs.count(text) == want, repr(text)
        assert TC.count_spliced(bpe, text, random.randint(20, 200), random.randint(2, 20)) == want, repr(text)


def test_splice_widens_where_no_boundary_is(bpe):
    for text in ("x" * 5000, " " * 5000, "a b " * 100 + "y" * 3000 + " c d" * 100):
        assert TC.count_spliced(bpe, text, 100, 8) == len(bpe.encode(text, add_special_tokens=False))


def test_token_counts_rows(spark, bpe):
    out = {r.doc_id: r for r in TC.token_counts(docs(spark, ODD), JSON, limit=100, chunk_chars=5000, overlap_chars=64).collect()}
    for i, text in enumerate(ODD):
        n = len(bpe.encode(text or "", add_special_tokens=False))
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (len((text or "").encode()), n, n > 100)
    assert TC.token_counts(docs(spark, []), JSON).count() == 0


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URLS = {None: ("", "", None, "allow"), "": ("", "", None, "allow"), "example.com/en/": ("", "", None, "allow"),
        "http://EXAMPLE.com/en/x?q": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://www.example.com/EN/": ("www.example.com", "/EN/", "com/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://x.net/es": ("x.net", "/es", None, "allow"),
        "http://x.net?u=/es/": ("x.net", "", None, "allow"), "a://b://net/fr/": ("b:", "//net/fr/", None, "allow"),
        "http://É.NET/fr/": ("É.net", "/fr/", "net/fr/", "block"), "http://net/fr/#x": ("net", "/fr/", "net/fr/", "block"),
        "http:///en/": ("", "/en/", None, "allow"), "http://x.com": ("x.com", "", None, "allow"),
        "http://" + "a." * 5000 + "net/es/": ("a." * 5000 + "net", "/es/", "net/es/", "block")}


def test_url_verdicts(spark):
    rows = [(i, u, "r", "v") for i, u in enumerate([*URLS, *URLS])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string")
    got = U.judge(pages, RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.url]
    assert U.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in U.judge(pages, []).collect()} == {"allow"}


def test_colliding_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(U, "_digests", lambda xs: np.array([len(x) % 3 for x in xs], np.uint64))
    index = U.build_index([("block", r) for r in ("a/", "b/", "cc/", "ddd/", "eeee/")])
    asked = ["b/", "a/", "z/", "eeee/", "dd/", "ddd/", "cc/"]
    found = U.probe(index, asked)
    ends, raw = index["ends"], index["bytes"].tobytes()
    texts = [raw[ends[j - 1] if j else 0:ends[j]].decode() if j >= 0 else None for j in found]
    assert texts == ["b/", "a/", None, "eeee/", None, "ddd/", "cc/"]


def test_bad_rules_are_refused():
    with pytest.raises(ValueError):
        U.build_index([("block", "host")])
    with pytest.raises(ValueError):
        U.build_index([("block", "h/"), ("allow", "h/")])
