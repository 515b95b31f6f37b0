import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from tessera.llm import pieces, transducer

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'s", "'re", "'", "''", "'ll", " ", "  ", "   ", "\n", " \n ", "\t", "\r\n", "a", "Ab", "don't", "é", "123", "½", "!!", "...", "<|endoftext|>", "</s>", "<0x41>", "😀", "中文", "　", "\xa0", "\x1c", "\x85", "_", "▁", "▁a", "’s", "'S", "ing", "tion", "​", "\x00", "the", "ﬁ", "Ⅳ", "é"]


def texts(n, most=14, seed=1):
    random.seed(seed)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    with open(BPE, encoding="utf-8") as f:
        return transducer.Counter(f.read())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def test_counts_are_the_librarys(counter, tokenizer):
    for text in texts(4000):
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text
    assert counter.count(None) == counter.count("") == 0


def composed(counter, text, chunk):
    """The count that the chunks' maps give together; None if the true state is in no map."""
    state, total = counter.bpe.start.ends, 0
    for i in range(0, len(text), chunk):
        begin = max(0, i - transducer.BACK)
        m = counter.state_map(text[begin : i + chunk + transducer.WINDOW], i - begin, i + chunk >= len(text), chunk)
        if state not in m:
            return None
        state, n = m[state]
        total += n
    return total


def long_texts(n, seed=2):
    random.seed(seed)
    for _ in range(n):
        parts = random.sample(PARTS, random.randint(1, 4))
        yield "".join(random.choice(parts) * random.choice((1, 3, 40, 700)) for _ in range(random.randint(2, 30)))
    for _ in range(n):
        yield "".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2000, 9000)))


def test_state_maps_of_chunks_compose(counter, tokenizer):
    met = lost = 0
    for text in long_texts(60):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        for chunk in (1024, 1500):
            got = composed(counter, text, chunk)
            assert got in (None, n), text
            met, lost = met + (got is not None), lost + (got is None)
    assert met > 20 * lost


def test_long_texts_by_rows_of_chunks(spark, tokenizer):
    some = [(i, t) for i, t in enumerate([*long_texts(8, 7), "a" * 140_000, "word " * 30_000, "word " * 30_000, "\n" * 5000 + "x", None, ""])]
    out = transducer.count_tokens(spark.createDataFrame(some, "doc_id int, text string").withColumn("_text_hash", F.lit("x")).withColumn("hash", F.lit("y")).withColumn("n", F.lit("z")), BPE, chunk=1024)
    assert out.columns == ["doc_id", "text", "_text_hash", "hash", "n", "_n_tokens"]
    assert {r.doc_id: r._n_tokens for r in out.collect()} == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in some}


def test_texts_whose_maps_do_not_meet_are_counted_whole(spark, tokenizer, monkeypatch):
    text = "some words " * 2000
    monkeypatch.setattr(transducer, "compose", lambda maps, most: maps.groupBy("hash").agg(F.first("map").alias("map")).withColumn("map", F.slice("map", 1, 0)))
    out = transducer.count_tokens(spark.createDataFrame([(1, text), (2, text)], "doc_id int, text string"), BPE, chunk=1024).collect()
    assert [r._n_tokens for r in out] == 2 * [len(tokenizer.encode(text, add_special_tokens=False).ids)]


def test_bounded_tables_do_not_change_counts(tokenizer):
    with open(BPE, encoding="utf-8") as f:
        small = transducer.Counter(f.read(), max_segments=5)
    small.bpe.max_states = 20
    for text in texts(300):
        assert small.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_long_runs(counter, tokenizer):
    for text in ("a" * 30_000, "ab" * 5000 + " " * 5000, "\n" * 70_000 + "x", "word " * 40_000):
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_of_odd_rows(odd, nothing, tokenizer):
    got = odd.select("text", transducer.token_counts(F.col("text"), BPE).alias("n")).collect()
    for r in got:
        assert r.n == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    assert nothing.select(transducer.token_counts(F.col("text"), BPE)).count() == 0


@pytest.fixture(scope="module")
def codec():
    with open(PIECES, "rb") as f:
        return pieces.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_and_spans_are_the_librarys(codec, library):
    for text in texts(3000):
        ids, begins, ends, decoded = codec.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert decoded == codec.decode(ids.tolist()) == library.decode(ids.tolist())
        proto = library.encode(text, return_type="proto")
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in proto.pieces]


def test_spans_are_bytes_of_the_source(codec):
    text = "Ünïcode 中文 😀  two"
    ids, begins, ends, _ = codec.encode(text)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw


def test_batches_agree_with_single_texts(codec, monkeypatch):
    some = texts(200, 20, 5)
    monkeypatch.setattr(pieces, "AT_ONCE", 50)
    monkeypatch.setattr(pieces, "TOGETHER", 3)
    for text, row in zip(some, codec.encode_all(some), strict=True):
        alone = codec.encode(text)
        assert all((a == b).all() for a, b in zip(row[:3], alone[:3])) and row[3] == alone[3]


def test_long_segments(codec, library):
    for text in ("x" * 20_000 + "y" * 5000, " " * 9000, "\n" * 3000, "😀" * 500):
        assert codec.encode(text)[0].tolist() == library.encode(text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_character_maps(rule):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(normalizer.serialized_model_proto())
    spec = model.normalizer_spec
    own = pieces.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces)
    for text in texts(1500, 14, 3):
        new, starts = own(text)
        assert new == normalizer.normalize(text), text
        if new:
            assert len(starts) == len(new) + 1 and (starts[1:] >= starts[:-1]).all() and starts[-1] <= len(text.encode())


def test_encoding_odd_rows(odd, nothing, library):
    rows = odd.select("text", pieces.encoded(F.col("text"), PIECES).alias("e")).collect()
    for r in rows:
        assert r.e.ids == library.encode(r.text or "")
        assert r.e.decoded == library.decode(r.e.ids)
        assert not r.e.ends or r.e.ends[-1] == len(r.text.encode())
    assert nothing.select(pieces.encoded(F.col("text"), PIECES)).count() == 0


def test_every_code_point_counts_as_in_the_library(counter, tokenizer):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for a in range(0, len(points), 4096):
        text = "x".join(points[a : a + 4096]) + " " + " ".join(points[a : a + 4096])
        assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), a


def test_counted_odd_rows(odd, nothing, tokenizer):
    out = transducer.count_tokens(odd, BPE)
    assert out.columns == [*odd.columns, "_n_tokens"] and out.count() == odd.count()
    for r in out.collect():
        assert r._n_tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) and r._text_hash == r._n_short == r.hash == "x"
    assert transducer.count_tokens(out.drop("_n_short"), BPE).count() == odd.count()
    assert transducer.count_tokens(nothing, BPE).count() == 0
