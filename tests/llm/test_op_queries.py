"""The registered queries over whole tables, against plain Python."""

import hashlib
import itertools
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tessera.llm import queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, docs):
    out = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    return out


def crc(value):
    return zlib.crc32(str(value).encode())


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op1(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op1_html_extraction(spark, SF).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        article = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        words = re.findall(r"[^\W\d_]+", re.sub("<[^>]+>|&[a-z]+;", " ", article))
        assert re.findall(r"[^\W\d_]+", r.text) == words and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


class Article(HTMLParser):
    """The blocks of an article element, by the standard library's parser."""

    INLINE = {"b", "i", "em", "strong", "a", "span", "code", "sup", "sub", "u", "small"}

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.silent, self.blocks = 0, 0, [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.silent += tag in ("script", "style")
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.silent -= tag in ("script", "style")
        if tag not in self.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.silent:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(filter(None, (" ".join(b.split()) for b in self.blocks)))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op1_is_the_articles_text_by_another_parser(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    wrong = [r.page_id for r in queries.op1_html_extraction(spark, sf).collect() if r.text != Article(pages[r.page_id]).text()]
    assert not wrong


def test_op3_against_all_keys_in_order(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    key = {i: (xxhash.xxh64_intdigest(t.encode(), 42), xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)) for i, t in texts.items()}
    out = sorted(queries.op3_sharding(spark, sf).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in out] == sorted(texts, key=key.get)
    assert [r.slot for r in out] == [n for _, rows in itertools.groupby(out, lambda r: r.shard) for n, _ in enumerate(rows)]
    share = sum(r.size for r in out) / 8
    below = [0, *itertools.accumulate(r.size for r in out)]
    for shard in range(1, 8):
        border = below[sum(r.shard < shard for r in out)]
        nearest = min(abs(b - shard * share) for b in below)
        assert abs(border - shard * share) <= max(nearest, 0.01 * share)


def test_op3(spark, docs):
    out = rows(spark, "op3_sharding", docs)
    total = [0] * 8
    for r in out:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        total[r.shard] += r.size
    largest = max(r.size for r in out)
    assert max(total) - min(total) <= 2 * largest
    for shard in range(8):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_op4(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows(spark, "op4_token_counts", docs):
        n = len(library.encode(docs[r.doc_id].text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].text.encode()), n, n > 512)


def test_op5(spark, docs):
    out = rows(spark, "op5_language_id", docs)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op7(spark, docs):
    seen = {}
    for r in rows(spark, "op7_media_columns", docs):
        raw = docs[r.doc_id].text.encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r.media_bytes > len(payload) and seen.setdefault(raw, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_op8(spark, docs):
    out = rows(spark, "op8_quality", docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    known = [r for r in out if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= 0.9 * len(known)


def test_op9(spark, docs):
    ids = sorted(docs)
    fps = np.array([simhash.fingerprint_of(docs[i].text) for i in ids], dtype=np.uint64)
    least = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            m = min(least[j] for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3))
            changed |= m < least[i]
            least[i] = min(m, least[i])
    want = {i: (f"{int(f):016x}", ids[m]) for i, f, m in zip(ids, fps, least, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op9_simhash", docs)} == want


def test_op10(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows(spark, "op10_sentencepiece", docs):
        ids = library.encode(docs[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
        assert r.span_bytes == len(docs[r.doc_id].text.encode())


@pytest.fixture(scope="module", params=["odd", "nothing"])
def strange(request, spark, tmp_path_factory):
    """A folder of tables with odd rows, or none."""
    folder = str(tmp_path_factory.mktemp(request.param))
    docs = request.getfixturevalue(request.param).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (2, "u", "")], "page_id long, url string, html string")
    pages.limit(3 * (request.param == "odd")).write.parquet(f"{folder}/pages.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (9, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    labels.limit(6 * (request.param == "odd")).write.parquet(f"{folder}/labels.parquet")
    return folder, docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_strange_tables(spark, strange, name):
    from tests.oracle import connected, same

    folder, n = strange
    out = queries.QUERIES[name](spark, folder).collect()
    assert len(out) == (n if name != "op1_html_extraction" else min(n, 3))
    if name in queries.ORACLE_SQL:
        assert same(spark, connected(folder), queries.QUERIES[name], queries.ORACLE_SQL[name], folder) == n


def test_the_pipeline_over_strange_tables(spark, strange):
    import corpus_pipeline

    folder, n = strange
    assert corpus_pipeline.run(spark, folder).count() <= 3 * n
