import hashlib
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalog.llm import langid, ogg, pieces, quality, queries

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
CRC = [0] * 256
for _i in range(256):
    _r = _i << 24
    for _ in range(8):
        _r = (_r << 1) ^ 0x04C11DB7 if _r & 0x80000000 else _r << 1
    CRC[_i] = _r & 0xFFFFFFFF


def slow_checksum(data):
    r = 0
    for b in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ CRC[(r >> 24) ^ b]
    return r


def test_page_checksum():
    for data in (b"", b"OggS", os.urandom(333)):
        assert ogg.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 4080, 4081, 8160, 61_200, 122_400, 400_001])
def test_ogg_round_trip(n):
    payload = ogg.padded(os.urandom(n))
    data = ogg.encode(payload)
    back, streams = ogg.decode(data)
    assert back == payload and len(streams) == 2
    assert sum(s.times[-1] * s.rate for s in streams.values()) == len(payload)
    for at in {0, 5, 23, 30, len(data) // 2, len(data) - 1}:
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.decode(bytes(bad))
    with pytest.raises(ValueError):
        ogg.decode(data[:-1])


def test_packets_span_pages():
    w = ogg.StreamWriter(7)
    big = os.urandom(200_000)
    data = b"".join([*w.pages([(ogg.IDENT.pack(ogg.MAGIC, 8000, 0, len(big) + 255), 0)], ogg.FIRST), *w.pages([(big, len(big)), (b"x" * 255, len(big) + 255)], last=True)])
    (s,) = ogg.demultiplex(data).values()
    assert s.packets == [big, b"x" * 255] and s.times == [len(big) / 8000, (len(big) + 255) / 8000]


def test_media_rows(spark, odd):
    for r in ogg.media_columns(odd).collect():
        data = (r.text or "").encode()
        payload = data + bytes(-len(data) % 64) or bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_bytes == len(r.media)
        assert ogg.decode(bytes(r.media))[0] == payload
    assert ogg.media_columns(odd.where("false")).count() == 0


def test_quality_on_held_out_rows(spark):
    out = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    good = [r.predicted for r in held if labels[r.doc_id] == 1]
    bad = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.5


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    out = quality.score(odd, model).collect()
    assert len(out) == odd.count() and all(r.score == 0 for r in out if not r.text)
    assert len({(r.score, r.predicted) for r in out if r.doc_id == 4}) == 1
    none = quality.fit(odd.where("false"), labels.where("false"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.0, 0.5}


def test_languages_on_held_out_rows(spark):
    out = queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out if r.held_out]) > 0.95


def test_languages_odd_rows(spark, odd):
    net = langid.train({"aa": [b"abab " * 40], "bb": [b"xyxy " * 40]}, epochs=2, per_language=20)
    out = langid.predict(odd, net).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in out)
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.sample_texts(odd.where("false")) == {}


def test_folded_network_equals_training():
    rng = np.random.default_rng(3)
    net = langid.train({"a": [rng.integers(97, 105, 900).astype(np.uint8).tobytes()], "b": [rng.integers(100, 110, 900).astype(np.uint8).tobytes()]}, epochs=2)
    x = rng.integers(0, 256, (50, langid.WINDOW)).astype(np.uint8)
    f, _ = net.features(x)
    z = f @ net.dense + net.offset
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.log_probabilities(x, net.tables()), want, atol=1e-3)


def test_gradients():
    rng = np.random.default_rng(5)
    net = langid.train({"a": [b"abc " * 60], "b": [b"xyz " * 60]}, epochs=1)
    x, y = rng.integers(97, 123, (6, langid.WINDOW)), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        f, _ = net.features(x)
        z = f @ net.dense + net.offset
        return (np.log(np.exp(z).sum(1)) - z[np.arange(6), y]).mean()

    grads = langid.gradients(net, x, y)
    for p, g in zip([net.embed, *net.filters.values(), net.bias, net.dense, net.offset], grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-6)


TRICKY = ["", " ", "  a  b ", "<s> x </s><unk>", "<0x0A>\n\t", "日本 🤖\x00x", "1234 5", "▁a ▁▁b", "a\r\n\n  b", "é ﬁ", "x" * 5000]


def test_parity_with_sentencepiece(docs):
    texts = TRICKY + [r.text for r in docs.collect()]
    assert pieces.parity(MODEL, texts) == []
    c = pieces.codec(pieces.read_model(MODEL))
    for t in texts:
        if "▁" not in t:
            assert c.decode(c.encode([t])[0]) == t


def test_threads_of_a_task(docs, monkeypatch):
    """Batches are encoded by as many threads as a task has cores, to the same ids."""
    data, seen = pieces.read_model(MODEL), []
    texts = TRICKY + [r.text for r in docs.select("text").limit(100).collect()]
    conf, use = type(docs.sparkSession.conf), pieces.use_threads
    with monkeypatch.context() as m:
        m.setattr(conf, "get", lambda self, key, *a, get=conf.get: "2" if key == "spark.task.cpus" else get(self, key, *a))
        m.setattr(type(docs), "mapInArrow", lambda self, f, schema: f)
        m.setattr(pieces, "use_threads", lambda n: (seen.append(n), use(n)))
        run = pieces.encode(docs.select("text"), data)
        (batch,) = run(iter([pa.RecordBatch.from_pydict({"text": texts})]))
    assert seen == [2] and batch.column("ids").to_pylist() == pieces.codec(data).encode(texts)


def test_encode_rows(spark, odd):
    out = pieces.encode(odd, pieces.read_model(MODEL), check_round_trip=True)
    rows = pieces.decode(out, pieces.read_model(MODEL)).collect()
    assert len(rows) == odd.count() and Counter(r.decoded for r in rows) == Counter(r.text for r in rows)
    assert all((r.ids is None) == (r.text is None) and r.round_trip in (True, None) for r in rows)
    assert pieces.encode(odd.where("false"), pieces.read_model(MODEL)).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def test_unigram_model(tmp_path):
    """A small unigram model written by hand: scores, byte fallback, squeezed spaces; the same ids as sentencepiece."""
    vocab = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    vocab += [("▁", -3.0, 1), ("▁the", -2.0, 1), ("▁th", -4.0, 1), ("e", -3.5, 1), ("re", -3.0, 1), ("▁there", -5.9, 1), ("r", -4.0, 1), ("t", -4.0, 1), ("h", -4.1, 1), ("a", -3.3, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocab)
    data += message((2, message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2))), (3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    texts = ["the there", "there  are", "  heart ", "zebra é", "", "t"]
    assert pieces.parse(data).kind == pieces.UNIGRAM
    assert pieces.parity(str(path), texts) == []


def test_bad_model():
    with pytest.raises(ValueError):
        pieces.parse(message((2, message((3, 3)))))
    with pytest.raises((ValueError, IndexError)):
        pieces.parse(b"\x0a\xff")


def test_parity_inside_the_query(spark, odd, docs):
    """One text in some is encoded by the library too; the same texts whatever their rows' order."""
    some = pieces.encode(docs.select("doc_id", "text"), pieces.read_model(MODEL), parity_share=8)
    rows = some.collect()
    assert {r.parity for r in rows} == {True, None} and 0 < sum(r.parity is not None for r in rows) < len(rows) / 4
    assert all((r.parity is not None) == (r.text is not None and pieces.checked(r.text, 8)) for r in rows)
    assert all(r.parity in (True, None) for r in pieces.encode(odd, pieces.read_model(MODEL), parity_share=1).collect())


def test_the_query_judges_every_text(spark, sf_dir, docs):
    rows = queries.op4_sentencepiece(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count() and all(r.parity is (None if texts[r.doc_id] is None else True) for r in rows)
