"""Token records: exact round trip, framing, shuffled reads, damage, odd rows."""

import glob
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinlens.llm import token_records as tr
from twinlens.llm.crc32c import _slow, crc32c, masked

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def expected(rows):
    """Per row in ascending document order (ids unique): (doc_id, start, n, crc)."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = ids_of(t)
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_checksums():
    known = np.frombuffer(b"123456789", dtype=np.uint8)
    assert crc32c(known, [0], [9])[0] == 0xE3069283               # published check value
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 80_000, dtype=np.uint8)
    size = np.array([0, 1, 3, 4, 9, 255, 256, 257, 511, 512, 513, 3000, 70_001])
    start = rng.integers(0, 9000, len(size))
    assert crc32c(buf, start, size).tolist() == [_slow(buf[a:a + n].tobytes()) for a, n in zip(start, size, strict=True)]
    assert masked(np.array([0], dtype=np.uint32))[0] == 0xA282EAD8


WORDS = tr.WordIds(tr.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85\xa0'stdΣσİ́.,!ab<|endoftext|>"))), max_size=4))
def test_ids_of_words_are_ids_of_the_text(texts):
    got = WORDS.of([t.encode() for t in texts])
    assert [np.frombuffer(g, dtype="<u2").tolist() for g in got] == [ids_of(t)[:-1].tolist() for t in texts]


def test_special_strings_and_bounded_memory(monkeypatch):
    monkeypatch.setattr(tr, "KEPT_WORDS", 3)
    words = tr.WordIds(tr.VOCABULARY)
    for text in ("a<|endoftext|>b <|startoftext|>", "x " * 10 + "y z u v w", "é" * 500 + " " + "Ab1" * 300, "a  ́b",
                 "İx Σας ΣΑΣ. ǅ, ﬁ! Ⅷ; don't it's 'll ... a., b.: 5. 6,\n.x é, …, Zz. <|ENDOFTEXT|> q.", "x y z u v w x, y. . , ;"):
        assert np.frombuffer(words.of([text.encode()])[0], dtype="<u2").tolist() == ids_of(text)[:-1].tolist()
        assert len(words.fresh) <= 25 and len(words.old) <= 25


def test_a_vocabulary_without_word_ends_and_wide_ids(spark, docs_of, tmp_path):
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["two  words\n", "It's a test, of blanks \t ."]
    got = tr.read(tr.write(docs_of(list(enumerate(texts))), str(tmp_path), vocabulary="byte_bpe_50k.json"), with_ids=True).collect()
    assert [r["ids"] for r in sorted(got)] == [[*other.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    payload = bytes([3]) + (9).to_bytes(8, "little") + np.array([70_000, 1], dtype="<u4").tobytes()
    assert [tr.unpacked(p)[1].tolist() for p in tr.parse(tr.frames([payload])[0], "f", 0)] == [[70_000, 1]]


def test_round_trip(spark, small_docs, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    manifest = tr.write(small_docs.repartition(5), str(tmp_path / "out"))
    assert manifest.select("file").distinct().count() > 1
    got = tr.read(manifest, with_ids=True).collect()
    assert order((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected(rows)
    texts = dict(rows)
    assert all(r["ids"] == ids_of(texts[r["doc_id"]]).tolist() for r in got)


def test_public_framing(spark, docs_of, tmp_path):
    """The bytes on disk, parsed by hand."""
    tr.write(docs_of([(7, "Hello world"), (None, None)]).coalesce(1), f"file://{tmp_path}/out").collect()
    data = b"".join(open(p, "rb").read() for p in sorted(glob.glob(f"{tmp_path}/out/*.records")))
    seen, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        for a, b in ((at, at + 8), (at + 12, at + 12 + n)):
            crc = _slow(data[a:b])
            assert int.from_bytes(data[b:b + 4], "little") == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
        payload = data[at + 12:at + 12 + n]
        seen.append((payload[0], int.from_bytes(payload[1:9], "little", signed=True), np.frombuffer(payload[9:], "<u2").tolist()))
        at += 16 + n
    assert sorted(seen) == [(0, 0, [2]), (1, 7, ids_of("Hello world").tolist())]


def test_shuffled_reads(spark, small_docs, tmp_path):
    manifest = tr.write(small_docs.select("doc_id", "text"), str(tmp_path / "out"))
    texts = {r["doc_id"]: r["text"] for r in small_docs.collect()}
    orders = []
    for seed in (1, 1, 2):
        got = tr.read_shuffled(manifest, seed).collect()
        assert [r["place"] for r in got] == sorted(r["place"] for r in got)
        assert len(got) == len(texts) and all(r["ids"] == ids_of(texts[r["doc_id"]]).tolist() for r in got)
        orders.append([r["doc_id"] for r in got])
    assert orders[0] == orders[1] != orders[2] and orders[0] != sorted(orders[0])
    index = tr.offsets(manifest)
    assert index.count() == len(texts)


def test_blocks_follow_the_index(spark, small_docs, tmp_path, monkeypatch):
    manifest = tr.write(small_docs.coalesce(1), str(tmp_path / "out"))
    index = tr.offsets(manifest).collect()
    by_file = {}
    for r in index:
        by_file.setdefault(r["file"], {})[r["record"]] = (r["offset"], r["ids_before"], r["bytes"])
    for b in manifest.collect():
        records = by_file[b["file"]]
        assert records[b["first_record"]][0] == b["offset"]
        assert sum(records[k][2] for k in range(b["first_record"], b["first_record"] + b["records"])) == b["bytes"]


def test_damage_is_found(spark, docs_of, tmp_path):
    for place, kind in ((3, "length"), (20, "checksum"), (-1, "checksum"), (None, "cut off")):
        out = str(tmp_path / f"out{place}")
        manifest = tr.write(docs_of([(1, "one two three"), (2, "four")]).coalesce(1), out)
        path = max(glob.glob(f"{out}/*.records"), key=os.path.getsize)
        data = bytearray(open(path, "rb").read())
        if place is None:
            data = data[:-5]
        else:
            data[place] ^= 1
        open(path, "wb").write(data)
        with pytest.raises(Exception, match=kind):
            tr.read(manifest).collect()


def test_odd_rows(spark, docs_of, tmp_path):
    rows = [(1, None), (2, ""), (None, "x"), (4, "same words"), (-5, "negative"), (6, "word " * 60_000),
            (7, " " * 1_000_000), (8, "日本é\x00 \x1c a" * 50), (9, "a" * 5000), (2 ** 62, "big")]
    assert order(map(tuple, tr.read(tr.write(docs_of(rows), str(tmp_path / "a"))).collect())) == expected(rows)
    clash = docs_of(rows).withColumnsRenamed({"lang": "h", "source": "place", "n_chars": "start"})
    assert order(map(tuple, tr.read(tr.write(clash, str(tmp_path / "b"))).collect())) == expected(rows)
    assert tr.read(tr.write(docs_of([]), str(tmp_path / "c"))).collect() == []
    assert tr.read_shuffled(tr.write(docs_of([]), str(tmp_path / "d")), 1).collect() == []


def test_one_id_for_a_third_of_all_rows(spark, tmp_path):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 77, id)) doc_id", "if(id % 3 = 0, 'copy of it', concat('text ', id)) text")
    path = str(tmp_path / "in")
    df.write.parquet(path)
    manifest = tr.write(spark.read.parquet(path), str(tmp_path / "out"))
    got = order(map(tuple, tr.read(manifest).collect()))
    start = 0
    for _, s, n, _ in got:
        assert s == start
        start += n
    assert len(got) == 3000 and sum(r[0] is None for r in got) == 1000
    per_file = [r["n"] for r in manifest.groupBy("file").agg({"records": "sum"}).toDF("file", "n").collect()]
    assert max(per_file) < 1000
