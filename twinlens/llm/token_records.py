"""Token ids as length-delimited binary records with a separate offset index.

``write`` tokenises texts and writes files of framed records in ascending
document order; ``read`` reads them back in order, ``read_shuffled`` in a seeded
random order through the offset index.

A record is framed as in the public TFRecord format, all numbers little-endian:
payload length (8 bytes), masked CRC-32C of the length (4), payload, masked
CRC-32C of the payload (4).  The payload is one flag byte (1: the document id is
not null, 2: ids are 4 bytes wide, else 2), the document id (8 bytes) and the ids.
The index file beside each data file holds, per record, its offset and the number
of ids before it in the file (8 bytes each), then the file's totals likewise, then
a masked CRC-32C of all that.

Rows are dealt into ranges of (document id, hash of the text, row position), so a
third of all rows with one id, or copies of one row, spread over many tasks; a
task sorts its range (Spark spills) and streams it into one file.  The manifest, a
DataFrame with one row per block of about 4 MB, names only files of tasks that
Spark committed: a task that is lost or runs twice leaves at most an unnamed file.
Ids before a document follow from per-file totals (one number a file in one window)
and per-block sums within a file.  Blocks are what readers split by.

Words between blanks are encoded once and remembered: this tokenizer splits at
white space and changes each character by itself, so the ids of a text are those
of its words in a row (tested against whole texts).

Defined results: a null or empty text is the end id alone; null document ids come
first; rows with the same id follow the hash of their text; extra columns are
ignored; an empty table gives no file and no row.  Damaged files raise an error
that names file and offset.  The input is read twice (for range borders), so it
should be a table; write other frames first.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from string import ascii_letters, ascii_lowercase

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from .common import runs, saved
from .crc32c import crc32c, masked

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK_BYTES = 4 << 20
KEPT_WORDS = 600_000            # per generation
JOINED = 500                    # words that go to the library at once
STOPS = ".,;:!?"
STOPPED = re.compile(rb"[.,;:!?](?<=[a-z0-9].)(?=[\x20\x09-\x0D]|\Z)")
HEAD = 12                       # length and its checksum
FRAME = HEAD + 4                # what a frame adds to its payload
PREFIX = 9                      # flag and document id
MANIFEST = "file string, file_no long, block long, offset long, bytes long, records long, ids long, first_record long"


class WordIds:
    """Packed ids of whole texts by a tokenizer file of the tokenizers library.

    If the vocabulary marks word ends (``end_of_word_suffix``), words between blanks
    are independent: the words of a run of texts that are not remembered yet go to
    the library together, the others are looked up.  Words of letters alone are
    joined by spaces and their ids are cut after each id that ends a word; other
    words are encoded one by one.  What the tokenizer does to ASCII is asked of it
    once: if it lower-cases A-Z, texts are lower-cased first; if a stop after a letter
    or digit is a unit of its own, it is a word of its own here; if a-z pass its
    normaliser and pre-tokenizer unchanged, words of them skip both.  Texts with a
    special token's string, and all texts if there are no word ends, go to the
    library whole.  Two generations of words are remembered, so frequent ones stay
    when a generation is full.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task is one thread
        path = vocabulary if os.path.exists(vocabulary) else public_tokenizers.path(vocabulary)
        self.tok = Tokenizer.from_file(path)
        model = json.loads(self.tok.to_str())
        suffix, size = model["model"].get("end_of_word_suffix"), self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u4" if size > 1 << 16 else "<u2"
        self.ends = np.zeros(size, dtype=bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.by_word = bool(suffix) and self.tok.normalizer is not None and self.tok.pre_tokenizer is not None
        self.special = [t["content"].lower().encode() for t in model["added_tokens"]]
        self.lowers = self.stops = False
        if self.by_word:
            self.lowers = all(self.tok.normalizer.normalize_str(c) == c.lower() for c in ascii_letters)
            self.stops = all(self._units(a + s) == [a, s] for a in ("ab", "1") for s in STOPS)
        self.bare = self.tok
        if self.lowers and self._units(ascii_lowercase) == [ascii_lowercase]:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.fresh: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _units(self, text: str) -> list[str]:
        return [unit for unit, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, texts: list[bytes], by=None) -> list[list[int]]:
        return [e.ids for e in (by or self.tok).encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        split = [self._words(t) for t in texts]
        self._remember(set().union(*[w for w in split if w is not None]))
        find = self.fresh.__getitem__
        return [b"".join(map(find, w)) if w is not None else self.packed(self.encode([t])[0]) for t, w in zip(texts, split, strict=True)]

    def _words(self, text: bytes) -> list[bytes] | None:
        """The text's words, None if it has to be encoded whole."""
        if not self.by_word:
            return None
        low = text.lower()                                  # of bytes: A-Z only
        if any(s in low for s in self.special):
            return None
        if self.lowers:
            text = low
        return (STOPPED.sub(rb" \g<0>", text) if self.stops else text).split()

    def _remember(self, words: set[bytes]) -> None:
        missing = words.difference(self.fresh)
        if len(self.fresh) + len(missing) > KEPT_WORDS:
            self.old, self.fresh, missing = self.fresh, {}, words
        known = [w for w in missing if w in self.old]
        self.fresh.update((w, self.old[w]) for w in known)
        missing = missing.difference(known)
        plain = [w for w in missing if w.isalpha()]         # of bytes: A-Z and a-z only
        missing = missing.difference(plain)
        letters = [w for w in missing if w.decode().isalpha()]
        whole = list(missing.difference(letters))
        for group, learn in ((plain, partial(self._learn, by=self.bare)), (letters, self._learn), (whole, self._each)):
            for a in range(0, len(group), JOINED):
                learn(group[a:a + JOINED])

    def _each(self, words: list[bytes]) -> None:
        self.fresh.update(zip(words, map(self.packed, self.encode(words)), strict=True))

    def _learn(self, words: list[bytes], by=None) -> None:
        """Words of letters alone: each is one unit of the tokenizer, in order."""
        ids = np.array(self.encode([b" ".join(words)], by)[0], dtype=np.int64)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):          # a letter that the tokenizer changes to something else
            self._each(words)
            return
        data, bounds = self.packed(ids), [0, *(cuts * int(self.dtype[-1])).tolist()]
        self.fresh.update(zip(words, [data[a:b] for a, b in zip(bounds, bounds[1:])], strict=True))


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """Kept by the worker process for its next tasks."""
    return WordIds(vocabulary)


def _file_system(folder: str):
    """(file system, path in it) of a folder named by path or URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def frames(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The framed records in a row, and the size of each."""
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    framed = sizes + FRAME
    ends = np.cumsum(framed)
    buf = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - framed
    lengths = sizes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for a, p in zip((starts + HEAD).tolist(), payloads, strict=True):
        buf[a:a + len(p)] = np.frombuffer(p, dtype=np.uint8)
    head = masked(crc32c(lengths.ravel(), np.arange(len(sizes)) * 8, np.full(len(sizes), 8)))
    for j in range(8):
        buf[starts + j] = lengths[:, j]
    data = masked(crc32c(buf, starts + HEAD, sizes))
    for j in range(4):
        buf[starts + 8 + j] = head.astype("<u4").view(np.uint8).reshape(-1, 4)[:, j]
        buf[ends - 4 + j] = data.astype("<u4").view(np.uint8).reshape(-1, 4)[:, j]
    return buf.tobytes(), framed


def parse(data: bytes, file: str, offset: int) -> Iterator[bytes]:
    """Payloads of the frames in ``data``, all checksums verified."""
    at, starts, sizes = 0, [], []
    while at < len(data):
        if at + FRAME > len(data):
            raise ValueError(f"{file}: record cut off at byte {offset + at}")
        n = int.from_bytes(data[at:at + 8], "little")
        if n < PREFIX or at + FRAME + n > len(data):
            raise ValueError(f"{file}: length of the record at byte {offset + at} runs past its block")
        starts.append(at)
        sizes.append(n)
        at += FRAME + n
    buf = np.frombuffer(data, dtype=np.uint8)
    start, size = np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64)

    def stored(place: np.ndarray) -> np.ndarray:
        return sum((buf[place + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4)), np.zeros(len(place), dtype=np.uint32))
    wrong = ((masked(crc32c(buf, start, np.full(len(start), 8))) != stored(start + 8))
             | (masked(crc32c(buf, start + HEAD, size)) != stored(start + HEAD + size)))
    if wrong.any():
        raise ValueError(f"{file}: checksum of the record at byte {offset + int(start[np.argmax(wrong)])} is wrong")
    for a, n in zip(starts, sizes, strict=True):
        yield data[a + HEAD:a + HEAD + n]


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    """(document id, ids) of a payload."""
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=PREFIX)
    return (doc_id if flags & 1 else None), ids.astype("<u4")


class _Writer:
    """One task's file and index; ``blocks`` holds finished manifest rows."""

    def __init__(self, folder: str, part: int):
        self.fs, root = _file_system(folder)
        self.fs.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.name, self.part = f"{folder}/{name}.records", part
        self.out = self.fs.open_output_stream(f"{root}/{name}.records")
        self.index = self.fs.open_output_stream(f"{root}/{name}.index")
        self.index_bytes: list[bytes] = []
        self.offset = self.ids = self.records = 0
        self.blocks: list[tuple] = []
        self.payloads: list[bytes] = []
        self.counts: list[int] = []
        self.waiting = 0

    def add(self, payload: bytes, n_ids: int) -> None:
        self.payloads.append(payload)
        self.counts.append(n_ids)
        self.waiting += len(payload) + FRAME
        if self.waiting >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.payloads:
            return
        data, sizes = frames(self.payloads)
        self.out.write(data)
        counts = np.array(self.counts, dtype=np.int64)
        entries = np.stack([self.offset + np.cumsum(sizes) - sizes, self.ids + np.cumsum(counts) - counts], axis=1)
        self.index_bytes.append(entries.astype("<u8").tobytes())
        self.blocks.append((self.name, self.part, len(self.blocks), self.offset, len(data), len(counts), int(counts.sum()), self.records))
        self.offset, self.ids, self.records = self.offset + len(data), self.ids + int(counts.sum()), self.records + len(counts)
        self.payloads, self.counts, self.waiting = [], [], 0

    def close(self) -> None:
        self.flush()
        self.out.close()
        entries = b"".join(self.index_bytes) + struct.pack("<QQ", self.offset, self.ids)
        check = masked(crc32c(np.frombuffer(entries, dtype=np.uint8), [0], [len(entries)]))
        self.index.write(entries + check.astype("<u4").tobytes())
        self.index.close()


def write(df: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text",
          vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Write record and index files into ``folder`` (shared by all executors) and
    return the manifest (see MANIFEST)."""
    import pyarrow as pa
    spark = df.sparkSession
    ship_package(spark)
    names, kinds = zip(*[c.split() for c in MANIFEST.split(", ")], strict=True)
    types = [pa.string() if k == "string" else pa.int64() for k in kinds]

    def written(batches):
        encoder, writer = word_ids(vocabulary), None
        end, width = encoder.packed([end_id]), int(encoder.dtype[-1])
        for batch in batches:
            for run in runs(batch, 1, BLOCK_BYTES):
                writer = writer or _Writer(folder, TaskContext.get().partitionId())
                texts = [t or b"" for t in run.column(1).cast(pa.binary()).to_pylist()]
                for one, ids in zip(run.column(0).to_pylist(), encoder.of(texts), strict=True):
                    flags = (one is not None) | (2 if width == 4 else 0)
                    writer.add(struct.pack("<Bq", flags, one or 0) + ids + end, len(ids) // width + 1)
        if writer is not None:
            writer.close()
            columns = zip(*writer.blocks, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keys = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = keys.repartitionByRange(_width(spark), F.asc_nulls_first("doc_id"), "h", "place")
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "place").select("doc_id", "text")
    return saved(ordered.mapInArrow(written, MANIFEST), "token-manifest")


def _starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``before``: the ids of all documents before the block."""
    files = manifest.groupBy("file_no").agg(F.sum("ids").alias("file_ids"))
    # one number per file in one window: as many rows as the write had tasks
    every = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file_no", F.coalesce(F.sum("file_ids").over(every), F.lit(0)).alias("base"))
    within = Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(base, "file_no").withColumn(
        "before", F.col("base") + F.coalesce(F.sum("ids").over(within), F.lit(0)))


def _width(spark: SparkSession) -> int:
    """Tasks of a step whose work in Python outweighs its rows' size: the session's
    shuffle width, which adaptive execution would otherwise narrow by bytes."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(_width(df.sparkSession), *keys)


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every record, verified."""
    import pyarrow as pa
    ship_package(manifest.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if with_ids:
        fields.append(("ids", pa.list_(pa.int64())))

    def records(batches):
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = _file_system(r["file"])
                with fs.open_input_file(path) as f:
                    data = f.read_at(r["bytes"], r["offset"])
                if len(data) != r["bytes"]:
                    raise ValueError(f"{r['file']}: block at byte {r['offset']} is cut off")
                rows, start = [], r["before"]
                for payload in parse(data, r["file"], r["offset"]):
                    one, ids = unpacked(payload)
                    rows.append((one, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype("i8")] if with_ids else [])))
                    start += len(ids)
                if len(rows) != r["records"] or start != r["before"] + r["ids"]:
                    raise ValueError(f"{r['file']}: block at byte {r['offset']} differs from the manifest")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    wanted = _starts(manifest).select("file", "offset", "bytes", "records", "ids", "before")
    return _spread(wanted, "file", "offset").mapInArrow(records, schema)


def offsets(manifest: DataFrame) -> DataFrame:
    """(file, record, offset, bytes, ids_before) of every record, from the index files."""
    import pyarrow as pa
    ship_package(manifest.sparkSession)

    def entries(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = _file_system(file.removesuffix(".records") + ".index")
                with fs.open_input_file(path) as f:
                    data = f.read()
                body = np.frombuffer(data[:-4], dtype=np.uint8)
                if len(data) % 16 != 4 or masked(crc32c(body, [0], [len(body)])).astype("<u4").tobytes() != data[-4:]:
                    raise ValueError(f"{file}: its index is damaged")
                table = body.view("<u8").reshape(-1, 2).astype(np.int64)
                for a in range(0, len(table) - 1, 100_000):
                    b = min(a + 100_000, len(table) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * (b - a)), pa.array(np.arange(a, b)), pa.array(table[a:b, 0]),
                         pa.array(np.diff(table[a:b + 1, 0])), pa.array(table[a:b, 1])],
                        ["file", "record", "offset", "bytes", "ids_before"])

    return _spread(manifest.select("file").distinct(), "file").mapInArrow(
        entries, "file string, record long, offset long, bytes long, ids_before long")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(place, doc_id, ids) of every record in a random order fixed by the seed:
    ascending ``place``, ranges of it per partition.  Each task reads its records at
    their offsets, file by file, a bounded run at a time."""
    import pyarrow as pa
    index = offsets(manifest).withColumn("place", F.xxhash64(F.lit(seed), F.regexp_extract("file", r"part-(\d+)", 1), "record"))
    order = index.repartitionByRange(_width(manifest.sparkSession), "place", "file", "record").sortWithinPartitions("place", "file", "record")

    def picked(batches):
        for batch in batches:
            sizes, at = np.cumsum(batch.column("bytes").to_numpy()), 0
            while at < len(sizes):
                until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 4 * BLOCK_BYTES, side="right")))
                yield fetched(batch.slice(at, until - at).to_pylist())
                at = until

    def fetched(rows):
        out: list = [None] * len(rows)
        by_file: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            by_file.setdefault(r["file"], []).append(k)
        for file, places in by_file.items():
            fs, path = _file_system(file)
            with fs.open_input_file(path) as f:
                for k in sorted(places, key=lambda k: rows[k]["offset"]):
                    payloads = list(parse(f.read_at(rows[k]["bytes"], rows[k]["offset"]), file, rows[k]["offset"]))
                    out[k] = unpacked(payloads[0])
        return pa.RecordBatch.from_arrays(
            [pa.array([r["place"] for r in rows], pa.int64()), pa.array([o[0] for o in out], pa.int64()),
             pa.array([o[1].astype("i8") for o in out], pa.list_(pa.int64()))], ["place", "doc_id", "ids"])

    return order.mapInArrow(picked, "place long, doc_id long, ids array<long>")


def output_folder(spark: SparkSession) -> str:
    """A new folder for records below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{spark.sparkContext.applicationId}/token-records-{uuid.uuid4().hex}"
