"""Hierarchical multi-length packing of tokenised documents.

A document's ids are cut into whole windows of the largest context size; what
is left is routed to the tier of the smallest context size that holds it.  Each
tier's windows open with one of its own rests, their gaps are filled with the
largest fitting rests of the shorter tiers, and the last gap by a cut from a
waiting rest, so windows are exactly full.  Full windows of the same tier are
dealt into step groups by attention cost (the sum of squared piece lengths), in
snake order, so that groups cost alike.

Work is local to a partition: ids are made, packed and checksummed in one pass,
nothing is shuffled and only ``FLUSH_TOKENS`` of rests wait at a time.  What a
partition has left at its end is cut into powers of two, which need no padding.  Sequence ids carry the partition number, so they are
unique without a count.

Ids are those of the named public vocabulary with an end id appended.  The
vocabulary's rank file gives the same ids as its JSON file, only faster; a text
that holds the special token's own string goes through the JSON file.

Defined results: a null text is the end id alone; null and repeated document
ids are packed like others; extra columns are ignored; an empty table gives no
piece.
"""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_SEQUENCES = 64
FLUSH_TOKENS = 1 << 18
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, step_group long")
SPECIAL = "<|endoftext|>"


def encoder(ranks_file: str = "byte_bpe_50k.tiktoken", json_file: str = "byte_bpe_50k.json"):
    """Text -> ids (uint32 array, without the end id)."""
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            if not exact:
                from tokenizers import Tokenizer
                exact.append(Tokenizer.from_file(public_tokenizers.path(json_file)))
            return np.array(exact[0].encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")
    return encode


class Packer:
    """Packs one partition's documents; ``rows`` holds finished pieces."""

    def __init__(self, partition: int, tiers=TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.base = partition << 33
        self.sequences = self.groups = self.waiting = 0
        self.rests: list[tuple[int, int]] = []      # (length, key), sorted by length
        self.items: dict[int, tuple] = {}           # key -> (doc_id, start, ids, doc_tokens)
        self.next_key = 0
        self.ready: dict[int, list] = {t: [] for t in self.tiers}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, n, at = self.tiers[0], len(ids), 0
        while n - at >= top:
            self.ready[top].append([(doc_id, at, ids[at:at + top], n)])
            at += top
        if at < n:
            self._wait(doc_id, at, ids[at:], n)
        if self.waiting >= FLUSH_TOKENS:
            self._pack(final=False)
        if len(self.ready[top]) >= 8 * STEP_SEQUENCES:
            self._emit(top)

    def finish(self) -> None:
        self._pack(final=True)
        for t in list(self.ready):
            self._emit(t)

    def _wait(self, doc_id, start, ids, doc_tokens) -> None:
        self.items[self.next_key] = (doc_id, start, ids, doc_tokens)
        bisect.insort(self.rests, (len(ids), self.next_key))
        self.next_key += 1
        self.waiting += len(ids)

    def _take(self, place: int) -> tuple:
        length, key = self.rests.pop(place)
        self.waiting -= length
        return self.items.pop(key)

    def _tier(self, length: int) -> int:
        return min(t for t in self.tiers if t >= length)

    def _pack(self, final: bool) -> None:
        """Fill windows, longest rests first, while the rests fill them."""
        while self.rests:
            window = self._tier(self.rests[-1][0])
            if self.waiting < window:
                if not final:
                    return
                # the end of the partition: the largest power of two that can be filled
                window = 1 << (self.waiting.bit_length() - 1)
            gap, pieces = window, []
            while gap:
                fit = bisect.bisect_right(self.rests, (gap, self.next_key)) - 1
                if fit >= 0:
                    piece = self._take(fit)
                else:                              # all rests are longer than the gap: cut one
                    doc_id, start, ids, total = self._take(0)
                    piece = (doc_id, start, ids[:gap], total)
                    self._wait(doc_id, start + gap, ids[gap:], total)
                pieces.append(piece)
                gap -= len(piece[2])
            self.ready.setdefault(window, []).append(pieces)
        self._settle()

    def _settle(self) -> None:
        for t in list(self.ready):
            if len(self.ready[t]) >= STEP_SEQUENCES:
                self._emit(t)

    def _emit(self, tier: int) -> None:
        """Deal the tier's ready sequences into step groups of like cost."""
        ready, self.ready[tier] = self.ready[tier], []
        if not ready:
            return
        n_groups = max(1, round(len(ready) / STEP_SEQUENCES))
        ready.sort(key=lambda s: -sum(len(p[2]) ** 2 for p in s))
        for k, pieces in enumerate(ready):
            turn, place = divmod(k, n_groups)
            group = self.groups + (place if turn % 2 == 0 else n_groups - 1 - place)
            offset = 0
            for doc_id, start, ids, total in pieces:
                self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total,
                                  self.base + self.sequences, offset, tier, self.base + group))
                offset += len(ids)
            self.sequences += 1
        self.groups += n_groups


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tiers=TIERS, end_id: int = END_ID,
         ranks_file: str = "byte_bpe_50k.tiktoken", json_file: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece (see SCHEMA); ``tier`` is the window's length."""
    import pyarrow as pa
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int32() if x.endswith(" int") else pa.int64() for x in SCHEMA.split(", ")]

    def packed(batches):
        encode, packer = encoder(ranks_file, json_file), Packer(TaskContext.get().partitionId(), tiers)
        end = np.array([end_id], dtype="<u4")

        def out():
            columns = list(zip(*packer.rows, strict=True))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, one in enumerate(ids):
                packer.add(one, np.concatenate((encode(texts[k].as_py() or ""), end)))
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(packed, SCHEMA)
