"""LM scoring by subword lattice likelihood.

Every word is a lattice of the pieces of an existing public vocabulary (with a
word-begin mark and byte pieces as fallback).  A forward recursion in log space
sums the probability of all segmentations, so a text's score is its marginal
log probability: the product over words, times the end piece.  The vocabulary's
own scores (ranks) give the first piece weights, ``log 1 / (rank + 10)``; each
round of re-estimation then replaces them by the pieces' expected counts over
all segmentations of all training words (forward and backward recursion on the
table of distinct words, weighted by their counts).

Training documents are those whose crc32 of the id's text is not ``HELD_OUT``
modulo ``FOLDS``.  Words are counted per chunk of texts inside tasks, then by a
map-side combined aggregation on the word.  Scoring is one pass over the texts:
the most frequent words (a table held to ``FREQUENT_WORDS`` rows by a count
threshold) come with count and lattice value as a broadcast; a rarer word's
lattice is run where it stands, and its training count comes by a join on the
word's hash, after which counts are summed per row.

Defined results: a null text is empty (its only token is the end); a null id
hashes as the empty text (0: training); repeated ids are rows of their own; with
no training rows N = V = 0 and the base is log10(1 / 1) = 0 a token; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .words import _BYTE, chunks, powers, ranges, words_of

FOLDS, HELD_OUT = 7, 2
FREQUENT_WORDS = 1 << 18
ROUNDS = 2
MARK = "▁".encode()
MAX_PIECE = 24                      # bytes; longer pieces of the vocabulary hold blanks only
LATTICE_CELLS = 1 << 18


def vocabulary(model: str = "piece_bpe_32k.model") -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (byte pieces as their byte) and initial log weights; the
    end piece is last."""
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces, weight = [], []
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = bytes([int(text[3:5], 16)]) if sp.is_byte(i) else text.encode()
        if len(piece) <= MAX_PIECE and MARK not in piece[1:]:
            pieces.append(piece)
            weight.append(1e-7 if sp.is_byte(i) else 1.0 / (10.0 - sp.get_score(i)))
    pieces.append(b"")
    weight.append(0.01)
    w = np.array(weight)
    return pieces, np.log(w / w.sum())


class Lattice:
    """Forward (and backward) recursions over many words at once.

    Words come as their joined bytes and their sizes.  Every place of a word walks
    the vocabulary's prefixes until none goes on; the pieces met on the way are
    the lattice's edges, kept as lists by (end, size)."""

    def __init__(self, pieces: list[bytes], log_weight: np.ndarray):
        """Pieces that read the same (a byte and its character) share one entry."""
        self.log_weight = log_weight
        ids: dict[bytes, int] = {}
        for i, p in enumerate(pieces):
            for k in range(1, len(p)):
                ids.setdefault(p[:k], -1)
            if p and ids.get(p, -1) < 0:
                ids[p] = i
        self.by_size = {}
        for size in range(1, MAX_PIECE + 1):
            some = [p for p in ids if len(p) == size]
            if some:
                raw = np.frombuffer(b"".join(some), dtype=np.uint8).reshape(-1, size)
                h = (_BYTE[raw] * powers(MAX_PIECE + 1)[:size]).sum(axis=1, dtype=np.uint64)
                order = np.argsort(h, kind="stable")
                self.by_size[size] = (h[order], np.array([ids[p] for p in some], dtype=np.int64)[order])

    def _edges(self, text: np.ndarray, size: np.ndarray):
        """Marked sizes and the edges as [(end, piece size, words, pieces)], by end."""
        first = len(MARK)
        size = size + first
        width = int(size.max())
        raw = np.zeros((len(size), width), dtype=np.uint8)
        raw[:, :first] = np.frombuffer(MARK, dtype=np.uint8)
        raw[:, first:][np.arange(width - first) < (size - first)[:, None]] = text
        word, place = np.nonzero(np.arange(width) < size[:, None])
        left, raw, at = (size[word] - place), raw.ravel(), word * width + place
        h, p = np.zeros(len(word), dtype=np.uint64), powers(MAX_PIECE + 1)
        found = []
        for k, (hashes, ids) in self.by_size.items():
            go = np.flatnonzero(left >= k)
            if not len(go):
                break
            word, place, left, at = word[go], place[go], left[go], at[go]
            h = h[go] + _BYTE[raw[at + k - 1]] * p[k - 1]
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            go = np.flatnonzero(hashes[spot] == h)
            word, place, left, at, h = word[go], place[go], left[go], at[go], h[go]
            piece = ids[spot[go]]
            whole = np.flatnonzero(piece >= 0)
            found.append(np.stack((place[whole] + k, np.full(len(whole), k), word[whole], piece[whole])))
        end, k, word, piece = np.concatenate(found, axis=1)
        key = end * (MAX_PIECE + 1) + k
        order = np.argsort(key, kind="stable")
        key, word, piece = key[order], word[order], piece[order]
        cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        return size, width, [(*divmod(int(key[a]), MAX_PIECE + 1), word[a:b], piece[a:b])
                             for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]

    def _forward(self, text, size):
        size, width, edges = self._edges(text, size)
        alpha = np.full((width + 1, len(size)), -np.inf)
        alpha[0] = 0.0
        for end, k, word, piece in edges:
            alpha[end, word] = np.logaddexp(alpha[end, word], alpha[end - k, word] + self.log_weight[piece])
        return size, width, edges, alpha

    def score(self, text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(size))
        for run, part in _runs(text, size):
            marked, _, _, alpha = self._forward(part, size[run])
            out[run] = alpha[marked, np.arange(len(run))]
        return out

    def expected(self, text: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece over all segmentations."""
        out = np.zeros(len(self.log_weight))
        for run, part in _runs(text, size):
            marked, width, edges, alpha = self._forward(part, size[run])
            n = np.arange(len(run))
            whole = alpha[marked, n]
            beta = np.full((width + 1, len(run)), -np.inf)
            beta[marked, n] = 0.0
            used, share = [], []
            for end, k, word, piece in reversed(edges):
                behind = beta[end, word] + self.log_weight[piece]
                used.append(piece)
                share.append(np.exp(alpha[end - k, word] + behind - whole[word]) * counts[run][word])
                beta[end - k, word] = np.logaddexp(beta[end - k, word], behind)
            out += np.bincount(np.concatenate(used), np.concatenate(share), len(out))
        return out


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.array([len(w) for w in words], dtype=np.int64)


def _runs(text: np.ndarray, size: np.ndarray):
    """Runs of words of like length (indices, joined bytes), so that a run's matrix stays small."""
    order = np.argsort(size, kind="stable")
    start = np.cumsum(size) - size
    a = 0
    while a < len(order):
        b = min(len(order), a + max(1, LATTICE_CELLS // int(size[order[a]] + len(MARK))))
        while b > a + 1 and (b - a) * (int(size[order[b - 1]]) + len(MARK)) > 2 * LATTICE_CELLS:
            b = a + max(1, (b - a) // 2)
        run = order[a:b]
        yield run, text[ranges(start[run], size[run])]
        a = b


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def _hash_words(words: list[bytes]) -> np.ndarray:
    w = words_of([b" ".join(words)])
    return w.hash


def _binary(pa, text: np.ndarray, size: np.ndarray):
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text)])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts of ``docs``; chunk counts are combined map-side."""
    import pyarrow as pa

    def counted(batches):
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for run in chunks(texts, lambda t: len(t or b"")):
                w = words_of(run)
                _, at, c = np.unique(w.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_binary(pa, *w.slices(at)), pa.array(c, pa.int64())], ["word", "c"])
    return (docs.select("text").mapInArrow(counted, "word binary, c long")
            .groupBy("word").agg(F.sum("c").alias("c")))


def fit_pieces(counts: DataFrame, n_texts: int, model: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the vocabulary's pieces after re-estimation on all words."""
    import pyarrow as pa
    pieces, log_weight = vocabulary(model)
    for _ in range(rounds):
        known = counts.sparkSession.sparkContext.broadcast(log_weight)

        def expected(batches, known=known):
            names, _ = vocabulary(model)
            lattice, total = Lattice(names, known.value), 0.0
            for batch in batches:
                words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                total = total + lattice.expected(*joined(words), c.astype(float))
            if np.ndim(total):
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])
        # one row per piece of the vocabulary at most
        rows = counts.mapInArrow(expected, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full(len(pieces), 0.1)
        n[rows["piece"].to_numpy()] += rows["n"].to_numpy()
        n[-1] += n_texts
        log_weight = np.log(n / n.sum())
    return log_weight


def _frequent(counts: DataFrame, limit: int) -> DataFrame:
    """Words above the smallest count that leaves ``limit`` of them at most."""
    sizes = (counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("c")).collect())
    total, threshold = 0, None
    for r in sizes:
        total += r["n"]
        if total > limit:
            break
        threshold = r["c"]
    return counts.where(F.lit(False)) if threshold is None else counts.where(F.col("c") >= threshold)


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model",
          rounds: int = ROUNDS, frequent_words: int = FREQUENT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import pyarrow as pa
    sc = df.sparkSession.sparkContext
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
                     (F.coalesce(fold_of(F.col(f"`{doc_id}`")), F.lit(0)) == HELD_OUT).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = saved(word_counts(training), "lm-counts")
    n_texts = training.count()
    stat = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train = stat["n"] + n_texts
    v_train = stat["v"] + (1 if n_texts else 0)
    log_weight = sc.broadcast(fit_pieces(counts, n_texts, model, rounds))
    frequent = _frequent(counts, frequent_words)

    def valued(batches):
        names, _ = vocabulary(model)
        lattice = Lattice(names, log_weight.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_hash_words(words).view(np.int64)), batch.column(1), pa.array(lattice.score(*joined(words)))],
                ["h", "c", "lp"])
    top = frequent.mapInArrow(valued, "h long, c long, lp double").toPandas()
    order = np.argsort(top["h"].to_numpy().view(np.uint64))
    table = sc.broadcast((top["h"].to_numpy().view(np.uint64)[order], top["c"].to_numpy()[order],
                          top["lp"].to_numpy()[order]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, log_count double, "
              "score double, rare array<long>")

    def scored(batches):
        names, _ = vocabulary(model)
        lattice = Lattice(names, log_weight.value)
        known, c, lp = table.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, at = batch.column(1).cast(pa.binary()).to_pylist(), 0
            for run in chunks(texts, lambda t: len(t or b"")):
                w = words_of(run)
                u, first, inv = np.unique(w.hash, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
                hit = known[place] == u if len(known) else np.zeros(len(u), bool)
                value, count = np.zeros(len(u)), np.zeros(len(u))
                if len(known):
                    value[hit], count[hit] = lp[place[hit]], c[place[hit]]
                miss = np.flatnonzero(~hit)
                if len(miss):
                    value[miss] = lattice.score(*w.slices(first[miss]))
                text_of, n = w.text_of_word(), len(run)
                rare_at = np.flatnonzero(~hit[inv])
                ends = np.searchsorted(rare_at, w.first)
                sums = [np.bincount(text_of, x[inv], n).astype(float) for x in (value, np.log10(count + 1), hit)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), batch.column(0).slice(at, n), batch.column(2).slice(at, n),
                     pa.array(np.diff(w.first).astype(np.int64) + 1), pa.array(sums[2].astype(np.int64)),
                     pa.array(sums[1]), pa.array((sums[0] + log_weight.value[-1]) / math.log(10)),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w.hash[rare_at].view(np.int64)))],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "log_count", "score", "rare"])
                row += n
                at += n
    passed = saved(docs.select("doc_id", "text", "held_out").mapInArrow(scored, schema), "lm-pass")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(_hash_words(batch.column(0).to_pylist()).view(np.int64)), batch.column(1)], ["h", "c"])
    all_counts = counts.mapInArrow(hashed, "h long, c long")
    rare = (passed.select("row", F.explode("rare").alias("h")).join(all_counts, "h")
            .groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_log")))
    d = passed.drop("rare").join(rare, "row", "left")
    end_known, end_count = (1, math.log10(n_texts + 1)) if n_texts else (0, 0.0)
    log_count = F.col("log_count") + F.coalesce("more_log", F.lit(0.0)) + F.lit(end_count)
    return d.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(end_known)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (log_count - F.col("n_tokens") * F.lit(math.log10(n_train + v_train + 1))).alias("base_score"), "score")
