"""Toxicity by nearest labelled examples.

Terms are words and the first 4, 5 and 6 bytes of longer words.  The terms
that mark toxic documents are chosen by their counts among the distinct labelled
training texts (copies of a text count once); their inverse document frequency
is counted over all documents.
Labelled examples become TF-IDF vectors over these terms, held in an inverted
index whose postings are cut into blocks of examples with the largest weight a
block reaches.  A document's nearest examples are found exactly: blocks are
opened in order of their bound until no bound can reach the k-th cosine.  Votes
weighted by cosine are mapped to probabilities by isotonic regression on the
examples' own leave-one-out votes; a document without any term gets the share
of toxic rows among labelled training rows without any.

Bounds (parameters): ``MAX_LABELLED`` labelled rows are learned from,
``MAX_EXAMPLES`` indexed a class; every telling term of their texts is kept.  So
the model's size does not grow with the documents and it goes to the tasks as a
broadcast; documents are scored in one pass over whole texts.  Only telling terms
are compared: one in fewer than ``MIN_DOCS`` texts, or about as frequent in clean
texts (``MIN_Z``, ``MIN_LIFT``), has no part in a vector.

Defined results: a null text is empty (it has no term); rows with a null id or
label teach nothing; a document with several labels counts as toxic if one of
them is; without labelled rows the score is 0.5, without a telling term the
share of toxic rows; repeated ids are scored row by row; extra columns pass
through (a result column replaces one of its name); an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, text_runs
from .words import _BYTE, _STEP, Words, mix, powers, ranges, words_of

FOLDS, HELD_OUT = 3, 1
PREFIXES = (4, 5, 6)
MAX_LABELLED = 200_000
MAX_EXAMPLES = 4096
BLOCK = 64
NEIGHBOURS = 15
THRESHOLD = 0.7
MIN_DOCS, MIN_Z, MIN_LIFT = 3, 4.0, 4.0     # what makes a term telling


def fold_of(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def term_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every term use: the words, then the prefixes of longer words."""
    text = w.text_of_word()
    texts, hashes = [text], [w.hash]
    p = powers(max(PREFIXES) + 1)
    for n in PREFIXES:
        long = np.flatnonzero(w.size > n)
        total = np.zeros(len(long), dtype=np.uint64)
        for j in range(n):
            total = total + _BYTE[w.buf[w.start[long] + j]] * p[j]
        texts.append(text[long])
        hashes.append(mix(total + np.full(1, n, dtype=np.uint64) * _STEP[63]))
    return np.concatenate(texts), np.concatenate(hashes)


def term_counts(texts: list[bytes | None], terms: np.ndarray):
    """(text, term index, uses) for the given sorted term hashes."""
    text, h = term_hashes(words_of(texts))
    if not len(terms) or not len(h):
        return (np.zeros(0, dtype=np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    hit = terms[at] == h
    key, uses = np.unique(text[hit] * len(terms) + at[hit], return_counts=True)
    return key // len(terms), key % len(terms), uses


@dataclass
class Index:
    """Block-max inverted index over labelled examples."""
    terms: np.ndarray                       # sorted hashes
    idf: np.ndarray
    without: float                          # probability when no term occurs
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))     # examples one stands for
    who: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))    # postings by term and example
    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # runs of postings of a term and block
    top: np.ndarray = field(default_factory=lambda: np.zeros(0))                    # largest weight of each run
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # first posting of each run, and the end
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # first run of each term, and the end
    steps: tuple = ((0.0, 1.0), (0.0, 1.0))  # calibration: vote -> probability

    def vector(self, terms: np.ndarray, uses: np.ndarray) -> np.ndarray:
        v = (1 + np.log(uses)) * self.idf[terms]
        return v / np.sqrt((v * v).sum())

    def build(self, rows: list[tuple]) -> None:
        """rows: (doc_id, label, weight, terms, uses); like vectors stand together."""
        rows = sorted(rows, key=lambda r: (int(r[3][np.argmax(self.vector(r[3], r[4]))]), r[0]))
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.label = np.array([float(r[1]) for r in rows])
        self.weight = np.array([r[2] for r in rows])
        size = np.array([len(r[3]) for r in rows], dtype=np.int64)
        term = np.concatenate([np.zeros(0, dtype=np.int64)] + [r[3] for r in rows]).astype(np.int64)
        who = np.repeat(np.arange(len(rows)), size)
        x = np.concatenate([np.zeros(0)] + [self.vector(r[3], r[4]) for r in rows])
        order = np.lexsort((who, term))
        term, self.who, self.x = term[order], who[order], x[order]
        block = self.who // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.block, self.start = block[at], np.append(at, len(term))
        self.top = np.maximum.reduceat(self.x, at) if len(at) else np.zeros(0)
        self.first = np.searchsorted(term[at], np.arange(len(self.terms) + 1))

    def nearest(self, terms, vector, k: int = NEIGHBOURS, skip: int = -1):
        """The k examples of largest cosine (ties: lower place), exactly."""
        n_runs = self.first[terms + 1] - self.first[terms]
        run, by = ranges(self.first[terms], n_runs), np.repeat(vector, n_runs)
        bound = np.bincount(self.block[run], by * self.top[run], minlength=1)
        best_s, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or (len(best_s) >= k and bound[b] < best_s[-1] - 1e-12):
                break
            mine = np.flatnonzero(self.block[run] == b)
            n = self.start[run[mine] + 1] - self.start[run[mine]]
            at = ranges(self.start[run[mine]], n)
            s = np.bincount(self.who[at] - b * BLOCK, np.repeat(by[mine], n) * self.x[at], minlength=BLOCK)
            here = np.flatnonzero(s > 0)
            best_s = np.concatenate((best_s, s[here]))
            best_i = np.concatenate((best_i, here + b * BLOCK))
            if skip >= 0:
                best_s, best_i = best_s[best_i != skip], best_i[best_i != skip]
            order = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[order], best_i[order]
        return best_i, best_s

    def vote(self, who, cosine) -> float:
        w = cosine * self.weight[who]
        return float((w * self.label[who]).sum() / w.sum()) if len(who) else 0.0

    def calibrate(self) -> None:
        """Isotonic regression (pool adjacent violators) of label on leave-one-out vote."""
        votes = np.zeros(len(self.ids))
        term = np.repeat(np.repeat(np.arange(len(self.terms)), np.diff(self.first)), np.diff(self.start))
        order = np.argsort(self.who, kind="stable")
        ends = np.searchsorted(self.who[order], np.arange(len(self.ids) + 1))
        for i in range(len(self.ids)):
            mine = order[ends[i]:ends[i + 1]]
            votes[i] = self.vote(*self.nearest(term[mine], self.x[mine], skip=i))
        pools: list[list[float]] = []         # vote sum, label sum, weight
        for i in np.argsort(votes, kind="stable"):
            pools.append([votes[i] * self.weight[i], self.label[i] * self.weight[i], self.weight[i]])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if pools:
            # a little weight at one half keeps probabilities off 0 and 1
            self.steps = (tuple(p[0] / p[2] for p in pools), tuple((p[1] + 0.5) / (p[2] + 1.0) for p in pools))

    def score(self, terms: np.ndarray, uses: np.ndarray):
        """(probability, example places, cosines) of one document's terms."""
        if not len(terms) or not len(self.ids):
            return self.without, np.zeros(0, dtype=np.int64), np.zeros(0)
        who, cosine = self.nearest(terms, self.vector(terms, uses))
        if not len(who):
            return self.without, who, cosine
        return float(np.interp(self.vote(who, cosine), *self.steps)), who, cosine


def _labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """Texts of the training rows that carry a label: (doc_id, text, toxic).

    At most about ``limit`` labelled ids take part, chosen by hash, so the label
    table may be broadcast."""
    ids = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold_of(F.col("doc_id")) != HELD_OUT)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    ids = saved(ids, "tox-labels")
    n = ids.count()
    if n > limit:
        ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * limit / n))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def _counted(rows: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents per term over all rows: one row a task and term leaves the tasks."""
    import pyarrow as pa
    known = rows.sparkSession.sparkContext.broadcast(terms)

    def counted(batches):
        total = np.zeros(len(known.value), dtype=np.int64)
        for batch in batches:
            for run in text_runs(batch, 0):
                total += np.bincount(term_counts(run, known.value)[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["term", "n"])
    out = np.zeros(len(terms), dtype=np.int64)
    got = rows.select("text").mapInArrow(counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def _candidates(toxic: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Terms of ``MIN_DOCS`` toxic texts or more with their counts (the labelled texts bound them)."""
    import pyarrow as pa

    def counted(batches):
        for batch in batches:
            for run in text_runs(batch, 0):
                text, h = term_hashes(words_of(run))
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                u, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])
    terms = saved(toxic.select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
                  .where(F.col("n") >= MIN_DOCS), "tox-terms")
    got = terms.toPandas()
    h = got["h"].to_numpy().view(np.uint64) if len(got) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        max_labelled: int = MAX_LABELLED, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index, learned from the labelled rows outside the held-out fold."""
    import pyarrow as pa
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    labels = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").alias("toxic"))
    rows = _labelled(docs, labels, max_labelled)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    share = (n_pos + 1) / (n_pos + n_neg + 2)
    # copies of a text are one text when terms are chosen
    texts = saved(rows.withColumn("key", F.xxhash64("text")).dropDuplicates(["key", "toxic"]).select("text", "toxic"),
                  "tox-texts")
    d = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    d_pos, d_neg = d.get(1, 0), d.get(0, 0)
    terms, pos = _candidates(texts.where("toxic = 1"))
    neg = _counted(texts.where("toxic = 0"), terms) if len(terms) else np.zeros(0)
    p1, p0 = (pos + 0.5) / (d_pos + 1), (neg + 0.5) / (d_neg + 1)
    p = (pos + neg + 0.5) / (d_pos + d_neg + 1)
    z = (p1 - p0) / np.sqrt(p * (1 - np.minimum(p, 0.999)) * (1 / (d_pos + 1) + 1 / (d_neg + 1)))
    good = np.flatnonzero((z > MIN_Z) & (p1 > MIN_LIFT * p0))
    terms = terms[good]
    if not len(terms):
        return Index(terms, np.zeros(0), share)
    n_docs = docs.count()
    index = Index(terms, np.log((n_docs + 1) / (_counted(docs, terms) + 1)) + 1.0, share)
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches):
        for batch in batches:
            ids, toxic, at = batch.column(0), batch.column(2), 0
            for run in text_runs(batch, 1):
                doc, term, uses = term_counts(run, known.value)
                ends = np.searchsorted(doc, np.arange(len(run) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, uses)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(run)), toxic.slice(at, len(run)), *lists], ["doc_id", "toxic", "terms", "uses"])
                at += len(run)
    examples = saved(rows.select("doc_id", "text", "toxic").mapInArrow(
        vectors, "doc_id long, toxic int, terms array<int>, uses array<int>"), "tox-examples")
    with_terms = examples.where(F.size("terms") > 0)
    m = {r["toxic"]: r["n"] for r in with_terms.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    m_pos, m_neg = m.get(1, 0), m.get(0, 0)
    index.without = (n_pos - m_pos + 1) / (n_pos - m_pos + n_neg - m_neg + 2)
    rate = {y: min(1.0, max_examples / max(1, k)) for y, k in ((1, m_pos), (0, m_neg))}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("x")), F.lit(1 << 30)) < F.when(
        F.col("toxic") == 1, F.lit(int((1 << 30) * rate[1]))).otherwise(F.lit(int((1 << 30) * rate[0])))
    index.build([(r["doc_id"], r["toxic"], 1 / rate[r["toxic"]], np.array(r["terms"]), np.array(r["uses"]))
                 for r in with_terms.where(drawn).collect()])
    index.calibrate()
    return index


def score(df: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD,
          evidence: bool = True) -> DataFrame:
    """Input columns plus score, predicted and evidence (nearest examples: id, label, cosine)."""
    import pyarrow as pa
    known = df.sparkSession.sparkContext.broadcast(index)
    results = ["score", "predicted", "evidence"][:3 if evidence else 2]
    kept = [c for c in df.columns if c not in results]
    kind = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()),
                                     T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([df.schema[c] for c in kept] + [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
        + [T.StructField("evidence", kind)] * evidence)
    evidence_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def scored(batches):
        index = known.value
        for batch in batches:
            at, columns = 0, batch.columns[:-1]
            for run in text_runs(batch, batch.num_columns - 1):
                doc, term, uses = term_counts(run, index.terms)
                ends = np.searchsorted(doc, np.arange(len(run) + 1))
                p, proof = np.full(len(run), index.without), [[] for _ in run]
                for k in np.unique(doc):
                    a, b = ends[k], ends[k + 1]
                    p[k], who, cosine = index.score(term[a:b], uses[a:b])
                    proof[k] = [{"doc_id": int(index.ids[i]), "toxic": int(index.label[i]), "cosine": float(c)}
                                for i, c in zip(who, cosine, strict=True)]
                out = [c.slice(at, len(run)) for c in columns] + [
                    pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                if evidence:
                    out.append(pa.array(proof, evidence_type))
                yield pa.RecordBatch.from_arrays(out, kept + results)
                at += len(run)
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    return rows.mapInArrow(scored, schema)


def drop_toxic(df: DataFrame, index: Index, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, as they are (``text`` is a string column; rows
    travel to the tasks once and are filtered there, run by run)."""
    import pyarrow as pa
    known, place = df.sparkSession.sparkContext.broadcast(index), df.columns.index(text)

    def clean(batches):
        index = known.value
        for batch in batches:
            at = 0
            for run in text_runs(batch, place):
                doc, term, uses = term_counts(run, index.terms)
                ends = np.searchsorted(doc, np.arange(len(run) + 1))
                p = np.full(len(run), index.without)
                for k in np.unique(doc):
                    p[k] = index.score(term[ends[k]:ends[k + 1]], uses[ends[k]:ends[k + 1]])[0]
                yield batch.slice(at, len(run)).filter(pa.array(p < threshold))
                at += len(run)
    return df.mapInArrow(clean, df.schema)
