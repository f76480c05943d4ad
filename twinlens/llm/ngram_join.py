"""N-gram Jaccard join through a token-group matrix.

A document is the set of its hashed word shingles; two link when the Jaccard
similarity of their sets reaches 3/4.  Equal sets are one set from the start.

1. Order: tokens are taken in the order of their hashes, common passages last.
   Common are tokens that several sets of one run of texts hold, ``COMMON`` times or
   more in all (counted over all texts; the order is a matter of speed, not of
   results).  Two sets that link share one of their first n - ceil(3n/4) + 1
   tokens in any common order, so this prefix is all the matrix needs.
2. Groups: sets with the same least hash meet their pivot, the one with most common
   tokens beyond its own ones (the first document of equals): a family's middle links
   with most of it.  Pairs that verify as links make the groups, the rest are groups
   of one.
3. Matrix: (token, group) for the prefix tokens of every member.  Where groups
   share tokens, a witness of each is compared with the token's first witness,
   which joins most groups that belong together.
4. Bound: the tokens a query's prefix shares with a group's union must reach
   what a member of a fitting size would need.  Only qualifying groups are
   opened, and their fitting members compared with the query exactly.  Of two
   groups the smaller one's sets are the queries.  A set with common tokens in its
   prefix has all its rare ones before them, so two such sets share at most the
   smaller one's common tokens and the rare ones that both prefixes hold.  Common
   tokens bring together only sets that this lets reach the overlap they need, found
   by their few kinds (size, common tokens): near copies of one text that lie too far
   from each other never meet.
5. Large groups (``LARGE`` sets or more) are narrowed before they are opened, over all
   tokens of their members and queries.  A query that links with the group's centre
   (its set of most verified links) belongs to it and is done.  The group's core are
   the tokens that more than ``CORE`` members hold; query and member share at most the
   smaller one's core tokens and the tokens outside the core that both hold, of which
   each is with few members.  Only pairs whose sum reaches the overlap they need are
   compared.

Links found are exact and none is lost that joins two components: steps 2 and 3
only merge verified links, and steps 4 and 5 try every member of every other
group that the bounds leave.  Work is proportional to tokens shared across groups,
not to pairs within a group of copies.

Defined results: a text of fewer than ``K`` words is one shingle; a null text or
one without words is empty and links with nothing; a null id takes part in
links, its component being the least id reached, if any; repeated ids are rows
of one id; extra columns are ignored; an empty table gives an empty result.
Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lanes, runs, saved, small, text_runs
from .components import connected_components
from .words import chunks, mix, shingle_sets, words_of

K = 5
COMMON = 16
MAX_COMMON = 1 << 20
RUN_TOKENS = 1 << 22
MIN_SKETCH, SKETCH = 3, 8
LARGE, CORE = 64, 16


def _rest(n: Column) -> Column:
    """Tokens behind the prefix: ceil(3n / 4) - 1."""
    return F.floor((F.lit(3) * n + 3) / 4) - 1


def _needed(n: Column, m: Column) -> Column:
    """Prefix tokens that linked sets of n and m tokens share at least."""
    overlap = F.ceil(F.lit(3) * (n + m) / 7)
    return F.greatest(F.lit(1), overlap - F.greatest(_rest(n), _rest(m)))


def _least_needed(n: Column, lo: Column, hi: Column) -> Column:
    """No more than ``_needed(n, m)`` of any m from lo to hi.  Up to m = n it never falls.
    Behind, it is ceil(3(n + m) / 7) - ceil(3m / 4) + 1 (or 1), whose inside falls while
    each rounding is off by less than 1: an m before hi needs one less than hi at worst."""
    return F.greatest(F.lit(1), F.least(_needed(n, lo), _needed(n, hi) - 1))


def _fits(n: Column, m: Column) -> Column:
    return (F.lit(4) * F.least(n, m)) >= (F.lit(3) * F.greatest(n, m))


def _text_bytes(batch, k):
    import pyarrow as pa
    return batch.column(k).cast(pa.binary()).to_pylist()


def _set_key(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))]))[0])


def common_tokens(docs: DataFrame, k: int = K) -> np.ndarray:
    """Sorted tokens that go to the end of the order, ``MAX_COMMON`` at most."""
    import pyarrow as pa

    def repeated(runs):
        token, n = np.unique(np.concatenate(runs), return_counts=True)
        again = n > 1
        return pa.RecordBatch.from_arrays([pa.array(token[again].view(np.int64)), pa.array(n[again].astype(np.int64))],
                                          ["token", "n"])

    def rows(batches):
        seen, runs, size = set(), [], 0
        for batch in batches:
            for run in text_runs(batch, 0):
                for x in shingle_sets(words_of(run), k):
                    key = _set_key(x) if len(x) else None
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    runs.append(x)
                    size += len(x)
                if size >= RUN_TOKENS:
                    yield repeated(runs)
                    seen, runs, size = set(), [], 0
        if runs:
            yield repeated(runs)
    counts = saved(docs.select("text").mapInArrow(rows, "token long, n long").groupBy("token")
                   .agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON), "common")
    total, least = 0, None
    for r in (counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("c"))
              .orderBy(F.desc("n")).collect()):
        total += r["c"]
        if total > MAX_COMMON:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    return np.sort(counts.where(F.col("n") >= least).select("token").toPandas()["token"].to_numpy().view(np.uint64))


def shingled(docs: DataFrame, common: np.ndarray, k: int = K) -> DataFrame:
    """doc_id, text key, n, set key ``s``; once a task and set, its least hashes, prefix
    and number of common tokens."""
    import pyarrow as pa
    last = docs.sparkSession.sparkContext.broadcast(common)

    def prefix(tokens):
        n, n_common = len(tokens), 0
        if len(last.value):
            place = np.minimum(np.searchsorted(last.value, tokens), len(last.value) - 1)
            late = last.value[place] == tokens
            n_common = int(late.sum())
            tokens = np.concatenate((tokens[~late], tokens[late]))
        return tokens[:n - ((3 * n + 3) // 4 - 1)].view(np.int64), n_common

    def rows(batches):
        seen = set()
        for batch in batches:
            at = 0
            for run in text_runs(batch, 2):
                sets = shingle_sets(words_of(run), k)
                keys, sketches, prefixes, commons = [], [], [], []
                for x in sets:
                    key = _set_key(x) if len(x) else None
                    new = key is not None and key not in seen
                    seen.add(key)
                    keys.append(None if key is None else key - (1 << 64) * (key >> 63))
                    sketches.append(x[:SKETCH].view(np.int64) if new else None)
                    first, n_common = prefix(x) if new else (None, None)
                    prefixes.append(first)
                    commons.append(n_common)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(run)), batch.column(1).slice(at, len(run)),
                     pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.int64()),
                     pa.array(sketches, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())),
                     pa.array(commons, pa.int64())],
                    ["doc_id", "text_key", "n", "s", "sketch", "prefix", "n_common"])
                at += len(run)
    return docs.mapInArrow(rows, "doc_id long, text_key long, n long, s long, sketch array<long>, prefix array<long>, "
                           "n_common long")


def _texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """One text (text_key, text) of each of the distinct ``keys``."""
    return saved(docs.select("text_key", "text").join(small(saved(keys, "text-keys")), "text_key", "left_semi")
                 .groupBy("text_key").agg(F.first("text").alias("text")), "texts")


def tokens_of(sets: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """Rows (s, tokens): all tokens of each of the ``sets`` (s, text_key)."""
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            at = 0
            for run in text_runs(batch, 1):
                found = shingle_sets(words_of(run), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), pa.array(
                    [x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["s", "tokens"])
                at += len(run)
    texts = sets.join(_texts(sets.select("text_key").distinct(), docs), "text_key").select("s", "text")
    return saved(texts.mapInArrow(rows, "s long, tokens array<long>"), "tokens")


def verify(pairs: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """The pairs (a, b, key_a, key_b) whose texts' sets link, as (a, b)."""
    import pyarrow as pa
    pairs = saved(pairs.select("a", "b", "key_a", "key_b").distinct(), "pairs")
    keys = pairs.select(F.col("key_a").alias("text_key")).union(pairs.select("key_b")).distinct()
    texts = _texts(keys, docs)
    both = (pairs.join(texts.select(F.col("text_key").alias("key_a"), F.col("text").alias("text_a")), "key_a")
            .join(texts.select(F.col("text_key").alias("key_b"), F.col("text").alias("text_b")), "key_b")
            .select("a", "b", "key_a", "text_a", "key_b", "text_b"))

    def linked(batches):
        for batch in (part for whole in batches for part in runs(whole, 3)):
            ka, kb = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            rows = list(zip(range(len(ka)), ka, _text_bytes(batch, 3), kb, _text_bytes(batch, 5), strict=True))
            good = []
            for run in chunks(rows, lambda r: len(r[2]) + len(r[4])):
                texts = {r[1]: r[2] for r in run} | {r[3]: r[4] for r in run}
                place = {key: i for i, key in enumerate(texts)}
                sets = shingle_sets(words_of(list(texts.values())), k)
                for i, one, _, other, _ in run:
                    x, y = sets[place[one]], sets[place[other]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= 75 * (len(x) + len(y) - common):
                        good.append(i)
            good = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], ["a", "b"])
    return saved(both.mapInArrow(linked, "a long, b long"), "linked")


def _labels(edges: DataFrame) -> DataFrame:
    return saved(connected_components(edges).select(F.col("node").alias("s"), F.col("component").alias("g")), "groups")


def _with_groups(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the group of their set (the set itself if in none)."""
    return rows.join(small(labels), "s", "left").withColumn("g", F.coalesce("g", "s"))


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (token, rare, s) whose token occurs in two sets or more.  One exchange on the
    token, of nothing but these, serves both the count and the rows."""
    rows = rows.select("token", "rare", "s").repartition("token")
    tokens = (rows.groupBy("token").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
              .where("lo <> hi").select("token"))
    return rows.join(tokens.hint("shuffle_hash"), "token")


def _across(rows: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (token, rare, s, n, n_common, g) whose token occurs in two groups or more."""
    rows = _with_groups(rows.join(small(sets.select("s", "n", "n_common")), "s"), labels)
    rows = rows.select("token", "rare", "s", "n", "n_common", "g")
    rows = rows.distinct().repartition("token")
    tokens = (rows.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
              .where("lo <> hi").select("token"))
    return rows.join(tokens.hint("shuffle_hash"), "token")


def _meetings(across: DataFrame, size: DataFrame) -> DataFrame:
    """Rows of a query (s, n, n_common, late: common tokens in its prefix, own group), a
    larger group's union and a token of both, rare or not.  No row is missing of a rare
    token, nor of sets that link without sharing one."""
    sized = (across.join(size, "g", "left").withColumn("size", F.coalesce("size", F.lit(1)))
             .withColumn("late", F.greatest(F.lit(0), F.col("n_common") - _rest(F.col("n")))))
    union = sized.groupBy("token", "rare", "g").agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("n_common").alias("common_hi"),
        F.max("late").alias("late_hi"), F.min("size").alias("g_size"))
    q = sized.withColumnsRenamed({"g": "own", "size": "own_size"})
    smaller = (F.col("own_size") < F.col("g_size")) | ((F.col("own_size") == F.col("g_size")) & (F.col("own") < F.col("g")))
    lo, hi = _range()
    both = q.where("rare").join(union.where("rare").drop("rare"), "token").where(smaller & (lo <= hi))
    q, union = q.where("NOT rare"), union.where("NOT rare").drop("rare")
    kinds = (q.select("token", "n", "n_common").distinct()
             .join(union.select("token", "n_lo", "n_hi", "common_hi").distinct(), "token")
             .where((lo <= hi) & (F.least("n_common", "common_hi") >= F.ceil(F.lit(3) * (F.col("n") + lo) / 7))))
    late = (q.join(kinds, ["token", "n", "n_common"]).join(union, ["token", "n_lo", "n_hi", "common_hi"]).where(smaller))
    return both.unionByName(late.select(*both.columns))


def _range() -> tuple[Column, Column]:
    """Least and largest size of a member, from n_lo to n_hi, that fits n."""
    n = F.col("n")
    return F.greatest(F.col("n_lo"), F.ceil(n * 3 / 4)), F.least(F.col("n_hi"), F.floor(n * 4 / 3))


def _few(df: DataFrame, label: str) -> DataFrame:
    """A table of groups, sets or their kinds, written as few files."""
    return saved(df.coalesce(max(1, lanes(df.sparkSession) // 16)), label)


def _narrowed(large: DataFrame, sets: DataFrame, labels: DataFrame, edges: DataFrame, docs: DataFrame,
              k: int = K) -> tuple[DataFrame, DataFrame]:
    """Of the queries (s, n, g, common) of large groups: (links a, b with a group's centre;
    pairs s, b of the other queries with members that they may link with)."""
    groups = small(_few(large.select("g").distinct(), "large"))
    members = _few(labels.join(groups, "g", "left_semi").join(sets.select("s", "n", "text_key"), "s"), "members")
    ends = edges.select(F.col("a").alias("s")).union(edges.select("b")).groupBy("s").agg(F.count(F.lit(1)).alias("links"))
    centre = small(_few(members.join(ends, "s").groupBy("g").agg(F.max(F.struct("links", "s", "n")).alias("p"))
                        .select("g", F.col("p.s").alias("centre"), F.col("p.n").alias("n_centre")), "centres"))
    keyed = large.select("s").distinct().join(sets.select("s", "text_key"), "s")
    tokens = tokens_of(members.select("s", "text_key").union(keyed).distinct(), docs, k)

    # a group's core tokens and those of its centre
    own = (members.select("g", F.col("s").alias("b"), F.col("n").alias("m"), "s").join(tokens, "s")
           .select("g", "b", "m", F.explode("tokens").alias("token")))
    held = (own.join(centre, "g").groupBy("g", "token")
            .agg((F.count(F.lit(1)) > CORE).alias("core"), F.max(F.col("b") == F.col("centre")).alias("middle")))
    marks = small(_few(held.where("core OR middle"), "marks"))

    def marked(rows):
        return rows.join(marks, ["g", "token"], "left").fillna(False, ["core", "middle"])
    asked = saved(marked(large.join(tokens, "s").select("g", "s", "n", "common", F.explode("tokens").alias("token"))), "asked")
    query = (asked.groupBy("g", "s", "n", "common").agg(F.count_if("core").alias("core"), F.count_if("middle").alias("middle"))
             .join(centre, "g"))
    met = 100 * F.col("middle") >= 75 * (F.col("n") + F.col("n_centre") - F.col("middle"))
    query = _few(query.withColumn("met", met), "queries")
    left = query.where(~F.col("met")).select("g", "s", "n", "common", "core")
    placed = saved(marked(own), "placed")
    member = _few(placed.groupBy("g", "b", "m").agg(F.count_if("core").alias("core_m")), "member-cores")

    # core tokens alone: by the few kinds (size, core tokens) of members; else by shared tokens outside
    fits = _fits(F.col("n"), F.col("m")) & (F.col("common") >= _needed(F.col("n"), F.col("m")))
    overlap, core = F.ceil(F.lit(3) * (F.col("n") + F.col("m")) / 7), F.least("core", "core_m")
    kinds = small(_few(member.select("g", "m", "core_m").distinct(), "kinds"))
    inside = left.join(kinds, "g").where(fits & (core >= overlap)).join(member, ["g", "m", "core_m"]).select("s", "b")
    outside = (asked.where(~F.col("core")).select("g", "s", "token")
               .join(left.select("g", "s"), ["g", "s"], "left_semi")
               .join(placed.where(~F.col("core")).select("g", "token", "b"), ["g", "token"])
               .groupBy("g", "s", "b").agg(F.count(F.lit(1)).alias("more")))
    outside = (outside.join(left, ["g", "s"]).join(member, ["g", "b"]).where(fits & (core + F.col("more") >= overlap))
               .select("s", "b"))
    return query.where("met").select(F.col("s").alias("a"), F.col("centre").alias("b")), inside.union(outside)


def links(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, s; edges between sets: a, b that span every component)."""
    t = F.col(f"`{text}`").cast("string")
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("text"))
    rows = saved(shingled(docs, common_tokens(docs, k), k), "shingled")
    # any of a set's texts serves as its text: all have the same set
    sets = saved(rows.where("s IS NOT NULL").groupBy("s").agg(
        F.min("n").alias("n"), F.min("text_key").alias("text_key"), F.min("doc_id").alias("first_id"),
        F.max("n_common").alias("n_common")), "sets")
    new = rows.where("prefix IS NOT NULL")

    # groups around pivots: sets with the same least hash
    typical = F.greatest(2 * F.col("n_common") - F.col("n"), F.lit(0)).alias("typical")
    least = saved(new.select("s", "n", F.get("sketch", F.lit(0)).alias("h"), "sketch", typical)
                  .dropDuplicates(["s"]).join(sets.select("s", "text_key", "first_id"), "s"), "least")
    pivots = least.groupBy("h").agg(F.min(F.struct(-F.col("typical"), F.col("first_id").isNull(), "first_id", "s", "n", "sketch",
                                                   "text_key")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = least.join(pivots, "h").where((F.col("s") != F.col("p.s")) & _fits(F.col("n"), F.col("p.n")) & (
        F.size(F.array_intersect("sketch", "p.sketch")) >= F.least(F.lit(MIN_SKETCH), F.size("sketch"), F.size("p.sketch"))))
    edges = verify(near.select(F.col("s").alias("a"), F.col("p.s").alias("b"), F.col("text_key").alias("key_a"),
                               F.col("p.text_key").alias("key_b")), docs, k)
    labels = _labels(edges)

    # token-group matrix; every group's witness meets the token's first witness
    placed = new.select("s", (F.col("n") - F.col("n_common")).alias("n_rare"), F.posexplode("prefix").alias("place", "token"))
    shared = saved(_shared(placed.withColumn("rare", F.col("place") < F.col("n_rare"))).distinct(), "shared")
    matrix = saved(_across(shared, sets, labels).groupBy("token", "g").agg(F.min("s").alias("s")), "matrix")
    first = matrix.groupBy("token").agg(F.min("s").alias("b"))
    witness = (matrix.join(first, "token").where("s <> b").groupBy(F.col("s").alias("a"), "b")
               .agg(F.count(F.lit(1)).alias("common")))
    witness = _pairs_with_keys(witness, sets).where(_fits(F.col("n_a"), F.col("n_b")) & (
        2 * F.col("common") >= _needed(F.col("n_a"), F.col("n_b"))))
    edges = saved(edges.union(verify(witness, docs, k)), "edges")
    labels = _labels(edges)

    # bound and open: sets of the smaller group are the queries, links being mutual
    across = saved(_across(shared, sets, labels), "across")
    size = small(_with_groups(sets.select("s"), labels).groupBy("g").agg(F.count(F.lit(1)).alias("size"))
                 .where("size > 1"))
    found = (_meetings(across, size).groupBy("s", "n", "n_common", "late", "own", "g")
             .agg(F.count_if("rare").alias("n_rare"), F.count_if(~F.col("rare")).alias("n_late"),
                  F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"), F.max("common_hi").alias("common_hi"),
                  F.max("late_hi").alias("late_hi"), F.min("g_size").alias("g_size")))
    # sets that share rare tokens may miss rows of common ones: as many as both prefixes hold
    most = F.col("n_rare") + F.least("late", "late_hi")
    found = found.withColumn("common", F.when(F.col("n_rare") > 0, most).otherwise(F.col("n_late")))
    (lo, hi), n = _range(), F.col("n")
    needed, overlap = _least_needed(n, lo, hi), F.ceil(F.lit(3) * (n + lo) / 7)
    reaches = (F.least("late", "late_hi") > 0) & (F.col("n_rare") + F.least("n_common", "common_hi") >= overlap)
    found = found.where((F.col("n_rare") >= needed) | (reaches & (F.col("common") >= needed)))
    found = saved(found.select("s", "n", "own", "g", "common", "g_size"), "qualified")
    large = found.where(F.col("g_size") >= LARGE)
    narrowed = None
    if large.limit(1).count():
        found = found.where(F.col("g_size") < LARGE)
        met, narrowed = _narrowed(large, sets, labels, edges, docs, k)
        edges = edges.union(met)
    groups = saved(found.select("g").distinct(), "opened")
    members = _with_groups(sets.select("s", "n"), labels).join(groups, "g", "left_semi").select(
        "g", F.col("s").alias("b"), F.col("n").alias("m"))
    opened = (found.join(members, "g").where(_fits(F.col("n"), F.col("m")))
              .where(F.col("common") >= _needed(F.col("n"), F.col("m"))).select("s", "b"))
    if narrowed is not None:
        opened = opened.union(narrowed)
    opened = opened.select(F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b")).distinct()
    last = verify(_pairs_with_keys(opened, sets), docs, k)
    return rows.select("doc_id", "n", "s"), saved(edges.union(last), "edges-all")


def _pairs_with_keys(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("s").alias("a"), F.col("n").alias("n_a"), F.col("text_key").alias("key_a"))
    two = sets.select(F.col("s").alias("b"), F.col("n").alias("n_b"), F.col("text_key").alias("key_b"))
    return pairs.join(one, "a").join(two, "b")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    rows, edges = links(df, doc_id, text, k)
    labels = _labels(edges)
    by_set = _with_groups(rows.where("s IS NOT NULL").groupBy("s").agg(F.min("doc_id").alias("first_id")), labels)
    least = by_set.groupBy("g").agg(F.min("first_id").alias("component_id"))
    by_set = by_set.join(least, "g").select("s", "component_id")
    out = rows.join(by_set, "s", "left")
    component = F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """One row of each component stays (the least id, then the first row), whole."""
    keyed = saved(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"),
                            F.col(f"`{text}`").cast("string").alias("text"),
                            F.col(f"`{doc_id}`").cast("long").alias("id"))
                  .withColumn("key", F.monotonically_increasing_id()), "keyed")
    d = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), "doc_id", "text", k)
    d = d.withColumnRenamed("doc_id", "key").join(keyed.select("key", "id"), "key")
    d = saved(d.select("key", "id", "component_id"), "kept-rows")
    stays = d.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("m")).select(
        F.col("m.key").alias("key"))
    gone = saved(d.join(stays, "key", "left_anti").select("key"), "dropped-rows")
    return keyed.join(small(gone), "key", "left_anti").select("input.*")
