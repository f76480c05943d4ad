"""N-gram Jaccard join against brute force and on odd rows."""

import random
import re

from pyspark.sql import functions as F

from twinlens.llm import ngram_join


def shingles(text, k=5):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    ids = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        if i is not None:
            ids[r] = min(ids.get(r, i), i)
    return sorted(((i, len(s), ids.get(root(k))) for k, (i, s) in enumerate(sets)), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()), key=str)


def test_sample_documents_match_brute_force(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    assert result(small_docs) == brute(rows)


def test_families_and_common_passages_match_brute_force(docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for family in range(4):
        base = [word() for _ in range(60)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    for _ in range(60):                       # a passage that many documents share, some hold little else
        own = [word() for _ in range(rng.choice([2, 8, 30, 60]))]
        rows.append((len(rows), " ".join(own + passage)))
    assert result(docs_of(rows)) == brute(rows)


def test_a_size_inside_a_groups_range_may_need_less_than_its_ends(docs_of):
    # x links with y (9 of 12), not with z and t, which y's group holds at both ends of its sizes
    rows = []
    for family in range(12):
        p = [f"p{family}w{i}" for i in range(13)]
        y = [f"v{family}", f"w{family}", *p]
        three = [y, y[:-1], [*y, f"r{family}"]]
        k = family % 3
        texts = [*three[k:], *three[:k], [f"u{family}", *p]]
        texts += [[f"o{family}x{d}y{i}" for i in range(40)] + p for d in range(20)]     # the passage is common
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    expected = brute(rows)
    assert all(len({c for i, _, c in expected if 24 * f <= i < 24 * f + 4}) == 1 for f in range(12))
    assert result(docs_of(rows)) == expected


def test_the_bound_of_a_range_is_at_most_that_of_any_size_in_it(spark):
    n, m = F.col("n"), F.col("m")
    sizes = spark.range(1, 200).select(F.col("id").alias("n")).withColumn(
        "m", F.explode(F.sequence(F.ceil(n * 3 / 4), F.floor(n * 4 / 3))))
    ends = sizes.join(sizes.withColumnRenamed("m", "lo"), "n").join(sizes.withColumnRenamed("m", "hi"), "n")
    wrong = ends.where("lo <= m AND m <= hi AND n < 60").where(
        ngram_join._least_needed(n, F.col("lo"), F.col("hi")) > ngram_join._needed(n, m))
    assert wrong.count() == 0


def test_odd_rows(docs_of):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (5, "one two"), (None, "one two"),
            (7, long_text), (8, long_text + " end"), (9, "É é"), (10, "é é")]
    assert result(docs_of(rows)) == brute(rows)


def test_empty_table_and_clashing_columns(docs_of, spark):
    assert result(docs_of([])) == []
    d = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]).withColumnsRenamed({"lang": "s", "source": "prefix", "n_chars": "n"})
    assert result(d) == brute([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")])
    kept = ngram_join.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_repeated_rows_leave_one(docs_of):
    d = docs_of([(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, None), (2, "")])
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in ngram_join.drop_near_duplicates(d).collect())
    assert kept == [-1, 1, 2]


def _family(rng, word, copies, most, n=120):
    """Near copies of one text (not among them) with up to ``most`` changed words."""
    base = [word() for _ in range(n)]
    texts = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(1, most + 1)):
            w[rng.randrange(n)] = word()
        texts.append(" ".join(w))
    return [" ".join(base), *texts]


def test_large_families_match_brute_force_in_few_comparisons(docs_of, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = _family(rng, word, 300, 7) + _family(rng, word, 150, 6)[1:]
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    counts, verify = [], ngram_join.verify

    def counted(pairs, docs, k=5):
        counts.append(pairs.select("a", "b").distinct().count())
        return verify(pairs, docs, k)
    monkeypatch.setattr(ngram_join, "verify", counted)
    assert result(docs_of(rows)) == brute(rows)
    assert sum(counts) < 10 * len(rows)


def test_narrowed_groups_match_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 2)
    monkeypatch.setattr(ngram_join, "CORE", 2)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [t for _ in range(5) for t in _family(rng, word, 24, 6, 50)[1:]]
    texts += [" ".join(t.split()[k:]) for t in texts[::5] for k in (6, 12)]      # other sizes
    rows = list(enumerate(rng.sample(texts, len(texts))))
    assert result(docs_of(rows)) == brute(rows)


def _joined_rows(df):
    """Rows that each join of the plan made, after running it as planned."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # it drops the joins of an empty result
    df.collect()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)

    def walk(node):
        name, children = node.getClass().getSimpleName(), node.children()
        own = [node.metrics().apply("numOutputRows").value()] if name.endswith("JoinExec") else []
        return own + [n for i in range(children.size()) for n in walk(children.apply(i))]
    return walk(df._jdf.queryExecution().executedPlan())


def _far(rng, word, copies, changes, n=150):
    """Copies of one text that link with nothing, each with evenly spread changed words."""
    base = [word() for _ in range(n)]
    texts = []
    for i in range(copies):
        w, many = list(base), changes[i % len(changes)]
        for j in range(many):
            w[n * j // many + rng.randrange(5, n // many - 5)] = word()
        texts.append(" ".join(w))
    return texts


def test_far_copies_of_one_text_do_not_meet(docs_of, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = list(enumerate(_far(rng, word, 300, (5, 6, 7))))
    made, saved = [], ngram_join.saved

    def counted(df, label):
        if label == "qualified":
            made.extend(_joined_rows(df))
        return saved(df, label)
    monkeypatch.setattr(ngram_join, "saved", counted)
    assert result(docs_of(rows)) == brute(rows)
    assert made and max(made) < 20 * len(rows)


def test_common_and_rare_tokens_together_match_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([12, 40, 70]))]
        twists = [[word() for _ in range(6)] for _ in range(8)]     # passages that few members share
        for _ in range(40):
            w = list(base)
            for twist in rng.sample(twists, rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(7)] = twist
            texts.append(" ".join(w[rng.randrange(4):len(w) - rng.randrange(4)]))
    rows = list(enumerate(rng.sample(texts, len(texts))))
    assert result(docs_of(rows)) == brute(rows)
