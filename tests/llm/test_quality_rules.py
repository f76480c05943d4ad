"""Quality rules against a direct count, clean documents, odd rows."""

import re
from collections import Counter

from twinlens.llm import quality_rules

BLANK = "[\x20\x09-\x0d]+"


def base(text):
    t = text or ""
    w = [x for x in re.split(BLANK, t) if x]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    again = set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.sub(BLANK, "", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))


def check(df):
    got = quality_rules.apply_rules(df).collect()
    for r in got:
        n, *rest = want = base(r["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (n < 10 or 100 * want[4] > 20 * n)
        assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["failed_rules"] and not r["base_failed"])
    return got


def test_sample_documents(small_docs):
    check(small_docs)


def test_good_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.1/"
    judged = quality_rules.apply_rules(spark.read.parquet(d + "documents.parquet")).join(
        spark.read.parquet(d + "labels.parquet"), "doc_id").select("quality", "base_failed", "kept").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) > 0.999 * len(good) and sum(junk) < 0.02 * len(junk)


def test_no_document_is_too_long(spark):
    passes = spark.range(1).selectExpr("5000000L AS n_words").select(quality_rules.compile_rules(
        [r for r in quality_rules.RULES if r.name == "word_count"])["word_count"].alias("ok"))
    assert passes.first()["ok"]


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c\n"), (None, "one"), (4, "a b c d e a b c d e"), (4, "a b c d e a b c d e"),
            (5, "x " * 40_000), (6, "\n".join(["same line"] * 30)), (7, "a a a a a a"), (8, "ÄÖ é\xa0b | # <x>"),
            (9, " ".join(f"word{i}" for i in range(20_000)))]
    got = check(docs_of(rows))
    assert len(got) == len(rows)
    d = docs_of(rows).withColumnsRenamed({"lang": "_w", "source": "input", "n_chars": "kept"})
    assert quality_rules.quality_filter(d).columns == d.columns
    assert quality_rules.quality_filter(docs_of([])).collect() == []
