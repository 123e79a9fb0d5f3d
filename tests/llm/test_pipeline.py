"""The pipeline against its stages' brute-force versions, and the contract queries on the smallest tables."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from netloom.llm import mixing, queries
from tests.llm.test_operators import SCHEMA, brute_components, brute_fingerprint, brute_hits, brute_spans

SMALL = "/root/testdata/sf0.001"


def corpus():
    rng = random.Random(11)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["the", "of"] * 40
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(30, 80))), "en", f"s{k % 4}", 0) for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s0", 0) for k in range(8)]
    rows += [(200, "12 34 !!", "en", "s1", 0), (201, None, "en", "s1", 0), (202, "", None, None, 0)]
    item = " ".join(f"bench{k}" for k in range(14))
    rows += [(300, f"{rows[0][1]} {item}", "en", "s2", 0), (301, f"{rows[1][1]} token = abcdef123456 and more of the text", "en", "s3", 0)]
    return rows, [(1, item), (2, "too short"), (None, "the of"), (3, None)]


CLASHES = ("kinds", "_row", "row", "spans", "found", "_nth", "nth", "_copies", "copies", "own", "cut", "extra", "epochs", "source_", "times", "h", "id", "fp", "low", "matched", "_m0", "longest", "predicted", "_p", "key", "size", "cell", "a.b", "sid")


def odd_rows():
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rng = random.Random(4)
    texts = [None, "", " \n ", "12 34", "é", "日本語", "a", "x " * 2000, "word" * 3000, "deadbeef" * 3 + " " + "0123456789abcdef01234567 " * 200]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None) for k, t in enumerate(texts)]
    rows += [(20, " ".join(words), "en", "s0", 1), (20, "token = abcdef123456 " + " ".join(words[::-1]), "en", "s0", 1)]
    rows += [(None, " ".join(rng.choice(words) for _ in range(40)), "de", "s1", 0) for _ in range(3)] + [(None, None, None, None, None)] * 2
    rows += [(30, "again and again the same words here", "en", "s2", 0)] * 10 + [(k, " ".join(rng.choice(words) for _ in range(30)), "en", "s1", 0) for k in range(40, 60)]
    return rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, name):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, and columns named like a stage's own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    item = " ".join(f"bench{k}" for k in range(14))
    spark.createDataFrame([(1, item), (None, "a b"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = odd_rows() + [(70, f"{'prose ' * 5000}{item}", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit("mine "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    out = stage(spark, docs, str(tmp_path))
    got = out.collect()
    # the docs' own columns come back as they were
    assert all(r[c] == f"mine {'-' if r.doc_id is None else r.doc_id}" for r in got for c in _kept(out))
    n = Counter((r.doc_id, r.text) for r in got)
    given = Counter((r[0], r[1]) for r in rows)
    if name != "mixing_sources":
        assert out.columns == docs.columns
    if name == "language_id":
        # texts of 200 letters or more may be like no learned language
        letters = {k: sum(c.isalpha() for c in k[1] or "") for k in given}
        assert {k: v for k, v in n.items() if letters[k] < 200} == {k: v for k, v in given.items() if 0 < letters[k] < 200}
    elif name == "near_dedup":
        # both unrelated texts of id 20 stay, one of the ten equal rows, one of all texts without a word, each id-less text
        assert sum(v for k, v in n.items() if k[0] == 20) == 2 and n[30, "again and again the same words here"] == 1
        assert sum(not (t or "").strip() for _, t in n.elements()) == 1 and sum(v for k, v in n.items() if k[0] is None) == 3
    elif name == "decontamination":
        assert n == Counter({k: v for k, v in given.items() if k[0] != 70})
    elif name == "secret_scan":
        assert len(got) == len(rows) and n[20, "[SECRET] " + " ".join("one two three four five six seven eight nine ten eleven twelve".split()[::-1])] == 1
        assert n[9, "[SECRET] " + "[SECRET] " * 200] == 1 and sum(v for k, v in n.items() if "[SECRET]" not in (k[1] or "")) == len(rows) - 2
    else:
        assert set(n) <= set(given) and all(1 <= r.epoch <= 2 for r in got)
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns
    none = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    assert stage(spark, none, str(tmp_path)).count() == {"near_dedup": 1, "mixing_sources": 0}.get(name, 3)


def _kept(df):
    return [c for c in CLASHES if c in df.columns]


def test_draw_counts_equal_rows_one_by_one(spark):
    """Ten equal rows of four words with a target of 60: two epochs would be 80, one and a half are drawn."""
    rows = [(7, "one two three four", "en", "a", 0)] * 10
    drawn = mixing.draw(spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1)))
    assert Counter(r.epoch for r in drawn.collect()) == {1: 10, 2: 5} and drawn.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies", "epoch"]
    mixed = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.taken for r in mixed) == {8: 5, 4: 5}


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    now = rows
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        got = [tuple(r) for r in docs.collect()]
        if name == "language_id":
            now = [r for r in now if r[1] and any(c.isalpha() for c in r[1])]
        elif name == "near_dedup":
            comp = brute_components([brute_fingerprint(r[1]) for r in now])
            least = {c: min(r[0] for r, x in zip(now, comp) if x == c) for c in set(comp)}
            now = [r for r, c in zip(now, comp) if r[0] == least[c]]
        elif name == "decontamination":
            now = [r for r, hit in zip(now, brute_hits([r[1] for r in now], items)) if not hit[1]]
        elif name == "secret_scan":
            assert sum(bool(brute_spans(r[1])) for r in now) == 1
            now = [r if not brute_spans(r[1]) else (r[0], r[1].replace("token = abcdef123456", "[SECRET]"), *r[2:]) for r in now]
        if name != "mixing_sources":
            assert docs.columns == columns and Counter(got) == Counter(now), name
    assert docs.columns == [*columns, "epoch"]
    kept = {r[0]: r for r in now}
    assert all(r[:5] == kept[r[0]] and r[5] in (1, 2) for r in got)
    spark.createDataFrame(now, SCHEMA).createOrReplaceTempView("kept")
    targets = {r["source"]: (r["target"], r["most"]) for r in mixing.mix(spark.table("kept")).join(spark.table("kept").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("most")).collect()}
    taken = Counter()
    for r in got:
        taken[r[3]] += len(r[1].split())
    assert all(target - most <= taken[s] <= target + 1 for s, (target, most) in targets.items())


def test_run_is_repeatable(spark):
    a, b = (Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "epoch").collect()) for _ in range(2))
    assert a == b and sum(a.values()) > 100


def rows_of(found):
    return Counter(tuple(None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_contract_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = __spark_entry__.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    assert rows_of(df.select(*cols).collect()) == rows_of(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall())


COLUMNS = {
    "op1_": ["doc_id", "held_out", "lang_pred", "score"], "op2_": ["page_id", "host", "path", "rule", "verdict"], "op3_": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_": ["doc_id", "fingerprint", "component_id"], "op5_": ["page_id", "url", "text", "n_chars"], "op6_": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op7_": ["doc_id", "size", "source_size", "target", "taken"], "op8_": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op9_": ["doc_id", "held_out", "score", "predicted"],
    "op10_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("prefix", list(COLUMNS))
def test_contract_columns(spark, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    df = __spark_entry__.queries()[name](spark, SMALL)
    table = "pages" if COLUMNS[prefix][0] == "page_id" else "documents"
    assert df.columns[: len(COLUMNS[prefix])] == COLUMNS[prefix]
    assert df.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
