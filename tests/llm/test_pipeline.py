"""The pipeline, stage by stage, against brute force over what each stage got."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_llm import brute_exact, brute_near, check_packing, table, words


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == columns
            docs = corpus_pipeline.written(docs, "test")
        seen[name] = before, docs
    ids = lambda rows: sorted(r[0] for r in rows)
    kept = {k: ids(v[1].select("doc_id").collect()) for k, v in seen.items() if k != "packing"}
    before = seen["language_id"][0]
    assert kept["language_id"] == ids([r for r in before if any(c.isalpha() for c in r[1] or "")])
    assert kept["exact_dedup"] == sorted(r[0] for r in brute_exact(seen["exact_dedup"][0]) if r[3])
    near = brute_near(seen["near_dedup"][0])
    first = {}
    for i, root in sorted(near.items()):
        first.setdefault(root, i)
    assert kept["near_dedup"] == sorted(first.values())
    copies = Counter(kept["mixing"])
    assert max(copies.values()) <= 3 and set(copies) <= set(kept["near_dedup"])
    check_packing(spark, seen["packing"][0], docs.collect())


def test_rows_of_null_and_repeated_ids(spark):
    """A rejected row takes no other row of its id along, and copies under one id leave one row."""
    a, b, c, d = (words(80, 600 + k) for k in range(4))
    left = lambda stage, rows: sorted((x["doc_id"] is None, x["text"]) for x in stage(spark, table(spark, [(i, t, "en", "s") for i, t in rows]), "").collect())
    assert left(corpus_pipeline.language_id, [(None, "12"), (None, a), (1, b), (1, "3")]) == sorted([(True, a), (False, b)])
    rows = [(None, a), (1, a), (None, b), (2, c), (2, c), (2, a), (None, d), (None, d)]
    want = sorted([(False, a), (True, b), (False, c), (True, d)])
    assert left(corpus_pipeline.exact, rows) == want
    assert left(corpus_pipeline.near, rows) == want


def test_mixing_by_row(spark):
    """Rows of one id, null ones too, each take their own copies."""
    rows = [(None if k < 60 else k, words(20, 900 + k), "en", "a" if k % 2 else "b") for k in range(120)]
    got = Counter(r["text"] for r in corpus_pipeline.mixing(spark, table(spark, rows), "").collect())
    from veriloom.llm import mixing

    docs = corpus_pipeline.keyed(corpus_pipeline.written(table(spark, rows), "test"))
    want = mixing.mix(docs, corpus_pipeline.ROW).agg({"copies": "sum"}).first()[0]
    assert sum(got.values()) == want and {t for _, t, *_ in rows[:60]} & set(got)


def test_names_empty_tables_and_nulls(spark):
    """Columns of any name stay, empty tables and null texts pass each stage, reserved names are an error."""
    docs = table(spark, [(1, words(30, 1), "en", "s"), (None, None, None, None), (2, words(9000, 2), "en", None)])
    odd = docs.withColumnsRenamed({"kept": "_id", "size": "_copies", "score": "_row"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns
        kept = out.collect()
        assert len(kept) == (2 if name == "language_id" else len(kept)) and {r["doc_id"] for r in kept} >= {1, 2}
        assert stage(spark, odd.limit(0), "").count() == 0
    assert corpus_pipeline.packing(spark, odd.limit(0), "").count() == 0
    with pytest.raises(ValueError, match="reserved"):
        corpus_pipeline.exact(spark, docs.withColumn("_veriloom_row", docs["doc_id"]), "")


def test_stages_share_nothing(spark):
    """Two runs of stages side by side; each still reads its own input."""
    a, b = table(spark, [(k, words(30, k), "en", "s") for k in range(5)]), table(spark, [(k, words(30, 90 + k), "en", "s") for k in range(7)])
    one, two = corpus_pipeline.exact(spark, a, ""), corpus_pipeline.exact(spark, b, "")
    three = corpus_pipeline.near(spark, one, "")
    assert (two.count(), one.count(), three.count()) == (7, 5, 5)


def test_uncertain_language_goes(spark):
    """A text of letter junk that states no language goes; clean ones stay, stated or not."""
    r = __import__("random").Random(3)
    vocabulary = {"en": ["the", "and", "house", "with", "there", "water"], "xx": ["zorka", "plim", "dravo", "kuzt", "mlev", "prask"]}
    text = lambda g, n: " ".join(r.choice(vocabulary[g]) for _ in range(n))
    rows = [(k, text(g := "en" if k % 2 else "xx", r.randint(5, 60)), g, "s") for k in range(80)]
    rows += [(100, text("en", 40), None, "s"), (101, "12 34 !!", "en", "s"), (102, "qjq qjq wvw jqj " * 20, None, "s")]
    kept = {x["doc_id"] for x in corpus_pipeline.language_id(spark, table(spark, rows), "").collect()}
    assert set(range(80)) | {100} <= kept and 101 not in kept and 102 not in kept


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    from veriloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and [p.name.split("-")[0] for p in (tmp_path / "veriloom").iterdir()] == ["packing"]
