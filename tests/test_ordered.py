"""Windows cut into slices, literal prefilters, and the report in pages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veriloom.functions import patterns as P
from veriloom.functions import redact as D
from veriloom.functions.literals import Prefilter, needed
from veriloom.operators.asof import asof_join
from veriloom.operators.ordered import _sliced, running, spread
from veriloom.plans import sinks


@pytest.fixture(scope="module")
def skewed(spark):
    """One key, a null one too, has half of all rows; places and values repeat and are null here and there."""
    r = random.Random(2)
    rows = [("hot" if k % 2 else [None, "a", "b"][k % 3], r.choice([None, *range(300)]), k, r.choice([None, r.randint(0, 9)])) for k in range(4000)]
    return spark.createDataFrame(rows, "key string, at long, id long, v long").cache()


@pytest.mark.parametrize("slices", [2, 16])
def test_slices_change_nothing(skewed, slices):
    how = {"sums": {"no": F.lit(1), "total": F.coalesce("v", F.lit(0))}, "lasts": {"last": F.col("v")}}
    rows = lambda df: sorted(map(str, df.collect()))
    for keys in (["key"], []):
        assert rows(running(skewed, keys, ["at", "id"], slices=slices, **how)) == rows(running(skewed, keys, ["at", "id"], **how))


def test_a_hot_key_spreads(skewed):
    assert spread(skewed, ["key"], 500) == 4 and spread(skewed, [], 500) == 8 and spread(skewed, ["key"]) == 1
    sizes = [r["n"] for r in skewed.groupBy("key", _sliced(skewed, F.col("at").cast("double"), 16)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 250  # of 2000


def test_asof_in_slices(skewed):
    left, right = skewed.where("id % 3 = 0 and at is not null"), skewed.where("id % 3 <> 0 and at is not null")
    got = [sorted(map(str, asof_join(left, right, ["key"], "at", "id", ["id", "v"], "last", s).collect())) for s in (1, 8)]
    assert got[0] == got[1] and sum("Row(id=" in x.split("last=")[1] for x in got[0]) > 500


def test_literals():
    assert needed(r"abc[0-9]+") == {"abc"} and needed(r"(?:ab|cd)x?") == {"ab", "cd", "abx", "cdx"} or needed(r"(?:ab|cd)x?") == {"ab", "cd"}
    assert needed(r"a*") is None and needed(r"(?i)\bToken\s*=") == {"token"} and needed(r"[0-9]{3}") is None
    may = Prefilter([needed("abc"), needed("x+y"), None])
    assert [may(t) for t in ("", "zABCz", "xy", "y")] == [4, 5, 6, 6 if needed("x+y") == {"y"} else 4]


def ungated(text):
    counts = {}

    def mark(kind, whole, secret):
        if not secret:
            return whole
        counts[kind] = counts.get(kind, 0) + 1
        return whole.replace(secret, f"«redacted:{kind}»", 1)

    for kind, rule, group in D.RULES:
        text = rule.sub(lambda m, k=kind, g=group: mark(k, m[0], m[g]), text)
    return text, counts


def test_prefilter_loses_no_secret():
    """Each rule has literals, and texts that it matches have one; gated and ungated rules do the same."""
    r = random.Random(9)
    h = "0f" * 32
    heads = ["AKIA", "A3TX", "ghp_", "ghr_", "github_pat_", "sk-ant-", "sk-", "AIza", "xoxb-", "rk_test_", "npm_", "hf_", "sbp_", "glsoat-", "SG.", "SK", "lin_api_", "dop_v1_", "shpca_", "figd_", "gsk_", "sk-or-v1-", "xai-", "dp.ct.", "eyJ", "bearer ", "HTTPS://a:", "Mongodb+srv://", "x", " = ", "note "]
    assert all(needed(rule.pattern, rule.flags) for _, rule, _ in D.RULES)
    for _ in range(3000):
        text = "".join(r.choice(heads) + r.choice(["", "A" * 16, h[: r.randint(10, 64)], ".", "@h/", " "]) for _ in range(r.randint(1, 4)))
        for k, (_, rule, _) in enumerate(D.RULES):
            assert not rule.search(text) or D.MAY(text) >> k & 1, (text, k)
        want, counts = ungated(text)
        want = D.ASSIGNED.sub(lambda m: m[0], want)
        got, found = D.redact(text)
        if not found.keys() & {"sensitive-key", "high-entropy"}:
            assert (got, dict(found)) == (want, counts)
    for pattern in (P.SENSITIVE_KEY, P.ASSIGNED_VALUE):
        assert needed(D._compiled(pattern, "i").pattern, re.I)


def test_report_in_pages(spark, tmp_path):
    """Thousands of branches as pages that tasks write; every branch once, in order, escaped."""
    n = 2500
    ids = spark.range(n)
    verdict = F.element_at(F.array(*[F.lit(v) for v in sinks.VERDICTS]), (F.col("id") % 4 + 1).cast("int"))
    rows = ids.select(F.concat(F.lit("b<"), F.col("id").cast("string"), F.lit(">&\"")).alias("label"), verdict.alias("verdict"), F.lit("say <i>\nno").alias("summary"), (F.col("id") % 7).alias("execs"), F.lit(1).cast("long").alias("edits"), F.array(F.col("id").cast("string")).alias("sessions"), F.struct(F.lit("t").alias("at"), F.col("id").cast("string").alias("session_id")).alias("row_ord"))
    reports = ids.select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("session_id"), F.lit(3).alias("execs"), F.lit(2).alias("runs"), F.lit(1).alias("edits"))
    run = F.struct(F.lit("rm <x>").alias("command"), F.lit("failed").alias("outcome"), F.lit("none").alias("basis"), F.lit(1).cast("long").alias("exit_code"))
    digests = ids.where("id % 2 = 0").select(F.col("id").cast("string").alias("session_id"), verdict.alias("verdict"), F.lit("<script>alert(1)</script>").alias("sentence"), F.array(F.lit("test")).alias("activities"), F.lit("why").alias("reason"), F.array(run).alias("evidence"), F.struct(F.col("id").alias("seq")).alias("claim_ord"))
    assert sinks.report_pages(rows, reports, digests, f"file://{tmp_path}/r", each=600, slices=4) == 5
    pages = [(tmp_path / f"r/pages-{k:05d}.html").read_text() for k in range(5)]
    labels = [x for p in pages for x in re.findall(r"<summary[^>]*>. b&lt;(\d+)&gt;&amp;&quot;", p)]
    order = sorted(range(n), key=lambda k: (k % 4, -(k % 7), str(k)))
    assert labels == [str(k) for k in order]
    assert all(p.startswith("<!doctype html>") and p.rstrip().endswith("</html>") and p.count("<details") == p.count("</details>") for p in pages)
    assert not any("<script>alert" in p or "rm <x>" in p for p in pages) and sum(p.count("<article") for p in pages) == n // 2
    assert sum(len((tmp_path / f"r/index-{k:05d}.jsonl").read_text().splitlines()) for k in range(5)) == n
    index = (tmp_path / "r/index.html").read_text()
    assert index.count("<li>") == 5 and "pages-00004.html" in index and "default-src 'none'" in index
