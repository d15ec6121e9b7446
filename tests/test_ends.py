"""Heads without links, and trees brought up to date from them."""

from pyspark.sql import functions as F

from veriloom.operators import chain


def rows(spark):
    told = [(s, k * 70, f"{s} {k}" if k % 11 else None) for s in ("a", "b", "é", None) for k in range(200)]
    return spark.createDataFrame(told, "session_id string, seq long, payload string")


def test_ends(spark):
    """They are the heads of the links, at once or in two parts; no row of links is shuffled for them."""
    e = rows(spark)
    key = lambda df: sorted(map(str, df.select("session_id", "stretch", "events", "head", "high").collect()))
    want = key(chain.heads(chain.extend(e, ["seq"])))
    assert key(chain.ends(e, ["seq"])) == want
    early = F.col("seq") % 8192 < 6000
    old = chain.ends(e.where(early), ["seq"]).cache()
    new = chain.ends(e.where(~early), ["seq"], old).cache()
    kept = old.join(new.select(*chain.KEY), F.expr("true") & old["session_id"].eqNullSafe(new["session_id"]) & (old["stretch"] == new["stretch"]), "left_anti")
    assert 0 < new.count() < old.count()
    whole = key(chain.heads(chain.extend(e.where(early), ["seq"]).unionByName(chain.extend(e.where(~early), ["seq"], old))))
    assert key(kept.unionByName(new)) == whole
    for depth in (0, 1, 2):
        tree = chain.tree(old, depth)
        told = {(r["level"], r["place"]): tuple(r) for r in chain.changed(tree, new, depth).collect()}
        after = {(r["level"], r["place"]): tuple(r) for r in chain.tree(kept.unionByName(new), depth).collect()}
        assert told == {at: after[at] for at in told} and len(told) >= new.count() + 1
