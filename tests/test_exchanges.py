"""How often rows are exchanged, and that spreading frequent keys changes no result."""

from pyspark.sql import functions as F

from quire.operators import reconcile


def test_copies_exchange_each_side_once(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("a"), (F.col("id") % 3).alias("b"))
    current = rows.filter(F.col("a") % 5 > 0)
    want = reconcile.exact_copies(rows, current, ["a", "b"], "id")
    plan = want._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Repartition" not in plan
    spread = reconcile.exact_copies(rows, current, ["a", "b"], "id", least=100)
    assert "Repartition" in spread._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, spread.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    counts = {(r["a"], r["b"]): r["matches"] for r in want.collect()}
    assert counts[7, 0] == rows.filter("a = 7 and b = 0").count() and counts[15, 0] == 0


def test_greedy_exchanges_its_keys_once(spark, monkeypatch):
    from quire.operators import components, dedup

    plans, real = [], dedup.cut

    def kept(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return real(df)

    rows = real(spark.range(3000).select("id", F.col("id").alias("ord"), (F.col("id") % 700).cast("string").alias("a"), F.expr("string(id div 3)").alias("b")))
    held = spark.createDataFrame([("a", "5", "x"), ("none", "5", "y")], "kind string, value string, owner string")
    monkeypatch.setattr(dedup, "cut", kept)
    monkeypatch.setattr(components, "cut", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r[0]: tuple(r)[1:] for r in dedup.greedy(rows, "id", "ord", ["a", "b"], held, one_task=10).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    holders, want = {("a", "5"): "x"}, {}
    for i in range(3000):
        keys = [("a", str(i % 700)), ("b", str(i // 3))]
        hit = next((k for k in keys if k in holders), None)
        want[i] = ("duplicate", holders[hit], hit[0]) if hit else ("accepted", None, None)
        if not hit:
            holders |= {k: str(i) for k in keys}
    assert got == want
    scans = [p for p in plans if "collect_set" in p]
    assert scans and all("ReusedExchange" in p for p in scans)
    moves = [p for p in plans if "further" in p and "_salt" in p]
    assert moves and all("ReusedExchange" in p for p in moves)
