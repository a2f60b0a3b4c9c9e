"""Publication and load of ledgers, and annotation under a head."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from provena.operators import integrity, ledger
from provena.operators.iterate import written

BY = ["run_id"]


def _items(spark, runs, mark=""):
    rows = [(run, i, json.dumps({"id": i, "text": f"row {i}{mark}", "metadata": {"z": 1.0, "a": [run]}})) for run, n in runs.items() for i in range(n)]
    return spark.createDataFrame(rows, "run_id long, seq long, content string")


def _store(spark):
    return written(spark.range(1), "store").inputFiles()[0].rsplit("/", 2)[0] + "/ledger"


def _chain(digests, last=""):
    out = []
    for d in digests:
        last = hashlib.sha256((d + last).encode()).hexdigest()
        out.append(last)
    return out


def test_publish_and_load(spark):
    store = _store(spark)
    with pytest.raises(ValueError, match="empty"):
        ledger.load(spark, store, BY)
    ledger.publish(_items(spark, {1: 3, 2: 5}), store, BY, F.lit("first"))
    ledger.publish(_items(spark, {1: 3, 2: 6, 3: 1}), store, BY, F.lit("second"))
    ledger.publish(_items(spark, {1: 3}), store, BY, F.lit("third"))
    # A publication without heads was never committed.
    ledger.sealed(_items(spark, {1: 9, 2: 9}, "!"), BY).write.parquet(f"{store}/items/99999999-torn")
    rows, status = ledger.load(spark, store, BY)
    got = {r["run_id"]: (r["status"], r["tree_size"], r["published_at"]) for r in status.collect()}
    assert got == {1: ("ok", 3, "first"), 2: ("ok", 6, "second"), 3: ("ok", 1, "second")}
    mine = sorted(rows.collect(), key=lambda r: (r["run_id"], r["seq"]))
    assert [(r["run_id"], r["seq"]) for r in mine] == [(1, 0), (1, 1), (1, 2), *((2, i) for i in range(6)), (3, 0)]
    for run in (1, 2, 3):
        of = [r for r in mine if r["run_id"] == run]
        assert [r["digest"] for r in of] == [hashlib.sha256(json.dumps(json.loads(r["content"]), sort_keys=True, ensure_ascii=False).encode()).hexdigest() for r in of]
        assert [r["chain_hash"] for r in of] == _chain([r["digest"] for r in of])
    assert integrity.chain_faults(rows, BY).count() == 0


def test_recovery_from_the_write_ahead_rows(spark):
    store = _store(spark)
    rows, status = ledger.load(spark, store, BY, _items(spark, {7: 3}))
    assert [tuple(r)[:3] for r in status.collect()] == [(7, "recovered", 3)] and integrity.chain_faults(rows, BY).count() == 0
    ledger.publish(rows, store, BY, F.lit("t"))
    # A stray log does not shadow what was published.
    rows, status = ledger.load(spark, store, BY, _items(spark, {7: 9, 8: 2}, "?"))
    assert {r["run_id"]: (r["status"], r["tree_size"], r["published_at"]) for r in status.collect()} == {7: ("ok", 3, "t"), 8: ("recovered", 2, None)}
    assert rows.where("run_id = 7").count() == 3


def test_rows_that_do_not_match_their_head(spark):
    store = _store(spark)
    items = _items(spark, {1: 4, 2: 4, 3: 4, 4: 1})
    heads = ledger.publish(items, store, BY, F.lit("t"))
    other = F.when((F.col("run_id") == 1) & (F.col("seq") == 2), F.lit('{"id": 2}')).otherwise(F.col("content"))
    bad = items.withColumn("content", other).where("not (run_id = 2 and seq = 3) and run_id <> 4")
    got = {r["run_id"]: r["status"] for r in ledger.checked(bad, heads, BY).collect()}
    assert got == {1: "mismatch", 2: "mismatch", 3: "ok", 4: "mismatch"}
    version = heads.first()["version"]
    changed = spark.read.parquet(f"{store}/items/{version}").withColumn("content", other).collect()
    spark.createDataFrame(changed, "run_id long, seq long, content string, digest string, parent_hash string, chain_hash string").write.mode("overwrite").parquet(f"{store}/items/{version}")
    with pytest.raises(ValueError, match="1 runs"):
        ledger.load(spark, store, BY)
    rows, status = ledger.load(spark, store, BY, strict=False)
    assert {r["run_id"] for r in rows.select("run_id").distinct().collect()} == {2, 3, 4} and status.where("status = 'mismatch'").count() == 1


def test_annotation_keeps_the_published_prefix(spark):
    store = _store(spark)
    heads = ledger.publish(_items(spark, {1: 5, 2: 2}), store, BY, F.lit("t"))
    rows = written(ledger.sealed(_items(spark, {1: 9, 2: 4, 3: 3}), BY), "rows")
    updates = spark.createDataFrame([(1, 4, "{}"), (1, 6, '{"verified": true}'), (1, 8, '{"verified": false}'), (2, 7, "{}"), (3, 0, "[]"), (9, 0, "{}")], "run_id long, seq long, content string")
    got, refused = ledger.annotate(rows, heads, updates, BY)
    assert sorted(tuple(r) for r in refused.collect()) == [(1, 4, "published"), (2, 7, "unknown"), (9, 0, "unknown")]
    before, after = ({(r["run_id"], r["seq"]): r for r in d.collect()} for d in (rows, got))
    assert before.keys() == after.keys() and integrity.chain_faults(got, BY).count() == 0
    for k, r in after.items():
        same = k[0] == 2 or (k[0] == 1 and k[1] < 6)
        assert (r["chain_hash"] == before[k]["chain_hash"]) == same
    assert after[1, 6]["content"] == '{"verified": true}' and after[3, 0]["content"] == "[]"
    sizes = heads.select("run_id", F.col("tree_size").alias("first"))
    proofs = integrity.consistency_proofs(got, BY, "digest", sizes).join(heads.select("run_id", F.col("root").alias("early")), "run_id").join(integrity.merkle_root(got, BY, "digest"), "run_id")
    ok = proofs.select("run_id", integrity.consistent(F.col("first"), F.col("size"), F.col("early"), F.col("root"), F.col("path")).alias("ok")).collect()
    assert len(ok) == 2 and all(r["ok"] for r in ok)


def test_a_long_run_is_folded_in_batches(spark):
    n = 30_000
    rows = spark.range(n).select((F.col("id") % 2).alias("run_id"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    got = integrity.chained(rows.repartition(7), BY).where(f"seq >= {n - 2}").collect()
    for run in (0, 1):
        want = _chain(hashlib.sha256(str(i).encode()).hexdigest() for i in range(run, n, 2))[-1]
        assert next(r["chain_hash"] for r in got if r["run_id"] == run) == want
    texts = spark.createDataFrame([(1, 2, "b\u00e9"), (1, 1, "a"), (2, 1, ""), (2, 2, None), (None, 5, "x")], "run_id long, seq long, text string")
    got = {r["run_id"]: (r["chars"], r["digest"]) for r in integrity.joined_digest(texts, BY, "seq", "text").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (4, sha("a b\u00e9")), 2: (0, sha("")), None: (1, sha("x"))}


def test_digests_of_one_small_file_are_dealt(spark):
    """A table in one partition is not digested by one task."""
    d = spark.createDataFrame([(i % 9, i, f'{{"n": {i}}}') for i in range(90)], "run_id long, seq long, content string").coalesce(1)
    assert ledger._digests(d, ["run_id"]).rdd.getNumPartitions() > 1 and ledger.sealed(d, ["run_id"]).rdd.getNumPartitions() > 1
    want = {r["run_id"]: r["root"] for r in integrity.merkle_root(integrity.canonical_digests(d, "content"), ["run_id"], "digest").collect()}
    assert {r["run_id"]: r["root"] for r in ledger.roots(d, ["run_id"]).collect()} == want
