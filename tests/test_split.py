import hashlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import split as S
from riskweave.sources.splits import export_csv, read_split, write_demo, write_splits


@pytest.fixture()
def accounts(spark):
    return spark.range(200).select(
        (F.col("id") + 10_000).cast("string").alias("account_id"),
        (F.col("id") % 2).cast("int").alias("label"),
        F.lit(1.0).alias("feature_completeness"), F.lit("ok").alias("quality_flag"),
    )


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.split, []).append((r.account_id, r.label))
    return {k: sorted(v) for k, v in out.items()}


def test_sizes_classes_and_repeatability(accounts):
    first = parts(S.stratified_split(accounts))
    assert {k: len(v) for k, v in first.items()} == {"train": 140, "validation": 30, "test": 30}
    assert all({y for _, y in rows} == {0, 1} for rows in first.values())
    for n in (1, 7, 64):
        assert parts(S.stratified_split(accounts.repartition(n))) == first
    assert parts(S.stratified_split(accounts, seed=43)) != first


def test_split_equals_direct_ranking(spark):
    df = spark.range(3001).select(
        F.col("id").cast("string").alias("account_id"),
        (F.col("id") % 7 == 0).cast("int").alias("label"),
    )
    quotas = S.split_quotas({0: 2572, 1: 429})
    assert sum(quotas["test"].values()) == 451 and sum(quotas["validation"].values()) == 450
    rank = F.row_number().over(
        Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("42:"), "account_id")),
                                            "account_id")
    )
    direct = {
        (r.account_id): (
            "test" if r.n <= quotas["test"][r.label]
            else "validation" if r.n <= quotas["test"][r.label] + quotas["validation"][r.label]
            else "train"
        )
        for r in df.withColumn("n", rank).collect()
    }
    got = {r.account_id: r.split for r in S.stratified_split(df).collect()}
    assert got == direct


def test_split_assignment_does_not_shuffle(accounts):
    plan = S.stratified_split(accounts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_largest_remainder():
    assert S.largest_remainder({0: 1, 1: 1, 2: 1}, 2) == {0: 1, 1: 1, 2: 0}
    # 347.503 and 83.497 of 431
    assert S.largest_remainder({0: 1157, 1: 278}, 431) == {0: 348, 1: 83}
    for sizes in ({0: 12, 1: 7}, {0: 17, 1: 8}, {0: 10**11, 1: 7}):
        total = sum(sizes.values())
        q = S.split_quotas(sizes)
        assert sum(map(sum, (p.values() for p in q.values()))) == total
        assert sum(q["test"].values()) + sum(q["validation"].values()) == -(-3 * total // 10)


def test_too_few_rows(spark):
    df = spark.createDataFrame([("1", 0), ("2", 0), ("3", 1)], "account_id string, label int")
    with pytest.raises(ValueError):
        S.stratified_split(df)


def test_demo_has_no_label(accounts):
    test = S.stratified_split(accounts).where("split = 'test'").drop("split")
    demo = S.demo_accounts(test, per_class=5)
    assert demo.count() == 10 and demo.columns == ["account_id"]
    again = S.demo_accounts(test.repartition(5), per_class=5)
    assert {r[0] for r in demo.collect()} == {r[0] for r in again.collect()}
    assert S.demo_accounts(test, per_class=500).count() == 30


def test_samples_are_the_first_rows_in_hash_order(accounts, spark):
    by_cut = S.class_sample(accounts, 40)
    assert "Window" not in by_cut._jdf.queryExecution().executedPlan().toString()
    keys = {}
    for r in accounts.collect():
        digest = hashlib.md5(f"{42 + r.label}:sample:{r.account_id}".encode()).hexdigest()
        keys.setdefault(r.label, []).append((digest, r.account_id))
    want = {i for rows in keys.values() for _, i in sorted(rows)[:40]}
    assert {r.account_id for r in by_cut.collect()} == want
    assert S.class_sample(accounts, 4000).count() == 200
    assert S.class_sample(accounts.where("false"), 5).count() == 0


@pytest.mark.parametrize("cell_rows", [1, 3, 10_000])
def test_order_keys_are_found_in_cells_of_any_size(accounts, cell_rows):
    order = S.hash_order("account_id", "7")
    cells = S.prefix_counts(accounts, "label", order)
    # coarse cells, so that several levels are needed
    coarse = {c: {} for c in cells}
    for c, parts in cells.items():
        for p, n in parts.items():
            coarse[c][p] = coarse[c].get(p, 0) + n
    found = S.order_keys_at(accounts, "label", order, coarse, {0: {1, 7, 50}, 1: {100}},
                            cell_rows)
    keys = {}
    for r in accounts.select("label", order.alias("k")).collect():
        keys.setdefault(r["label"], []).append(r["k"])
    ranked = {c: sorted(k) for c, k in keys.items()}
    assert found == {0: {r: ranked[0][r - 1] for r in (1, 7, 50)}, 1: {100: ranked[1][99]}}


def test_crowded_cells_are_split_by_more_digits(spark):
    # all hashes begin with the same eight digits
    rows = spark.range(3000).select(
        F.lit(1).alias("label"), F.concat(F.lit("abcdabcd"), F.md5(F.col("id").cast("string")))
        .alias("k"))
    cells = S.prefix_counts(rows, "label", F.col("k"))
    assert cells == {1: {"abcd": 3000}}
    ranked = sorted(r["k"] for r in rows.collect())
    found = S.order_keys_at(rows, "label", F.col("k"), cells, {1: {1, 1500, 3000}}, 20)
    assert found == {1: {r: ranked[r - 1] for r in (1, 1500, 3000)}}


def test_split_and_demo_files(spark, accounts, tmp_path):
    folder = str(tmp_path / "splits")
    write_splits(S.stratified_split(accounts), folder)
    test = read_split(spark, folder, "test")
    assert test.count() == 30
    assert "PartitionFilters: [isnotnull(split" in (
        test._jdf.queryExecution().executedPlan().toString()
    )
    write_demo(S.demo_accounts(test.drop("split")), str(tmp_path / "demo"))
    assert "label" not in spark.read.parquet(str(tmp_path / "demo")).columns
    with pytest.raises(AssertionError):
        write_demo(test, str(tmp_path / "demo2"))
    export_csv(test, str(tmp_path / "csv"))
    lines = [
        line for f in sorted((tmp_path / "csv").glob("part-*.csv"))
        for line in f.read_text().splitlines() if not line.startswith("account_id")
    ]
    assert len(lines) == 30 and lines == sorted(lines)
