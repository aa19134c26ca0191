from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigil.functions.scalars import fault_id
from vigil.plans import datagen as D
from vigil.plans import faults as X
from vigil.sources.seal import Seal
from vigil.sources.snapshots import Snapshots

T0 = datetime(2026, 10, 7, 12, tzinfo=UTC)


def table(spark, tmp_path):
    t = Snapshots(spark, f"file://{tmp_path}/ledger")
    t.overwrite(spark.createDataFrame([("a", "s1", 1), ("b", "s1", 2), (None, None, 3)], "id string, ref string, n int"), T0)
    return t


def rows(t):
    return sorted(map(str, t.read().collect()))


def test_table_faults_are_undone_from_the_record(spark, tmp_path):
    t, seal = table(spark, tmp_path), Seal(spark, f"file://{tmp_path}/sealed")
    before = rows(t)
    for make, changed in (
        (lambda: X.SchemaDrift(spark, "w", "ledger", path=t.path, renames={"ref": "reference"}), lambda: "reference" in t.read().columns),
        (lambda: X.ColumnWidening(spark, "w", "ledger", path=t.path, column="ref", unique="n"), lambda: {r.ref for r in t.read().collect()} == {"s1#1", "s1#2", None}),
    ):
        f = make()
        key = f.inject_and_seal(seal, T0)
        assert changed() and key == f.fault_id
        with pytest.raises(FileExistsError):
            make().inject_and_seal(seal, T0)
        again = X.rebuild(spark, seal.load(key))
        again.revert_and_record(seal, T0 + timedelta(hours=1))
        assert rows(t) == before and seal.window(key)[1] is not None
    with pytest.raises(ValueError):
        X.SchemaDrift(spark, "w", "l", path=t.path, renames={"nope": "x"}).inject(T0)
    t.overwrite(t.read().withColumn("ref", F.lit("x#y")), T0)
    with pytest.raises(ValueError):
        X.ColumnWidening(spark, "w", "ledger", path=t.path, column="ref", unique="n").inject(T0)
    with pytest.raises(ValueError):
        X.SchemaDrift(spark, "w", "l", path=t.path, renames={"a": "b"}).ground_truth()


def test_a_source_cut_to_its_header(spark, tmp_path):
    p = tmp_path / "landing.csv"
    p.write_text("a,b\n1,2\n3,4\n5,6\n")
    f = X.SilentZeroRow(spark, "w", "load", path=f"file://{p}")
    f.inject(T0)
    assert p.read_text() == "a,b\n"
    with pytest.raises(FileExistsError):
        X.SilentZeroRow(spark, "w", "load", path=f"file://{p}").inject(T0)
    assert p.read_text() == "a,b\n"
    X.rebuild(spark, f.ground_truth().first()).revert(T0)
    assert p.read_text() == "a,b\n1,2\n3,4\n5,6\n" and not list(tmp_path.glob("*.backup"))
    with pytest.raises(FileNotFoundError):
        f.revert(T0)


def test_ids():
    assert fault_id("c", "i", {"b": 1, "a": "é"}, 5) == fault_id("c", "i", {"a": "é", "b": 1}, 5) != fault_id("c", "i", {"a": "é", "b": 2}, 5)


def test_star(spark):
    made = D.star(spark, 20_000)
    ledger = made["Ledger"].cache()
    got = ledger.agg(*(F.count_distinct(c).alias(c) for c in ("TransactionID", "SourceRef", "Branch", "CurrencyCode")), F.avg("Amount").alias("mean"), F.median("Amount").alias("mid"), F.min("Amount").alias("least"), F.count("*").alias("n")).first()
    assert got.n == 20_000 == got.TransactionID and got.SourceRef > 6000 and got.Branch == 12 and got.CurrencyCode == 3 and got.mean > 1.3 * got.mid and got.least > 0
    days = {r.d: r.n for r in ledger.groupBy(F.weekday("TransactionDate").alias("d")).agg((F.count("*") / F.count_distinct("TransactionDate")).alias("n")).collect()}
    assert days[6] < 0.3 * sum(days[d] for d in range(5)) / 5
    share = sorted(r.n / 20_000 for r in ledger.groupBy("Branch").agg(F.count("*").alias("n")).collect())
    assert share[-1] > 0.15 and share[0] < 0.05
    assert ledger.where("to_date(PostedTimestamp) <> to_date(TransactionDate) or TransactionDate < '2026-01-01' or TransactionDate > '2026-06-30'").count() == 0
    pay = made["Repayments"]
    joined = pay.join(ledger.select("TransactionID", F.col("ClientID").alias("c"), "TransactionDate"), "TransactionID")
    assert pay.count() == 6666 == joined.count() == joined.where("c = ClientID and RepaymentDate > TransactionDate").count()
    assert ledger.join(made["Clients"], "ClientID", "left_anti").count() == 0 == ledger.join(made["Branches"], "Branch", "left_anti").count() == ledger.join(made["Products"], "ProductCode", "left_anti").count()
    again = D.ledger(spark, 20_000, 4417, date(2026, 1, 1), date(2026, 6, 30)).repartition(7)
    assert again.exceptAll(ledger).count() == 0 and D.ledger(spark, 20_000, 1, date(2026, 1, 1), date(2026, 6, 30)).intersect(ledger).count() == 0
    ledger.unpersist()


def test_landing_batch(spark):
    a = D.landing_batch(spark, 50, date(2026, 7, 1))
    assert a.columns == D.ledger(spark, 1, 1, date(2026, 7, 1), date(2026, 7, 1)).columns and a.first().TransactionDate == "2026-07-01"
    assert sorted(a.collect()) == sorted(D.landing_batch(spark, 50, date(2026, 7, 1)).collect()) and a.select("Amount").intersect(D.landing_batch(spark, 50, date(2026, 7, 2)).select("Amount")).count() < 5
