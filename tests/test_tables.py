"""Rows, links, sources and table sets."""

import numpy as np
import pytest
from conftest import read

from tablewash.errors import CleaningError
from tablewash.operators import relate, rows
from tablewash.sources.tables import (
    Relationship, TableSet, append_rows, infer_types, nan_to_null, preview, preview_text, read_table, stack_tables,
)


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (1, 10), (None, 5), (None, 5)], "a int, b int")
    assert rows.drop_duplicates(df).count() == 3
    assert rows.drop_duplicates(rows.drop_duplicates(df)).count() == 3


def test_drop_duplicates_keeps_the_first_row_id(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (5, None)], "k int, c string")
    assert sorted(map(tuple, rows.drop_duplicates(df, "k").collect())) == [(1, "x"), (2, None)]


def test_iqr(column):
    assert rows.remove_outliers(column([10.0, 20.0, 30.0, 40.0, 50.0]), "c").count() == 5
    assert read(rows.remove_outliers(column([10.0, 20.0, 30.0, 40.0, 1000.0, None]), "c")) == [10.0, 20.0, 30.0, 40.0, None]
    assert rows.remove_outliers(column(["a", "b"], "string"), "c").count() == 2


def test_zscore(column):
    values = [float(x) for x in np.random.default_rng(0).normal(100, 5, 100)] + [200.0]
    assert 200.0 not in read(rows.remove_outliers(column(values), "c", "zscore"))
    assert rows.remove_outliers(column([5.0, 5.0, None]), "c", "zscore").count() == 3
    with pytest.raises(CleaningError):
        rows.remove_outliers(column([1.0]), "c", "magic")


def test_outliers_are_refitted_after_each_column(spark):
    data = [(i, float(i % 10), float(i % 7)) for i in range(100)] + [(100, 500.0, 80.0), (101, 1.0, 90.0)]
    df = spark.createDataFrame(data, "k int, a double, b double")
    kept = rows.remove_outliers_all(df, ["a", "b"])
    assert sorted(r["k"] for r in kept.collect()) == list(range(100))
    assert rows.remove_outliers_all(df.limit(5), ["a"]).count() == 5


@pytest.fixture
def shop(spark):
    customers = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1), (2, "c", 2), (None, "z", 1)], "id int, city string, v int")
    orders = spark.createDataFrame([(10, 1, None), (11, 2, None), (12, 9, None), (13, None, None), (14, 1, "kept")],
                                   "k int, cust int, city string")
    return TableSet({"orders": orders, "customers": customers}, (Relationship("orders", "cust", "customers", "id"),),
                    primary="orders", order_by={"orders": ["k"], "customers": ["v"]})


def test_lookup_fill_takes_the_first_row_even_if_empty(shop):
    done = relate.lookup_fill(shop["orders"], "city", "cust", shop["customers"], "id", "city", ["v"])
    assert read(done, "city") == ["a", None, None, None, "kept"]
    assert done.columns == ["k", "cust", "city"]


def test_foreign_keys(shop):
    orders, customers = shop["orders"], shop["customers"]
    assert read(relate.enforce_fk(orders, "cust", customers, "id"), "k") == [10, 11, 13, 14]
    assert read(relate.fk_orphans(orders, "cust", customers, "id"), "k") == [12]
    assert relate.fk_integrity_score(shop) == 0.75
    assert relate.fk_integrity_score(TableSet({"orders": orders})) == 1.0
    with pytest.raises(CleaningError):
        relate.fk_integrity(TableSet({"orders": orders}))


def test_hot_and_missing_keys_do_not_meet_in_one_partition(spark):
    # Nine of ten rows have no key: they are spread by content instead of sharing one NULL key.
    df = spark.range(1000).selectExpr("id AS k", "CASE WHEN id % 10 = 0 THEN id END AS fk")
    keys = spark.range(500).selectExpr("id AS key")
    marked = relate._marked(df, "fk", keys, "key")
    assert marked.where("fk is null").select("__spread").distinct().count() > 300
    assert relate.enforce_fk(df, "fk", keys, "key").count() == 950


def test_table_set(shop):
    with pytest.raises(CleaningError):
        shop["nothing"]
    with pytest.raises(CleaningError):
        shop.with_table("nothing", shop["orders"])
    less = shop.with_table("orders", shop["orders"].limit(1))
    assert less["orders"].count() == 1 and shop["orders"].count() == 5
    assert Relationship.from_dict({"from_table": "orders", "from_column": "cust", "to_table": "customers",
                                   "to_column": "id"}) == shop.relationships[0]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d\n1,x,1.5,True\nNA,"q, ""r""",n/a,False\n3,-,2,\n')
    raw = read_table(spark, str(path))
    assert [f.dataType.simpleString() for f in raw.schema.fields] == ["string"] * 4
    typed = read_table(spark, str(path), infer=True)
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["bigint", "string", "double", "boolean"]
    assert [tuple(r) for r in typed.collect()] == [(1, "x", 1.5, True), (None, 'q, "r"', None, False), (3, "-", 2.0, None)]
    given = read_table(spark, str(path), schema="a int, c double")
    assert [tuple(r) for r in given.collect()] == [(1, 1.5), (None, None), (3, 2.0)]
    assert infer_types(spark.range(1)).columns == ["id"]


def test_unions_and_previews(shop, spark):
    assert append_rows(shop["orders"], shop["orders"]).count() == 10
    stacked = stack_tables(shop, shop.order_by, n=2)
    assert stacked.columns[0] == "_table" and stacked.count() == 4
    assert stacked.where("_table = 'orders' and v = 'NULL'").count() == 2
    assert read(preview(shop["orders"], ["k"], 2), "k") == [10, 11]
    assert preview_text(shop["orders"], ["k"], 0).collect()[0]["city"] == "NULL"
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert nan_to_null(nan).where("x is null").count() == 1
