"""Golden cases of seeds, exports, snapshots, schema hashes and sharing."""

import pytest
from pyspark.sql import functions as F

from strataweave.operators import exchange, seeding


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "maker, text, want",
    [
        (seeding.path_slugs, "/api/v2/Orders/{id}", ["orders"]), (seeding.path_slugs, "/api/v1", ["v1"]), (seeding.path_slugs, "/:x", []), (seeding.path_slugs, "/web/core", []), (seeding.path_slugs, None, []),
        (seeding.tokens, "OrderItemService", ["order", "item"]), (seeding.tokens, "a-bb.cc_dd/Repo", ["bb", "cc", "dd"]), (seeding.route_slugs, "/api/get/users/{id}/42/list", ["users"]), (seeding.route_slugs, "/주문/x", ["주문"]),
        (seeding.package_slugs, "com.acme.shop.order", ["shop", "order"]), (seeding.package_slugs, "abc.orders.io", ["orders"]), (seeding.package_slugs, "com", []), (seeding.package_slugs, "shop/core/cart", ["shop", "cart"]), (seeding.file_slugs, "/src/x/OrderMapper.java", ["order"]),
    ],
)
def test_slugs(spark, maker, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.coalesce(maker(F.col("t")), F.array().cast("array<string>")).alias("s")).first().s
    assert got == want


def test_clusters_weigh_all_kinds_of_seeds(spark):
    objects = spark.createDataFrame([("f", "function", "orderApi", "/api/order", "OrderHandler", None), ("t", "db_table", "shop_order", "/x/y", None, None), ("u", "db_table", "cart", None, None, None)], "id string, object_type string, name string, path string, class_name string, file_path string")
    artifacts = spark.createDataFrame([("f", None, "com.a.order")], "object_id string, file_path string, package string")
    intents = spark.createDataFrame([("f", "/order/1", None), ("t", None, "order.made"), ("u", None, "cart.made")], "object_id string, route string, topic string")
    found = seeding.seeds(objects, artifacts, intents)
    assert ("f", "order", "package") in rows(found, "object_id", "slug", "source") and ("u", "cart", "table") not in rows(found, "object_id", "slug", "source")
    got = rows(seeding.clusters(objects, found), "slug", "object_id", "affinity")
    assert got == [("order", "f", 0.675), ("order", "t", 0.575), ("shop", "t", 0.475), ("cart", "u", 0.25)] or got == sorted([("order", "f", 0.675), ("order", "t", 0.575), ("shop", "t", 0.475), ("cart", "u", 0.25)], key=repr)


def test_csv_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x", y'), (2, None), (3, "two\nlines"), (4, "plain")], "a int, b string").repartition(2)
    exchange.write_csv(df, f"file://{tmp_path}/c", "a", "b")
    files = [p.read_bytes().decode() for p in tmp_path.glob("c/part-*") if p.stat().st_size]
    assert all(f.startswith("﻿a,b\r\n") for f in files)
    assert sorted(x for f in files for x in f.removeprefix("﻿a,b\r\n").split("\r\n") if x) == ['1,"say ""x"", y"', "2,", '3,"two\nlines"', "4,plain"]


def test_unfinished_snapshots_are_none(spark, tmp_path):
    a, b = spark.range(3), spark.createDataFrame([("x",)], "s string")
    exchange.save({"a": a, "b": b}, f"file://{tmp_path}/s")
    back = exchange.restore(spark, f"file://{tmp_path}/s")
    assert (rows(back["a"], "id"), rows(back["b"], "s")) == ([(0,), (1,), (2,)], [("x",)])
    a.write.parquet(f"file://{tmp_path}/t/a")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        exchange.restore(spark, f"file://{tmp_path}/t")


def test_schema_hashes_see_columns_and_keys(spark):
    t = spark.createDataFrame([("d", "t", None), ("d", "u", "m")], "database string, table string, metadata string")
    c = spark.createDataFrame([("d", "t", "x", "int"), ("d", "t", "y", "text")], "database string, table string, column string, type string")
    k = spark.createDataFrame([("d", "t", "x", "u")], "database string, table string, column string, ref string")
    hashed = lambda *x: exchange.full_schema_hashes(*x).first().schema_hash
    one = hashed(t, c, k)
    assert one == hashed(t.union(t), c.orderBy(F.desc("column")), k)
    others = [hashed(t, c.where("column = 'x'"), k), hashed(t, c.withColumn("type", F.lit("int")), k), hashed(t, c, k.limit(0)), hashed(t.fillna("z"), c, k)]
    assert len({one, *others}) == 5


def test_sharing(spark):
    tables = spark.createDataFrame([(1, "A", 1, True), (2, "a", 2, True), (3, "a", 3, False), (4, "b", 1, True), (5, "c", 1, True)], "table_id int, name string, database_id int, guessed boolean")
    uses = spark.createDataFrame([(2, 1), (2, 2), (3, 1), (3, 1), (5, 1)], "table_id int, service_id int")
    assert rows(exchange.sharing(uses, tables), "table_id", "services", "model") == [(1, 0, "SUSPECTED_SHARED"), (2, 2, "SHARED"), (3, 1, "OWNED"), (4, 0, "UNUSED"), (5, 1, "OWNED")]
