"""Golden cases of candidate targets, keys, contradictions and completeness."""

from pyspark.sql import functions as F

from strataweave.operators import targets


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_affinity_by_kind_of_object(spark):
    yes, half = F.lit(1), F.lit(0.5)
    table, other = (targets.weighted_affinity(F.lit(t), name=half, table=yes, route=yes) for t in (True, False))
    whole = targets.weighted_affinity(F.lit(True), path=yes, route=yes, topic=yes, name=yes, code=yes, table=yes)
    assert [round(x, 6) for x in one(spark, table, other, whole)] == [0.675, 0.425, 1.0]


def test_gateway_strips_and_endpoint_paths(spark):
    paths = ("/api/users/**", "/api/v1/users/*", "/users/**", "/**", "", " /a/b ")
    assert one(spark, *[targets.strip_count(F.lit(p)) for p in paths]) == (1, 2, None, None, None, 1)
    none = F.lit(None).cast("string")
    cases = [("/m", "GET /x"), ("m", "GET /x"), (None, "post   /x/{id} "), (None, "GETS /x"), (None, None), (None, "GET x")]
    got = one(spark, *[targets.endpoint_path(F.lit(m) if m else none, F.lit(n) if n else none) for m, n in cases])
    assert got == ("/m", "/x", "/x/{id}", None, None, None)
    assert [targets.page_size(n) for n in (None, 0, 7, 500)] == [20, 1, 7, 100]


def test_contradictions(spark):
    pair = lambda a, b: tuple(F.lit(x).cast("string") for x in (a, b))
    reasons = lambda i, s, r, u=False, t=False: one(spark, targets.db_contradictions(pair(*i), pair(*s), pair(*r), F.lit(u), F.lit(t)))[0]
    assert reasons(("Sales", "order_items"), ("sales", "OrderItems"), (None, None)) == []
    assert reasons(("a", None), ("b", "t"), (None, "u")) == ["DB_SCHEMA_CONTRADICTION", "DB_TABLE_CONTRADICTION"]
    assert reasons((None, None), (None, None), ("x", "y"), True, True) == ["UNSUPPORTED_SUMMARY_CONFLICT", "TRUNCATED_SUMMARY_CONFLICT"]


def test_completeness(spark):
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("double")
    http = targets.section_completeness(yes, yes, yes, yes, yes)
    db = targets.section_completeness(yes, yes, F.lit(None).cast("boolean"))
    got = one(spark, targets.summary_completeness([http, db, none], no, no), targets.summary_completeness([http], yes, yes), targets.summary_completeness([none], no, no), targets.summary_completeness([targets.section_completeness(no, no, yes)], yes, yes))
    assert got == (0.75, 0.45, 0.0, 0.0)


def test_keys(spark):
    keys = spark.createDataFrame([("app.client.order-url",), ("ORDER-URL",), ("hosts[0]",), ("",), (None,), ("x",)], "key string")
    asked = spark.createDataFrame([("order-url",), ("client.order-url",), ("Hosts.0",), ("zzz",), (None,), (" ",)], "key string")
    got = {r.asked: (r.key, r.strategy) for r in targets.key_matches(asked, keys).collect()}
    assert got == {"order-url": ("order-url", "exact"), "client.order-url": ("app.client.order-url", "suffix"), "hosts.0": ("hosts.0", "exact"), "zzz": ("app.client.order-url", "token")}
    assert targets.key_matches(asked, keys.limit(0)).count() == 0


def test_endpoints_of_a_service_and_twins(spark):
    cands = spark.createDataFrame([("a", "s", 0.9), ("a", "s", 0.4), ("b", "s", 0.5), ("b", None, 0.5)], "subject_id string, object_id string, confidence double")
    ends = spark.createDataFrame([("e1", "s"), ("e2", "s"), ("e3", None)], "id string, parent_id string")
    known = spark.createDataFrame([("a", "e1")], "subject_id string, object_id string")
    got = {(r.subject_id, r.object_id): round(r.confidence, 3) for r in targets.on_endpoints(cands, ends, known).collect()}
    assert got == {("a", "e2"): 0.765, ("b", "e1"): 0.5, ("b", "e2"): 0.5}
    plain = spark.createDataFrame([("d", "t"), ("d", "t"), ("d", "u"), ("e", "t")], "database string, name string")
    full = spark.createDataFrame([("d", "t", "s1"), ("d", "t", "s2"), ("d", "u", "s1"), ("f", "t", "s1")], "database string, name string, schema string")
    out = {(r.name, r.schema): r.confidence for r in targets.twin_tables(plain, full, full.where("schema = 's2'")).collect()}
    assert out == {("t", "s1"): 0.4, ("u", "s1"): 0.65}


def test_schema_hash_ignores_order_and_case(spark):
    rows = [("d", "A"), ("d", "b"), ("d", "b"), ("e", "x")]
    make = lambda r: {x.database: (x.tables, x.schema_hash) for x in targets.schema_hashes(spark.createDataFrame(r, "database string, name string")).collect()}
    assert make(rows) == make([("e", "X"), ("d", "B"), ("d", "a")]) and make(rows)["d"][0] == 2
    assert make(rows)["d"] != make([("d", "a")])["d"]
