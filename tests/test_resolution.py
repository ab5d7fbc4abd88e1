"""Golden cases of intent resolution, patches, families, symbols and hierarchies."""

import random

import pytest
from pyspark.sql import functions as F

from strataweave.functions.scalars import exact_avg, path_compatibility, segments
from strataweave.operators import families, hierarchy, patches, providers, symbols


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_means_do_not_depend_on_order(spark):
    values = [0.95] * 71 + [0.96] * 89  # their mean is a half at the sixth digit
    for n in (1, 3, 8):
        random.Random(n).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(n)
        assert df.agg(F.round(exact_avg(F.col("x")), 6)).first()[0] == 0.955563
    assert spark.createDataFrame([], "x double").agg(exact_avg(F.col("x"))).first()[0] is None


SERVICES = [("orders", ["orders", "ordersinternal"]), ("billing", ["billing"]), ("users-a", ["usersa", "users"]), ("users-b", ["usersb", "users"]), ("stock", ["stock"])]
ENDPOINTS = [("stock", "/stock/items/{id}", "GET", "e1"), ("billing", "/bills", "POST", "e2"), ("orders", "/orders/{id}", "GET", "e3"), ("orders", "/orders/7", "GET", "e4"), ("users-a", "/u", "ANY", "e5"), ("billing", "/bills/{x}", "POST", "e6"), ("billing", "/bills/{y}", "POST", "e7")]
BINDINGS = [("payUrl", "pay", None, "billing", None), ("queueKey", "q", "stock", None, "http://orders.internal:8080/x"), ("queueKey", "q2", "other", None, "billing")]
INTENTS = [
    (1, None, "/orders/9", "GET", ["orders"], [], None, None),  # own token, fits
    (2, None, "/orders/7", "GET", ["http://orders/"], [], None, None),  # equal path before fitting ones
    (3, None, "/bills", "POST", [], ["pay_url"], None, None),  # by alias, without its ending
    (4, None, "/u", "GET", ["users"], [], None, None),  # two services
    (5, None, "/u", "GET", ["users"], [], "users-a", None),  # one of them is chosen
    (6, "stock", "/orders/9", "GET", [], ["queueKey"], None, None),  # by the host of an alias in scope
    (7, "elsewhere", "/orders/9", "GET", [], ["queueKey"], None, None),  # the alias is another's
    (8, None, "/stock/items/5", "GET", [], [], None, None),  # by the path alone
    (9, "stock", "/stock/items/5", "GET", [], [], None, None),  # but not by the source's own endpoint
    (10, None, "/orders/9", None, ["orders"], [], None, None),
    (11, None, "/orders/9", "DELETE", ["orders"], [], None, None),
    (12, None, "/bills/3", "POST", ["billing"], [], None, None),  # two fit
    (13, None, "/bills/3", "POST", ["billing"], [], None, "e7"),  # a hint decides
    (14, None, "/none/at/all", "GET", [], [], None, None),
]


def http(spark):
    intents = spark.createDataFrame(INTENTS, "intent_id long, source_id string, path string, method string, hosts array<string>, config_keys array<string>, provider_override string, hint_id string").withColumn("dynamic", F.lit(None).cast("boolean"))
    services = spark.createDataFrame(SERVICES, "service_id string, tokens array<string>")
    bindings = spark.createDataFrame(BINDINGS, "alias_key string, alias_value string, owner_id string, service_id string, host string")
    return intents, services, bindings, spark.createDataFrame(ENDPOINTS, "provider_id string, endpoint_path string, endpoint_method string, endpoint_id string")


def test_http_stages(spark):
    got = {r[0]: r[1:] for r in rows(providers.resolve_http(*http(spark)), "intent_id", "status", "stage", "target_id")}
    assert got == {
        1: ("CLOSED_ATOMIC", "alias", "e3"), 2: ("CLOSED_ATOMIC", "alias", "e4"), 3: ("CLOSED_ATOMIC", "alias", "e2"), 4: ("PROVIDER_SERVICE_AMBIGUOUS", "alias", None), 5: ("CLOSED_ATOMIC", "alias", "e5"),
        6: ("CLOSED_ATOMIC", "host", "e3"), 7: ("CLOSED_ATOMIC", "path", "e3"), 8: ("CLOSED_ATOMIC", "path", "e1"), 9: ("PATH_ONLY_TARGET_UNRESOLVED", None, None), 10: ("METHOD_UNKNOWN", "alias", None),
        11: ("PROVIDER_ENDPOINT_NOT_FOUND", "alias", None), 12: ("ENDPOINT_MATCH_AMBIGUOUS", "alias", None), 13: ("CLOSED_ATOMIC", "alias", "e7"), 14: ("PATH_ONLY_TARGET_UNRESOLVED", None, None),
    }


def test_fitting_paths_lose_no_pair(spark):
    rng = random.Random(3)
    some = lambda: "/" + "/".join(rng.choice(["a", "b", "7", "{x}", ":y", "c3"]) for _ in range(rng.choice([0, 1, 2, 3, 6, 7, 13])))
    long = ["/".join(["", *"abcdefgh"]), "/".join(["", *"abcdefgx"]), "/".join(["", "x", *"bcdefgh"]), "/" + "/".join("abcdefghijklm"), "/" + "/".join("xbcdeyghijklm")]
    paths = spark.createDataFrame([(some(),) for _ in range(120)] + [(p,) for p in long], "path string")
    patterns = spark.createDataFrame([(some(),) for _ in range(120)] + [(p,) for p in long], "endpoint_path string")
    want = paths.distinct().crossJoin(patterns.distinct()).withColumn("score", path_compatibility(segments(F.col("path")), segments(F.col("endpoint_path")))).where("score >= 0.75")
    assert rows(providers.fitting_paths(paths, patterns), "path", "endpoint_path", "score") == rows(want, "path", "endpoint_path", "score")


def _state(spark, **changes):
    base = {"intent_id": 1, "provider_id": None, "method": None, "confidence": 0.5, "open_reason": "HOST_ALIAS_UNRESOLVED", "hints": ["Pay"], "candidates": ["a", "b"], "options": [("e1", "a", "GET"), ("e2", "a", "ANY"), ("e3", "b", "GET")]}
    row = base | changes
    schema = "intent_id long, provider_id string, method string, confidence double, open_reason string, hints array<string>, candidates array<string>, options array<struct<endpoint_id:string,provider_id:string,method:string>>"
    return spark.createDataFrame([tuple(row.values())], schema)


def _patches(spark, *items):
    names = ("method", "path", "endpoint_id", "service_id", "host", "alias_key", "alias_value", "action")
    return spark.createDataFrame([(1, k + 1, t, *[x.get(c) for c in names], x.get("reasons")) for k, (t, x) in enumerate(items)], "intent_id long, seq long, patch_type string, " + ", ".join(f"{c} string" for c in names) + ", reasons array<string>")


def test_each_patch_sees_what_earlier_ones_changed(spark, tmp_path):
    todo = _patches(
        spark, ("endpoint_disambiguation", {"endpoint_id": "e1"}), ("provider_service_selection", {"service_id": "z"}), ("provider_service_selection", {"service_id": "a"}), ("provider_service_selection", {"service_id": "b"}),
        ("method_path_hint", {"method": "PUT", "path": "/x"}), ("method_path_hint", {"method": "get", "path": "/x"}), ("endpoint_disambiguation", {"endpoint_id": "e3"}), ("endpoint_disambiguation", {"endpoint_id": "e2", "method": "GET"}),
        ("endpoint_disambiguation", {"endpoint_id": "e1"}), ("contradiction_challenge", {"action": "reopen_frontier"}), ("contradiction_challenge", {"action": "reopen_frontier", "reasons": ["odd"]}), ("alias_binding", {}),
    )
    got = rows(patches.fold(_state(spark), todo), "seq", "verdict", "errors", "status", "reason", "target_id")
    wrong = "frontier does not ask for it"
    assert got == sorted([
        (1, "REJECTED", wrong, "FRONTIER", "PROVIDER_SERVICE_AMBIGUOUS", None), (2, "REJECTED", "service is no candidate", "FRONTIER", "PROVIDER_SERVICE_AMBIGUOUS", None), (3, "ACCEPTED", "", "FRONTIER", "METHOD_UNKNOWN", None),
        (4, "REJECTED", wrong, "FRONTIER", "METHOD_UNKNOWN", None), (5, "REJECTED", "no endpoint of the provider fits", "FRONTIER", "METHOD_UNKNOWN", None), (6, "ACCEPTED", "", "FRONTIER", "ENDPOINT_MATCH_AMBIGUOUS", None),
        (7, "REJECTED", "endpoint of another provider; endpoint is no candidate", "FRONTIER", "ENDPOINT_MATCH_AMBIGUOUS", None), (8, "REJECTED", "method differs", "FRONTIER", "ENDPOINT_MATCH_AMBIGUOUS", None), (9, "ACCEPTED", "", "CLOSED_ATOMIC", None, "e1"),
        (10, "REJECTED", "reasons are required", "CLOSED_ATOMIC", None, "e1"), (11, "ACCEPTED", "", "FRONTIER", "SMART_CONTRADICTION_CHALLENGED", None),
        (12, "REJECTED", "alias_key is required; alias_value is required; service_id or host is required", "FRONTIER", "SMART_CONTRADICTION_CHALLENGED", None),
    ], key=repr)
    for k in range(3):
        todo.where(F.col("seq").between(4 * k + 1, 4 * k + 4)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    patches.fold_stream(_state(spark), source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "seq", "verdict", "errors", "status", "reason", "target_id") == got


def test_aliases_and_confident_proofs(spark):
    one = lambda state, patch: rows(patches.fold(state, _patches(spark, patch)), "verdict", "errors", "status")
    alone = {"candidates": []}
    assert one(_state(spark, **alone), ("alias_binding", {"alias_key": "PAY", "alias_value": "v", "service_id": "a"})) == [("ACCEPTED", "", "FRONTIER")]
    assert one(_state(spark, **alone), ("alias_binding", {"alias_key": "other", "alias_value": "v", "service_id": "a"})) == [("REJECTED", "alias_key is no hint of the frontier", "FRONTIER")]
    assert one(_state(spark, provider_id="b", method="GET", confidence=0.65), ("contradiction_challenge", {"action": "reopen_frontier", "reasons": ["x"]})) == [("REJECTED", "proof is too confident", "CLOSED_ATOMIC")]
    assert patches.fold(_state(spark), _patches(spark).limit(0)).count() == 0


def test_route_families(spark):
    e = spark.createDataFrame([("s", "/api/a/{id}", "e1"), ("s", "/api/b", "e2"), ("s", "/other", "e3"), ("t", "/x", "g"), ("t", "/x/", "p"), ("u", "/k", "k1"), ("u", "/k", "k2"), ("u", "/m", "m")], "provider_id string, endpoint_path string, endpoint_id string")
    r = spark.createDataFrame([(1, "s", "prefix", ["/api"]), (2, "s", "exact", ["/other"]), (3, "s", "prefix", ["/none"]), (4, "t", "prefix", ["/x"]), (5, "u", "exact", ["/k"]), (6, "s", "prefix", ["/api/a/7"])], "route_id long, provider_id string, mode string, paths array<string>")
    assert rows(families.route_families(r, e), "route_id", "status", "n", "child_id") == [
        (1, "DERIVED_CHILDREN", 2, "e1"), (1, "DERIVED_CHILDREN", 2, "e2"), (2, "DERIVED_CHILDREN", 1, "e3"), (3, "ROUTE_FAMILY_DERIVATION_EMPTY", 0, None), (4, "ROUTE_FAMILY_TOO_BROAD", 2, None), (5, "ENDPOINT_SET_OPEN", 2, None), (6, "DERIVED_CHILDREN", 1, "e1"),
    ]
    paths = spark.range(1).select(families.composed_paths(F.lit("/gw/v1/orders/7"), F.lit("/gw/v1/**"), F.lit(2), F.lit("/in")).alias("p")).first().p
    assert paths == ["/in/orders/7", "/gw/v1/orders/7", "/gw/v1", "/in/gw/v1", "/in", "/orders/7"]


def test_alias_quality(spark):
    services = spark.createDataFrame([("1", "Order Service", ["orders.net"]), ("2", "orders", ["o.net"]), ("3", "orders-eu", ["x"]), ("4", "orders-us", ["y"])], "service_id string, name string, hosts array<string>")
    hints = spark.createDataFrame([("f", "orders", True), ("g", "orders.net", False), ("h", "ordersx", False), ("h", "eu", False), ("i", "order", False), ("j", "-", True)], "frontier_id string, hint string, name_hint boolean")
    best = families.best_alias(families.alias_scores(hints, services))
    assert rows(best, "frontier_id", "n", "service_id", "score") == [("f", 1, "2", 3), ("g", 1, "1", 3), ("h", 1, "3", 1), ("i", 4, None, 1)]


def test_projection(spark):
    schema = "proof_id string, relation_type string, subject_id string, object_id string, confidence double, status string"
    proofs = spark.createDataFrame([("p1", "call", "s", "t", 0.9, "CLOSED_ATOMIC"), ("p2", "call", "s", "u", 0.8, "FRONTIER"), ("p3", "call", "s", "v", 0.7, "CLOSED_ATOMIC"), ("p4", "call", "s", "w", 0.7, "CLOSED_ATOMIC"), ("p5", "call", "s", "x", 0.7, "CLOSED_ATOMIC")], schema)
    before = spark.createDataFrame([("p1", "call", "s", "old", 0.1, "PENDING"), ("p2", "call", "s", "u", 0.1, "PENDING"), ("p3", "call", "s", "v", 0.1, "REJECTED"), (None, "call", "s", "w", 0.1, "APPROVED"), (None, "call", "a", "b", 0.1, "PENDING"), ("p9", "call", "a", "c", 0.1, "PENDING")], schema)
    manual = spark.createDataFrame([("call", "s", "x")], "relation_type string, subject_id string, object_id string")
    assert rows(families.projected(proofs, before, manual), "proof_id", "object_id", "status") == sorted([("p1", "t", "PENDING"), ("p3", "v", "REJECTED"), (None, "w", "APPROVED"), (None, "b", "PENDING"), ("p9", "c", "PENDING")], key=repr)


def test_calls_through_interfaces(spark):
    starts = spark.createDataFrame([("x", "I", "m")], "start string, type string, method string")
    implements = spark.createDataFrame([("A", "I"), ("B", "J"), ("C", "J")], "class string, interface string")
    faces = spark.createDataFrame([("I",), ("J",), ("K",)], "type string")
    nested = spark.createDataFrame([("A", "m", "J", "n"), ("A", "m", "K", "n"), ("B", "n", "A", "m"), ("C", "n", "D", "o")], "type string, method string, to_type string, to_method string")
    direct = spark.createDataFrame([("A", "m", "a"), ("B", "n", "b"), ("D", "o", "d"), ("K", "n", "k")], "type string, method string, target string")
    got = rows(symbols.resolve_calls(starts, implements, faces, nested, direct, 3), "target", "depth", "impl", "ambiguous", "penalty")
    assert got == [("a", 1, "A", False, 0.0), ("a", 3, "B", True, 0.1), ("b", 2, "B", True, 0.1), ("d", 3, "C", True, 0.1)]


def test_owners_are_the_innermost_ranges(spark):
    rng = random.Random(9)
    functions = [(rng.choice("xy"), f"f{k:03}", a := rng.randrange(300), a + rng.randrange(-2, 90)) for k in range(150)] + [("x", "all", 0, 2**30), ("y", "one", 5, 5), ("y", "two", 5, 5)]
    lines = [(f, k, "s") for f in "xyz" for k in range(0, 400, 3)] + [("x", 2**30, "s"), ("x", 5, "s"), ("y", 5, "s")]
    got = symbols.owners(spark.createDataFrame(lines, "file string, line long, signal string"), spark.createDataFrame(functions, "file string, function_id string, line_start long, line_end long"))
    inner = lambda f, k: min(((-a, b, i) for g, i, a, b in functions if g == f and a <= k <= b), default=(0, 0, None))[2]
    assert rows(got, "file", "line", "function_id") == sorted(((f, k, inner(f, k)) for f, k, _ in lines), key=repr)


def test_roots_with_missing_parents_and_cycles(spark):
    deep = [(f"n{k}", f"n{k - 1}") for k in range(1, 40)]
    objects = spark.createDataFrame([("n0", None), *deep, ("a", "gone"), ("b", "a"), ("p", "r"), ("q", "p"), ("r", "q"), ("under", "q"), ("self", "self")], "id string, parent_id string")
    got = dict(rows(hierarchy.roots_by_parent(objects), "id", "root_id"))
    assert got == {f"n{k}": "n0" for k in range(40)} | {"a": "a", "b": "a", "p": "p", "q": "p", "r": "p", "under": "p", "self": "self"}


def test_scope_goes_down_all_levels(spark):
    objects = spark.createDataFrame([("s", "service", None), ("c", "class", "s"), ("f", "function", "c"), ("t", "service", None), ("e", "api_endpoint", "t"), ("loop", "x", "loop")], "id string, object_type string, parent_id string")
    relations = spark.createDataFrame([("f", "table"), ("f", "t"), ("e", "other")], "subject_id string, object_id string")
    selected = spark.createDataFrame([("s",)], "id string")
    assert rows(hierarchy.selected_objects(objects, relations, selected), "id") == [("c",), ("f",), ("s",), ("table",)]
    intents = spark.createDataFrame([(1, "t"), (2, "c")], "intent_id long, source_id string")
    assert rows(hierarchy.inherited(intents, objects), "intent_id", "object_id") == [(1, "e"), (1, "t"), (2, "c")]


def test_approval_equals_a_rebuild_and_reads_touched_services(spark):
    objects = spark.createDataFrame([(s, "service", None) for s in "abc"] + [(f"{s}{k}", "api_endpoint", s) for s in "abc" for k in range(4)], "id string, object_type string, parent_id string")
    old = spark.createDataFrame([(f"{s}{k}", "D0" if k < 2 and s != "c" else "D1", 0.6) for s in "abc" for k in range(4)], "object_id string, domain_id string, affinity double")
    members = spark.createDataFrame([("a0", 0.9), ("a3", 0.6)], "object_id string, affinity double")
    after, touched, edges = hierarchy.approve_members(objects, old, "D0", members, hierarchy.implements(objects, old))
    assert rows(touched, "service_id") == [("a",), ("b",)]
    columns = ("service_id", "domain_id", "in_domain", "total", "confidence")
    assert rows(edges, *columns) == rows(hierarchy.implements(objects, after), *columns) == [("a", "D0", 2, 4, 0.5), ("a", "D1", 1, 4, 0.25), ("b", "D1", 2, 4, 0.5), ("c", "D1", 4, 4, 1.0)]


def test_equal_evidence_has_one_id(spark):
    e = spark.createDataFrame([("f", 1, 2, "s2", "k"), ("f", 1, 2, "s1", "k"), ("f", 1, None, "s1", "l"), (None, 1, 2, "s", "m"), ("", 1, 2, "s", "k")], "file string, line_start long, line_end long, source_id string, key string")
    assert rows(hierarchy.evidence_pool(e), "file", "line_end", "source_id") == [("f", 2, "s1"), ("f", None, "s1")]
    got = rows(hierarchy.pooled_sets(e, "key"), "key", "evidence_id")
    assert [(k, i is None) for k, i in got] == [("k", False), ("l", False), ("m", True)]


@pytest.mark.parametrize("kind, value, part", [("object_name", "Alpha Beta", 1), ("route_prefix", "/Users/list", 1), ("class_name", "ctrl", 1), ("table_name", "ctrl", None), ("seed_source", "ETA", 1), ("file_path", "src", 1)])
def test_selectors(spark, kind, value, part):
    members = spark.createDataFrame([("c", "m", s) for s in ("name:alpha beta", "route:/users/1", "class:MyCtrl", "file:/src/x")], "cluster_id string, object_id string, source string")
    selectors = spark.createDataFrame([("c", 2, "seed_source", "alpha"), ("c", 1, kind, f" {value} ")], "cluster_id string, part int, kind string, value string")
    assert rows(hierarchy.split_members(members, selectors), "part") == [(part or 2,)]


def test_cohesion_of_parts(spark):
    members = spark.createDataFrame([("c", "a", 1), ("c", "b", 1), ("c", "d", None), ("c", "e", None)], "cluster_id string, object_id string, part int")
    relations = spark.createDataFrame([("a", "b"), ("a", "d"), ("x", "a")], "subject_id string, object_id string")
    assert rows(hierarchy.part_cohesion(members, relations), "object_id", "cohesion") == [("a", 1 / 3), ("b", 1.0), ("d", 0.0), ("e", 0.0)]
