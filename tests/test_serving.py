"""Golden cases of generations, drill-down, search, resources, intake and decisions."""

from pyspark.sql import functions as F

from strataweave.functions.scalars import cursor
from strataweave.operators import drilldown, generations, intake, resources, review, texts
from strataweave.operators.generations import Generations, Request
from strataweave.streaming import changes


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


EDGES = "relation_type string, subject_id string, object_id string, edge_weight long, confidence double"


def test_generations_change_hands(spark, tmp_path):
    edges = lambda *pairs: spark.createDataFrame([("call", a, b, 1, 1.0) for a, b in pairs], EDGES)
    store = Generations(spark, f"file://{tmp_path}/g")
    assert (store.active(), store.cursor(), store.edges("L").count(), store.state().count()) == (None, (0, "0:0"), 0, 0)
    assert store.rebuild({"L": lambda: edges(("a", "b"))}, mode="x") == 1
    second = store.create()
    store.write(second, "L", edges(("a", "b"), ("b", "c")))
    assert rows(store.state(), "version", "status") == [(1, "ACTIVE"), (2, "BUILDING")]
    assert store.edges("L").count() == 1 and store.create() == 2  # a build that was left is begun again
    before = store.cursor()
    store.add_meta(1, mode="y", more="z")
    store.add_meta(7, mode="lost")
    store.activate(second)
    assert store.cursor() != before and store.cursor()[0] == 2
    assert rows(store.state(), "version", "status", "meta") == [(1, "ARCHIVED", {"mode": "y", "more": "z"}), (2, "ACTIVE", {})]
    members = spark.createDataFrame([("a", "D", 0.5)], "object_id string, domain_id string, affinity double")
    relations = spark.createDataFrame([], "id string, relation_type string, subject_id string, object_id string, confidence double")
    run = lambda kind, version=None, **p: generations.execute(store, Request(kind, "L", version, p), relations, members)
    assert [(v, rows(df, "id")) for v, df in (run("IMPACT_ANALYSIS", object_id="a"), run("IMPACT_ANALYSIS", 1, object_id="a"))] == [(2, [("a",), ("b",), ("c",)]), (1, [("a",), ("b",)])]
    assert rows(run("PATH_DISCOVERY", source_id="a", target_id="c")[1], "path") == [("a>b>c",)]
    assert rows(run("DOMAIN_SUMMARY", domain_id="D")[1], "members") == [(1,)]
    assert rows(run("USAGE_DISCOVERY", object_id="c")[1], "subject_id") == [("b",)] and run("?")[1].count() == 0


def test_page_tokens(spark):
    df = spark.createDataFrame([(0,), (7,), (12345,)], "n int").withColumn("back", drilldown.offset_of(cursor(F.col("n"))))
    assert all(r.n == r.back for r in df.collect())
    odd = spark.createDataFrame([(None,), ("",), ("?",), ("LTU",), ("eA",)], "t string").select(drilldown.offset_of(F.col("t")).alias("n"))
    assert {r.n for r in odd.collect()} == {0}


def test_contributors_by_request(spark):
    objects = spark.createDataFrame([("S", "service", "Shop", None, "/S"), ("S1", "api_endpoint", None, "S", "/S/S1"), ("T", "service", "Till", None, "/T"), ("U", "service", "U", None, "/U"), ("D", "domain", "Dom", None, "/D")], "id string, object_type string, name string, parent_id string, path string").withColumn("display_name", F.lit(None).cast("string"))
    relations = spark.createDataFrame([(f"r{k}", t, a, b, s) for k, (t, a, b, s) in enumerate([("call", "T", "S1", "APPROVED"), ("call", "T", "S", "APPROVED"), ("read", "U", "S1", "APPROVED"), ("call", "T", "S1", "PENDING"), ("expose", "T", "S1", "APPROVED")])], "id string, relation_type string, subject_id string, object_id string, status string").withColumn("confidence", F.lit(1.0))
    affinities = spark.createDataFrame([("S", "D", 0.3), ("U", "D", 0.1)], "object_id string, domain_id string, affinity double")
    evidences = spark.createDataFrame([("e1", "r0"), ("e2", "r0"), ("e3", "r2")], "id string, relation_id string")
    ask = lambda k, **x: (k, x.get("source", "T"), x.get("target", "S"), x.get("by", "x"), x.get("mode", "GLOBAL"), x.get("types"), x.get("excluded"), None, x.get("size"), x.get("cursor"))
    requests = [ask(1), ask(2, by="sourceAtomic", size=1), ask(3, by="sourceAtomic", size=1, cursor="MQ"), ask(4, by="targetAtomic", mode="SUBTREE"), ask(5, by="relationType", excluded=[]), ask(6, target="D", by="relationType", types=["read"]), ask(7, target="none")]
    got = drilldown.contributors(spark.createDataFrame(requests, "request_id int, source_id string, target_id string, group_by string, scope_mode string, relation_types array<string>, excluded_types array<string>, threshold double, page_size int, cursor string"), relations, objects, affinities, evidences)
    assert rows(got, "request_id", "place", "group_key", "group_label", "weight", "evidence_count", "total", "next_cursor") == sorted([
        (1, 1, "S", "Shop", 3, 3, 3, None), (2, 1, "T", "Till", 2, 2, 3, "MQ"), (3, 2, "U", "U", 1, 1, 3, None), (4, 1, "S", "Shop", 1, 0, 2, None), (4, 2, "S1", "S1", 1, 2, 2, None),
        (5, 1, "call", "call", 2, 2, 4, None), (5, 2, "expose", "expose", 1, 0, 4, None), (5, 3, "read", "read", 1, 1, 4, None), (6, 1, "read", "read", 1, 1, 1, None),
    ], key=repr)


def test_search(spark):
    objects = spark.createDataFrame([("1", "a", "Alpha"), ("2", "a", "alpha beta"), ("3", "b", "100%_x"), ("4", "b", "100ax")], "id string, object_type string, name string").withColumn("display_name", F.lit(None).cast("string"))
    asked = spark.createDataFrame([(1, "ALPHA", None), (2, "beta", None), (3, "100%", None), (4, "nothing", "b"), (5, "", None), (6, "alpha", "b")], "request_id int, text string, object_type string")
    for block in (1, 1000):
        assert rows(drilldown.find_objects(objects, asked, block), "request_id", "object_id", "match", "n") == [(1, "1", "exact", 2), (2, "2", "part", 1), (3, "3", "part", 1), (4, "3", "first", 0), (5, "3", "first", 0), (6, "3", "first", 0)]


def test_related_objects(spark):
    relations = spark.createDataFrame([("r", "call", "a", "b", "APPROVED"), ("s", "call", "a", "a", "APPROVED")], "id string, relation_type string, subject_id string, object_id string, status string")
    objects = spark.createDataFrame([("a", "A", None)], "id string, name string, display_name string")
    assert rows(drilldown.related(relations, objects), "id", "direction", "relation_id", "other_label") == [("a", "INBOUND", "s", "A"), ("a", "OUTBOUND", "r", "b"), ("a", "OUTBOUND", "s", "A"), ("b", "INBOUND", "r", "A")]


def test_texts_that_hold_each_other(spark):
    words = ["a", "ab", "abc", "bc", "xabcx", "", "zz", "é", "caé"]
    a, b = spark.createDataFrame([(w,) for w in words], "a string"), spark.createDataFrame([(w,) for w in words[1:]], "b string")
    assert rows(texts.holding_pairs(a, "a", b, "b"), "a", "b") == sorted((x, y) for x in words for y in words[1:] if x and y and (x in y or y in x))
    assert texts.holding_pairs(a, "a", b.limit(0), "b").count() == 0


def test_tables_and_channels(spark):
    tables = spark.createDataFrame([("t1", "orders", "shop", ["db-1"]), ("t2", "Orders", "bank", ["db-2"]), ("t3", "items", "shop", ["db-1"]), ("t4", "items", "shop", ["db-2"])], "id string, name string, schema string, tokens array<string>")
    bindings = spark.createDataFrame([("mainUrl", None, "db_1", None), ("other", None, "nothing", None)], "alias_key string, alias_value string, service_id string, host string")
    intents = [(1, "select", "orders", None, []), (2, "UPDATE", "bank.orders", None, []), (3, "read", "orders", None, ["main"]), (4, "read", "items", "shop", []), (5, "read", "items", "shop", ["main-url"]), (6, "read", "gone", None, []), (7, "mystery", "orders", None, []), (8, "read", " ", None, []), (9, "read", "orders", None, ["other"])]
    got = resources.resolve_tables(spark.createDataFrame(intents, "intent_id int, action string, resource string, schema string, hints array<string>"), tables, bindings)
    assert rows(got, "intent_id", "status", "relation_type", "target_id", "narrowed") == [
        (1, "DB_SCHEMA_AMBIGUOUS", "read", None, False), (2, "CLOSED_ATOMIC", "write", "t2", False), (3, "CLOSED_ATOMIC", "read", "t1", True), (4, "TABLE_MATCH_AMBIGUOUS", "read", None, False), (5, "CLOSED_ATOMIC", "read", "t3", True),
        (6, "DB_TABLE_UNRESOLVED", "read", None, False), (7, "DB_ACTION_UNKNOWN", None, None, False), (8, "DB_TABLE_UNRESOLVED", "read", None, False), (9, "DB_SCHEMA_AMBIGUOUS", "read", None, False),
    ]
    said = lambda *x: spark.range(1).select(resources.message_contradictions(*[F.lit(v).cast("boolean" if k > 6 else "string") for k, v in enumerate(x)]).alias("r")).first().r
    assert said("a_b", "", "topic", "aB", None, None, "topic", False, None) == []
    assert said("a", None, "queue", "x", "b", None, "topic", True, True) == ["MESSAGE_TARGET_CONTRADICTION", "MESSAGE_CHANNEL_TYPE_CONTRADICTION", "UNSUPPORTED_SUMMARY_CONFLICT", "TRUNCATED_SUMMARY_CONFLICT"]
    assert said("", "c", "topic", "", "", "d", None, None, None) == ["MESSAGE_TARGET_CONTRADICTION"]


def test_json_and_projects(spark):
    files = spark.createDataFrame([("f", '{"a": {"b": [1, {"c": null}], "d": true}, "e": "x.y"}'), ("g", "[]"), ("h", "no json"), ("i", None)], "path string, text string")
    assert rows(intake.json_entries(files), "path", "key", "value") == [("f", "a.b.0", "1"), ("f", "a.b.1.c", None), ("f", "a.d", "true"), ("f", "e", "x.y")]
    paths = ["/r/pom.xml", "/r/package.json", "/r/a/go.mod", "/r/a/b/pom.xml", "/r/.x/pom.xml", "/r/dist/pom.xml", "/r/c/readme", "/rr/pom.xml", "/q/pom.xml/x"]
    found = intake.projects(spark.createDataFrame([("/r", p) for p in paths] + [("/q", "/q/pom.xml/x")], "root string, path string"))
    assert rows(found, "path", "name", "language", "marker") == [("/r", "r", "node", "package.json"), ("/r/a", "a", "go", "go.mod")]
    assert rows(intake.under_root(spark.createDataFrame([(p,) for p in ("/a", "/a/b", "/ab")], "path string").withColumn("root", F.lit("/a/")), "root"), "path") == [("/a",), ("/a/b",)]


def test_named_services_must_be_unique(spark):
    entries = spark.createDataFrame([("p", "spring.application.name", "My_App"), ("q", "spring.application.name", "twin"), ("p", "other", "x")], "path string, key string, value string")
    services = spark.createDataFrame([("1", "my-app"), ("2", "Twin"), ("3", "t-win")], "id string, name string")
    assert rows(intake.named_services(entries, services), "path", "service_id") == [("p", "1")]


def test_decisions(spark):
    schema = "id string, relation_type string, subject_id string, object_id string, confidence double, status string, feedback_key string"
    c = spark.createDataFrame([("c1", "call", "a", "b", 0.9, "PENDING", "k"), ("c2", "call", "a", "c", 0.8, "PENDING", "k"), ("c3", "call", "a", "d", 0.7, "REJECTED", "k"), ("c4", "call", "x", "y", 0.6, "PENDING", "l")], schema)
    d = spark.createDataFrame([("c1", 1, "REJECTED"), ("c1", 2, "APPROVED"), ("c2", 1, "REJECTED"), ("c3", 1, "APPROVED"), ("none", 1, "APPROVED")], "id string, at int, action string")
    relations = spark.createDataFrame([("r1", "call", "a", "d", 0.5)], "id string, relation_type string, subject_id string, object_id string, confidence double")
    evidence = spark.createDataFrame([("c1", "e1"), ("c2", "e2"), ("c3", "e3"), ("c3", "e4")], "candidate_id string, evidence_id string")
    held = spark.createDataFrame([("r1", "e3")], "relation_id string, evidence_id string")
    after, made, links, first = review.decide(c, d, relations, evidence, held)
    assert rows(after, "id", "status") == [("c1", "APPROVED"), ("c2", "REJECTED"), ("c3", "APPROVED"), ("c4", "PENDING")]
    assert rows(made, "id", "object_id", "confidence") == [("R-c1", "b", 0.9)]
    assert rows(links, "relation_id", "evidence_id") == [("R-c1", "e1"), ("r1", "e4")]
    assert rows(first, "feedback_key", "approved", "rejected") == [("k", 1, 1)]


def test_cutover(spark):
    pairs = lambda *x: spark.createDataFrame([(p,) for p in x], "k string")
    run = lambda a, b, **t: rows(review.cutover(pairs(*a), pairs(*b), pairs("1", "2", "3"), "k", **t), "baseline_precision", "candidate_precision", "recall_delta", "approval_delta", "failed", "decision")
    assert run(("1", "x"), ("1", "2", "2")) == [(0.5, 1.0, 0.3334, 0, "", "GO")]
    assert run(("1",), ("1", "x")) == [(1.0, 0.5, 0.0, 1, "precision,approvals", "NO_GO")]


def test_scenarios_and_cuts(spark):
    s = spark.createDataFrame([(1, "publish", "p", 1, 0, 1), (1, "consume", "m", 1, 1, 1), (1, "http", "a", 2, 5, 1), (1, "http", "a", 1, 9, 2), (1, "http", "b", 1, 2, None)], "domain_id int, trigger string, key string, entry_id int, seq int, evidence_id int")
    assert rows(review.scenarios(s, 2), "place", "title", "entry_id", "evidences") == [(1, "b request", 1, 0), (2, "a request", 2, 2)]
    chain = spark.createDataFrame([(1, 0.9, 1.0, 1, 0, "a"), (1, 0.9, 2.0, 1, 0, "b"), (1, 0.5, 9.0, 1, 0, "c"), (1, 0.9, 2.0, 1, 1, "d")], "g int, confidence double, score double, edge_weight int, hop int, evidence_id string")
    assert rows(review.recut(chain, 2, 0.6, "g"), "place", "evidence_id") == [(1, "b"), (2, "d")]


def test_stream_reads_relations_only_for_events_that_need_them(spark, tmp_path):
    relations = spark.createDataFrame([("r", "call", "a", "b", 0.5, "APPROVED")], "id string, relation_type string, subject_id string, object_id string, confidence double, status string")
    seen = []

    def scope(events, now):
        seen.append(now.count())
        return events.select("subject_id")

    keeper = changes.RollupMaintainer(spark, relations, scope, lambda r: r.groupBy(*changes.KEY).agg(F.count(F.lit(1)).alias("edge_weight"), F.avg("confidence").alias("confidence")), f"file://{tmp_path}/k")
    event = lambda k, kind: spark.createDataFrame([(k, kind, "call", "a", "c", 1.0)], changes.EVENT_SCHEMA)
    keeper.apply(event(1, "RELATION_CREATED"), 0)
    keeper.apply(event(2, "EXPOSE_CHANGED"), 1)
    assert seen == [0, 2]
    assert rows(keeper.edges(), "object_id") == [("b",), ("c",)]
