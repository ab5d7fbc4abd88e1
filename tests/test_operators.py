"""Golden cases on small hand-made graphs."""

import math

import pytest
from pyspark.sql import functions as F

from strataweave.functions import scalars
from strataweave.operators import confidence, domain, graph, proof, review, rollup, signals

EDGE = "relation_type string, subject_id string, object_id string, edge_weight long, confidence double"


@pytest.fixture(scope="module")
def shop(spark):
    objects = spark.createDataFrame(
        [(s, "service", "COMPOUND", None) for s in ("svc-a", "svc-b")] + [("ep-b1", "api_endpoint", "ATOMIC", "svc-b"), ("ep-b2", "api_endpoint", "ATOMIC", "svc-b"), ("tbl-x", "db_table", "ATOMIC", "db-x"), ("topic-p", "topic", "ATOMIC", "brk-m")],
        "id string, object_type string, granularity string, parent_id string",
    )
    rows = [("1", "call", "svc-a", "ep-b1", 0.9), ("2", "call", "svc-a", "ep-b2", 0.8), ("3", "expose", "svc-b", "ep-b1", 1.0), ("4", "read", "svc-a", "tbl-x", 0.5), ("5", "write", "svc-b", "tbl-x", 0.5), ("6", "produce", "svc-a", "topic-p", 0.5), ("7", "consume", "svc-b", "topic-p", 0.5), ("8", "call", "svc-b", "ep-b1", 0.7)]
    relations = spark.createDataFrame([(*r, "APPROVED") for r in rows], "id string, relation_type string, subject_id string, object_id string, confidence double, status string")
    return objects, relations


def test_rollups(spark, shop):
    objects, relations = shop
    s2s = rollup.service_to_service(relations, objects)
    assert [(r.subject_id, r.object_id, r.edge_weight, round(r.confidence, 6)) for r in s2s.collect()] == [("svc-a", "svc-b", 2, 0.85)]
    assert {tuple(r)[:4] for r in rollup.service_to_database(relations, objects).collect()} == {("read", "svc-a", "db-x", 1), ("write", "svc-b", "db-x", 1)}
    assert {tuple(r)[:4] for r in rollup.service_to_broker(relations, objects).collect()} == {("produce", "svc-a", "brk-m", 1), ("consume", "svc-b", "brk-m", 1)}
    affinities = spark.createDataFrame([("svc-a", "Order", 0.8), ("svc-a", "Payment", 0.3), ("svc-b", "Payment", 0.9), ("svc-b", "Order", 0.2)], "object_id string, domain_id string, affinity double")
    got = {(r.from_domain, r.to_domain): (round(r.weight, 2), r.edge_weight, round(r.confidence, 2)) for r in rollup.domain_to_domain(s2s, affinities).collect()}
    assert got == {("Order", "Payment"): (1.44, 1, 0.85), ("Order", "Order"): (0.32, 0, 0.85), ("Payment", "Payment"): (0.54, 1, 0.85), ("Payment", "Order"): (0.12, 0, 0.85)}


def edges(spark, *rows):
    return spark.createDataFrame([("call", *r) for r in rows], EDGE)


def test_paths(spark):
    e = edges(spark, ("a", "b", 5, 0.9), ("b", "d", 5, 0.9), ("a", "c", 1, 0.6), ("c", "d", 1, 0.6))
    assert [(r.path, r.hops) for r in graph.simple_paths(e, "a", "d", 4, 1).collect()] == [("a>b>d", 2)]
    line = edges(spark, ("a", "b", 1, 1.0), ("b", "c", 1, 1.0), ("c", "d", 1, 1.0))
    assert graph.simple_paths(line, "a", "d", 2, 3).count() == 0
    assert graph.simple_paths(line, "a", "d", 3, 3).first().score == pytest.approx(math.log(2) / 1.2)
    cycle = edges(spark, ("a", "b", 1, 1.0), ("b", "a", 1, 1.0), ("b", "c", 1, 1.0))
    assert [r.path for r in graph.simple_paths(cycle, "a", "c", 6, 3).collect()] == ["a>b>c"]


def test_impact(spark):
    e = edges(spark, ("a", "b", 1, 1.0), ("b", "c", 1, 1.0))
    assert {r.id for r in graph.reach(spark, e, "b", "BOTH", 2).collect()} == {"a", "b", "c"}
    nodes = graph.reach(spark, e, "a", "DOWNSTREAM", 1)
    assert {r.id for r in nodes.collect()} == {"a", "b"}
    assert graph.impact_edges(e, nodes, "DOWNSTREAM", 1).count() == 1
    assert {r.id for r in graph.reach(spark, e, "zz", "UPSTREAM", 3).collect()} == {"zz"}


EVENT = "event_id long, kind string, relation_type string, subject_id string, object_id string, confidence double"


def test_incremental_equals_full(spark, shop):
    objects, relations = shop
    build = lambda r: rollup.service_to_service(r, objects)
    old, new = build(relations), relations.where("id <> '2'")
    events = spark.createDataFrame([(1, "RELATION_DELETED", "call", "svc-a", "ep-b2", 0.8)], EVENT)
    subjects = rollup.services_at(rollup.affected_scope(events, new), "SERVICE_TO_SERVICE")
    assert [r.subject_id for r in subjects.collect()] == ["svc-a"]
    got = rollup.incremental(old, new, subjects, build)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build(new).collect()))
    stats = rollup.incremental_stats(rollup.graph_stats(old), old.join(subjects, "subject_id", "left_semi"), got.join(subjects, "subject_id", "left_semi"))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, rollup.graph_stats(build(new)).collect()))


def test_scope_of_each_kind(spark, shop):
    _, relations = shop
    rows = [("EXPOSE_CHANGED", "expose", "svc-b", "ep-b1"), ("OBJECT_PARENT_CHANGED", None, None, "tbl-x"), ("RELATION_CREATED", "produce", "svc-z", "topic-p")]
    scope = lambda r: {(x.level, x.service_id) for x in rollup.affected_scope(spark.createDataFrame(r, "kind string, relation_type string, subject_id string, object_id string"), relations).collect()}
    calls = {("SERVICE_TO_SERVICE", "svc-b"), ("SERVICE_TO_SERVICE", "svc-a"), ("DOMAIN_TO_DOMAIN", None)}
    assert scope(rows[:1]) == calls
    assert scope(rows[1:2]) == {("SERVICE_TO_DATABASE", "svc-a"), ("SERVICE_TO_DATABASE", "svc-b")}
    assert scope(rows[2:]) == {("SERVICE_TO_BROKER", "svc-z")}
    assert scope([("DOMAIN_AFFINITY_CHANGED", None, None, None)]) == {("DOMAIN_TO_DOMAIN", None)}
    assert scope(rows) == calls | scope(rows[1:2]) | scope(rows[2:])


def test_rollup_goes_on_after_a_restart(spark, shop, tmp_path):
    from strataweave.streaming import changes

    objects, relations = shop
    scope = lambda e, r: rollup.services_at(rollup.affected_scope(e, r), "SERVICE_TO_SERVICE")
    build = lambda r: rollup.service_to_service(r, objects)
    keeper = lambda: changes.RollupMaintainer(spark, relations, scope, build, f"file://{tmp_path}/state")
    batches = [[(1, "RELATION_DELETED", "call", "svc-a", "ep-b2", 0.8), (4, "RELATION_CREATED", "call", "svc-a", "ep-b1", 0.5)], [(3, "RELATION_DELETED", "call", "svc-a", "ep-b1", 0.0), (2, "RELATION_CREATED", "depend_on", "svc-b", "svc-a", 0.4)]]
    frames = [spark.createDataFrame(b, EVENT) for b in batches]
    want = sorted(map(tuple, build(changes.applied(relations, changes.last_events(frames[0].union(frames[1])))).collect()))
    first = keeper()
    first.apply(frames[0], 0)
    again = keeper()  # a restart: the folder is there, the last batch is played once more
    again.apply(frames[0], 0)
    again.apply(frames[1], 1)
    again.apply(frames[1], 1)
    assert sorted(map(tuple, again.edges().collect())) == want == [("call", "svc-a", "svc-b", 1, 0.5), ("depend_on", "svc-b", "svc-a", 1, 0.4)]


@pytest.mark.parametrize("call, endpoint, want", [("/orders/12", "/orders/{id}", 0.95), ("/orders/abc", "/orders/{id}", 0.75), ("/a/b", "/a/b", 1.0), ("/", "/", 1.0), ("/a/b/c", "/a/*", 0.55), ("/a", "/a/b/c/d", 0.0)])
def test_path_compatibility(spark, call, endpoint, want):
    df = spark.createDataFrame([(call, endpoint)], "c string, e string")
    assert df.select(scalars.path_compatibility(scalars.segments(F.col("c")), scalars.segments(F.col("e")))).first()[0] == pytest.approx(want)


def test_confidence_and_feedback(spark):
    df = spark.createDataFrame([(0.5, 1, 0, 0.5), (0.5, 2, 0, 0.8), (0.5, 1, 1, 0.35), (0.9, 3, 0, 0.99)], "c double, n int, k int, want double")
    for r in df.withColumn("got", confidence.adjusted(F.col("c"), F.col("n"), F.col("k"))).collect():
        assert r.got == pytest.approx(r.want)
    reviews = spark.createDataFrame([("x", "APPROVED")] * 9 + [("x", "REJECTED")] * 3 + [("y", "APPROVED")], "feedback_key string, status string")
    got = {r.feedback_key: (r.rate, r.adjustment) for r in confidence.feedback_stats(reviews).collect()}
    assert got == {"x": (0.75, 0.0375), "y": (1.0, 0.0)}


def test_cohesion_and_review(spark):
    rel = spark.createDataFrame([("1", "a", "b"), ("2", "a", "z"), ("3", "a", "a")], "id string, subject_id string, object_id string")
    members = spark.createDataFrame([("a", "D"), ("b", "D")], "object_id string, domain_id string")
    assert {(r.member, r.inner_relations, r.all_relations) for r in domain.cohesion(rel, members).collect()} == {("a", 2, 3), ("b", 1, 1)}
    relations = spark.createDataFrame([("call", "a", "b", 0.5), ("call", "a", "c", 0.7), ("call", "b", "c", 0.7)], "relation_type string, subject_id string, object_id string, confidence double")
    same = spark.createDataFrame([("b", "b"), ("c", "b")], "id string, survivor_id string")
    assert [tuple(r) for r in review.repoint(relations, same).collect()] == [("call", "a", "b", 0.7, 2)]


def test_signals_and_routes(spark):
    docs = spark.createDataFrame([(1, "@GetMapping\nx\nrequests.get()"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r.doc_id, r.line, r.kind) for r in signals.line_signals(docs, "doc_id", "text").collect()} == {(1, 1, "expose"), (1, 3, "call")}
    sql = spark.createDataFrame([(1, "WITH t AS (SELECT * FROM a) INSERT INTO b SELECT * FROM t JOIN c -- from d")], "k int, sql string")
    assert {(r.table_name, r.access) for r in signals.sql_tables(sql, "k", "sql").collect()} == {("a", "read"), ("b", "write"), ("c", "read")}
    intents = spark.createDataFrame([(1, "/public/orders/123"), (2, "/other/x")], "intent_id long, path string")
    rules = spark.createDataFrame([("r1", "prefix", "/public/**", 1), ("r2", "prefix", "/public/orders/**", 1)], "rule_id string, mode string, match_path string, priority int")
    got = proof.route_matches(intents, rules).withColumn("out", proof.transformed(F.col("path"), F.lit(1), F.lit("/internal")))
    assert [(r.intent_id, r.rule_id, r.out) for r in got.collect()] == [(1, "r2", "/internal/orders/123")]


def test_rules_for_any_path_and_ties(spark):
    intents = spark.createDataFrame([(1, "/a/b/7"), (2, "/c"), (3, "/c/d"), (4, "/x/1")], "intent_id long, path string")
    rules = spark.createDataFrame([("all", "prefix", "/**", 0), ("re", "regex", "/[0-9]$", 1), ("c1", "prefix", "/c/**", 1), ("c2", "prefix", "/c/*", 1), ("one", "exact", "/c", 2)], "rule_id string, mode string, match_path string, priority int")
    got = {r.intent_id: (r.rule_id, r.tied) for r in proof.route_matches(intents, rules).collect()}
    assert got == {1: ("re", False), 2: ("one", False), 3: ("c1", True), 4: ("re", False)}
    only = {r.intent_id: r.rule_id for r in proof.route_matches(intents, rules.where("rule_id = 'all'")).collect()}
    assert only == {k: "all" for k in (1, 2, 3, 4)}
    steps = rules.withColumn("strip", F.lit(1)).withColumn("prepend", F.lit("/end"))
    chain = {r.intent_id: (r.path, r.hops, r.status) for r in proof.route_chain(intents, steps.where("rule_id in ('c1', 'c2', 'one')")).collect()}
    assert chain == {1: ("/a/b/7", 0, ""), 2: ("/end", 1, ""), 3: ("/c/d", 0, "ROUTE_RULE_CONFLICT"), 4: ("/x/1", 0, "")}


def test_fuzzy_names_and_prefixes(spark):
    names = spark.createDataFrame([(x,) for x in ("order", "orders", "border", "odrer", "payment", "pay", "o")], "name string")
    got = {tuple(r) for r in domain.fuzzy_pairs(names, names).collect()}
    every = [r.name for r in names.collect()]
    rows = spark.createDataFrame([(a, b) for a in every for b in every], "word string, name string")
    want = {(r.word, r.name) for r in rows.where(domain.fuzzy_score(F.col("word"), F.col("name")) > 0).collect()}
    assert want <= got
    tables = spark.createDataFrame([("ORDER_item",), ("pay_log",), ("zzz",), ("_x",)], "table_name string")
    domains = spark.createDataFrame([("Order", "d1"), ("payment", "d2"), ("Orders", "d0")], "name string, domain_id string")
    assert {(r.table_name, r.domain_id) for r in domain.table_domains(tables, domains).collect()} == {("ORDER_item", "d1"), ("pay_log", "d2")}


def test_key_tiers_and_modules(spark):
    columns = spark.createDataFrame([("orders", "user_id", None, False, False), ("orders", "shop_no", None, True, True), ("users", "id", None, False, False), ("shop", "owner_id", "people", False, True), ("shop", "user_id", None, False, True)], "table_name string, column_name string, declared_ref string, is_unique boolean, in_index boolean")
    assert {tuple(r) for r in signals.key_candidates(columns).collect()} == {("orders", "user_id", "users", 0.5), ("orders", "shop_no", "shop", 0.85), ("shop", "owner_id", "people", 0.95), ("shop", "user_id", "users", 0.7)}
    files = spark.createDataFrame([("gw", "src/main/resources/application.yml", ""), ("gw", "build.gradle", "id 'org.springframework.boot'"), ("shop-common", "src/main/java/A.java", ""), ("tool", "src/main/ts/main.ts", None)], "module string, path string, text string")
    assert [(r.module, r.score, r["class"]) for r in signals.module_scores(files).collect()] == [("gw", 7, "service_candidate"), ("tool", 3, "service_candidate"), ("shop-common", -3, "library_candidate")]


def test_configuration_files(spark, tmp_path):
    from strataweave.operators import intake

    (tmp_path / "gw" / "src").mkdir(parents=True)
    (tmp_path / "gw" / "application.yml").write_text("# top\nspring:\n  application:\n    name: gateway\n  datasource:\n    url: jdbc:mysql://orders-db:3306/order_db?ssl=1\nport: '80'\n")
    (tmp_path / "gw" / "docker-compose.yml").write_text("services:\n  order-service:\n    image: shop/order\n    depends_on:\n      - payment-service\n      - db\n  db:\n    image: postgres:16\n")
    files = intake.text_files(spark, f"file://{tmp_path}", "*.yml")
    got = {(r.path.rpartition("/")[2], r.key): r.value for r in intake.flattened(files).collect()}
    assert got["application.yml", "spring.application.name"] == "gateway" and got["application.yml", "port"] == "80"
    df = spark.createDataFrame([(got["application.yml", "spring.datasource.url"],)], "u string")
    assert df.select(intake.jdbc_identity(F.col("u"))).first()[0] == "orders-db:3306/order_db"
    services = {r.service: (r.kind, r.depends_on) for r in intake.compose_services(files.where("path like '%compose%'")).collect()}
    assert services == {"order-service": ("service", ["db", "payment-service"]), "db": ("database", [])}


def test_relations_from_configuration(spark):
    from strataweave.operators import intake

    app = "spring:\n  datasource:\n    url: jdbc:postgresql://db:5432/orders?x=1\n  kafka:\n    bootstrap-servers: kafka:9092\n    consumer:\n      group-id: g\n    producer:\n      acks: all\nzuul:\n  routes:\n    pay:\n      serviceId: payment\n      path: /pay/**\n"
    k8s = "kind: Deployment\nmetadata:\n  name: gw\nspec:\n  env:\n    - name: DB_URL\n      value: jdbc:mysql://m:3306/x\n    - name: KAFKA_BROKERS\n      value: \"k:9092\"\n---\nkind: Service\nmetadata:\n  name: gw-svc\n"
    files = spark.createDataFrame([("app.yml", app), ("k.yml", k8s), ("none.yml", None)], "path string, text string")
    got = {tuple(r) for r in intake.config_candidates(intake.flattened(files.where("path <> 'k.yml'"))).collect()}
    assert got == {("app.yml", "read", "db:5432/orders", 0.9), ("app.yml", "write", "db:5432/orders", 0.9), ("app.yml", "consume", "kafka:9092", 0.85), ("app.yml", "produce", "kafka:9092", 0.85), ("app.yml", "call", "payment", 0.7)}
    rows = intake.manifests(files.where("path = 'k.yml'"))
    assert {(r.kind, r.name, r.env_name, r.env_value) for r in rows.collect()} == {("Deployment", "gw", "DB_URL", "jdbc:mysql://m:3306/x"), ("Deployment", "gw", "KAFKA_BROKERS", "k:9092"), ("Service", "gw-svc", None, None)}
    assert {(r.relation_type, r.target) for r in intake.manifest_candidates(rows).collect()} == {("read", "m:3306/x"), ("write", "m:3306/x"), ("produce", "k:9092"), ("consume", "k:9092")}


def test_scopes_and_placeholders(spark):
    from strataweave.operators import intake

    files = spark.createDataFrame([("r/a/b/x.java",), ("r/c/y.java",)], "path string")
    entries = spark.createDataFrame([("r/app.yml", "k", "top"), ("r/a/app.yml", "k", "mid"), ("r/a/app-dev.yml", "k", "dev")], "path string, key string, value string")
    assert {(r.path, r.value) for r in intake.scoped(files, entries).collect()} == {("r/a/b/x.java", "dev"), ("r/c/y.java", "top")}
    df = spark.createDataFrame([("${a:1}", "9"), ("${b:1}", "1"), ("plain", "plain"), ("${c}", "")], "v string, want string").withColumn("m", F.create_map(F.lit("a"), F.lit("9"), F.lit("b"), F.lit("")))
    assert all(r.got == r.want for r in df.withColumn("got", intake.resolved_value(F.col("v"), F.col("m"))).collect())
