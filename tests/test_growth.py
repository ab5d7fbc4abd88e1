"""Steps whose work must grow with their input, not with its square; rows are counted in the plans that ran."""

import glob
import os

from pyspark.sql import functions as F

from strataweave.operators import confidence, drilldown, graph, patches, proof, providers, resources, rollup, symbols
from strataweave.plans import decisions, graphs, proofs, reports, resolution
from strataweave.sources import scratch
from strataweave.sources.graph_tables import GraphTables


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def most_rows(df):
    """The most rows that any step of the plan put out, once df was collected."""

    def walk(node):
        kind, found = node.getClass().getSimpleName(), []
        if node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            found += walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            found += walk(node.plan())
        for i in range(node.children().length()):
            found += walk(node.children().apply(i))
        return found

    df.collect()
    return max(walk(df._jdf.queryExecution().executedPlan()), default=0)


def test_name_choice_keeps_a_row_an_intent(spark):
    intents = spark.range(400).select(F.col("id").alias("intent_id"), F.lit("twin").alias("hint")).union(spark.createDataFrame([(-1, "one"), (-2, "gone"), (-3, None)], "intent_id long, hint string"))
    targets = spark.range(400).select(F.lit("twin").alias("name"), F.col("id").cast("string").alias("id")).union(spark.createDataFrame([("one", "x"), ("one", "x"), (None, "y")], "name string, id string"))
    got = proof.name_choice(intents, targets, "hint", "OPEN", "MANY")
    assert rows(got.where("intent_id <= 0"), "intent_id", "status", "target_id") == [(-1, "CLOSED_ATOMIC", "x"), (-2, "OPEN", None), (-3, "OPEN", None), (0, "MANY", None)]
    assert most_rows(got) <= 403


def test_search_by_parts_of_names(spark):
    objects = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("object_type"), F.concat(F.lit("Name "), F.col("id") % 5).alias("name"), F.lit(None).cast("string").alias("display_name"))
    asked = spark.range(2000).select(F.col("id").alias("request_id"), F.when(F.col("id") < 5, F.concat(F.lit("name "), "id")).when(F.col("id") == 5, "ME").otherwise(F.concat(F.lit("NO_"), "id")).alias("text"), F.lit(None).cast("string").alias("object_type"))
    got = drilldown.find_objects(objects, asked)
    assert rows(got.where("request_id < 7"), "request_id", "object_id", "match", "n") == [(k, least, "exact", 100) for k, least in enumerate(("0", "1", "102", "103", "104"))] + [(5, "0", "part", 500), (6, "0", "first", 0)]


def test_search_has_no_join_a_block_of_texts(spark):
    objects = spark.createDataFrame([("1", "a", "x", None)], "id string, object_type string, name string, display_name string")
    asked = spark.range(3000).select(F.col("id").alias("request_id"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("object_type"))
    assert str(drilldown.find_objects(objects, asked)._jdf.queryExecution().optimizedPlan()).count("Join") <= 4


def test_requests_for_one_domain_share_what_it_holds(spark, monkeypatch):
    services = spark.range(150).select(F.concat(F.lit("S"), "id").alias("id"), F.lit("service").alias("object_type"), F.concat(F.lit("/S"), "id").alias("path"))
    objects = services.union(spark.createDataFrame([("D", "domain", "/D")], "id string, object_type string, path string")).withColumn("name", F.col("id")).withColumn("display_name", F.lit(None).cast("string"))
    relations = spark.range(150).select(F.col("id").cast("string").alias("id"), F.lit("call").alias("relation_type"), F.lit("S0").alias("subject_id"), F.concat(F.lit("S"), "id").alias("object_id"), F.lit("APPROVED").alias("status"))
    affinities = services.select(F.col("id").alias("object_id"), F.lit("D").alias("domain_id"), F.lit(0.9).alias("affinity"))
    requests = spark.range(150).select(
        F.col("id").alias("request_id"), F.lit("S0").alias("source_id"), F.lit("D").alias("target_id"), F.lit("sourceAtomic").alias("group_by"), F.when(F.col("id") % 2 == 0, "GLOBAL").alias("scope_mode"), F.lit(None).cast("array<string>").alias("relation_types"),
        F.lit(None).cast("array<string>").alias("excluded_types"), F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("int").alias("page_size"), F.lit(None).cast("string").alias("cursor"))
    real, steps = drilldown.stored, []
    monkeypatch.setattr(drilldown, "stored", lambda df, name: (steps.append(most_rows(df)), real(df, name))[1])
    got = drilldown.contributors(requests, relations, objects, affinities, spark.createDataFrame([], "id string, relation_id string"))
    assert rows(got.select("group_key", "weight", "evidence_count", "total").distinct(), "group_key", "weight", "evidence_count", "total") == [("S0", 150, 0, 150)]
    assert got.count() == 150 and max(steps + [most_rows(got)]) <= 1000


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_evidence_is_counted_where_it_met_its_relation(spark, monkeypatch):
    monkeypatch.setattr(scratch, "PART_ROWS", 10)
    evidences = spark.createDataFrame([("a", "FILE"), ("a", "FILE"), ("a", "SCHEMA"), ("b", "FILE"), ("x", "FILE")], "relation_id string, evidence_type string")
    relations = spark.createDataFrame([("a", "APPROVED"), ("b", "APPROVED"), ("b", "REJECTED")], "relation_id string, status string")
    got = confidence.by_source(scratch.spread(evidences, 80, "relation_id"), scratch.spread(relations, 80, "relation_id").hint("merge"))
    assert exchanges(got) == 3  # each side once, and the sums
    assert rows(got, "status", "evidence_type", "source", "n", "relations") == [("APPROVED", "FILE", "code", 3, 2), ("APPROVED", "SCHEMA", "db", 1, 1), ("REJECTED", "FILE", "code", 1, 1)]
    # more rows make more partitions, not larger ones
    assert scratch.spread(evidences, 80, "relation_id").rdd.getNumPartitions() == 8 and scratch.spread(evidences, 800, "relation_id").rdd.getNumPartitions() == 80


def test_lines_meet_the_ranges_of_their_chunk(spark, monkeypatch):
    ranges = [(f"f{i % 3}", f"{i:03}", i * 37 % 400, i * 37 % 400 + i * i % 211 - 1) for i in range(300)] + [(None, "x", 0, 400)]
    places = [(f"f{k % 4}", k // 4) for k in range(2000)] + [("f0", None), (None, 5), ("f1", -3)]
    inside = lambda f, n: [(-a, b, i) for g, i, a, b in ranges if f is not None and n is not None and g == f and a <= n <= b]
    want = sorted(((f, n, min(inside(f, n))[2] if inside(f, n) else None) for f, n in places), key=repr)
    lines, functions = spark.createDataFrame(places, "file string, line long"), spark.createDataFrame(ranges, "file string, function_id string, line_start long, line_end long")
    got = symbols.owners(lines, functions)
    assert rows(got, "file", "line", "function_id") == want and most_rows(got) <= len(places) + 2 * len(ranges)
    monkeypatch.setattr(symbols, "CHUNK", 3)  # most ranges hold whole chunks
    assert rows(symbols.owners(lines, functions), "file", "line", "function_id") == want


def test_scope_reads_relations_only_if_events_name_objects(spark):
    events = spark.createDataFrame([("RELATION_CREATED", "call", "S1", "E1"), ("DOMAIN_AFFINITY_CHANGED", "call", "S2", "E1")], "kind string, relation_type string, subject_id string, object_id string")
    unread = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("id"), F.lit("call").alias("relation_type"), F.lit("S1").alias("subject_id"), F.raise_error(F.lit("read")).cast("string").alias("object_id"), F.lit("APPROVED").alias("status"))
    assert rows(rollup.affected_scope(events, unread), "level", "service_id") == [("DOMAIN_TO_DOMAIN", None), ("SERVICE_TO_SERVICE", "S1")]


def test_domain_profile_derives_dependencies_once(spark):
    plan = decisions.domain_profile(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_calls_of_an_interface_meet_before_they_fan_out(spark, monkeypatch):
    classes = spark.range(120).select(F.concat(F.when(F.col("id") < 60, "A").otherwise("B"), "id").alias("class"), F.when(F.col("id") < 60, "I").otherwise("J").alias("interface"))
    faces, starts = spark.createDataFrame([("I",), ("J",)], "type string"), spark.createDataFrame([("s", "I", "m")], "start string, type string, method string")
    nested = classes.where("interface = 'I'").select(F.col("class").alias("type"), F.lit("m").alias("method"), F.lit("J").alias("to_type"), F.lit("m").alias("to_method"))
    direct = classes.where("interface = 'J'").select(F.col("class").alias("type"), F.lit("m").alias("method"), F.concat(F.lit("t"), "class").alias("target"))
    real, steps = symbols.stored, []
    monkeypatch.setattr(symbols, "stored", lambda df, name: (steps.append(most_rows(df)), real(df, name))[1])
    got = symbols.resolve_calls(starts, classes, faces, nested, direct, 3)
    assert rows(got, "target", "depth", "impl", "ambiguous", "penalty") == sorted((f"tB{k}", 2, f"B{k}", True, 0.2) for k in range(60, 120))
    assert max(steps + [most_rows(got)]) <= 250  # 60 states fan out to 60 classes, not 60 each


def test_intents_that_ask_the_same_are_answered_as_one(spark, monkeypatch):
    intents = spark.range(400).select(F.col("id").alias("intent_id"), F.lit("read").alias("action"), F.lit("S.T").alias("resource"), F.lit(None).cast("string").alias("schema"), F.when(F.col("id") % 2 == 0, F.array(F.lit("ds"))).alias("hints"))
    tables = spark.range(9).select(F.concat(F.lit("t"), "id").alias("id"), F.lit("t").alias("name"), F.when(F.col("id") == 3, "s").when(F.col("id") == 8, "S").otherwise("x").alias("schema"), F.array(F.concat(F.lit("b"), "id")).alias("tokens"))
    bindings = spark.range(8).select(F.lit("ds").alias("alias_key"), F.lit(None).cast("string").alias("alias_value"), F.concat(F.lit("b"), "id").alias("service_id"), F.lit(None).cast("string").alias("host"))
    real, steps = resources.stored, []
    monkeypatch.setattr(resources, "stored", lambda df, name: (steps.append(most_rows(df)), real(df, name))[1])
    got = resources.resolve_tables(intents, tables, bindings)
    assert rows(got.where("intent_id < 2"), "intent_id", "status", "target_id", "narrowed") == [(0, "CLOSED_ATOMIC", "t3", True), (1, "TABLE_MATCH_AMBIGUOUS", None, False)]
    assert got.count() == 400 and max(steps + [most_rows(got)]) <= 400  # not a row an intent and token


def test_patches_arrive_in_as_many_files_as_they_make(spark, monkeypatch, tmp_path):
    schema = "intent_id long, seq long, patch_type string, method string, path string, endpoint_id string, service_id string, host string, alias_key string, alias_value string, action string, reasons array<string>"
    todo = spark.createDataFrame([(i, 10 * k + i, "method_path_hint", "GET" if k else None, "/x", *[None] * 7) for k in range(9) for i in range(10)], schema).repartition(16)
    states = spark.range(9).select(F.col("id").alias("intent_id"), F.lit("a").alias("provider_id"), F.lit(None).cast("string").alias("method"), F.lit(0.5).alias("confidence"), F.lit("X").alias("open_reason"), F.array().cast("array<string>").alias("hints"), F.array(F.lit("a")).alias("candidates"), F.expr("array(named_struct('endpoint_id', 'e', 'provider_id', 'a', 'method', 'GET'))").alias("options"))
    monkeypatch.setattr(resolution, "GraphTables", lambda *a: None)
    monkeypatch.setattr(resolution, "patch_tables", lambda g: (states, todo))
    monkeypatch.setattr(resolution, "fresh_path", lambda spark, name: f"{tmp_path}/s")
    got = rows(resolution.patch_stream(spark, ""), "intent_id", "seq", "verdict", "status", "target_id")
    assert got == sorted([(i, 10 * k + i, "ACCEPTED" if k == 1 else "REJECTED", "CLOSED_ATOMIC" if k else "FRONTIER", "e" if k else None) for k in range(9) for i in range(9)], key=repr)
    assert len(glob.glob(f"{tmp_path}/s/in/part-*")) > 6  # not one file an arrival


def test_impact_makes_pairs_alone(spark, monkeypatch):
    real, plans = graph.stored, []
    monkeypatch.setattr(graph, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, name))[1])
    graphs.ENTRIES["impact_both"][0](spark, "/root/testdata/sf0.001")
    assert plans[0].count("Window [") == 1 and "sum(" not in plans[0]  # lines once, no means
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("d", "d")], "subject_id string, object_id string")
    assert rows(graph.neighbours(e, "BOTH").distinct(), "src", "dst") == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("d", "d")]
    assert rows(graph.neighbours(e, "UPSTREAM"), "src", "dst") == [("a", "b"), ("b", "a"), ("c", "b"), ("d", "d")]


def shuffled(df):
    """The rows that the plan's exchanges wrote, once df was collected."""

    def walk(node):
        kind, n = node.getClass().getSimpleName(), 0
        if node.metrics().contains("shuffleRecordsWritten"):
            n += node.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            n += walk(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            n += walk(node.plan())
        return n + sum(walk(node.children().apply(i)) for i in range(node.children().length()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_statuses_are_counted_by_what_intents_ask_for(spark, tmp_path, monkeypatch):
    for name in ("part", "lineitem", "events", "region", "supplier"):
        os.symlink(f"/root/testdata/sf0.01/{name}.parquet", tmp_path / f"{name}.parquet")
    monkeypatch.setattr(reports, "proof_http", lambda spark, sf_dir: spark.createDataFrame([(1, "CLOSED_ATOMIC")], "intent_id long, status string"))
    got = reports.proof_run_summary(spark, str(tmp_path))
    counts = {(r.kind, r.status): r.n for r in got.collect()}
    for kind, query in (("db", proofs.proof_db), ("message", proofs.proof_message)):
        for r in query(spark, str(tmp_path)).groupBy("status").count().collect():
            assert counts.pop((kind, r.status)) == r["count"]
    assert counts == {("http", "CLOSED_ATOMIC"): 1}
    assert shuffled(got) < 6000  # 10,000 events and 2,000 parts ask for some two hundred names; the lines' 2,000 part keys are the most that moves


def test_endpoints_meet_intents_once(spark):
    intents = spark.createDataFrame([(1, "h", "/a/1", "GET"), (2, "h", "/a/1", "POST"), (3, "h", "/z/z/z", "GET"), (4, None, "/a/1", "GET"), (5, "k", "/a/1", "POST")], "intent_id long, provider_id string, path string, method string")
    endpoints = spark.createDataFrame([("h", "/a/{id}", "GET", "g"), ("h", "/a/{id}", "ANY", "x"), ("h", "/a/1", "POST", "p"), ("k", "/a/{id}", "GET", "g")], "provider_id string, endpoint_path string, endpoint_method string, endpoint_id string")
    got = proof.endpoint_choice(intents, endpoints)
    assert rows(got, "intent_id", "status", "endpoint_id") == [(1, "ENDPOINT_MATCH_AMBIGUOUS", None), (2, "CLOSED_ATOMIC", "p"), (3, "PROVIDER_ENDPOINT_NOT_FOUND", None), (4, "PROVIDER_ENDPOINT_NOT_FOUND", None), (5, "PROVIDER_ENDPOINT_NOT_FOUND", None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3


def test_weights_are_made_of_what_a_path_can_take(spark, monkeypatch):
    pairs = [("S0", "S1", 0.9), ("S1", "S3", 0.8), ("S0", "S2", 0.7), ("S2", "S4", 0.6), ("S8", "S9", 0.5), ("S3", "S5", 0.5), ("S5", "S0", 0.5)]
    calls = spark.createDataFrame([("x", "call", *pair) for pair in pairs], "id string, relation_type string, subject_id string, object_id string, confidence double")
    real, met = rollup.edges, []
    monkeypatch.setattr(rollup, "service_calls", lambda relations, objects: calls)
    monkeypatch.setattr(rollup, "edges", lambda lifted: (met.append(rows(lifted, "subject_id", "object_id")), real(lifted))[1])
    assert [r.path for r in graphs.path_discovery(spark, "/root/testdata/sf0.001").collect()] == ["S0>S1>S3"]
    assert met == [[("S0", "S1"), ("S0", "S2"), ("S1", "S3"), ("S2", "S4")]]


def test_what_no_path_can_take_loses_no_path(spark):
    calls = spark.range(45).select(F.lit("call").alias("relation_type"), (F.col("id") * 7 % 11).cast("string").alias("subject_id"), (F.col("id") * F.col("id") * 3 % 13).cast("string").alias("object_id"), (F.col("id") % 9 / 10).alias("confidence"))
    calls = calls.where("subject_id <> object_id").localCheckpoint()
    for hops in (1, 2, 4):
        every, some = (rows(graph.simple_paths(rollup.edges(c), "7", "10", hops, 5), "path", "score") for c in (calls, graph.ahead(calls, "7", "10", hops)))
        assert some == every and (hops < 4 or every)


def test_columns_of_relations_that_nobody_asks_for_are_not_made(spark):
    plan = GraphTables(spark, "/root/testdata/sf0.001").relations("call", "read").select("subject_id", "object_id")._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_discount" in plan  # the discount orders the lines


def test_states_of_patches_go_through_no_driver(spark, monkeypatch, tmp_path, capsys):
    real, plans = scratch.stored, []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (providers, resolution):
        monkeypatch.setattr(module, "stored", lambda df, name: (plans.append(plan(df)), real(df, name))[1])
    g = GraphTables(spark, "/root/testdata/sf0.01")
    states, todo = resolution.patch_tables(g)
    plans += [plan(todo), plan(providers.resolve_http(*resolution.http_tables(g)))]
    todo.limit(50).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(todo.schema).parquet(f"{tmp_path}/in")
    query = patches.fold_stream(states, source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    capsys.readouterr()
    query.explain()
    plans.append(capsys.readouterr().out)
    sent = [line.strip() for p in plans for line in p.splitlines() if "Broadcast" in line and "Join" in line]
    # The next page's host is sized by the pages' own files and served hosts by what was shuffled, both right; all else would be sized by small files of texts that repeat.
    assert "SortMergeJoin" in plans[-1] and [x for x in sent if "Inner" in x or "page_id" not in x and "[provider_id#" not in x] == []
