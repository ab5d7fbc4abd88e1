"""Queries on the resolution of HTTP intents: providers, endpoints, patches, route families, alias scores, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions.scalars import url_host, url_path
from strataweave.operators import families, patches, providers
from strataweave.plans.proofs import ENDPOINTS, SCORE, URLS
from strataweave.sources.graph_tables import GraphTables
from strataweave.sources.scratch import fresh_path, stored


def pages(g: GraphTables):
    """page_id, url, html, host, path, name (of the host), language and number of the path; hosts below a name serve their paths behind their own labels."""
    p = g.source("pages").select("page_id", "url", "html", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    p = p.withColumn("name", F.regexp_extract("host", r"([a-z0-9-]+)\.example\.", 1)).withColumn("lang", part("^/([a-z]+)/")).withColumn("number", part("^/[a-z]+/([0-9]+)"))
    return p.withColumn("path", F.concat(F.when(F.col("host").rlike(r"^[a-z]+\.[a-z0-9-]+\.example\."), F.concat(F.lit("/"), F.regexp_extract("host", "^([a-z]+)", 1), F.lit("/"), "name")).otherwise(""), "path"))


def endpoints(p):
    """Endpoints of each host: the paths of its longer pages, with numbers as placeholders."""
    e = p.where("length(html) >= 1500").select(F.col("host").alias("provider_id"), F.regexp_replace("path", "/[0-9]+", "/{id}").alias("endpoint_path"), F.when(F.col("page_id") % 2 == 0, "ANY").otherwise("GET").alias("endpoint_method")).distinct()
    return e.withColumn("endpoint_id", F.concat_ws(" ", "endpoint_method", F.concat("provider_id", "endpoint_path")))


def http_tables(g: GraphTables):
    """Hosts are services. A page is an intent of the host of the next page; its address tells what is known of the target: the host, its name, a configuration key or the path alone.
    Addresses with a source mark are bindings of such keys: to a service (.com) or to a host."""
    p = pages(g)
    services = p.select(F.col("host").alias("service_id"), F.array_distinct(F.array(providers.service_token(F.col("host")), providers.service_token(F.col("name")))).alias("tokens")).distinct()
    source = p.select((F.col("page_id") - 1).alias("page_id"), F.col("host").alias("source_id"))
    key = F.concat(F.lit("keylang"), F.substring("number", 1, 2))
    keyed, marked = F.col("url").endswith("#top"), F.col("url").contains("utm_source")
    mine = p.join(source, "page_id", "left")
    none = F.array().cast("array<string>")
    intents = mine.select(
        F.col("page_id").alias("intent_id"), "source_id", "path", F.when(F.col("page_id") % 11 == 0, None).when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.when(keyed | marked, none).otherwise(F.array(F.when(F.col("url").contains("ref="), F.col("name")).otherwise(F.col("host")))).alias("hosts"),
        F.when(keyed, F.array(key)).otherwise(none).alias("config_keys"), F.col("url").endswith("/").alias("dynamic"),
        F.when(F.col("page_id") % 4 == 0, F.col("host")).alias("provider_override"), F.lit(None).cast("string").alias("hint_id"),
    )
    com = F.col("host").endswith(".com")
    bindings = mine.where(marked).select(
        key.alias("alias_key"), F.concat(F.lit("value"), "number").alias("alias_value"), F.when(F.col("page_id") % 2 == 1, F.col("source_id")).alias("owner_id"),
        F.when(com, F.col("host")).alias("service_id"), F.when(~com, F.col("host")).alias("host"),
    )
    return intents, services, bindings, endpoints(p)


def http_resolution(spark, sf_dir):
    """Every page as an intent, closed at one of three stages or open with its reason."""
    return providers.resolve_http(*http_tables(GraphTables(spark, sf_dir)))


def patch_tables(g: GraphTables):
    """Proof states of the intents of http_tables, and patches from the events of the user with the intent's number: the event's type is the patch's, its number tells what the patch says."""
    intents, services, bindings, ends = http_tables(g)
    staged = providers.staged_providers(intents, services, bindings, ends)
    offered = staged.select("intent_id", "path", F.explode(F.array("low", "high", "source_id")).alias("provider_id")).where("provider_id is not null").distinct()
    fits = offered.join(providers.fitting_paths(offered, ends, "provider_id").hint("merge"), ["provider_id", "path"]).join(ends.hint("shuffle_hash"), ["provider_id", "endpoint_path"])
    # Endpoints of at most three providers that fit one path.
    options = fits.groupBy("intent_id").agg(F.array_sort(F.collect_list(F.struct("endpoint_id", "provider_id", F.col("endpoint_method").alias("method")))).alias("options"))
    states = stored(staged.join(options.hint("merge"), "intent_id", "left").select(
        "intent_id", "provider_id", "method", (F.col("intent_id") % 10 / 10).alias("confidence"), providers.open_reason().alias("open_reason"), "hints",
        F.array_distinct(F.array_compact(F.array("low", "high"))).alias("candidates"), "options", "source_id", "path",
    ), "proof-states")
    e = g.source("events").select("event_id", "event_type", (F.col("user_id") % 200).alias("intent_id")).join(states.select("intent_id", "options", "candidates", "hints", "path", "source_id").hint("merge"), "intent_id")
    pick = lambda c: F.when(F.size(c) > 0, F.get(c, (F.col("event_id") % F.size(c)).cast("int")))
    k = F.col("event_id") % 7
    kind = F.when(F.col("event_type") == "click", "method_path_hint").when(F.col("event_type") == "view", "endpoint_disambiguation").when(F.col("event_type") == "error", "contradiction_challenge").when(F.col("event_type") == "signup", "provider_service_selection").otherwise("alias_binding")
    patches = e.select(
        "intent_id", F.col("event_id").alias("seq"), kind.alias("patch_type"), F.when(k < 3, "GET").when(k < 5, "POST").alias("method"), F.when(k != 2, F.col("path")).alias("path"),
        F.when(k != 1, pick("options")["endpoint_id"]).alias("endpoint_id"), F.coalesce(pick("candidates"), "source_id").alias("service_id"), F.lit(None).cast("string").alias("host"),
        F.coalesce(pick("hints"), F.lit("none")).alias("alias_key"), F.lit("value").alias("alias_value"), F.when(k != 3, "reopen_frontier").alias("action"), F.array(F.lit("low")).alias("reasons"),
    )
    return states.drop("source_id", "path"), patches


def patch_fold(spark, sf_dir):
    """Every patch with its verdict and the state after it."""
    return patches.fold(*patch_tables(GraphTables(spark, sf_dir)))


def patch_stream(spark, sf_dir):
    """The same patches as a stream of files, in order of their numbers."""
    states, todo = patch_tables(GraphTables(spark, sf_dir))
    base = fresh_path(spark, "patches")
    todo = stored(todo, "patches")
    ends = todo.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    step = ((ends["high"] or 0) - (ends["low"] or 0)) // 3 + 1
    for k in range(3):  # as they would arrive: a batch each, of as many files as they make, and the stream goes on where it stood
        todo.where(F.floor((F.col("seq") - (ends["low"] or 0)) / step) == k).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(todo.schema).parquet(f"{base}/in")
        query = patches.fold_stream(states, source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(patches.RESULT).parquet(f"{base}/out")


def route_families(spark, sf_dir):
    """Each page's address as a gateway route to its host: exact, or for all below the last slash; children, or why there are none."""
    p = pages(GraphTables(spark, sf_dir))
    inner = F.regexp_replace("path", "/[0-9]+", "/{id}")
    exact = F.col("page_id") % 3 == 0
    external = F.concat(F.lit("/gw"), inner)
    match = F.when(exact, external).otherwise(F.concat(F.regexp_replace(external, "/[^/]*/?$", ""), F.lit("/**")))
    routes = p.select(F.col("page_id").alias("route_id"), F.col("host").alias("provider_id"), F.when(exact, "exact").otherwise("prefix").alias("mode"), F.when(exact, external).otherwise(F.regexp_replace(match, "/[*]+$", "")).alias("external"), match.alias("match_path"))
    routes = routes.select("route_id", "provider_id", "mode", families.composed_paths(F.col("external"), F.col("match_path"), F.lit(1), F.lit("")).alias("paths"))
    return families.route_families(routes, endpoints(p))


def _alias(g: GraphTables):
    """Pages without a long text are open on their host's name, its labels and the start of the name; hosts are services."""
    p = pages(g)
    hint = lambda h, named=False: F.struct(h.alias("hint"), F.lit(named).alias("name_hint"))
    said = F.array(hint(F.when(F.col("page_id") % 3 == 0, F.col("name")).otherwise(""), True), hint(F.regexp_extract("host", "^([a-z]+)", 1)), hint(F.substring("name", 1, 5)), hint(F.when(F.col("page_id") % 2 == 0, F.col("host")).otherwise("")))
    hints = p.where("length(html) < 3000").select(F.col("page_id").alias("frontier_id"), F.explode(said).alias("h")).select("frontier_id", "h.*")
    services = p.select(F.col("host").alias("service_id"), "name", F.array(F.col("host"), F.regexp_extract("host", "^([a-z]+[.][a-z-]+)", 1)).alias("hosts")).distinct()
    return hints, services


def alias_scores(spark, sf_dir):
    """The seven keys of every service that a frontier's hints touch."""
    return families.alias_scores(*_alias(GraphTables(spark, sf_dir)))


def alias_best(spark, sf_dir):
    """The best service of each frontier; none where two tie on all seven keys."""
    return families.best_alias(families.alias_scores(*_alias(GraphTables(spark, sf_dir))))


def proof_projection(spark, sf_dir):
    """Candidates after the intents of http_resolution were closed or reopened: earlier ones were made for all long pages, decided by their number."""
    g = GraphTables(spark, sf_dir)
    intents, services, bindings, ends = http_tables(g)
    done = providers.resolve_http(intents, services, bindings, ends).join(intents.select("intent_id", "source_id").hint("merge"), "intent_id")
    k = F.col("intent_id")
    proofs = stored(done.select(F.concat(F.lit("P"), k.cast("string")).alias("proof_id"), "status", F.lit("call").alias("relation_type"), F.coalesce("source_id", F.lit("edge")).alias("subject_id"), F.col("target_id").alias("object_id"), (k % 10 / 10).alias("confidence"), k.alias("k")), "proofs")
    before = proofs.where("k % 2 = 0").withColumn("object_id", F.coalesce("object_id", F.lit("gone"))).withColumn("status", F.when(F.col("k") % 6 == 0, "PENDING").when(F.col("k") % 6 == 2, "REJECTED").otherwise("APPROVED"))
    before = before.withColumn("proof_id", F.when(F.col("k") % 4 == 0, F.col("proof_id"))).drop("k")
    manual = proofs.where("k % 15 = 1 and object_id is not null")
    return families.projected(proofs.drop("k"), before, manual)


def _tokens(v: str) -> str:
    kebab = f"lower(regexp_replace(regexp_replace(regexp_replace(trim({v}), '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '[_\\s]+', '-', 'g'), '-+', '-', 'g'))"
    stem = f"regexp_replace({kebab}, '{providers.ENDINGS}', '')"
    return f"list_filter(list_concat([{kebab}, regexp_replace({kebab}, '[-_.]', '', 'g'), {stem}, regexp_replace({stem}, '[-_.]', '', 'g')], regexp_split_to_array({kebab}, '[./-]+')), lambda t: t <> '')"


def _service(v: str) -> str:
    return f"regexp_replace(regexp_extract(regexp_replace(lower(trim({v})), '^https?://', ''), '^([^/:]*)', 1), '[^a-z0-9]+', '', 'g')"


FITS = SCORE.replace("sc AS (SELECT host, path", "fits AS (SELECT path").replace("SELECT DISTINCT u.host, u.path", "SELECT DISTINCT u.path").replace("FROM u JOIN ep ON u.host = ep.host", "FROM u, ep")
MOUNTED = URLS.replace("u AS (", "u0 AS (") + """,
u AS (SELECT page_id, host, CASE WHEN regexp_matches(host, '^[a-z]+\\.[a-z0-9-]+\\.example\\.') THEN '/' || regexp_extract(host, '^([a-z]+)', 1) || '/' || regexp_extract(host, '([a-z0-9-]+)\\.example\\.', 1) ELSE '' END || path AS path, path AS plain FROM u0)"""
HTTP = f"""{MOUNTED}, {ENDPOINTS}, {FITS},
p AS (SELECT page_id, url, host, path, regexp_extract(host, '([a-z0-9-]+)\\.example\\.', 1) AS name, 'keylang' || regexp_extract(plain, '^/[a-z]+/([0-9]+)', 1)[1:2] AS key,
  regexp_extract(plain, '^/[a-z]+/([0-9]+)', 1) AS number, lead(host) OVER (ORDER BY page_id) AS next_host, lead(page_id) OVER (ORDER BY page_id) AS next_id FROM u JOIN pages USING (page_id)),
q AS (SELECT *, CASE WHEN next_id = page_id + 1 THEN next_host END AS source_id FROM p),
svc AS (SELECT DISTINCT host AS service_id, unnest([{_service('host')}, {_service('name')}]) AS token FROM p),
i AS (SELECT page_id AS intent_id, source_id, path, host, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, suffix(url, '#top') AS keyed, suffix(url, '/') AS dynamic,
  CASE WHEN suffix(url, '#top') THEN key WHEN contains(url, 'utm_source') THEN NULL WHEN contains(url, 'ref=') THEN name ELSE host END AS hint FROM q),
b AS (SELECT key AS alias_key, 'value' || number AS alias_value, CASE WHEN page_id % 2 = 1 THEN source_id END AS owner_id, CASE WHEN suffix(host, '.com') THEN host END AS service_id, CASE WHEN NOT suffix(host, '.com') THEN host END AS bound FROM q WHERE contains(url, 'utm_source')),
bt AS (SELECT DISTINCT owner_id, service_id, bound, unnest(list_concat(list_concat({_tokens('alias_key')}, {_tokens('alias_value')}), coalesce({_tokens('bound')}, []))) AS token FROM b),
it AS (SELECT DISTINCT intent_id, source_id, unnest({_tokens('hint')}) AS token FROM i WHERE hint IS NOT NULL),
dt AS (SELECT DISTINCT intent_id, {_service('x')} AS token FROM (SELECT intent_id, unnest({_tokens('token')}) AS x FROM it)),
bm AS (SELECT intent_id, bt.service_id, bt.bound FROM it JOIN bt ON it.token = bt.token AND (bt.owner_id IS NULL OR bt.owner_id = it.source_id)),
c1 AS (SELECT intent_id, service_id FROM bm WHERE service_id IS NOT NULL UNION SELECT intent_id, service_id FROM dt JOIN svc USING (token)),
c2 AS (SELECT DISTINCT intent_id, svc.service_id FROM bm JOIN svc ON svc.token = {_service('bm.bound')} WHERE intent_id NOT IN (SELECT intent_id FROM c1)),
sc3 AS (SELECT intent_id, ep.host AS service_id, max(score + CASE WHEN m = 'ANY' OR m = method THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM i JOIN fits ON fits.path = i.path AND fits.score >= 0.75 JOIN ep ON ep.endpoint_path = fits.endpoint_path
  WHERE ep.host IS DISTINCT FROM source_id AND intent_id NOT IN (SELECT intent_id FROM c1) AND intent_id NOT IN (SELECT intent_id FROM c2) GROUP BY 1, 2),
c3 AS (SELECT intent_id, service_id FROM (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM sc3 WINDOW w AS (PARTITION BY intent_id ORDER BY score DESC, service_id)) WHERE k = 1 AND round(score, 6) >= 0.9 AND (second IS NULL OR round(score - second, 6) >= 0.2)),
st AS (SELECT intent_id, stage, count(*) AS n, min(service_id) AS low, max(service_id) AS high FROM (SELECT *, 'alias' AS stage FROM c1 UNION ALL SELECT *, 'host' FROM c2 UNION ALL SELECT *, 'path' FROM c3) GROUP BY 1, 2),
pv AS (SELECT i.*, stage, low, high, coalesce(n, 0) AS n, CASE WHEN intent_id % 4 = 0 AND i.host IN (low, high) THEN i.host WHEN n = 1 THEN low END AS provider_id FROM i LEFT JOIN st USING (intent_id)),
em AS (SELECT intent_id, m || ' ' || ep.host || ep.endpoint_path AS e, pv.path = ep.endpoint_path AS same FROM pv JOIN ep ON ep.host = provider_id AND method IS NOT NULL AND (m = 'ANY' OR m = method) JOIN fits ON fits.path = pv.path AND fits.endpoint_path = ep.endpoint_path AND fits.score >= 0.75),
en AS (SELECT intent_id, count(*) AS k, min(e) AS e FROM em WHERE same OR intent_id NOT IN (SELECT intent_id FROM em WHERE same) GROUP BY 1)
"""

FOLD_SQL = f"""WITH RECURSIVE {HTTP},
ps AS (SELECT intent_id, path, source_id, provider_id, method, intent_id % 10 / 10 AS confidence, CASE WHEN dynamic THEN 'DYNAMIC_URI_UNRESOLVED' WHEN hint IS NULL THEN 'PATH_ONLY_TARGET_UNRESOLVED' WHEN keyed THEN 'CONFIG_BINDING_MISSING' ELSE 'HOST_ALIAS_UNRESOLVED' END AS open_reason,
  hint AS key, CASE WHEN low IS NULL THEN [] WHEN low = high THEN [low] ELSE [low, high] END AS cand, low, high FROM pv),
op AS (SELECT intent_id, provider, m || ' ' || ep.host || ep.endpoint_path AS e, m FROM (SELECT DISTINCT intent_id, path, unnest([low, high, source_id]) AS provider FROM ps) o JOIN ep ON ep.host = provider JOIN fits ON fits.path = o.path AND fits.endpoint_path = ep.endpoint_path AND fits.score >= 0.75),
ol AS (SELECT intent_id, list(e ORDER BY e) AS es FROM op GROUP BY 1),
pt AS (SELECT event_id AS seq, ps.intent_id, row_number() OVER (PARTITION BY ps.intent_id ORDER BY event_id) AS r, CASE event_type WHEN 'click' THEN 'method_path_hint' WHEN 'view' THEN 'endpoint_disambiguation' WHEN 'error' THEN 'contradiction_challenge' WHEN 'signup' THEN 'provider_service_selection' ELSE 'alias_binding' END AS kind,
  CASE WHEN event_id % 7 < 3 THEN 'GET' WHEN event_id % 7 < 5 THEN 'POST' END AS p_method, event_id % 7 <> 2 AS has_path, CASE WHEN event_id % 7 <> 1 THEN es[event_id % len(es) + 1] END AS e, coalesce(CASE WHEN len(cand) > 0 THEN cand[event_id % len(cand) + 1] END, source_id) AS service, coalesce(key, 'none') AS p_key, event_id % 7 <> 3 AS acts
  FROM events JOIN ps ON user_id % 200 = ps.intent_id LEFT JOIN ol ON ol.intent_id = ps.intent_id),
mt(q) AS (VALUES ('GET'), ('POST')),
ev AS (SELECT intent_id, provider, q, count(*) AS n, min(e) AS least FROM op, mt WHERE m = q OR m = 'ANY' GROUP BY 1, 2, 3),
z0 AS (SELECT ps.*, CASE WHEN provider_id IS NULL THEN CASE WHEN len(cand) > 1 THEN 'PROVIDER_SERVICE_AMBIGUOUS' ELSE open_reason END WHEN method IS NULL THEN 'METHOD_UNKNOWN' WHEN n IS NULL THEN 'PROVIDER_ENDPOINT_NOT_FOUND' WHEN n > 1 THEN 'ENDPOINT_MATCH_AMBIGUOUS' END AS reason, CASE WHEN n = 1 THEN least END AS target
  FROM ps LEFT JOIN ev ON ev.intent_id = ps.intent_id AND ev.provider = provider_id AND ev.q = method),
rec AS (SELECT intent_id, 0::BIGINT AS r, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS errors, provider_id, method, NULL::VARCHAR AS hint, FALSE AS challenged, reason, target, confidence, open_reason, key, cand FROM z0
  UNION ALL SELECT y.intent_id, y.r, seq, kind, errors, n_provider, n_method, n_hint, n_challenged,
    CASE WHEN n_challenged THEN 'SMART_CONTRADICTION_CHALLENGED' WHEN n_provider IS NULL THEN CASE WHEN len(cand) > 1 THEN 'PROVIDER_SERVICE_AMBIGUOUS' ELSE open_reason END WHEN n_method IS NULL THEN 'METHOD_UNKNOWN' WHEN n IS NULL THEN 'PROVIDER_ENDPOINT_NOT_FOUND' WHEN n > 1 AND h.e IS NULL THEN 'ENDPOINT_MATCH_AMBIGUOUS' END,
    CASE WHEN NOT n_challenged THEN CASE WHEN h.e IS NOT NULL THEN h.e WHEN n = 1 THEN least END END, confidence, open_reason, key, cand FROM (
    SELECT x.*, CASE WHEN errors = '' AND kind IN ('alias_binding', 'provider_service_selection') THEN service ELSE provider_id END AS n_provider, CASE WHEN errors = '' AND kind = 'method_path_hint' THEN p_method ELSE method END AS n_method,
      CASE WHEN errors = '' AND kind = 'endpoint_disambiguation' THEN e ELSE hint END AS n_hint, challenged OR (errors = '' AND kind = 'contradiction_challenge') AS n_challenged FROM (
      SELECT rec.intent_id, pt.r, pt.seq, pt.kind, rec.provider_id, rec.method, rec.hint, rec.challenged, confidence, open_reason, key, cand, service, p_method, pt.e, concat_ws('; ', CASE pt.kind
        WHEN 'alias_binding' THEN CASE WHEN service IS NULL THEN 'service_id or host is required' WHEN reason IS NULL OR reason NOT IN ('CONFIG_BINDING_MISSING', 'HOST_ALIAS_UNRESOLVED', 'PATH_ONLY_TARGET_UNRESOLVED') THEN 'frontier does not ask for it' WHEN key IS NOT NULL AND p_key <> key THEN 'alias_key is no hint of the frontier' END
        WHEN 'provider_service_selection' THEN CASE WHEN service IS NULL THEN 'service_id is required' WHEN reason IS DISTINCT FROM 'PROVIDER_SERVICE_AMBIGUOUS' THEN 'frontier does not ask for it' WHEN NOT list_contains(cand, service) THEN 'service is no candidate' END
        WHEN 'method_path_hint' THEN CASE WHEN p_method IS NULL OR NOT has_path THEN NULLIF(concat_ws('; ', CASE WHEN p_method IS NULL THEN 'method is required' END, CASE WHEN NOT has_path THEN 'path is required' END), '')
          WHEN reason IS NULL OR reason NOT IN ('METHOD_UNKNOWN', 'PATH_TEMPLATE_UNKNOWN', 'PROVIDER_ENDPOINT_NOT_FOUND') THEN 'frontier does not ask for it' WHEN rec.provider_id IS NULL THEN 'no provider' WHEN g.intent_id IS NULL THEN 'no endpoint of the provider fits' END
        WHEN 'contradiction_challenge' THEN CASE WHEN NOT acts THEN 'action must reopen' WHEN reason IS NOT NULL THEN 'proof is not closed' WHEN confidence >= 0.65 THEN 'proof is too confident' END
        ELSE CASE WHEN pt.e IS NULL THEN 'endpoint_id is required' WHEN reason IS DISTINCT FROM 'ENDPOINT_MATCH_AMBIGUOUS' THEN 'frontier does not ask for it' ELSE NULLIF(concat_ws('; ', CASE WHEN o.provider <> rec.provider_id THEN 'endpoint of another provider' END,
          CASE WHEN o.provider <> rec.provider_id OR o.m NOT IN (rec.method, 'ANY') THEN 'endpoint is no candidate' END, CASE WHEN p_method <> o.m THEN 'method differs' END), '') END END) AS errors
      FROM rec JOIN pt ON pt.intent_id = rec.intent_id AND pt.r = rec.r + 1 LEFT JOIN op o ON o.intent_id = pt.intent_id AND o.e = pt.e LEFT JOIN (SELECT DISTINCT intent_id, provider, m FROM op) g ON g.intent_id = rec.intent_id AND g.provider = rec.provider_id AND g.m = p_method) x) y
    LEFT JOIN ev ON ev.intent_id = y.intent_id AND ev.provider = n_provider AND ev.q = n_method LEFT JOIN op h ON h.intent_id = y.intent_id AND h.e = n_hint AND h.provider = n_provider AND h.m IN (n_method, 'ANY'))
SELECT intent_id, seq, kind AS patch_type, CASE WHEN errors = '' THEN 'ACCEPTED' ELSE 'REJECTED' END AS verdict, errors, CASE WHEN reason IS NULL THEN 'CLOSED_ATOMIC' ELSE 'FRONTIER' END AS status, reason, provider_id, method, target AS target_id FROM rec WHERE r > 0"""

SEGS = lambda c: f"list_filter(string_split(lower({c}), '/'), lambda s: s <> '')"
ROUTE_SQL = f"""WITH {MOUNTED}, {ENDPOINTS},
rt AS (SELECT page_id, host, page_id % 3 = 0 AS exact, '/gw' || regexp_replace(path, '/[0-9]+', '/{{id}}', 'g') AS ext FROM u),
r2 AS (SELECT *, CASE WHEN exact THEN ext ELSE regexp_replace(ext, '/[^/]*/?$', '') END AS base FROM rt),
r3 AS (SELECT page_id, host, exact, list_filter([{SEGS('base')}[2:], {SEGS('base')}], lambda x: len(x) > 0) AS ps FROM r2),
rp AS (SELECT DISTINCT page_id, host, exact, unnest(ps) AS p FROM r3),
e2 AS (SELECT host, m || ' ' || host || endpoint_path AS e, {SEGS('endpoint_path')} AS q FROM ep),
{FITS.replace('u.path', 'pp.path').replace('FROM u, ep', "FROM (SELECT DISTINCT '/' || array_to_string(p, '/') AS path FROM rp WHERE NOT exact) pp, (SELECT DISTINCT '/' || array_to_string(q, '/') AS endpoint_path FROM e2) ep")},
rc AS (SELECT DISTINCT page_id, e, q FROM rp JOIN e2 USING (host) LEFT JOIN fits ON fits.path = '/' || array_to_string(p, '/') AND fits.endpoint_path = '/' || array_to_string(q, '/') WHERE CASE WHEN exact THEN p = q ELSE q[1:len(p)] = p OR coalesce(fits.score, 0) >= 0.75 END),
rs AS (SELECT page_id, count(*) AS n, max(k) AS most FROM (SELECT page_id, count(*) OVER (PARTITION BY page_id, q) AS k FROM rc) GROUP BY 1),
rr AS (SELECT rt.page_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'ROUTE_FAMILY_DERIVATION_EMPTY' WHEN most = 1 THEN 'DERIVED_CHILDREN' WHEN n = (SELECT count(*) FROM e2 WHERE e2.host = rt.host) THEN 'ROUTE_FAMILY_TOO_BROAD' ELSE 'ENDPOINT_SET_OPEN' END AS status FROM rt LEFT JOIN rs USING (page_id))
SELECT rr.page_id AS route_id, status, n, e AS child_id FROM rr LEFT JOIN rc ON rc.page_id = rr.page_id AND status = 'DERIVED_CHILDREN'"""

ALIAS = f"""{MOUNTED},
p AS (SELECT page_id, host, regexp_extract(host, '([a-z0-9-]+)\\.example\\.', 1) AS name, html FROM u JOIN pages USING (page_id)),
h0 AS (SELECT page_id, unnest([{{'h': CASE WHEN page_id % 3 = 0 THEN name ELSE '' END, 'n': TRUE}}, {{'h': regexp_extract(host, '^([a-z]+)', 1), 'n': FALSE}}, {{'h': name[1:5], 'n': FALSE}}, {{'h': CASE WHEN page_id % 2 = 0 THEN host ELSE '' END, 'n': FALSE}}], recursive := true) FROM p WHERE length(html) < 3000),
h1 AS (SELECT DISTINCT page_id, regexp_replace(lower(trim(h)), '[^a-z0-9]+', '', 'g') AS hint, CASE WHEN n THEN lower(trim(h)) END AS named FROM h0),
sv AS (SELECT DISTINCT host, name FROM p),
tk AS (SELECT DISTINCT host, regexp_replace(name, '[^a-z0-9]+', '', 'g') AS t, 'name' AS kind FROM sv UNION SELECT host, regexp_replace(x, '[^a-z0-9]+', '', 'g'), 'host' FROM (SELECT host, unnest([host, regexp_extract(host, '^([a-z]+[.][a-z-]+)', 1)]) AS x FROM sv)),
lv AS (SELECT page_id, hint, host, max(CASE WHEN hint = t AND kind = 'name' THEN 4 WHEN hint = t THEN 3 WHEN kind = 'name' THEN 2 ELSE 1 END) AS l FROM (SELECT DISTINCT page_id, hint FROM h1 WHERE hint <> '') JOIN tk ON t <> '' AND (contains(t, hint) OR contains(hint, t)) GROUP BY 1, 2, 3),
ex AS (SELECT page_id, host, count(*) AS k FROM h1 JOIN sv ON lower(trim(name)) = named WHERE hint <> '' GROUP BY 1, 2),
az AS (SELECT lv.page_id AS frontier_id, lv.host AS service_id, CAST(max(CASE WHEN l >= 3 THEN 3 ELSE 1 END) AS BIGINT) AS score, count(*) FILTER (WHERE l = 4) AS exact_names, count(*) FILTER (WHERE l = 3) AS exact_hosts, count(*) FILTER (WHERE l = 2) AS partial_names, count(*) FILTER (WHERE l = 1) AS partial_hosts,
  coalesce(any_value(k), 0) AS exact_service_names, CAST(sum(length(hint)) AS BIGINT) AS coverage FROM lv LEFT JOIN ex ON ex.page_id = lv.page_id AND ex.host = lv.host GROUP BY 1, 2)"""

PROJECTION_SQL = f"""WITH {HTTP},
rs AS (SELECT pv.intent_id AS k, 'P' || pv.intent_id AS proof_id, 'call' AS relation_type, coalesce(source_id, 'edge') AS subject_id, CASE WHEN method IS NOT NULL AND en.k = 1 THEN e END AS object_id, pv.intent_id % 10 / 10 AS confidence FROM pv LEFT JOIN en USING (intent_id)),
bf AS (SELECT CASE WHEN k % 4 = 0 THEN proof_id END AS proof_id, relation_type, subject_id, coalesce(object_id, 'gone') AS object_id, confidence, CASE k % 6 WHEN 0 THEN 'PENDING' WHEN 2 THEN 'REJECTED' ELSE 'APPROVED' END AS status FROM rs WHERE k % 2 = 0),
kp AS (SELECT * FROM bf WHERE status <> 'PENDING' OR proof_id IS NULL),
sd AS (SELECT subject_id, object_id FROM rs WHERE k % 15 = 1 UNION SELECT subject_id, object_id FROM kp WHERE status = 'APPROVED')
SELECT * FROM kp UNION ALL SELECT proof_id, relation_type, subject_id, object_id, confidence, 'PENDING' FROM rs WHERE object_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM kp WHERE kp.proof_id = rs.proof_id AND kp.object_id = rs.object_id AND kp.subject_id = rs.subject_id AND kp.status <> 'PENDING') AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.subject_id = rs.subject_id AND sd.object_id = rs.object_id)"""

ENTRIES = {
    "http_resolution": (http_resolution, f"""WITH {HTTP} SELECT intent_id, CASE WHEN provider_id IS NULL AND n > 1 THEN 'PROVIDER_SERVICE_AMBIGUOUS' WHEN provider_id IS NULL THEN CASE WHEN dynamic THEN 'DYNAMIC_URI_UNRESOLVED' WHEN hint IS NULL THEN 'PATH_ONLY_TARGET_UNRESOLVED' WHEN keyed THEN 'CONFIG_BINDING_MISSING' ELSE 'HOST_ALIAS_UNRESOLVED' END
        WHEN provider_id NOT IN (SELECT host FROM ep) THEN 'PROVIDER_ENDPOINT_INDEX_EMPTY' WHEN method IS NULL THEN 'METHOD_UNKNOWN' WHEN k IS NULL THEN 'PROVIDER_ENDPOINT_NOT_FOUND' WHEN k > 1 THEN 'ENDPOINT_MATCH_AMBIGUOUS' ELSE 'CLOSED_ATOMIC' END AS status,
        stage, provider_id, CASE WHEN k = 1 THEN e END AS target_id FROM pv LEFT JOIN en USING (intent_id)"""),
    "patch_fold": (patch_fold, FOLD_SQL),
    "patch_stream": (patch_stream, FOLD_SQL),
    "route_families": (route_families, ROUTE_SQL),
    "alias_scores": (alias_scores, f"WITH {ALIAS} SELECT * FROM az"),
    "alias_best": (alias_best, f"WITH {ALIAS}, q AS (SELECT *, rank() OVER (PARTITION BY frontier_id ORDER BY score DESC, exact_names DESC, exact_hosts DESC, partial_names DESC, partial_hosts DESC, exact_service_names DESC, coverage DESC) AS place FROM az) SELECT frontier_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(service_id) END AS service_id, max(score) AS score FROM q WHERE place = 1 GROUP BY 1"),
    "proof_projection": (proof_projection, PROJECTION_SQL),
}
