"""Gateway routes that stand for a family of endpoints, how well services match a frontier's hints, and candidates from closed proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.providers import fitting_paths
from strataweave.operators.texts import holding_pairs
from strataweave.sources.scratch import stored


def parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda s: s != "")


def joined(segs: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(segs, "/"))


def composed_paths(external: Column, match_path: Column, strip: Column, prepend: Column) -> Column:
    """Under which paths a provider may serve a route: as it comes in, its fixed part, both behind the prefix, without the stripped segments, and what is left behind the fixed part."""
    came, base, before = parts(external), parts(F.regexp_replace(match_path, r"[*].*$", "")), parts(prepend)
    after = lambda segs, n: F.slice(segs, n + 1, F.greatest(F.size(segs) - n, F.lit(0)))
    under = F.slice(came, 1, F.size(base)) == base
    inner = F.concat(before, after(came, strip))
    some = F.array(inner, came, base, F.concat(before, base), F.concat(before, after(base, strip)), F.when(under, after(came, F.size(base))))
    return F.array_distinct(F.transform(F.filter(F.array_compact(some), lambda s: F.size(s) > 0), joined))


def reachable(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """route_id and endpoint_id. routes: route_id, provider_id, mode (exact, prefix), paths (array). endpoints: provider_id, endpoint_id, endpoint_path.

    An endpoint lies as a row under each of its prefixes, so a route meets what it is a prefix of by an equi-join; prefix routes also reach what fits their path.
    """
    at = stored(routes.select("route_id", "provider_id", "mode", F.explode("paths").alias("path")).withColumn("path", joined(parts(F.col("path")))), "route-paths")
    e = stored(endpoints.select("provider_id", "endpoint_id", joined(parts(F.col("endpoint_path"))).alias("endpoint_path")), "route-endpoints")
    prefixes = e.withColumn("segs", parts(F.col("endpoint_path"))).select("provider_id", "endpoint_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("segs")), lambda n: joined(F.slice("segs", F.lit(1), n)))).alias("path"))
    exact = at.where("mode = 'exact'").join(e.withColumnRenamed("endpoint_path", "path"), ["provider_id", "path"])
    prefix = at.where("mode = 'prefix'")
    below = prefix.join(prefixes, ["provider_id", "path"])
    fit = prefix.join(fitting_paths(prefix, e, "provider_id").hint("merge"), ["provider_id", "path"]).join(e.hint("shuffle_hash"), ["provider_id", "endpoint_path"])
    pair = ["route_id", "endpoint_id"]
    return exact.select(pair).unionByName(below.select(pair)).unionByName(fit.select(pair)).distinct()


def route_families(routes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """route_id, status, n, child_id: a row a derived child, or one with why there is none.

    Several endpoints make children if no two have one path; a set of all the provider's endpoints is too broad, another stays open.
    """
    e = endpoints.select("provider_id", "endpoint_id", joined(parts(F.col("endpoint_path"))).alias("endpoint_path"))
    found = stored(reachable(routes, e).join(e.select("endpoint_id", "endpoint_path"), "endpoint_id"), "route-children")
    per_path = found.groupBy("route_id", "endpoint_path").agg(F.count(F.lit(1)).alias("k"))
    sums = per_path.groupBy("route_id").agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    total = e.groupBy("provider_id").agg(F.count(F.lit(1)).alias("all"))
    rows = routes.select("route_id", "provider_id").join(sums, "route_id", "left").join(total, "provider_id", "left")
    status = F.when(F.col("n").isNull(), "ROUTE_FAMILY_DERIVATION_EMPTY").when(F.col("most") == 1, "DERIVED_CHILDREN").when(F.col("n") == F.col("all"), "ROUTE_FAMILY_TOO_BROAD").otherwise("ENDPOINT_SET_OPEN")
    rows = rows.select("route_id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    kids = found.select("route_id", F.col("endpoint_id").alias("child_id"), F.lit("DERIVED_CHILDREN").alias("status"))
    return rows.join(kids, ["route_id", "status"], "left").select("route_id", "status", "n", "child_id")


KEYS = ("score", "exact_names", "exact_hosts", "partial_names", "partial_hosts", "exact_service_names", "coverage")


def alias_scores(hints: DataFrame, services: DataFrame) -> DataFrame:
    """frontier_id, service_id and the seven keys, most telling first. hints: frontier_id, hint, name_hint (boolean: the hint may be a service's exact name). services: service_id, name, hosts (array).

    A hint counts once a service: as an equal name, else an equal host, else a name that holds it or that it holds, else such a host.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "")
    h = stored(hints.select("frontier_id", norm(F.col("hint")).alias("hint"), F.when(F.col("name_hint"), F.lower(F.trim("hint"))).alias("named")).where("hint <> ''").distinct(), "alias-hints")
    names = services.select("service_id", norm(F.col("name")).alias("token"), F.lit("name").alias("kind"))
    tokens = stored(names.unionByName(services.select("service_id", F.explode(F.transform("hosts", norm)).alias("token"), F.lit("host").alias("kind"))).where("token <> ''").distinct(), "alias-tokens")
    pairs = holding_pairs(h, "hint", tokens, "token").join(tokens, "token")
    kind, same = F.col("kind"), F.col("hint") == F.col("token")
    level = F.when(same & (kind == "name"), 4).when(same, 3).when(kind == "name", 2).otherwise(1)
    best = pairs.groupBy("hint", "service_id").agg(F.max(level).alias("level"))
    rows = h.select("frontier_id", "hint").distinct().join(best, "hint")
    count = lambda n: F.count_if(F.col("level") == n)
    scored = rows.groupBy("frontier_id", "service_id").agg(F.max(F.when(F.col("level") >= 3, 3).otherwise(1)).alias("score"), count(4).alias("exact_names"), count(3).alias("exact_hosts"), count(2).alias("partial_names"), count(1).alias("partial_hosts"), F.sum(F.length("hint")).alias("coverage"))
    exact = h.where("named is not null").join(services.select("service_id", F.lower(F.trim("name")).alias("named")), "named").groupBy("frontier_id", "service_id").agg(F.count(F.lit(1)).alias("exact_service_names"))
    return scored.join(exact, ["frontier_id", "service_id"], "left").select("frontier_id", "service_id", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in KEYS])


def best_alias(scores: DataFrame) -> DataFrame:
    """frontier_id, n (services of the best quality), service_id (null where they tie), and the best's score: the keys are compared as one struct, in order."""
    quality = F.struct(*KEYS)
    top = scores.groupBy("frontier_id").agg(F.max(quality).alias("q"))
    rows = scores.withColumn("q", quality).join(top, ["frontier_id", "q"]).groupBy("frontier_id").agg(F.count(F.lit(1)).alias("n"), F.min("service_id").alias("service_id"), F.max("score").alias("score"))
    return rows.select("frontier_id", "n", F.when(F.col("n") == 1, F.col("service_id")).alias("service_id"), "score")


def projected(proofs: DataFrame, candidates: DataFrame, manual: DataFrame) -> DataFrame:
    """Candidates after proofs were evaluated: proof_id (null: no proof's), relation_type, subject_id, object_id, confidence, status.

    proofs: proof_id, status, relation_type, subject_id, object_id, confidence (target columns null where open). candidates: the same with status. Pending candidates
    of these proofs go (an open proof takes its own back); a closed proof makes one unless its own candidate was decided before, or a manual relation or another approved candidate already says so.
    """
    triple = ["relation_type", "subject_id", "object_id"]
    columns = ["proof_id", *triple, "confidence", "status"]
    mine = proofs.select("proof_id")
    kept = candidates.where("status <> 'PENDING' or proof_id is null").unionByName(candidates.where("status = 'PENDING' and proof_id is not null").join(mine, "proof_id", "left_anti").select(candidates.columns))
    decided = kept.where("status <> 'PENDING' and proof_id is not null").select("proof_id", *triple).distinct()
    said = manual.select(triple).unionByName(kept.where("status = 'APPROVED'").select(triple)).distinct()
    new = proofs.where("status = 'CLOSED_ATOMIC'").join(decided, ["proof_id", *triple], "left_anti").join(said, triple, "left_anti")
    # One row a proof and target, however often the proof is given.
    made = new.groupBy("proof_id", *triple).agg(F.max("confidence").alias("confidence")).withColumn("status", F.lit("PENDING"))
    return kept.select(columns).unionByName(made.select(columns))
