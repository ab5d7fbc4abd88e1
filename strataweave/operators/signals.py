"""Signals in source files: URLs, configuration entries, SQL tables, owners, incremental scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.scalars import url_host, url_path

#: Kinds of line signals in the order in which they are tried, with their patterns and confidences.
LINE_SIGNALS = (
    ("expose", r"@(Get|Post|Put|Delete|Patch|Request)Mapping", 0.8),
    ("call", r"(RestTemplate|WebClient|FeignClient|axios\.|fetch\(|requests\.)", 0.7),
    ("produce", r"(kafkaTemplate\.send|\.send\(\s*new\s+ProducerRecord)", 0.7),
    ("consume", r"@KafkaListener", 0.8),
    ("link", r"https?://[^\s\"'<>]+", 0.6),
    ("entry", r"[A-Za-z_][A-Za-z0-9_.-]*\s*[=:]\s*\"[^\"]+\"", 0.5),
)


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), content."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p", "content")).select(key, (F.col("p") + 1).alias("line"), "content")


def line_signals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, kind, confidence: the first pattern that a line matches."""
    kind = F.coalesce(*[F.when(F.col("content").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))) for k, p, c in LINE_SIGNALS])
    some = "|".join(p for _, p, _ in LINE_SIGNALS)  # most lines match none: one pattern tells
    return lines(docs, key, text).where(F.col("content").rlike(some)).withColumn("s", kind).where("s is not null").select(key, "line", "s.kind", "s.confidence")


def merge_signals(signals: DataFrame, key: list[str]) -> DataFrame:
    """Signals of several engines (engine, confidence) as one: highest confidence wins, engines are listed."""
    return signals.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.max_by("engine", F.struct("confidence", "engine")).alias("best_engine"))


def config_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, name, value of name = \"value\" entries, wherever they stand."""
    pattern = r'([A-Za-z_][A-Za-z0-9_.-]*)\s*=\s*"([^"]+)"'
    found = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("e"))  # texts are searched once, entries taken apart
    return found.select(key, F.regexp_extract("e", pattern, 1).alias("name"), F.regexp_extract("e", pattern, 2).alias("value"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, link_host (empty for links inside the site) and path of each link in a page."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    urls = pages.select("page_id", F.explode(links).alias("l"))
    return urls.select("page_id", url_host(F.col("l")).alias("link_host"), F.when(F.col("l").contains("://"), url_path(F.col("l"))).otherwise(F.regexp_extract("l", "^[^?#]*", 0)).alias("path"))


def sql_tables(statements: DataFrame, key: str, sql: str) -> DataFrame:
    """key, table_name, access of simple SQL text: comments go, names of common table expressions do not count."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.col(sql)), r"/\*.*?\*/", " "), r"--[^\n]*", " ")
    ctes = F.regexp_extract_all(F.col("s"), F.lit(r"(?:with|,)\s+(?:recursive\s+)?([a-z_][a-z0-9_]*)\s+as\s*\("), F.lit(1))
    part = lambda pattern, access: F.transform(F.regexp_extract_all(F.col("s"), F.lit(pattern), F.lit(1)), lambda t: F.struct(t.alias("table_name"), F.lit(access).alias("access")))
    found = F.concat(part(r"(?:from|join)\s+([a-z_][a-z0-9_.]*)", "read"), part(r"(?:insert\s+into|update|delete\s+from)\s+([a-z_][a-z0-9_.]*)", "write"))
    rows = statements.withColumn("s", clean).select(key, ctes.alias("ctes"), F.explode(found).alias("t"))
    return rows.where(~F.array_contains("ctes", F.col("t.table_name"))).select(key, "t.table_name", "t.access").distinct()


def changed_files(now: DataFrame, before: DataFrame, key: str, text: str) -> DataFrame:
    """Keys and hashes of files whose content is new or differs from the scan before."""
    hashed = lambda df: df.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"))
    return hashed(now).join(hashed(before), [key, "sha256"], "left_anti")


def owners(paths: DataFrame, services: DataFrame) -> DataFrame:
    """path, service_id: the service whose name is the nearest enclosing segment of the path."""
    parts = paths.select("path", F.posexplode(F.split(F.lower("path"), "/")).alias("pos", "segment"))
    named = services.select(F.lower("name").alias("segment"), F.col("id").alias("service_id"))
    return parts.join(named, "segment").groupBy("path").agg(F.max_by("service_id", F.struct("pos", "service_id")).alias("service_id"))


#: Columns that look like keys but are not.
NO_KEYS = ("id", "uuid_id", "session_id", "trace_id")


#: How sure a foreign key is: declared, on a unique column, in a composite index, by name alone.
KEY_TIERS = (("declared", 0.95), ("unique", 0.85), ("index", 0.7), ("name", 0.5))


def key_candidates(columns: DataFrame) -> DataFrame:
    """Foreign keys of columns (table_name, column_name, declared_ref, is_unique, in_index): table_name, column_name, ref_table, confidence.

    A declared reference counts as it is. Otherwise the name tells it: base + 's' if such a table exists, else base; columns that are
    unique or in an index are surer than those with the name alone. The surest stays.
    """
    base = F.regexp_extract("column_name", "^(.+)_(id|no)$", 1)
    known = columns.withColumn("base", base)
    sure = dict(KEY_TIERS)
    declared = known.where("declared_ref is not null").select("table_name", "column_name", F.col("declared_ref").alias("ref_table"), F.lit(sure["declared"]).alias("confidence"))
    rows = known.where((F.col("base") != "") & ~F.col("column_name").isin(*NO_KEYS))
    tables = columns.select(F.col("table_name").alias("ref")).distinct()
    tier = F.when(F.col("is_unique"), sure["unique"]).when(F.col("in_index"), sure["index"]).otherwise(sure["name"])
    guess = rows.select("table_name", "column_name", tier.alias("confidence"), F.explode(F.array(F.struct(F.lit(1).alias("place"), F.concat("base", F.lit("s")).alias("ref")), F.struct(F.lit(2).alias("place"), F.col("base").alias("ref")))).alias("g"))
    named = guess.select("table_name", "column_name", "confidence", "g.place", "g.ref").join(tables, "ref").groupBy("table_name", "column_name").agg(F.min_by("ref", "place").alias("ref_table"), F.max("confidence").alias("confidence"))
    best = F.max_by(F.struct("ref_table", "confidence"), "confidence")
    return declared.unionByName(named).groupBy("table_name", "column_name").agg(best.alias("b")).select("table_name", "column_name", "b.ref_table", "b.confidence")


def module_scores(files: DataFrame) -> DataFrame:
    """module, score, class of modules by their files (module, path inside it, text), best first.

    Configuration of an application +3, a main source set +2, a main folder +1, an executable build plugin +3, a
    library's name -3, neither entry point nor plugin -3; from 3 on a service, up to -1 a library.
    """
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    path, text = F.col("path"), F.col("text")
    build = path.isin("build.gradle", "build.gradle.kts", "pom.xml")
    sums = files.groupBy("module").agg(
        any_(path.rlike(r"^src/main/resources/(application\.(yml|yaml|json|properties)|bootstrap\.properties)$")).alias("config"), any_(path.rlike("^src/main/(java|kotlin|ts|python)(/|$)")).alias("code"), any_(path.rlike("^src/main(/|$)")).alias("main"),
        any_(build & text.rlike(r"(?i)(spring-boot|application|org\.springframework\.boot|io\.quarkus|shadowJar)")).alias("plugin"), any_(path.rlike(r"Application\.(java|kt)$|main\.(ts|js|py)$")).alias("entry"),
    )
    score = 3 * F.col("config") + 2 * F.col("code") + F.col("main") + 3 * F.col("plugin") - 3 * F.col("module").rlike("(?i)(common|domain|shared|lib|library)").cast("int") - 3 * ((F.col("entry") == 0) & (F.col("plugin") == 0)).cast("int")
    kind = F.when(F.col("score") >= 3, "service_candidate").when(F.col("score") <= -1, "library_candidate").otherwise("inherited")
    return sums.select("module", score.alias("score")).withColumn("class", kind).orderBy(F.desc("score"), "module")


def with_rules(signals: DataFrame, rules: list[tuple]) -> DataFrame:
    """Signals after confidence rules (condition, change), in order, each kept within 0 and 1."""
    c = F.col("confidence")
    for condition, change in rules:
        c = F.least(F.greatest(F.when(condition, c + change).otherwise(c), F.lit(0.0)), F.lit(1.0))
    return signals.withColumn("confidence", c)


def unambiguous(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that stand for one value only, with it."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")
