"""Reading project files: discovery, configuration in YAML, compose and manifests, property scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def text_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and text of files under a folder, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


#: A 'name: value' line of YAML-like text; a list item's dash is part of its indent.
YAML_LINE = r"^(\s*(?:- )?)([A-Za-z0-9_.\-/]+)\s*:\s*(.*?)\s*$"


def flattened(files: DataFrame) -> DataFrame:
    """path, key, value: dotted keys of YAML-like files. One pass over a file's lines with the list of open parents: those before it of each smaller depth."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(YAML_LINE) & ~x.rlike(r"^\s*#"))
    part = lambda x, n: F.regexp_extract(x, YAML_LINE, n)
    rows = F.transform(lines, lambda x: F.struct(F.length(part(x, 1)).alias("depth"), part(x, 2).alias("name"), F.regexp_replace(part(x, 3), "^[\"']|[\"']$", "").alias("value")))
    start = F.struct(F.array().cast("array<struct<depth:int,name:string>>").alias("open"), F.array().cast("array<struct<key:string,value:string>>").alias("found"))

    def step(state, x):
        opened = F.concat(F.filter(state["open"], lambda o: o["depth"] < x["depth"]), F.array(F.struct(x["depth"].alias("depth"), x["name"].alias("name"))))
        entry = F.struct(F.array_join(F.transform(opened, lambda o: o["name"]), ".").alias("key"), x["value"].alias("value"))
        return F.struct(opened.alias("open"), F.when(x["value"] == "", state["found"]).otherwise(F.concat(state["found"], F.array(entry))).alias("found"))

    return files.select("path", F.explode(F.aggregate(rows, start, step, lambda s: s["found"])).alias("e")).select("path", "e.key", "e.value")


def manifests(files: DataFrame) -> DataFrame:
    """path, kind, name, env_name, env_value of the documents of Kubernetes files; documents without variables have null ones."""
    docs = files.select("path", F.explode(F.split("text", r"(?m)^---\s*$")).alias("doc")).where(F.col("doc").rlike(r"(?m)^kind:"))
    env = lambda n: F.regexp_extract_all("doc", F.lit(r"-\s*name:\s*([A-Z][A-Z0-9_]*)\s*\n\s*value:\s*[\"']?([^\"'\n]*)"), F.lit(n))
    rows = docs.select("path", F.regexp_extract("doc", r"(?m)^kind:\s*(\S+)", 1).alias("kind"), F.regexp_extract("doc", r"(?ms)^metadata:.*?^\s+name:\s*(\S+)", 1).alias("name"), F.explode_outer(F.arrays_zip(env(1).alias("n"), env(2).alias("v"))).alias("e"))
    return rows.select("path", "kind", "name", F.col("e.n").alias("env_name"), F.col("e.v").alias("env_value"))


#: How sure a relation is that configuration tells of.
CONFIG_CONFIDENCE = {"datasource": 0.9, "kafka_consume": 0.85, "kafka_produce": 0.85, "depends_on": 0.6, "k8s": 0.7, "zuul_route": 0.7}


def config_candidates(entries: DataFrame) -> DataFrame:
    """path, relation_type, target, confidence that flattened keys (path, key, value) tell of: data sources, Kafka sides, gateway routes."""
    key, value, sure = F.col("key"), F.col("value"), CONFIG_CONFIDENCE
    found = lambda kind, target, c: F.struct(F.lit(kind).alias("relation_type"), target.alias("target"), F.lit(c).alias("confidence"))
    brokers = entries.where("key = 'spring.kafka.bootstrap-servers'").select("path", F.col("value").alias("broker"))
    rules = F.when(key.rlike(r"(^|\.)datasource\.(.*\.)?url$") & value.startswith("jdbc:"), F.array(found("read", jdbc_identity(value), sure["datasource"]), found("write", jdbc_identity(value), sure["datasource"])))
    rules = rules.when(key.rlike(r"^spring\.kafka\.consumer\."), F.array(found("consume", F.col("broker"), sure["kafka_consume"]))).when(key.rlike(r"^spring\.kafka\.producer\."), F.array(found("produce", F.col("broker"), sure["kafka_produce"])))
    rules = rules.when(key.rlike(r"^zuul\.routes\.[^.]+\.service-?[iI]d$"), F.array(found("call", value, sure["zuul_route"])))
    return entries.join(brokers, "path", "left").select("path", F.explode(rules).alias("c")).select("path", "c.*").where("target <> ''").distinct()


def manifest_candidates(rows: DataFrame) -> DataFrame:
    """path, relation_type, target, confidence of ``manifests``: variables with a JDBC URL or Kafka brokers."""
    sure, v = CONFIG_CONFIDENCE["k8s"], F.col("env_value")
    kinds = F.when(v.startswith("jdbc:"), F.array(F.lit("read"), F.lit("write"))).when(F.col("env_name").contains("KAFKA"), F.array(F.lit("produce"), F.lit("consume")))
    return rows.select("path", F.explode(kinds).alias("relation_type"), F.when(v.startswith("jdbc:"), jdbc_identity(v)).otherwise(v).alias("target")).withColumn("confidence", F.lit(sure)).where("target <> ''").distinct()


def properties(files: DataFrame) -> DataFrame:
    """path, key, value of 'key = value' files."""
    rows = files.select("path", F.explode(F.split("text", r"\r?\n")).alias("raw"))
    pattern = r"^\s*([A-Za-z0-9_.\-]+)\s*[=:]\s*(.*?)\s*$"
    return rows.where(F.col("raw").rlike(pattern) & ~F.col("raw").rlike(r"^\s*[#!]")).select("path", F.regexp_extract("raw", pattern, 1).alias("key"), F.regexp_extract("raw", pattern, 2).alias("value"))


def resolved_value(value: Column, values: Column) -> Column:
    """A ${key:default} placeholder from a map of values; other text stays."""
    pattern = r"^\$\{([^:}]+)(?::([^}]*))?\}$"
    key, default = F.regexp_extract(value, pattern, 1), F.regexp_extract(value, pattern, 2)
    found = F.element_at(values, key)
    return F.when(~value.rlike(pattern), value).otherwise(F.coalesce(F.when(found == "", None).otherwise(found), default))


def scoped(files: DataFrame, entries: DataFrame) -> DataFrame:
    """For each file and key the entry of its deepest enclosing folder; profile files override. Folders meet files by equi-join on every ancestor."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    parts = F.split(folder(F.col("path")), "/")
    ancestors = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("scope"))
    e = entries.select(folder(F.col("path")).alias("scope"), "key", "value", F.col("path").rlike("-[a-z]+\\.[a-z]+$").alias("profile"), F.col("path").alias("from_path"))
    rank = F.struct(F.length("scope"), F.col("profile"), F.col("from_path"))
    return ancestors.join(e, "scope").groupBy("path", "key").agg(F.max_by("value", rank).alias("value"))


#: What an image name stands for.
IMAGES = (("database", "postgres|mysql|mariadb|oracle|mongo|redis"), ("message_broker", "kafka|rabbitmq|activemq|nats"))


def compose_services(files: DataFrame) -> DataFrame:
    """path, service, kind, depends_on (array) of compose files."""
    keys = flattened(files).where(F.col("key").startswith("services."))
    images = keys.where(F.col("key").rlike(r"^services\.[^.]+\.image$")).select("path", F.split("key", r"\.")[1].alias("service"), "value")
    kind = F.lit("service")
    for name, pattern in reversed(IMAGES):
        kind = F.when(F.col("value").rlike(pattern), name).otherwise(kind)
    rows = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    w = Window.partitionBy("path").orderBy("line")
    head = F.last(F.when(F.col("raw").rlike(r"^  [A-Za-z0-9_-]+:\s*$"), F.regexp_extract("raw", r"^  ([A-Za-z0-9_-]+):", 1)), ignorenulls=True).over(w)
    part = F.last(F.when(F.col("raw").rlike(r"^    [A-Za-z0-9_-]+:"), F.regexp_extract("raw", r"^    ([A-Za-z0-9_-]+):", 1)), ignorenulls=True).over(w)
    items = rows.withColumn("service", head).withColumn("part", part).where((F.col("part") == "depends_on") & F.col("raw").rlike(r"^\s+- "))
    deps = items.groupBy("path", "service").agg(F.array_sort(F.collect_set(F.regexp_extract("raw", r"^\s+- ([A-Za-z0-9_-]+)", 1))).alias("depends_on"))
    known = images.select("path", "service", kind.alias("kind"))
    return known.join(deps, ["path", "service"], "full").select("path", "service", F.coalesce("kind", F.lit("service")).alias("kind"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def jdbc_identity(url: Column) -> Column:
    """host:port/database of a JDBC URL, lower case, without options."""
    return F.lower(F.regexp_extract(url, r"^jdbc:[a-z0-9:]+//([^/?;]+/[A-Za-z0-9_\-]+)", 1))


#: Files that mark a project, in order, with its language, and folders that are not looked into.
MARKERS = (("package.json", "node"), ("pom.xml", "java"), ("build.gradle", "java"), ("build.gradle.kts", "kotlin"), ("pyproject.toml", "python"), ("setup.py", "python"), ("go.mod", "go"), ("Cargo.toml", "rust"))
NOT_PROJECTS = ("node_modules", ".git", ".svn", "dist", "build", "target", "__pycache__", ".next", ".turbo", ".cache", "vendor")


def under_root(rows: DataFrame, root: Column | str) -> DataFrame:
    """Rows whose path is the root or below it."""
    root = F.regexp_replace(F.col(root) if isinstance(root, str) else root, "/+$", "")
    return rows.where((F.col("path") == root) | F.col("path").startswith(F.concat(root, F.lit("/"))))


def projects(files: DataFrame) -> DataFrame:
    """root, path, name, language, marker: projects at a root or in a folder right below it, by the first marker that lies there. files: root, path."""
    inner = F.substring("path", F.length("root") + 2, F.length("path"))
    parts = files.where(F.col("path").startswith(F.concat("root", F.lit("/")))).select("root", F.split(inner, "/").alias("p")).where("size(p) <= 2")
    parts = parts.select("root", F.when(F.size("p") == 2, F.col("p")[0]).alias("folder"), F.element_at("p", -1).alias("marker")).where(F.col("folder").isNull() | ~(F.col("folder").isin(*NOT_PROJECTS) | F.col("folder").startswith(".")))
    rank = F.when(F.lit(False), F.struct(F.lit(0).alias("k"), F.lit("").alias("language"), F.lit("").alias("marker")))
    for k, (marker, language) in enumerate(MARKERS):
        rank = rank.when(F.col("marker") == marker, F.struct(F.lit(k).alias("k"), F.lit(language).alias("language"), F.lit(marker).alias("marker")))
    best = parts.select("root", "folder", rank.alias("m")).where("m is not null").groupBy("root", "folder").agg(F.min("m").alias("m"))
    name = F.coalesce("folder", F.element_at(F.split("root", "/"), -1))
    return best.select("root", F.when(F.col("folder").isNull(), F.col("root")).otherwise(F.concat_ws("/", "root", "folder")).alias("path"), name.alias("name"), "m.language", "m.marker")


def json_entries(files: DataFrame, levels: int = 32) -> DataFrame:
    """path, key, value: dotted keys of JSON files, list items by number; a level a round, until no value is an object or a list. Text that is no JSON has no entries."""
    kind = lambda v: F.schema_of_variant(v)
    nested = lambda v: kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")
    spark = files.sparkSession
    live, done = files.select("path", F.lit("").alias("key"), F.try_parse_json("text").alias("v")).where("v is not null"), None
    for _ in range(levels):
        leaf = live.where(~nested(F.col("v")) & (F.col("key") != "")).select("path", "key", F.col("v").cast("string").alias("value"))
        done = leaf if done is None else done.unionByName(leaf)
        live = live.where(nested(F.col("v")))
        if live.isEmpty():
            return done
        live.createOrReplaceTempView("_json_level")
        live = spark.sql("SELECT path, concat_ws('.', nullif(t.key, ''), coalesce(e.key, cast(e.pos AS string))) AS key, e.value AS v FROM _json_level t, LATERAL variant_explode(t.v) e")
    raise ValueError(f"JSON is nested deeper than {levels} levels")


def named_services(entries: DataFrame, services: DataFrame) -> DataFrame:
    """path and service_id: the service that a file's spring.application.name names, letter case and separators aside, if exactly one bears the name."""
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[-_]", "")
    names = services.groupBy(bare(F.col("name")).alias("bare")).agg(F.min("id").alias("service_id"), F.count_distinct("id").alias("n")).where("n = 1")
    return entries.where("key = 'spring.application.name'").select("path", bare(F.col("value")).alias("bare")).join(names, "bare").select("path", "service_id")


def relation_candidates(found: DataFrame, owners: DataFrame) -> DataFrame:
    """subject_id, relation_type, target, confidence, files: what files tell of their services, each once with its surest source and number of files. found: path, relation_type, target, confidence."""
    rows = found.join(owners, "path")
    return rows.groupBy(F.col("service_id").alias("subject_id"), "relation_type", "target").agg(F.max("confidence").alias("confidence"), F.count_distinct("path").alias("files"))


def compose_candidates(services: DataFrame) -> DataFrame:
    """path, subject, relation_type, target, confidence of ``compose_services``: a service that waits for a database reads and writes it, for a broker produces and consumes, for a service depends on it."""
    kinds = services.select("path", F.col("service").alias("target"), F.col("kind").alias("target_kind"))
    waits = services.where("kind = 'service'").select("path", F.col("service").alias("subject"), F.explode("depends_on").alias("target")).join(kinds, ["path", "target"])
    types = F.when(F.col("target_kind") == "database", F.array(F.lit("read"), F.lit("write"))).when(F.col("target_kind") == "message_broker", F.array(F.lit("produce"), F.lit("consume"))).otherwise(F.array(F.lit("depend_on")))
    return waits.select("path", "subject", F.explode(types).alias("relation_type"), "target", F.lit(CONFIG_CONFIDENCE["depends_on"]).alias("confidence")).distinct()
