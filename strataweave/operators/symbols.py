"""Code symbols: what a call reaches through interfaces, and which function a line belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strataweave.sources.scratch import stored


def implementations(implements: DataFrame) -> DataFrame:
    """Of each interface the number of classes that implement it, and the only one if there is one. implements: class, interface."""
    sums = implements.select("class", "interface").distinct().groupBy("interface").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("first"))
    return sums.select("interface", "n", F.when(F.col("n") == 1, F.col("first")).alias("only"))


def resolve_calls(starts: DataFrame, implements: DataFrame, interfaces: DataFrame, nested: DataFrame, direct: DataFrame, max_depth: int = 3) -> DataFrame:
    """start, target, depth, impl, ambiguous, penalty: the direct calls that each start (start, type, method) reaches.

    nested: type, method, to_type, to_method. direct: type, method, target. A call of an interface goes on in the class that implements it (impl); of several
    in each, marked and with a tenth of penalty more; of none nowhere. Each level is one join over distinct states, stored; paths that reach the
    same state are one row, so a cycle adds at most max_depth levels.
    """
    known = implementations(implements).select(F.col("interface").alias("type"), "n")
    faces = stored(interfaces.select("type").distinct().join(known, "type", "left").select("type", F.lit(True).alias("face"), "n"), "interfaces")
    classes = stored(implements.select(F.col("interface").alias("type"), "class").distinct().join(faces.select("type"), "type", "left_semi"), "classes")
    nested, direct = stored(nested.distinct(), "nested-calls"), stored(direct.distinct(), "direct-calls")  # each level reads them

    def landed(states: DataFrame) -> DataFrame:
        rows = states.join(faces, "type", "left").where("face is null or n is not null")
        through = F.col("face").isNotNull()
        several = F.col("n") > 1
        # What led to an interface counts no more, so its states are one row before they fan out to the classes.
        rows = rows.select(
            "start", "type", "method", "depth", F.when(~through, F.col("impl")).alias("impl"), F.when(through, several).otherwise(F.col("ambiguous")).alias("ambiguous"),
            (F.col("penalty") + F.when(several, 1).otherwise(0)).alias("penalty"),
        ).distinct()
        rows = rows.join(classes, "type", "left")
        return rows.select("start", F.coalesce("class", "type").alias("type"), "method", "depth", F.coalesce("class", "impl").alias("impl"), "ambiguous", "penalty").distinct()

    live = starts.select("start", "type", "method", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("impl"), F.lit(None).cast("boolean").alias("ambiguous"), F.lit(0).alias("penalty"))
    out = None
    for depth in range(1, max(1, max_depth) + 1):
        live = stored(landed(live), "call-states")
        found = live.join(direct, ["type", "method"]).select("start", "target", "depth", "impl", "ambiguous", (F.col("penalty") / 10).alias("penalty"))
        out = found if out is None else out.unionByName(found)
        if depth < max_depth:
            live = live.join(nested, ["type", "method"]).select("start", F.col("to_type").alias("type"), F.col("to_method").alias("method"), F.lit(depth + 1).alias("depth"), "impl", "ambiguous", "penalty")
    return out.distinct()


#: Levels of dyadic blocks: lines are under 2^LEVELS.
LEVELS = 31
#: Lines of a chunk: 2^CHUNK.
CHUNK = 10


def _blocks(low: Column, high: Column) -> Column:
    """The largest dyadic blocks (level, block) that lie within low to high, at most two a level."""

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        left, right = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        at = lambda k: F.struct(level.alias("level"), k.alias("block"))
        more = F.array_compact(F.array(F.when(left, at(a)), F.when(right, at(b))))
        a, b = F.when(left, a + 1).otherwise(a), F.when(right, b - 1).otherwise(b)
        up = lambda k, done: F.when(a <= b, F.shiftright(k, 1)).otherwise(F.lit(done)).cast("long")
        return F.struct(up(a, 0).alias("a"), up(b, -1).alias("b"), F.concat(s["out"], more).alias("out"))

    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["out"])


def owners(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """lines (file, line and other columns) with function_id: the function whose range holds the line and began last (ties: that ends first, then the least id), else null.

    functions: file, function_id, line_start, line_end. Files are cut into chunks of 2^CHUNK lines. A range makes at most two pieces that lie within a chunk, of which
    only the innermost with the same ends is kept; a task goes through the sorted lines and pieces of a chunk with those that are open. Chunks that longer ranges
    hold whole meet them as dyadic blocks, by an equi-join, and take the innermost as one more piece. So no range products, and a file that has a third of all
    lines is spread by its chunks.
    """
    line, size = F.col("line").cast("long"), 1 << CHUNK
    inner = F.struct((-F.col("line_start").cast("long")).alias("later"), F.col("line_end").cast("long").alias("ends"), F.col("function_id").alias("id"))
    whole = functions.where("file is not null and line_start <= line_end and line_start >= 0").select("file", F.col("line_start").cast("long").alias("a"), F.col("line_end").cast("long").alias("b"), inner.alias("f"))
    chunk = lambda c: F.shiftright(c, CHUNK)
    first, last = chunk(F.col("a")), chunk(F.col("b"))
    piece = lambda c, s, e: F.struct(c.alias("chunk"), s.alias("s"), e.alias("e"))
    ends = F.array(piece(first, F.col("a"), F.least("b", (first + 1) * size - 1)), F.when(last > first, piece(last, last * size, F.col("b"))))
    pieces = whole.select("file", "f", F.explode(ends).alias("x")).where("x is not null").select("file", "x.*", "f")
    long = whole.where(last > first + 1).select("file", "f", F.explode(_blocks(first + 1, last - 1)).alias("x"))
    best = stored(long.groupBy("file", F.col("x.level").alias("level"), F.col("x.block").alias("block")).agg(F.min("f").alias("f")), "blocks")
    top = best.agg(F.max("level")).first()[0]
    if top is not None:
        here = lines.select("file", chunk(line).alias("chunk")).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("block", F.expr("shiftright(chunk, level)"))
        pieces = pieces.unionByName(here.join(best, ["file", "level", "block"]).select("file", "chunk", (F.col("chunk") * size).alias("s"), ((F.col("chunk") + 1) * size - 1).alias("e"), "f"))
    pieces = pieces.groupBy("file", "chunk", "s", "e").agg(F.min("f").alias("f"))
    rows = lines.select("file", chunk(line).alias("chunk"), line.alias("at"), F.struct(*lines.columns).alias("row"))
    rows = rows.unionByName(pieces.select("file", "chunk", F.col("s").alias("at"), "e", "f"), allowMissingColumns=True)
    ordered = rows.repartition("file", "chunk").sortWithinPartitions("file", "chunk", "at", F.col("e").isNull(), F.desc("f"))  # pieces before lines, the innermost last
    ordered = ordered.select("file", "chunk", "at", "e", F.col("f.id").alias("function_id"), "row")
    schema = StructType([ordered.schema["row"], StructField("function_id", ordered.schema["function_id"].dataType)])
    return ordered.mapInArrow(_innermost, schema).select("row.*", "function_id")


def _innermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's row with the innermost piece that is open there. Pieces open in order; one that ended stays closed, as lines come in order too."""
    place, pieces = None, []
    for batch in batches:
        found, kept = [], []
        file, chunk, at, end, name = (batch.column(k).to_pylist() for k in range(5))
        for k, here in enumerate(zip(file, chunk)):
            if here != place:
                place, pieces = here, []
            if end[k] is not None:
                pieces.append((end[k], name[k]))
                continue
            while pieces and pieces[-1][0] < at[k]:
                pieces.pop()
            kept.append(k)
            found.append(pieces[-1][1] if pieces else None)
        yield pa.RecordBatch.from_arrays([batch.column(5).take(pa.array(kept, pa.int64())), pa.array(found, batch.column(4).type)], ["row", "function_id"])
