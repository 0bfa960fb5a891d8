"""Mixing sources to target weights by pivotal rounding, in DataFrame operations only.

A source that is to give f times its words takes floor(f) whole copies of each document and a fraction
f - floor(f) of one more. Pivotal rounding makes these fractions whole without moving the sum: of two
documents with fractions left, one gives words to the other, in a direction drawn so that each keeps
its expected share, until one of them is taken in full or not at all. What is left of the other
meets the next. So runs of at most `FAN` documents are folded, each to one residual; the residuals are
dealt anew and folded again, and so on up a tree until a source has one. That one can't be paired: it
gives its words in part, so a source's taken words are its target, rounded.

Sizes weigh the transfer: what moves is words, not copies, so the sum of words stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convene.llm.common import cut, discard, spaced

FAN = 64
#: Copies of one row that one task makes.
COPIES = 4096
#: Sources (a name and two numbers each) that are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    return F.size(_words(F.coalesce(text, F.lit("")))).cast("long")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.replace(spaced(text), F.lit("\n"), F.lit(" ")), " ", -1), "")


def source_targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) from (source, source_size): `share` times all words dealt by weight,
    no source above `most` times its own.

    Sources are numbered in code-point order, null last, by the parts of a sort: a number in each part,
    and what the parts before it hold. Then a level is raised until it rests: at a level, a source gets
    its weight times the level or its limit, and what the full ones leave is shared by the weights of the
    others. The level never falls, and each step fills a source or is the last. No step needs the sources
    in one task."""
    parts = sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = sizes.repartitionByRange(int(parts), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = cut(ordered, "mix-ordered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over parts, not sources
    offsets = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("offset")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighted = ordered.join(F.broadcast(offsets), "part").select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("limit"))
    weighted = cut(weighted, "mix-weights")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("limit") <= F.col("weight") * level
        row = weighted.agg(F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)).alias("spent"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"), F.count(F.when(over, 1)).alias("full")).first()
        if row.full == full or not row.open:
            break
        level, full = max(level, (share * total - row.spent) / row.open), row.full
    target = F.col("limit") if not row.open else F.least(F.col("limit"), F.col("weight") * level)
    out = cut(weighted.select("source", "source_size", target.alias("target")), "mix-targets")
    discard(ordered, weighted)
    return out


def _uniform(seed: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)


def _fold(items: Column) -> Column:
    """Pivotal rounding along an array of (doc_id, size, whole, part, salt), part in words between 0 and
    size: an array of the same documents, decided, and the last residual.

    The state holds the decided documents and the open one. Of the open one (words a of size s) and the
    next (b of t) with a + b = w, the open one ends at its highest share, min(s, w), or at its lowest,
    max(0, w - t), with chances that keep its mean at a."""
    document = "struct<k:bigint,doc_id:bigint,th:bigint,source:string,size:bigint,source_size:bigint,target:double,whole:bigint,part:double,salt:bigint>"

    def step(state: Column, item: Column) -> Column:
        held = state["open"]
        words = held["part"] + item["part"]
        high = F.least(held["size"].cast("double"), words)
        low = F.greatest(F.lit(0.0), words - item["size"])
        chance = F.when(high > low, (held["part"] - low) / (high - low)).otherwise(1.0)
        up = _uniform(3, held["salt"], item["salt"]) < chance
        mine = F.when(up, high).otherwise(low)
        other = words - mine
        settled = (mine <= 0) | (mine >= held["size"])
        first, second = held.withField("part", mine), item.withField("part", other)
        pair = F.struct(F.when(settled, first).otherwise(second).alias("decided"), F.when(settled, second).otherwise(first).alias("open"))
        return F.when(held.isNull(), F.struct(state["decided"].alias("decided"), item.alias("open"))).otherwise(
            F.struct(F.concat(state["decided"], F.array(pair["decided"])).alias("decided"), pair["open"].alias("open"))
        )

    start = F.struct(F.array().cast(f"array<{document}>").alias("decided"), F.lit(None).cast(document).alias("open"))
    return F.aggregate(items, start, step)


def _with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows with the columns of their source; the sources are broadcast if they are few by count."""
    known = per_source.withColumnRenamed("source", "s")
    if per_source.count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    return rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: int = 1, fan: int = FAN) -> DataFrame:
    """doc_id, th (hash of the text), size, source_size, target, taken for every row of docs (doc_id,
    text, source).

    Sources in code-point order, null last, weigh `weights`, repeating; together they are to give `share`
    times all words, none over `most` times its own. taken is a whole number of copies times the size,
    but for one document of each source, which gives a part of a copy. Documents without words take
    nothing. Repeated rows are rows of their own; the same input gives the same result. A null doc_id is
    an id like others; other columns are ignored; an empty table gives no row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    # repeated rows are told apart by number
    sized = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "mix-sizes")
    # many copies of one row are dealt to tasks in parts
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("chunk")
    many = sized.where(F.col("n") > COPIES).select("*", chunk).repartition("doc_id", "th", "chunk")
    dealt = sized.where(F.col("n") <= COPIES).withColumn("chunk", F.lit(0).cast("long")).unionByName(many)
    copies = F.sequence(F.col("chunk") * COPIES + 1, F.least(F.col("n"), (F.col("chunk") + 1) * COPIES))
    each = dealt.withColumn("copy", F.explode(copies)).withColumn("salt", F.xxhash64("th", "copy")).drop("copy", "n", "chunk")
    sources = source_targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most, weights)
    joined = _with_source(each, sources)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(times + 1e-12)
    planned = joined.withColumn("whole", whole).withColumn("part", F.col("size") * F.greatest(F.lit(0.0), times - whole))
    planned = cut(planned, "mix-planned")
    discard(sized, sources)
    taken = lambda part: (F.col("whole") * F.col("size") + F.round(part)).cast("long").alias("taken")
    columns = ["doc_id", "th", "size", "source_size", "target"]
    done = [planned.where(F.col("part") <= 0).select(*columns, taken(F.lit(0.0)))]
    todo, levels = planned.where(F.col("part") > 0), [planned]
    fields = ["doc_id", "th", "source", "size", "source_size", "target", "whole", "part", "salt"]
    level = 0
    while True:
        level += 1
        groups = cut(todo.groupBy("source").agg(F.ceil(F.count("*") / fan).alias("groups"), F.count("*").alias("n")), "mix-groups")
        if (groups.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        grouped = _with_source(todo, groups.drop("n")).withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "salt"), F.col("groups")))
        folded = grouped.groupBy("source", "grp").agg(_fold(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), F.lit(-level), "doc_id", "salt").alias("k"), *fields)))).alias("r"))
        folded = cut(folded.select("r.decided", "r.open"), f"mix-level{level}")
        discard(groups)
        levels.append(folded)
        done.append(folded.select(F.explode("decided").alias("d")).select("d.*").select(*columns, taken(F.col("part"))))
        todo = folded.select("open.*")
    done.append(todo.select(*columns, taken(F.col("part"))))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = cut(out, "mix-taken")
    discard(groups, *levels)
    return out


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixture itself: rows of docs repeated as mix() decided, columns as they are, whatever their
    names. A part of a copy is a row whose text is the document's first words, parted by spaces. Rows that
    share doc_id and text share what they take evenly. No row taken: an empty table."""
    plan = mixed.where(F.col("taken") > 0).groupBy("doc_id", "th").agg(F.first("size").alias("size"), F.expr("sum(taken) div count(*)").alias("taken"))
    plan = plan.select(F.struct("*").alias("plan"))
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(plan, F.col("row.doc_id").cast("long").eqNullSafe(F.col("plan.doc_id")) & (F.xxhash64("row.text") == F.col("plan.th")))
    rest = F.col("plan.taken") % F.col("plan.size")
    parts = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.expr("cast(plan.taken div plan.size as int)")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = joined.select("row", F.explode(parts).alias("part"))
    words = F.slice(_words(F.col("row.text")), F.lit(1), F.greatest(F.col("part"), F.lit(0)).cast("int"))
    text = F.when(F.col("part") < 0, F.col("row.text")).otherwise(F.array_join(words, " ")).alias("text")
    return each.select(*(text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
