"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: sources in code point order, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` times all words; no target
exceeds ``LIMIT`` times its source's words, and what is cut off is shared again by weight.

Rates: of all document rates between 0 and ``LIMIT`` that meet the token constraints, sum(size * rate) = target for every
source, those are sought that stay closest to 1 in relative entropy, every document counting alike.  They are exponential
tilts, rate = min(LIMIT, exp(lambda[source] * size / mean size of the source)): documents of one source differ in rate by
their length.  Newton iterations on the convex dual give the multipliers.  Each step takes the dual's gradient and
curvature in one distributed aggregate over the counts of documents by source and size, a table that stands for all
documents exactly, and moves the multipliers in a table with a row for each source; a bracket around each solution turns
steps that leave it into bisections.  Steps end when every source's words are within ``TOLERANCE`` of its target, or half a word.  The sums
are decimal, so they don't depend on the order of rows.

Copies: every document gets the whole part of its rate.  The rest of its rate less a uniform hash of doc_id is its place in
the order in which documents of a source are taken once more, so the words that the tilts ask for are met by a cutoff near
place 0.  The cutoff is found from sums over 2**16 ranges of places, then 2**16 ranges inside one of these, then single
places; two further rounds fill what is left with smaller documents, and at last the one document that brings the words
nearest to the target is taken.  A document's copies follow from its source, size and hash alone, so reruns agree, and no
document is taken more than LIMIT times.

The table of sources is broadcast if it is small (``SMALL_SOURCES``, ``SMALL_BYTES``, both counted first), else joined;
its ranks are windows over it, so sources are expected to be far fewer than documents.

Null texts have size 0, a null source is a source, sizes of 0 take no words and stay once.  Rows with equal doc_ids are
taken together.  Texts are counted whole, however long.  An empty table gives no rows.  ``mixed`` keeps all columns,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import drop, scratch, stored

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
STEPS, TOLERANCE, LEAST = 60, 1e-6, 0.5
ROUNDS, ORDER_BITS, RANGE_BITS = 3, 60, 16
SMALL_SOURCES, SMALL_BYTES = 100_000, 8 << 20
EXACT = "decimal(38,6)"


def size_of(text: str) -> Column:
    r"""Number of runs of ``[^\x20\x09-\x0D]+``."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: str) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the MD5 of doc_id."""
    name = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def source_key(source: str) -> Column:
    """The source as a name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))


def targets(sources: DataFrame) -> DataFrame:
    """sources (key, source, source_size, ...) with ``bound`` = LIMIT times the size and ``target``: the smaller of it and a common level times the weight."""
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") - 1) % len(WEIGHTS) + 1))
    ranked = ranked.withColumn("bound", LIMIT * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    line = Window.orderBy("ratio", "place")
    cut = F.coalesce(F.sum("bound").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (total * SHARE - cut) / rest)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"]
    bound = F.col("bound").cast("double")
    return ranked.withColumn("common", level).select(*sources.columns, "bound", F.least(bound, F.coalesce(F.col("common") * F.col("weight"), bound)).alias("target"))


def rate_of() -> Column:
    """The rate of a row with size, joined with its source's lambda, mean and whether it is ``full``."""
    tilt = F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("lambda") * F.col("size") / F.col("mean"), F.lit(50.0))))
    return F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(LIMIT)).otherwise(tilt)


@dataclass
class Sources:
    """Joins rows with the table of sources, by broadcast if that was found small."""

    small: bool

    def on(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(sources) if self.small else sources, "key")


def newton_step(counts: DataFrame, sources: DataFrame, join: Sources) -> DataFrame:
    """sources after one step on the dual sum(n * phi(lambda * x)) - lambda * target; counts: key, size, n.

    phi' is the rate, so the gradient is the words that the rates take, less the target, and the curvature sums the
    rates below LIMIT times size squared.
    """
    tilted = join.on(counts, sources.where("open").select("key", "lambda", "mean", "full")).withColumn("rate", rate_of())
    words = F.col("n") * F.col("size") * F.col("rate")
    sums = tilted.groupBy("key").agg(F.sum(words.cast(EXACT)).alias("words"), F.sum(F.when(F.col("rate") < LIMIT, words * F.col("size") / F.col("mean")).otherwise(0.0).cast(EXACT)).alias("curvature"))
    s = sources.drop("words", "curvature").join(sums, "key", "left")
    gradient = F.col("words").cast("double") - F.col("target")
    s = s.withColumn("gradient", gradient).withColumn("open", F.col("open") & (F.abs("gradient") > TOLERANCE * F.col("target") + LEAST))
    s = s.withColumn("low", F.when(F.col("open") & (F.col("gradient") <= 0), F.col("lambda")).otherwise(F.col("low")))
    s = s.withColumn("high", F.when(F.col("open") & (F.col("gradient") > 0), F.col("lambda")).otherwise(F.col("high")))
    newton = F.col("lambda") - F.col("gradient") / F.nullif(F.col("curvature").cast("double"), F.lit(0.0))
    inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
    middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.when(F.col("gradient") > 0, F.least(F.col("lambda") * 2, F.col("lambda") - 1)).otherwise(F.greatest(F.col("lambda") * 2, F.col("lambda") + 1)))
    return s.withColumn("lambda", F.when(F.col("open"), F.when(inside, newton).otherwise(middle)).otherwise(F.col("lambda")))


def balanced(counts: DataFrame, sources: DataFrame, join: Sources, folder: str) -> DataFrame:
    """sources with ``lambda``, ``mean`` and ``full`` (the target is the bound, all rates are LIMIT)."""
    s = sources.withColumn("mean", F.col("source_size") / F.nullif(F.col("worded"), F.lit(0)))
    s = s.withColumn("full", F.col("target") >= F.col("bound")).withColumn("open", ~F.col("full"))
    s = s.withColumn("lambda", F.when(F.col("full"), 0.0).otherwise(F.greatest(F.lit(-5.0), F.log(F.col("target") / F.col("source_size")))))
    s = s.withColumns({c: F.lit(None).cast("double") for c in ("low", "high", "gradient")} | {c: F.lit(None).cast(EXACT) for c in ("words", "curvature")})
    s, last = stored(s, f"{folder}/newton-0"), f"{folder}/newton-0"
    for k in range(1, STEPS + 1):
        if s.where("open").isEmpty():
            break
        s = stored(newton_step(counts, s, join), f"{folder}/newton-{k}")
        drop(s.sparkSession, last)
        last = f"{folder}/newton-{k}"
    return s


def with_place() -> tuple[Column, Column]:
    """The whole part of a row's rate, and its place in the order of further copies."""
    whole = F.floor(F.col("rate"))
    place = (F.col("uniform") - (F.col("rate") - whole) + 1.0) * float(1 << (ORDER_BITS - 1))
    return whole.cast("long").alias("whole"), F.least(place.cast("long"), F.lit((1 << ORDER_BITS) - 1)).alias("place")


def tilted(rows: DataFrame, sources: DataFrame, join: Sources, *keep: str) -> DataFrame:
    """rows (key, size, uniform, keep) joined with their source's row, with whole and place."""
    out = join.on(rows, sources).withColumn("rate", rate_of())
    return out.select("key", "size", *keep, *[c for c in sources.columns if c != "key"], *with_place())


def crossing(rows: DataFrame, need: DataFrame, join: Sources, shift: int) -> DataFrame:
    """need (key, need, base, prefix) narrowed to the range of 2**shift places where the words reach ``need``.

    rows have places that begin with the prefix; base counts the words before it.  Keys whose words don't reach it go.
    """
    sums = rows.groupBy("key", F.shiftright("place", shift).alias("range")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("range"))
    found = join.on(sums.withColumn("upto", upto), need.select("key", "need", "base")).where("base + upto > need")
    return found.groupBy("key").agg(F.min(F.struct("range", (F.col("base") + F.col("upto") - F.col("words")).alias("base"), "need")).alias("at")).select("key", "at.need", "at.base", F.col("at.range").alias("prefix"))


def cutoffs(rows: DataFrame, need: DataFrame, join: Sources) -> DataFrame:
    """need (key, need) with ``cutoff`` and ``found``: rows (key, place, size) with place < cutoff have ``found`` <= need words together.

    Only keys whose rows exceed the need are returned.
    """
    at = need.select("key", "need", F.lit(0).cast("long").alias("base"))
    shift = ORDER_BITS - RANGE_BITS
    at = crossing(rows, at, join, shift)
    inside = lambda at, shift: join.on(rows, at.select("key", "prefix")).where(F.shiftright("place", shift) == F.col("prefix"))
    at = crossing(inside(at, shift), at, join, shift - RANGE_BITS)
    at = crossing(inside(at, shift - RANGE_BITS), at, join, 0)
    return at.select("key", F.col("prefix").alias("cutoff"), F.col("base").alias("found"))


def plan(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, Sources]:
    """Rows (doc_id, source, key, size, uniform) and, for each source, its target and what decides the copies of its documents."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), source_key(source).alias("key"), size_of(text).alias("size"), uniform(doc_id).alias("uniform"))
    rows = stored(rows, f"{folder}/rows")
    counts = stored(rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), f"{folder}/counts")
    sources = targets(counts.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("worded")))
    sources = stored(sources, f"{folder}/targets")
    n, n_bytes = sources.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    join = Sources(n <= SMALL_SOURCES and n_bytes <= SMALL_BYTES)
    sources = balanced(counts, sources, join, folder).select("key", "source_size", "target", "lambda", "mean", "full")
    given = join.on(counts, sources).withColumn("rate", rate_of()).groupBy("key").agg(F.sum(F.col("n") * F.col("size") * F.floor("rate")).cast("long").alias("given"))
    sources = sources.join(given, "key").withColumn("need", F.greatest(F.lit(0).cast("long"), F.round("target").cast("long") - F.col("given"))).drop("given")
    sources = stored(sources.withColumn("from_0", F.lit(0).cast("long")).withColumn("most_0", F.lit(1 << 62)), f"{folder}/sources-0")
    for k in range(1, ROUNDS + 1):
        start, most = f"from_{k - 1}", f"most_{k - 1}"
        left = tilted(rows, sources.where("need > 0"), join).where((F.col("whole") < LIMIT) & (F.col("place") >= F.col(start)) & (F.col("size") > 0) & (F.col("size") <= F.col(most))).select("key", "size", "place")
        found = cutoffs(left, sources.where("need > 0").select("key", "need"), join)
        sources = sources.join(found, "key", "left")
        sources = sources.withColumn("need", F.col("need") - F.coalesce("found", F.lit(0))).withColumn(f"from_{k}", F.coalesce("cutoff", start)).withColumn(f"most_{k}", F.least(F.col(most), F.col("need")))
        sources = stored(sources.drop("cutoff", "found"), f"{folder}/sources-{k}")
    picked = stored(last_picks(rows, sources, join), f"{folder}/decisions")
    drop(docs.sparkSession, f"{folder}/counts", f"{folder}/targets", *(f"{folder}/sources-{k}" for k in range(ROUNDS + 1)))
    return rows, picked, join


def last_picks(rows: DataFrame, sources: DataFrame, join: Sources) -> DataFrame:
    """sources with the place and size of the document, if any, that brings the words nearest to the target."""
    left = tilted(rows, sources.where("need > 0"), join).where((F.col("whole") < LIMIT) & ~in_rounds() & (F.col("size") > 0) & (F.col("size") < 2 * F.col("need")))
    alike = left.groupBy("key", "need", "place", "size").agg(F.sum("size").alias("words")).where("words < 2 * need")
    pick = alike.groupBy("key").agg(F.min(F.struct(F.abs(F.col("words") - F.col("need")).alias("off"), "place", "size")).alias("pick"))
    return sources.join(pick, "key", "left").withColumn("pick_place", F.coalesce("pick.place", F.lit(-1))).withColumn("pick_size", F.coalesce("pick.size", F.lit(-1))).drop("pick")


def in_rounds() -> Column:
    """Whether a row joined with its source's plan is taken once more in one of the rounds."""
    extra = F.lit(False)
    for k in range(1, ROUNDS + 1):
        extra = extra | ((F.col("place") >= F.col(f"from_{k - 1}")) & (F.col("place") < F.col(f"from_{k}")) & (F.col("size") <= F.col(f"most_{k - 1}")) & (F.col("size") > 0) & (F.col("whole") < LIMIT))
    return extra


def copies() -> Column:
    """Copies of a row joined with its source's plan."""
    picked = (F.col("place") == F.col("pick_place")) & (F.col("size") == F.col("pick_size")) & (F.col("whole") < LIMIT)
    return F.col("whole") + (in_rounds() | picked).cast("long")


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    rows, sources, join = plan(docs, scratch(docs.sparkSession, "mix"), doc_id, text, source)
    out = tilted(rows, sources, join, "doc_id", "source")
    return out.select("doc_id", "source", "size", "source_size", "target", copies().alias("copies"), (copies() * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as it is taken, with the columns of docs.

    Sizes are counted again beside the texts: that costs less than joining the texts with the plan by doc_id.
    """
    _, sources, join = plan(docs, scratch(docs.sparkSession, "mix"), doc_id, text, source)
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], source_key(source).alias("key"), size_of(text).alias("size"), uniform(doc_id).alias("uniform"))
    out = tilted(rows, sources, join, *names.values())
    out = out.withColumn("copies", copies()).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
