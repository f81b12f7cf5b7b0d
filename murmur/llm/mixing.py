"""Mixing sources to target weights: block quotas split among output shards by hypergeometric draws.

Every document gets a fixed random key within its source, so a source in key order is a
random permutation. A source that shall give ``target`` words gives whole passes and,
in a last pass, the documents up to a cut key; behind it come those short enough for what is
then left, up to a second cut, and one last document that fits. The permuted source is divided into blocks; how many blocks of every source
an output shard gets is drawn in a binary tree of multivariate hypergeometric splits,
and the shards take disjoint runs of blocks. Only counts per source (and 1,024 cells of a
source at a time) are ever gathered; documents are never sorted by source and never
leave their partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.exprs import bind
from murmur.session import materialize

WEIGHTS = (5, 2, 1)
LAST_KEY = (1 << 63) - 1
CELL_BITS = 10  # a level of the search for a cut looks at 1,024 cells of a source


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permutation_key(seed: int, source: Column, doc_id: Column, size: Column) -> Column:
    """63 random bits per document; rows that share id, size and source share the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), source, doc_id, size), 1)


def targets(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, docs, rank, target): one row per source.

    ``share`` of all words is dealt by weight (repeating over the sources in code point
    order, null last); no target exceeds ``cap`` times its source, and the excess is
    dealt again by weight, which ends at one level ``target = min(cap * size, level * weight)``.
    The windows without keys hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    weighted = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.get(cycle, F.col("rank") % len(weights))
    )
    levels = (
        weighted.withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.col("capped")) / F.col("open_weight"))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return levels.withColumn("first", first).select(
        "source", "source_size", "docs", "rank",
        F.coalesce(F.least("most", F.col("first") * F.col("weight")), F.col("most")).alias("target"),
    )


def _descend(sized: DataFrame, wanted: DataFrame, shift: int) -> DataFrame:
    """The cell of every source that holds its cut, and the words wanted from that cell.

    ``wanted`` has (source, cell, words); ``cell`` is the key's bits above ``shift + CELL_BITS``.
    """
    key = F.shiftright("key", shift)
    inside = _of_source(sized, wanted).filter(F.shiftright("key", shift + CELL_BITS) == F.col("cell"))
    cells = inside.groupBy("source", key.alias("finer"), "words").agg(F.sum("size").alias("size"))
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("finer"))
    return (
        cells.withColumn("until", so_far)
        .filter((F.col("until") > F.col("words")) & (F.col("until") - F.col("size") <= F.col("words")))
        .select("source", F.col("finer").alias("cell"), (F.col("words") - F.col("until") + F.col("size")).alias("words"))
    )


def _of_source(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of the listed sources, each with its source's columns."""
    sources = sources.withColumnRenamed("source", "wanted_source")
    return sized.join(sources, F.col("source").eqNullSafe(F.col("wanted_source"))).drop("wanted_source")


def _cuts(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut, left) for (source, words): the last key of the longest run that fits, and the words still wanted.

    A source whose documents all fit is cut behind its last possible key.
    """
    at = wanted.select("source", F.lit(0).cast("long").alias("cell"), "words")
    shift = 63
    for _ in range(2):
        shift -= CELL_BITS
        at = materialize(_descend(sized, at, shift), "mix-cells")
    inside = _of_source(sized, at).filter(F.shiftright("key", shift) == F.col("cell"))
    rows = inside.groupBy("source", "key", "cell", "words").agg(F.sum("size").alias("size"))
    rows = rows.withColumn("until", F.sum("size").over(Window.partitionBy("source").orderBy("key")))
    fits = F.col("until") <= F.col("words")
    found = rows.groupBy(F.col("source").alias("found")).agg(
        F.coalesce(F.max(F.when(fits, F.col("key"))), F.first(F.shiftleft("cell", shift) - 1)).alias("cut"),
        (F.first("words") - F.coalesce(F.max(F.when(fits, F.col("until"))), F.lit(0))).alias("left"),
    )
    joined = wanted.join(found, F.col("source").eqNullSafe(F.col("found")), "left")
    return joined.select("source", F.coalesce("cut", F.lit(LAST_KEY)).alias("cut"), F.coalesce("left", F.lit(0).cast("long")).alias("left"))


def _fillers(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """(source, filler): the largest document behind the cut that still fits."""
    fitting = _of_source(sized, cuts).filter((F.col("key") > F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
    best = materialize(fitting.groupBy("source", "left").agg(F.max(F.struct("size", "key"))["key"].alias("filler")), "mix-fillers")
    rows = _of_source(sized, best).filter(F.col("key") == F.col("filler"))
    return rows.groupBy("source", "filler", "left").agg(F.sum("size").alias("size")).filter("size <= left").select("source", "filler")


def hypergeometric(marked: Column, drawn: Column, pool: Column, uniform: Column) -> Column:
    """How many of ``marked`` among ``pool`` units are in a random draw of ``drawn``, from one uniform number.

    Walks the outcomes from the most likely one upwards and then downwards with the
    ratio of neighbouring probabilities.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - pool)
    high = F.least(marked, drawn)
    mode = F.least(high, F.greatest(low, F.floor((marked + 1) * (drawn + 1) / (pool + 2)).cast("long")))
    given = F.struct(
        marked.alias("n"), drawn.alias("m"), pool.alias("all"), uniform.alias("u"), low.alias("low"), high.alias("high"), mode.alias("mode")
    )

    def pick(g: Column) -> Column:
        ratio = lambda x: (g["n"] - x + 1) * (g["m"] - x + 1) / (x * (g["all"] - g["n"] - g["m"] + x)).cast("double")
        weight = lambda w, x: (
            F.when(x == g["mode"], F.lit(1.0)).when(x > g["mode"], w * ratio(x)).when(x == g["mode"] - 1, 1.0 / ratio(x + 1)).otherwise(w / ratio(x + 1))
        )
        outcomes = F.concat(
            F.sequence(g["mode"], g["high"]),
            F.when(g["mode"] > g["low"], F.sequence(g["mode"] - 1, g["low"], F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        )
        total = F.aggregate(
            outcomes,
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda s, x: bind(weight(s["w"], x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))),
            lambda s: s["sum"],
        )
        return bind(
            total * g["u"],
            lambda aim: F.aggregate(
                outcomes,
                F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("pick")),
                lambda s, x: bind(
                    weight(s["w"], x),
                    lambda w: F.struct(
                        w.alias("w"), (s["sum"] + w).alias("sum"), F.when(s["pick"].isNull() & (s["sum"] + w > aim), x).otherwise(s["pick"]).alias("pick")
                    ),
                ),
                lambda s: F.coalesce(s["pick"], g["mode"]),
            ),
        )

    return bind(given, pick)


def split_counts(counts: Column, salt: Column, seed: int) -> Column:
    """How many units of every source go to the left half of a node: one multivariate hypergeometric draw."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(
        total.alias("pool"), F.floor((total + F.shiftright(salt, 1) % 2) / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("left")
    )

    def step(s: Column, n: Column) -> Column:
        uniform = F.pmod(F.xxhash64(F.lit(seed), salt, F.size(s["left"])), F.lit(1 << 53)) / F.lit(float(1 << 53))
        return bind(
            hypergeometric(n, s["draws"], s["pool"], uniform),
            lambda x: F.struct((s["pool"] - n).alias("pool"), (s["draws"] - x).alias("draws"), F.concat(s["left"], F.array(x)).alias("left")),
        )

    return F.aggregate(counts, start, step, lambda s: s["left"])


def shard_runs(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, starts): for every source the first block of each shard's run, in shard order.

    The array of a node has one count per source: sources are named corpora, and their
    number does not follow the number of documents.
    """
    depth = max(0, (shards - 1).bit_length())
    nodes = plan.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "units"))), lambda x: x["units"]).alias("counts")
    ).select(F.lit(1).cast("long").alias("node"), "counts")
    for _ in range(depth):
        split = nodes.withColumn("left", split_counts(F.col("counts"), F.col("node"), seed))
        right = F.zip_with("counts", "left", lambda a, b: a - b)
        nodes = materialize(
            split.select(F.explode(F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")),
                F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")),
            )).alias("x")).select("x.*"),
            "mix-nodes",
        )
    leaves = nodes.select("node", F.posexplode("counts").alias("rank", "units"))
    ordered = F.array_sort(F.collect_list(F.struct("node", "units")))
    runs = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda s, x: F.struct((s["at"] + x["units"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
        lambda s: s["starts"],
    )
    return leaves.groupBy("rank").agg(runs.alias("starts"))


def block_of(key: Column, blocks: Column) -> Column:
    return F.shiftright(F.shiftright(key, 32) * blocks, 31)


def mixing_plan(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...], shards: int, blocks_per_source: int, seed: int) -> DataFrame:
    """One row per source: target, whole passes, cut key, filler, number of blocks and the shards' runs of blocks."""
    size = F.col("source_size")
    aims = targets(sized, share, cap, weights)
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    plan = aims.withColumn("passes", passes).withColumn("rest", F.floor(F.col("target") - F.col("passes") * size).cast("long"))
    plan = materialize(
        plan.withColumn("blocks", F.least(F.lit(blocks_per_source).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("docs") / 256)))), "mix-targets"
    )
    cuts = materialize(_cuts(sized, plan.filter("rest > 0").select("source", F.col("rest").alias("words"))), "mix-cuts")
    behind = _of_source(sized, cuts).filter((F.col("key") > F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
    wanted = cuts.filter("left > 0").select("source", F.col("left").alias("words"))
    short = materialize(_cuts(behind.select(*sized.columns), wanted), "mix-cuts")
    fillers = _fillers(sized, short)
    full = plan
    for found in (cuts, short.select("source", F.col("cut").alias("short_cut")), fillers):
        found = found.withColumnRenamed("source", "found")
        full = full.join(found, F.col("source").eqNullSafe(F.col("found")), "left").drop("found")
    last = F.when(F.col("cut").isNotNull(), block_of(F.greatest("cut", F.lit(0).cast("long")), F.col("blocks")) + 1).otherwise(0)
    full = materialize(full.withColumn("units", F.col("passes") * F.col("blocks") + last), "mix-plan")
    return materialize(full.join(shard_runs(full, shards, seed), "rank"), "mix-runs")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, shards: int = 16, blocks_per_source: int = 4096, seed: int = 7,
) -> DataFrame:
    """How often every document is taken: doc_id, source, size, key, source_size, target, copies, taken, shards.

    One row per input row. ``copies`` is at most ``ceil(cap)``; ``shards`` names the output
    shard of every copy. Null and empty texts have size 0 and are taken with their
    source's whole passes, which add no words; a null source is a source of its own, last in
    order. Rows equal in id, size and source are taken alike. An empty table gives an
    empty result. All draws are hashes of ``seed``, so reruns agree.
    """
    size = word_count(F.col(f"`{text_col}`"))
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    sized = materialize(
        narrow.select("*", permutation_key(seed, F.col("source"), F.col("doc_id"), F.col("size")).alias("key")), "mix-sizes"
    )
    plan = mixing_plan(sized, share, cap, weights, shards, blocks_per_source, seed)
    return apply_plan(sized, plan)


def apply_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    plan = plan.withColumnRenamed("source", "plan_source").select(
        "plan_source", "source_size", "target", "passes", "cut", "left", "short_cut", "filler", "blocks", "units", "starts"
    )
    short = (F.col("key") > F.col("cut")) & (F.col("key") <= F.col("short_cut")) & (F.col("size") <= F.col("left"))
    extra = F.lit(False)
    for rule in (F.col("key") <= F.col("cut"), short, F.col("key") == F.col("filler")):
        extra = extra | F.coalesce(rule, F.lit(False))
    copies = (F.col("passes") + extra.cast("long")).cast("int")
    unit = lambda turn: F.least(F.col("units") - 1, turn.cast("long") * F.col("blocks") + block_of(F.col("key"), F.col("blocks")))
    turns = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    shard = lambda turn: bind(unit(turn), lambda u: F.size(F.filter("starts", lambda s: s <= u)) - 1)
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
        .withColumn("copies", copies)
        .select(*sized.columns, "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.transform(turns, shard).alias("shards"))
    )


def mixed_documents(docs: DataFrame, seed: int = 7, **params) -> DataFrame:
    """The drawn documents: every input column, one row per copy, with ``shard`` and ``shard_order``.

    A document's decision depends only on its id, size and source, so the plan is applied
    in place: no text is shuffled. Writers that want the shards as files repartition by
    ``shard`` and sort by ``shard_order``.
    """
    id_col, text_col, source_col = (params.pop(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    options = {"share": 1.5, "cap": 2.0, "weights": WEIGHTS, "shards": 16, "blocks_per_source": 4096} | params
    names = docs.columns
    size = word_count(F.col(f"`{text_col}`"))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(row, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    keyed = keyed.withColumn("key", permutation_key(seed, F.col("source"), F.col("doc_id"), F.col("size")))
    sized = materialize(keyed.drop("row"), "mix-sizes")
    plan = mixing_plan(sized, seed=seed, **options)
    drawn = apply_plan(keyed, plan).select("row", "key", F.posexplode("shards").alias("turn", "shard"))
    return drawn.select("row.*", "shard", F.xxhash64(F.lit(seed), "turn", "key").alias("shard_order"))
