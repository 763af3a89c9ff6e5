"""Unanswerable variants: another answer from the pool in place of the right one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions.hashing import hash_key
from driftlens.operators.ordering import HASH_SHIFT, running_total
from driftlens.session import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, materialize

SLOT = 10_000  # pool places per slot when answers are found by a shuffle


def answer_pool(df: DataFrame, answers: str | Column) -> DataFrame:
    """(split, answer, n): every offered answer with its number of copies."""
    column = F.col(answers) if isinstance(answers, str) else answers
    return (
        df.select("split", F.explode(column).alias("answer"))
        .groupBy("split", "answer")
        .agg(F.count("*").alias("n"))
    )


def _places(pool: DataFrame) -> DataFrame:
    """Lay the pool's copies out in hash order of the answers: each answer owns places [start, start + n)."""
    hashed = pool.withColumn("_h", hash_key(F.col("answer"))).withColumn("_b", F.shiftright("_h", HASH_SHIFT))
    placed = running_total(hashed, ["split"], "_b", [F.col("_h"), F.col("answer")], "n", "start")
    return placed.select("split", "answer", "n", "start")


def random_negative(
    df: DataFrame,
    pool: DataFrame,
    good: str,
    seed: int = 42,
    row_id: str = "row_id",
    out: str = "negative",
    pool_split: str | None = None,
    max_broadcast: int = BROADCAST_ROWS,
    slot: int = SLOT,
) -> DataFrame:
    """Add a seeded draw from the pool of the row's split, uniform over the copies of other answers.

    The copies of the right answer are one run of places, so the draw picks among the places outside
    that run and never has to be repeated. A pool without another answer raises. ``pool_split`` names
    one split whose pool serves all rows.
    """
    places = materialize(_places(pool))
    sizes = places.groupBy("split").agg(
        F.sum("n").alias("_size"), F.count("*").alias("_answers"), F.sum(F.octet_length("answer")).alias("_bytes")
    )
    known = {row["split"]: row for row in sizes.collect()}
    rows = df.withColumn("_split", F.lit(pool_split) if pool_split else F.col("split"))
    size = F.coalesce(*[F.when(F.col("_split") == s, F.lit(r["_size"])) for s, r in known.items()], F.lit(0))
    small = (
        sum(r["_answers"] for r in known.values()) <= max_broadcast
        and sum(r["_bytes"] or 0 for r in known.values()) <= BROADCAST_BYTES
    )

    own = places.select(
        F.col("split").alias("_split"), F.col("answer").alias(good), F.col("n").alias("_n"), F.col("start").alias("_start")
    )
    met = rows.join(F.broadcast(own), ["_split", good], "left") if small else _own_runs(rows, own, good, row_id)
    drawn = (
        met.withColumn("_free", size - F.coalesce("_n", F.lit(0)))
        .withColumn(
            "_free",
            F.when(F.col("_free") > 0, F.col("_free")).otherwise(
                F.raise_error(F.lit("the pool holds no other answer")).cast("long")
            ),
        )
        .withColumn("_draw", hash_key(seed, F.col(row_id)) % F.col("_free"))
        .withColumn(
            "_place",
            F.col("_draw") + F.when(F.col("_draw") >= F.col("_start"), F.col("_n")).otherwise(F.lit(0)),
        )
    )
    if small:
        return _by_broadcast(drawn, places, known, df.columns, out)
    return _by_slots(drawn, places, known, df.columns, out, slot, row_id)


def _own_runs(rows: DataFrame, own: DataFrame, good: str, row_id: str) -> DataFrame:
    """Each row with the run of its right answer, for pools too large to broadcast.

    Answers that are right for a thousandth of the rows or more (so at most a thousand) are broadcast, if they are no longer than that
    allows. Their rows and those without an answer enter the shuffled join of the others under a key of their own, so no task
    gets all rows of one answer.
    """
    asked = rows.where(F.col(good).isNotNull()).groupBy("_split", good).agg(F.count("*").alias("_asked"))
    often = asked.where(F.col("_asked") * 1_000 >= rows.count()).drop("_asked")
    hot = own.join(often, ["_split", good]).select(
        "_split", good, F.col("_n").alias("_hot_n"), F.col("_start").alias("_hot_start"), F.lit(True).alias("_hot")
    )
    tagged = rows.join(broadcast_if_small(hot), ["_split", good], "left")
    tagged = tagged.withColumn("_cold", F.col("_hot").isNull() & F.col(good).isNotNull())
    keyed = tagged.withColumn("_key", F.when(F.col("_cold"), F.col(good)).otherwise(F.col(row_id).cast("string")))
    cold = own.select("_split", F.col(good).alias("_key"), F.lit(True).alias("_cold"), "_n", "_start")
    met = keyed.join(cold, ["_split", "_key", "_cold"], "left")
    return met.withColumns({"_n": F.coalesce("_hot_n", "_n"), "_start": F.coalesce("_hot_start", "_start")})


def _whole(x: Column, width: Column) -> Column:
    """Division of non-negative longs without a detour over doubles."""
    return F.call_function("div", x, width.cast("long"))


def _slotted(places: DataFrame, width: Column) -> DataFrame:
    """One row per (answer run, slot it reaches into)."""
    first = _whole(F.col("start"), width)
    final = _whole(F.col("start") + F.col("n") - 1, width)
    return places.select(
        F.col("split").alias("_split"),
        F.col("answer").alias("_answer"),
        F.col("start").alias("_from"),
        (F.col("start") + F.col("n")).alias("_to"),
        F.explode(F.sequence(first, final)).alias("_slot"),
    )


def _by_broadcast(drawn, places, known, columns, out) -> DataFrame:
    """Few distinct answers: a hash join on narrow slots, rows stay where they are."""
    width = F.lit(max(1, max((r["_size"] for r in known.values()), default=1) // 65_536))
    runs = _slotted(places, width)
    probe = drawn.withColumn("_slot", _whole(F.col("_place"), width))
    hit = (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))
    return (
        probe.join(F.broadcast(runs.withColumnsRenamed({"_split": "_s", "_slot": "_t"})),
                   (F.col("_split") == F.col("_s")) & (F.col("_slot") == F.col("_t")) & hit)
        .select(*columns, F.col("_answer").alias(out))
    )


def _by_slots(drawn, places, known, columns, out, slot, row_id) -> DataFrame:
    """Many distinct answers: rows and run starts meet per slot, each row takes the last start before it.

    Draws are even over the places; more rows than places are dealt out over salted copies of the slots.
    """
    counts = {r["_split"]: r["count"] for r in drawn.groupBy("_split").count().collect()}
    salts = max([1, *[-(-counts.get(s, 0) // r["_size"]) for s, r in known.items()]])
    width = F.lit(slot)
    starts = _slotted(places, width).select(
        "_split", "_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"),
        F.greatest("_from", F.col("_slot") * width).alias("_place"), F.lit(0).alias("_kind"), "_answer",
        F.lit(None).cast(drawn.select(F.struct(*columns).alias("r")).schema["r"].dataType).alias("_row"),
    )
    asks = drawn.select(
        "_split", _whole(F.col("_place"), width).alias("_slot"),
        F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts).cast("long")).alias("_salt"),
        "_place", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_answer"), F.struct(*columns).alias("_row"),
    )
    before = W.partitionBy("_split", "_slot", "_salt").orderBy("_place", "_kind").rowsBetween(W.unboundedPreceding, 0)
    return (
        starts.unionByName(asks)
        .withColumn(out, F.last("_answer", ignorenulls=True).over(before))
        .where(F.col("_kind") == 1)
        .select("_row.*", out)
    )


def replace_answer(choices: str, key: str, negative: str) -> Column:
    """The choices struct with the right answer's text replaced."""
    place = F.array_position(F.col(f"{choices}.label"), F.col(key)) - 1
    texts = F.transform(
        F.col(f"{choices}.text"), lambda t, i: F.when(i == place, F.col(negative)).otherwise(t)
    )
    return F.struct(texts.alias("text"), F.col(f"{choices}.label").alias("label"))
