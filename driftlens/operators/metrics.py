"""Task metrics of generated texts against references, one row per (sample, sequence).

``keys`` are the columns kept beside the scores, the identifying ones first; with all columns of the pairs a
metric is added in place and nothing has to be joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions.lcs import rouge_l as lcs_rouge
from driftlens.functions.lcs import rouge_lsum as lcs_rouge_sum
from driftlens.functions.text import joined_stems, mteval_words, rouge_words, shared_ngrams
from driftlens.operators import pairing
from driftlens.operators.detectors.projection import cosine
from driftlens.session import BROADCAST_ROWS, dealt, is_small, materialize, text_batches

KEYS = ("sample_id", "seq_id")
PRF = "precision double, recall double, fmeasure double"
Tokenizer = Callable[[Column], Column]

# Texts that look up their stems together, where the table of stems is large.
STEM_BLOCK_BYTES = 4 << 20


def ngram_overlap(
    pairs: DataFrame, tokenizer: Tokenizer, max_n: int, hyp: str = "hyp", ref: str = "ref", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Per pair: token counts hyp_len, ref_len and clipped n-gram matches match_1 ... match_n.

    All within the row, so no n-gram is shuffled and a pair of any length stays where it was read.
    """
    text_batches(pairs.sparkSession)
    tokens = pairs.select(*keys, tokenizer(F.col(hyp)).alias("_h"), tokenizer(F.col(ref)).alias("_r"))
    counted = tokens.withColumn("_shared", shared_ngrams(F.col("_h"), F.col("_r"), max_n))
    return counted.select(
        *keys,
        F.size("_h").alias("hyp_len"),
        F.size("_r").alias("ref_len"),
        *[F.col("_shared")[n - 1].alias(f"match_{n}") for n in range(1, max_n + 1)],
    )


def _bleu(hyp_len: Column, ref_len: Column, matches: Sequence[Column], effective: bool) -> Column:
    """BLEU on 0-100 with exponential smoothing; effective order leaves out orders the text is too short for."""
    log_sum, orders, misses = F.lit(0.0), F.lit(0), F.lit(0)
    for n, match in enumerate(matches, start=1):
        room = hyp_len - (n - 1)
        missed = (room > 0) & (match == 0)
        misses = misses + F.when(missed, 1).otherwise(0)
        share = F.when(missed, 100.0 / (F.pow(F.lit(2.0), misses) * room)).otherwise(100.0 * match / room)
        log_sum = log_sum + F.when(room > 0, F.log(share)).otherwise(0.0)
        orders = orders + F.when(room > 0, 1).otherwise(0)
    brevity = F.when(hyp_len >= ref_len, 1.0).otherwise(F.exp(F.lit(1.0) - ref_len / hyp_len))
    full = len(matches)
    nothing = reduce(lambda a, b: a + b, matches) == 0
    too_short = F.lit(False) if effective else hyp_len < full
    return F.when((hyp_len == 0) | nothing | too_short, 0.0).otherwise(
        brevity * F.exp(log_sum / (orders if effective else F.lit(full)))
    )


def sentence_bleu(
    pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", tokenizer: Tokenizer = mteval_words, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Sentence BLEU with effective order."""
    counts = ngram_overlap(pairs, tokenizer, 4, hyp, ref, keys)
    score = _bleu(F.col("hyp_len"), F.col("ref_len"), [F.col(f"match_{n}") for n in range(1, 5)], effective=True)
    return counts.select(*keys, score.alias("bleu"))


def corpus_bleu(
    pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", tokenizer: Tokenizer = mteval_words, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One row: BLEU over the summed counts of all pairs, texts stripped first."""
    stripped = pairs.withColumns({hyp: F.trim(hyp), ref: F.trim(ref)})
    counts = ngram_overlap(stripped, tokenizer, 4, hyp, ref, keys)
    sums = counts.agg(
        F.sum("hyp_len").alias("hyp_len"),
        F.sum("ref_len").alias("ref_len"),
        *[F.sum(f"match_{n}").alias(f"match_{n}") for n in range(1, 5)],
        *[F.sum(F.greatest(F.col("hyp_len") - (n - 1), F.lit(0))).alias(f"room_{n}") for n in range(1, 5)],
    )
    rooms = [F.col(f"room_{n}") for n in range(1, 5)]
    matches = [F.col(f"match_{n}") for n in range(1, 5)]
    log_sum, misses = F.lit(0.0), F.lit(0)
    for room, match in zip(rooms, matches):
        misses = misses + F.when((room > 0) & (match == 0), 1).otherwise(0)
        share = F.when(match == 0, 100.0 / (F.pow(F.lit(2.0), misses) * room)).otherwise(100.0 * match / room)
        log_sum = log_sum + F.when(room > 0, F.log(share)).otherwise(0.0)
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(
        F.exp(F.lit(1.0) - F.col("ref_len") / F.col("hyp_len"))
    )
    empty = (rooms[-1] == 0) | (reduce(lambda a, b: a + b, matches) == 0)
    return sums.select(
        F.when(empty, 0.0).otherwise(brevity * F.exp(log_sum / 4)).alias("bleu"), "hyp_len", "ref_len"
    )


def rouge_n(
    pairs: DataFrame,
    orders: Sequence[int] = (1, 2),
    hyp: str = "hyp",
    ref: str = "ref",
    tokenizer: Tokenizer = rouge_words,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """rouge{n}_precision / _recall / _fmeasure for each order."""
    counts = ngram_overlap(pairs, tokenizer, max(orders), hyp, ref, keys)
    return counts.select(*keys, *_ngram_shares(orders, {n: F.col(f"match_{n}") for n in orders}))


def _ngram_shares(orders: Sequence[int], matches: Mapping[int, Column]) -> list[Column]:
    columns = []
    for n in orders:
        match = matches[n].cast("double")

        def share(size: str) -> Column:
            room = F.col(size) - (n - 1)
            return F.when(room > 0, match / room).otherwise(0.0)

        precision, recall = share("hyp_len"), share("ref_len")
        f = F.when(match > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        columns += [
            precision.alias(f"rouge{n}_precision"), recall.alias(f"rouge{n}_recall"), f.alias(f"rouge{n}_fmeasure")
        ]
    return columns


def _parts(score: Column, name: str) -> list[Column]:
    return [score[f].alias(f"{name}_{f}") for f in ("precision", "recall", "fmeasure")]


def _sequence_score(hyp: Column, ref: Column) -> Column:
    return F.arrow_udf(lcs_rouge, PRF)(hyp, ref)


def _scored(pairs: DataFrame, keys: Sequence[str], score: Column, name: str) -> DataFrame:
    text_batches(pairs.sparkSession)
    return pairs.select(*keys, score.alias("_s")).select(*keys, *_parts(F.col("_s"), name))


def rouge_l(
    pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", tokenizer: Tokenizer = rouge_words, keys: Sequence[str] = KEYS
) -> DataFrame:
    """rougeL over whole texts; long ones are costly and are dealt out evenly first."""
    texts = dealt(pairs.select(*dict.fromkeys([*keys, hyp, ref])), *keys[:2])
    return _scored(texts, keys, _sequence_score(tokenizer(F.col(hyp)), tokenizer(F.col(ref))), "rougeL")


def sentences(text: Column) -> Column:
    """Sentences end at a full stop or a line break."""
    return F.filter(F.split(text, r"[\n.]+"), lambda s: F.trim(s) != "")


def _union_score(hyp: Column, ref: Column, tokenizer: Tokenizer) -> Column:
    return F.arrow_udf(lcs_rouge_sum, PRF)(F.transform(sentences(hyp), tokenizer), F.transform(sentences(ref), tokenizer))


def rouge_lsum(
    pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", tokenizer: Tokenizer = rouge_words, keys: Sequence[str] = KEYS
) -> DataFrame:
    """rougeLsum: union LCS per reference sentence over all hypothesis sentences."""
    texts = dealt(pairs.select(*dict.fromkeys([*keys, hyp, ref])), *keys[:2])
    return _scored(texts, keys, _union_score(F.col(hyp), F.col(ref), tokenizer), "rougeLsum")


def corpus_rouge(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row: mean F-measures of all pairs, texts stripped first. One scan; each pair is dealt out once and gets all its scores from one worker."""
    text_batches(pairs.sparkSession)
    texts = dealt(pairs.select(*keys, F.trim(hyp).alias("_hyp"), F.trim(ref).alias("_ref")), *keys[:2])
    tokens = texts.select("_hyp", "_ref", rouge_words(F.col("_hyp")).alias("_h"), rouge_words(F.col("_ref")).alias("_r"))
    scored = tokens.select(
        F.size("_h").alias("hyp_len"),
        F.size("_r").alias("ref_len"),
        shared_ngrams(F.col("_h"), F.col("_r"), 2).alias("_shared"),
        _sequence_score(F.col("_h"), F.col("_r")).alias("_l"),
        _union_score(F.col("_hyp"), F.col("_ref"), rouge_words).alias("_lsum"),
    )
    shares = _ngram_shares((1, 2), {n: F.col("_shared")[n - 1] for n in (1, 2)})
    scores = scored.select(*shares, *_parts(F.col("_l"), "rougeL"), *_parts(F.col("_lsum"), "rougeLsum"))
    return scores.agg(*[F.avg(f"{name}_fmeasure").alias(name) for name in ("rouge1", "rouge2", "rougeL", "rougeLsum")])


def stemmed(
    tokenizer: Tokenizer,
    pairs: DataFrame,
    stem_map: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    max_broadcast: int = BROADCAST_ROWS,
    block_bytes: int = STEM_BLOCK_BYTES,
) -> DataFrame:
    """Replace each text by its stemmed tokens, joined by spaces, with a (token, stem) table.

    Tokens the table does not hold stay as they are; several stems of a token follow each other in order. A small table is sent to all
    tasks and no row moves. With a larger one, texts meet in blocks, of which only the different tokens are joined to the table.
    """
    text_batches(pairs.sparkSession)
    own = F.coalesce("stem", "token")
    stems = stem_map.where("token IS NOT NULL").groupBy("token").agg(F.array_join(F.array_sort(F.collect_list(own)), " ").alias("stem"))
    stems = materialize(stems.where(F.col("token") != F.col("stem")))
    others = [c for c in pairs.columns if c not in keys and c not in columns]
    tokens = [F.coalesce(tokenizer(F.col(c)), F.array().cast("array<string>")).alias(c) for c in columns]
    if is_small(stems, max_broadcast):
        table = stems.toArrow()
        shared = pairs.sparkSession.sparkContext.broadcast(tuple(table[c].combine_chunks() for c in ("token", "stem")))

        def look(lists: pa.Array) -> pa.Array:
            return joined_stems(lists, *shared.value)

        texts = F.arrow_udf(look, "string")
        return pairs.select(*keys, *others, *tokens).select(*keys, *others, *[texts(F.col(c)).alias(c) for c in columns])

    content = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in columns)
    n_blocks = max(1, (pairs.agg(F.sum(content)).first()[0] or 0) // block_bytes)
    rows = pairs.select(*keys, *others, *tokens, F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).alias("_block"))
    # Rows of a block lie together before its tokens are made distinct, so a token leaves a block once.
    seen = dealt(rows.select("_block", F.array_distinct(F.concat(*columns)).alias("_t")), "_block")
    seen = seen.select(F.col("_block").alias("_of"), F.explode("_t").alias("token")).distinct().join(stems, "token")
    schema = T.StructType([pairs.schema[c] for c in (*keys, *others)] + [T.StructField(c, T.StringType()) for c in columns])

    def stem(block: pa.Table, known: pa.Table) -> pa.Table:
        names, values = (known[c].combine_chunks() for c in ("token", "stem"))
        changed = {c: joined_stems(block[c].combine_chunks(), names, values) for c in columns}
        return pa.table({c: changed.get(c, block[c]) for c in schema.names})

    return rows.groupBy("_block").cogroup(seen.groupBy("_of")).applyInArrow(stem, schema)


def bert_greedy(
    tokens: DataFrame, baseline: float = 0.0, pair: str = "pair_id", block_rows: int = pairing.BLOCK_ROWS
) -> DataFrame:
    """Greedy embedding match of (pair_id, side, pos, vector) rows: precision, recall, F1, rescaled by the baseline.

    ``side`` is "hyp" or "ref" and ``pos`` counts the tokens of a side. Long texts meet in blocks.
    """

    def best(of: str, against: str, name: str) -> DataFrame:
        def emit(keys, mine, others, theirs):
            _, scores = pairing.best_partners(cosine(mine, theirs), others, 1, largest=True)
            return {**keys, "best": scores[:, 0]}

        left = tokens.where(F.col("side") == of).select(pair, F.col("pos").cast("long").alias("pos"), "vector")
        right = tokens.where(F.col("side") == against).select(pair, F.col("pos").cast("long").alias("other"), "vector")
        found, several = pairing.within_group(
            left, right, pair, emit, f"pos long, best double, {pair} long", ["pos"], "other", block_rows=block_rows
        )
        if several:
            found = found.groupBy(pair, "pos").agg(F.max("best").alias("best"))
        return found.groupBy(pair).agg(F.avg("best").alias(name))

    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0)
    raw = best("hyp", "ref", "precision").join(best("ref", "hyp", "recall"), pair).withColumn("f1", f1)
    return raw.select(pair, *[((F.col(c) - baseline) / (1 - baseline)).alias(c) for c in ("precision", "recall", "f1")])
