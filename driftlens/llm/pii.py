"""Personal data: patterns, and terms that the corpus shows to reveal them. DataFrame functions only.

Every value that a pattern finds (an address, a number) is a protected entity. A term (a word of three letters or more) anywhere in a document
with the entity reveals it as far as the corpus lets one conclude from the term to the entity: with document counts n over N documents, the
pointwise mutual information log(n(t, e) N / (n(t) n(e))) divided by the entity's own information log(N / n(e)). At GENERALISE or more every
occurrence of the term in documents with the entity is a span too, and is written as a placeholder; at REMOVE or more it is cut out. A pair
counts from SUPPORT documents on. A text without personal data stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions.vectors import let
from driftlens.session import materialize

SUPPORT = 2
GENERALISE = 0.8
REMOVE = 0.95

# The patterns start a match only where a leftmost one can start, and never step back: a long run costs one pass. They find what
# the plain forms find, except for digit groups that are too short for a card number, which would be dropped anyway.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
TERM = r"\p{L}{3,}+"
_PLACE = "array<struct<start:int,end:int,value:string>>"
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
_REVEALING = "array<struct<start:int,end:int,ratio:double>>"


def located(text: Column, pattern: str) -> Column:
    """Matches with their places in code points: the gaps between them come from a split by the same pattern."""

    def places(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(found))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + F.char_length(x["gap"])
            end = start + F.char_length(x["value"])
            place = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(place)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACE).alias("out"))
        pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
        return F.when(F.size(found) == 0, F.array().cast(_PLACE)).otherwise(
            F.aggregate(pairs, begin, step, lambda state: state["out"])
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + weighed(i)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    count = F.char_length(_digits(value))
    if kind == "card":
        return F.when(count.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return count.between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans of all kinds by start, then kind as listed."""
    hints = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}

    def of(rank: int, kind: str) -> Column:
        def span(p: Column) -> Column:
            return F.struct(
                p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value")
            )

        spans = F.transform(F.filter(located(text, PATTERNS[kind]), lambda p: _holds(kind, p["value"])), span).cast(_SPAN)
        return F.when(hints[kind], spans).otherwise(F.array().cast(_SPAN)) if kind in hints else spans

    parts = [of(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def _entity(span: Column) -> Column:
    return F.xxhash64(span["kind"], F.lower(span["value"]))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, base: one pass of the patterns over whole texts (NULL: empty)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))


def _words(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    long = F.filter(F.array_distinct(F.split(text, r"[^\p{L}]+")), lambda w: F.char_length(w) >= 3)
    return F.array_distinct(F.transform(long, F.lower))


def _text_set() -> list[Column]:
    """128 bits that tell which different texts a group has; each text is there once."""
    return [F.bit_xor(F.xxhash64("text_id", F.lit(salt))) for salt in (0, 1)]


def revealing_terms(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """text_id, term, ratio: for each text its terms at GENERALISE or more for one of its entities, with the highest ratio.

    `texts` has text_id, n (its documents), text, base per different text with personal data. Entities that are in the same texts, and terms
    that are, meet as one, so neither copies nor long texts multiply pairs. As n(t, e) <= n(e), only terms with n(t) <= n(e)^G N^(1 - G)
    can reach a ratio of G; others are left out before they meet.
    """
    documents = docs.count()

    def limit(n_entity: Column) -> Column:
        return F.pow(n_entity, F.lit(GENERALISE)) * documents ** (1 - GENERALISE) * (1 + 1e-9)

    entities = texts.select("text_id", "n", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    first, second = _text_set()
    shared = entities.groupBy("entity").agg(F.sum("n").alias("n_entity"), first.alias("e0"), second.alias("e1"))
    shared = shared.where((F.col("n_entity") >= SUPPORT) & (F.col("n_entity") < documents))
    groups = materialize(entities.join(shared, "entity").select("text_id", "n_entity", "e0", "e1").distinct())
    most = groups.agg(F.max("n_entity")).first()[0] or 0

    counts = docs.select(F.explode(_words(F.col("text").cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = counts.where((F.col("n_term") >= SUPPORT) & (F.col("n_term") <= limit(F.lit(most))))
    held = texts.join(groups.select("text_id").distinct(), "text_id", "left_semi")
    held = materialize(held.select("text_id", "n", F.explode(_words(F.col("text"))).alias("term")).join(counts, "term"))
    kinds = held.groupBy("term").agg(first.alias("t0"), second.alias("t1"))
    held = materialize(held.join(kinds, "term"))

    meetings = held.select("text_id", "n", "n_term", "t0", "t1").distinct().join(groups, "text_id").where(F.col("n_term") <= limit(F.col("n_entity")))
    pair = ["e0", "e1", "n_entity", "t0", "t1", "n_term"]
    told = F.log(F.col("n_both") * F.lit(float(documents)) / (F.col("n_term") * F.col("n_entity")))
    ratios = (
        meetings.groupBy(*pair).agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= SUPPORT)
        .select(*pair, (told / F.log(F.lit(float(documents)) / F.col("n_entity"))).alias("ratio"))
        .where(F.col("ratio") >= GENERALISE)
    )
    term = ["text_id", "t0", "t1", "n_term"]
    best = meetings.join(ratios, pair).groupBy(*term).agg(F.max("ratio").alias("ratio"))
    return materialize(held.join(best, term).select("text_id", "term", "ratio"))


def occurrences(texts: DataFrame) -> DataFrame:
    """text_id, term, start, end: every term of the texts (text_id, text, base) that overlaps no base span. Sorted sweeps: time grows with the text."""
    gaps, found = F.split("text", TERM), F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    words = texts.select("text_id", F.posexplode(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(F.char_length(g).alias("gap"), v.alias("value")))))
    size = F.char_length("col.value")
    end = F.sum(F.col("col.gap") + size).over(W.partitionBy("text_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    words = words.select("text_id", F.lower("col.value").alias("term"), size.alias("size"), end.cast("int").alias("end"))
    none = F.lit(None)
    spans = texts.select("text_id", F.explode("base").alias("s")).select(
        "text_id", F.col("s.start").alias("at"), F.lit(0).alias("later"), F.col("s.end").alias("reach"), none.cast("string").alias("term"), none.cast("int").alias("start"), none.cast("int").alias("end")
    )
    words = words.select("text_id", (F.col("end") - 1).alias("at"), F.lit(1).alias("later"), none.cast("int").alias("reach"), "term", (F.col("end") - F.col("size")).alias("start"), "end")
    so_far = W.partitionBy("text_id").orderBy("at", "later").rowsBetween(W.unboundedPreceding, 0)
    swept = spans.unionAll(words).withColumn("reach", F.coalesce(F.max("reach").over(so_far), F.lit(0)))
    return swept.where((F.col("later") == 1) & (F.col("reach") <= F.col("start"))).select("text_id", "term", "start", "end")


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, base, text_hash, the last for documents with personal data; text_hash, revealing: term spans with their ratio, where there are any)."""
    held = F.size("base") > 0
    seen = materialize(marked(docs).select("doc_id", "base", F.when(held, F.col("text")).alias("text"), F.when(held, _hash(F.col("text"))).alias("text_hash")))
    texts = seen.where(held).groupBy("text_hash").agg(F.count("*").alias("n"), F.first(F.struct("text", "base")).alias("t"))
    texts = materialize(texts.select(F.monotonically_increasing_id().alias("text_id"), "text_hash", "n", "t.*"))
    revealing = revealing_terms(docs, texts)
    spots = occurrences(texts.join(revealing.select("text_id").distinct(), "text_id", "left_semi")).join(revealing, ["text_id", "term"])
    places = spots.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "ratio"))).alias("revealing"))
    return seen.drop("text"), texts.select("text_id", "text_hash").join(places, "text_id").drop("text_id")


def _with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    joined = rows.join(places, "text_hash", "left").drop("text_hash")
    return joined.withColumn("revealing", F.coalesce("revealing", F.array().cast(_REVEALING)))


def _all_spans(base: Column, revealing: Column) -> Column:
    terms = F.transform(
        revealing,
        lambda t: F.struct(
            t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), t["end"].alias("end"), F.lit("term").alias("kind"), t["ratio"].cast("string").alias("value")
        ),
    ).cast(_SPAN)
    return F.array_sort(F.concat(base, terms))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: one row per document.

    NULL text counts as empty (no spans). Rows that repeat are documents of their own, each with its row and its count. NULL ids are kept.
    Spans of different kinds may overlap. Other columns are not read; an empty table gives an empty table.
    """
    seen, places = find(docs)
    plain = seen.where(F.size("base") == 0).select("doc_id", "base", F.array().cast(_REVEALING).alias("revealing"))
    rows = plain.unionByName(_with_places(seen.where(F.size("base") > 0), places))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(_all_spans(F.col("base"), F.col("revealing"))).alias("spans"),
        F.size("revealing").cast("long").alias("n_term"),
    )


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span written as [KIND], and terms at REMOVE or more cut out. Of overlapping spans the first stays; the rest of a later one goes too."""

    def of(chars: Column) -> Column:
        def part(start: Column, size: Column) -> Column:
            return F.array_join(F.slice(chars, start + 1, size), "")

        def step(state: Column, s: Column) -> Column:
            start = F.greatest(state["at"], s["start"])
            removed = (s["kind"] == "term") & (s["value"].try_cast("double") >= REMOVE)
            shown = F.when(removed | (s["start"] < state["at"]), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], part(state["at"], start - state["at"]), shown).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.aggregate(spans, begin, step, lambda state: F.concat(state["out"], part(state["at"], F.size(chars) - state["at"])))

    # A place in a text is found by reading it from its start, one in an array at once.
    return let(F.split(text, ""), of)


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with sanitised texts; n_chars, if there is such a column, is that of the new text. Rows without spans stay as they are.

    All columns are kept, whatever their names. A NULL text stays NULL.
    """
    _, places = find(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), base_spans(text).alias("base"), row.alias("row"))
    untouched = rows.where(F.size("base") == 0).select("row.*")
    touched = _with_places(rows.where(F.size("base") > 0).withColumn("text_hash", _hash(F.col("text"))), places)
    clean = sanitised(F.col("text"), _all_spans(F.col("base"), F.col("revealing")))
    touched = touched.select("row", clean.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    columns = [(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return untouched.unionAll(touched.select(*columns))
