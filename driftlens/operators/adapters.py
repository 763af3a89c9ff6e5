"""Adapters from raw corpus columns to the two table shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.functions.hashing import hash_hex
from driftlens.operators.ordering import running_total
from driftlens.session import broadcast_if_small

NO_ANSWER = "None"
ORDER_COLUMNS = ("row_id", "split", "part", "order_key")


def joined(first: str, second: str) -> Column:
    """Two fields with a space between; NULL when either is NULL."""
    return F.concat(F.col(first), F.lit(" "), F.col(second))


def _replace(df: DataFrame, drop: Sequence[str], **new: Column) -> DataFrame:
    kept = [c for c in df.columns if c not in drop and c not in new]
    return df.select(*kept, *[value.alias(name) for name, value in new.items()])


def to_classification(df: DataFrame, first: str, second: str | None = None, label: str = "label") -> DataFrame:
    """{text, labels}: one field or two joined by a space; label 0 when the column is absent."""
    text = F.col(first) if second is None else joined(first, second)
    labels = F.col(label).cast("int") if label in df.columns else F.lit(0)
    keys = [c for c in ORDER_COLUMNS if c in df.columns]
    return df.select(*keys, text.alias("text"), labels.alias("labels"))


def to_generation(df: DataFrame, source: str | Column, target: str | Column) -> DataFrame:
    """{source, target} from two columns or expressions."""
    source = F.col(source) if isinstance(source, str) else source
    target = F.col(target) if isinstance(target, str) else target
    keys = [c for c in ORDER_COLUMNS if c in df.columns]
    return df.select(*keys, source.alias("source"), target.alias("target"))


def concat_fields(df: DataFrame, first: str, second: str, out: str = "text") -> DataFrame:
    return _replace(df, (first, second), **{out: joined(first, second)})


def rename_fields(df: DataFrame, **names: str) -> DataFrame:
    """Keep the keys and the named fields: rename_fields(df, text="TWEET", label="LABEL")."""
    keys = [c for c in ORDER_COLUMNS if c in df.columns]
    return df.select(*keys, *[F.col(old).alias(new) for new, old in names.items()])


def pick_pair(df: DataFrame, source: str, target: str, column: str = "translation") -> DataFrame:
    """source/target out of a language-keyed map or struct."""
    return to_generation(df, F.col(column)[source], F.col(column)[target])


def orient_pair(df: DataFrame, source_lang: str) -> DataFrame:
    """The first test row tells whether sourceString really is in the source language."""
    lang = df.where(F.col("split") == "test").agg(F.min_by("sourceLang", "row_id")).scalar()
    straight = lang == source_lang
    return to_generation(
        df,
        F.when(straight, F.col("sourceString")).otherwise(F.col("targetString")),
        F.when(straight, F.col("targetString")).otherwise(F.col("sourceString")),
    )


def const_target(df: DataFrame, source: str, target: str | None = "a") -> DataFrame:
    """A constant target; with None the source is its own target."""
    return to_generation(df, F.col(source), F.lit(target) if target is not None else F.col(source))


def first_elem(df: DataFrame, column: str, out: str, strict: bool = True) -> DataFrame:
    """First array element; an empty array raises when strict, else gives NULL."""
    value = F.element_at(column, 1) if strict else F.get(column, F.lit(0))
    return _replace(df, (column,), **{out: value})


def answer_of(choices: str = "choices", key: str = "answerKey") -> Column:
    """Text of the choice whose label is the answer key; raises when there is none."""
    place = F.array_position(F.col(f"{choices}.label"), F.col(key)).cast("int")
    known = F.when(place > 0, place).otherwise(
        F.raise_error(F.concat(F.lit("no choice is labelled "), F.col(key))).cast("int")
    )
    return F.element_at(F.col(f"{choices}.text"), known)


def shift_label(df: DataFrame, column: str, shift: int = 0, out: str = "label") -> DataFrame:
    return _replace(df, (column,), **{out: F.col(column).cast("int") + F.lit(shift)})


def map_labels(df: DataFrame, mapping: Mapping[str, int], column: str = "label", out: str = "label") -> DataFrame:
    """Fixed dictionary; an unknown key raises."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    code = F.element_at(table, F.col(column))
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(column), F.lit("NULL"))))
    return _replace(df, (column,), **{out: F.when(code.isNotNull(), code).otherwise(unknown.cast("int"))})


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): distinct labels in descending order, numbered from 0."""
    distinct = df.select(F.col(column).alias("label")).where(F.col(column).isNotNull()).distinct()
    # Code point of the first character, negated: an ascending bucket for a descending order.
    coded = distinct.withColumn("_b", -F.ascii("label")).withColumn("_one", F.lit(1))
    numbered = running_total(coded, [], "_b", [F.desc("label")], "_one", "code")
    return numbered.select("label", F.col("code").cast("int").alias("code"))


def lookup_labels(df: DataFrame, codes: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Attach learnt codes; a label the codes do not know raises."""
    dim = broadcast_if_small(codes.select(F.col("label").alias("_name"), F.col("code").alias("_code")))
    unknown = F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(column), F.lit("NULL"))))
    tagged = df.join(dim, F.col(column) == F.col("_name"), "left")
    code = F.when(F.col("_code").isNotNull(), F.col("_code")).otherwise(unknown.cast("int"))
    return _replace(tagged, (column, "_name", "_code"), **{out: code})


def label_by_subset(dfs: Sequence[DataFrame], out: str = "label") -> DataFrame:
    """Union of named subsets, labelled by their place in the list."""
    return reduce(
        lambda a, b: a.unionByName(b), [df.withColumn(out, F.lit(i)) for i, df in enumerate(dfs)]
    )


def parse_tsv_qa(df: DataFrame, column: str = "text") -> DataFrame:
    """'1 question<TAB>answer' lines: exactly one tab, first character of the question dropped."""
    fields = F.split(F.col(column), "\t", -1)
    checked = F.when(F.size(fields) == 2, fields).otherwise(
        F.raise_error(F.lit("a line needs exactly one tab")).cast("array<string>")
    )
    question = F.element_at(checked, 1)
    return to_generation(df, F.substring(question, 2, 2**31 - 1), F.element_at(checked, 2))


def flatten_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def shuffled(elements: Column, row_id: Column, seed: int = 42) -> Column:
    """Seeded order of an array's elements; repeats stay."""
    tagged = F.transform(elements, lambda e, i: F.struct(hash_hex(seed, row_id, e, i).alias("h"), e.alias("e")))
    return F.transform(F.array_sort(tagged), lambda s: s["e"])


def add_instruction(df: DataFrame, instruction: str, column: str = "source") -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(instruction), F.col(column)))


def zip_explode(df: DataFrame, first: str, second: str, names: tuple[str, str]) -> DataFrame:
    """Parallel arrays to one row per pair; the shorter one decides, other columns repeat."""
    a, b = F.col(first), F.col(second)
    shared = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(
        F.slice(a, F.lit(1), shared), F.slice(b, F.lit(1), shared),
        lambda x, y: F.struct(x.alias(names[0]), y.alias(names[1])),
    )
    kept = [c for c in df.columns if c not in (first.split(".")[0], second.split(".")[0])]
    return df.select(*kept, F.posexplode(pairs).alias("pos", "_pair")).select(*kept, "pos", "_pair.*")


def flatten_structs(df: DataFrame, sep: str = "+") -> DataFrame:
    """Nested structs to flat columns named by their path."""

    def leaves(schema, path: tuple[str, ...] = ()):
        for field in schema.fields:
            here = (*path, field.name)
            if field.dataType.typeName() == "struct":
                yield from leaves(field.dataType, here)
            else:
                yield here

    quoted = [(".".join(f"`{p}`" for p in path), sep.join(path)) for path in leaves(df.schema)]
    return df.select(*[F.col(source).alias(name) for source, name in quoted])


def reshape_sequences(df: DataFrame, column: str, per_sample: int, out: str = "value") -> DataFrame:
    """A flat list of N * R sequences to (sample_id, seq_id, value): R sequences per sample."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(column).alias("_pos", out)).select(
        *kept,
        F.floor(F.col("_pos") / per_sample).alias("sample_id"),
        (F.col("_pos") % per_sample).alias("seq_id"),
        out,
    )


def pad_matrix(df: DataFrame, column: str) -> DataFrame:
    """Zero-pad every array to the longest one; ``length`` keeps the true size."""
    longest = df.agg(F.max(F.size(column))).scalar()
    missing = (longest - F.size(column)).cast("int")
    return df.withColumn("length", F.size(column)).withColumn(
        column, F.concat(F.col(column), F.array_repeat(F.lit(0.0), missing))
    )
