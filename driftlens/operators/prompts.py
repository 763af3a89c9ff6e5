"""Prompt templates as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The exact prompt text of each corpus.
TEMPLATES = {
    "openbookqa": "Context:{context} ; Question: {question} ; Choices: {choices}",
    "ai2_arc": "Context: ; Question: {question} ; Choices: {choices}",
    "sciq": "Context:{context} ; Question: {question} ; Choices: {choices}",
    "trivia_qa": "Context: {context} ; Question: {question}",
    "coqa": "Context: {context} ; Question: {question}",
    "tweetqa": "Context:{context} ; Question: {question}",
    "natural_instructions": "{context}.\n {question}",
    "quartz": "Context:{context} ; Question: {question}",
    "squad_v2": "Context:{context} ; Question: {question}",
    "cuad": "Context:{context} ; Question: {question}",
}
CHOICE_SEPARATOR = " - "
QUARTZ_SEPARATOR = "- "


def prompt(template: str, **fields: Column) -> Column:
    """Fill a template's {fields} with columns; NULL in any field gives NULL."""
    parts = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(fields[field])
    return F.concat(*parts)


def choice_list(choices: Column, separator: str = CHOICE_SEPARATOR) -> Column:
    return F.array_join(choices, separator)
