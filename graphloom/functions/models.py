"""Deterministic stand-ins for learned models, and the registry that replaces them.

A model is a callable on columns.  ``register`` puts another under the same name,
such as one that wraps a pandas UDF around a real model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import jaccard, phrase, words

_MODELS: dict[str, Callable] = {}


def register(name: str, model: Callable | None = None):
    """Register a callable, also as a decorator."""

    def put(f: Callable) -> Callable:
        _MODELS[name] = f
        return f

    return put(model) if model else put


def model(name: str) -> Callable:
    if name not in _MODELS:
        raise KeyError(f"no model named {name!r}; there are {sorted(_MODELS)}")
    return _MODELS[name]


@register("embed")
def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Signed hashing of words to a unit vector; blank text is embedded as ``none``."""
    shown = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("none")).otherwise(text)
    tokens = F.filter(F.split(F.lower(shown), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    held = F.array(F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dim))))
    # how many tokens fall into a cell is told by what is left without them
    count = lambda cells: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (F.size(F.array_remove(cells, i + dim)) - F.size(F.array_remove(cells, i))).cast("double"),
    )
    counts = F.element_at(F.transform(held, count), 1)
    # arrays of one element name what is used more than once, so it is made once
    sized = F.transform(F.array(counts), lambda c: F.struct(c.alias("c"), F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return F.element_at(F.transform(sized, lambda s: F.transform(s["c"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0))), 1)


@register("rerank")
def overlap_score(query: Column, passage: Column) -> Column:
    """Jaccard of words."""
    return jaccard(F.array_distinct(words(query)), F.array_distinct(words(passage)))


@register("summarize")
def first_sentences(text: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^.!?\u3002\uff01\uff1f]+[.!?\u3002\uff01\uff1f]?"), F.lit(0)), 1, n), "")


@register("entities")
def capitalised_entities(text: Column) -> Column:
    """Distinct capitalised words: a stand-in for named-entity recognition."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z]{2,})\b"), F.lit(1)))


@register("questions")
def stock_questions(text: Column) -> Column:
    """One question about each entity of the text."""
    return F.transform(capitalised_entities(text), lambda e: F.concat(F.lit("What is "), e, F.lit("?")))


@register("cuts")
def middle_sentence(text: Column) -> Column:
    """Where to cut a text: the first sentence that starts in its second half, with its first words as abstract."""
    at = F.call_function("locate", F.lit(". "), text, F.floor(F.length(text) / 2).cast("int") + 1) + 1
    mark = F.struct(at.cast("int").alias("at"), F.substring_index(F.ltrim(F.substr(text, at + 1, F.lit(80))), " ", 5).alias("abstract"))
    return F.when(at > 1, F.array(mark)).otherwise(F.array().cast("array<struct<at:int,abstract:string>>"))


@register("answer")
def nearest_sentence(question: Column, context: Column) -> Column:
    """The sentence of the context that shares most words with the question, the first of equals; null without any."""
    asked = F.array_distinct(words(question))
    cut = F.filter(F.transform(F.regexp_extract_all(context, F.lit(r"[^.!?\u3002\uff01\uff1f\n]+[.!?\u3002\uff01\uff1f]?"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")
    ranked = F.array_sort(F.transform(cut, lambda s, i: F.struct((-jaccard(asked, F.array_distinct(words(s)))).alias("far"), i.alias("i"), s.alias("s"))))
    return F.try_element_at(ranked, F.lit(1))["s"]


@register("rewrite")
def without_question_words(text: Column) -> Column:
    """Other wordings of a question: what is left without its question words, and each part between commas and ``and``."""
    bare = F.trim(F.regexp_replace(text, r"(?i)^\s*(?:(?:who|what|which|where|when|how|why|is|are|was|were|does|do|did|the)\b\s*)+", ""))
    return F.array_except(F.array_distinct(F.concat(F.array(bare), F.transform(F.split(bare, r"(?i),|\band\b"), lambda x: F.trim(x)))), F.array(text, F.lit("")))


@register("judge")
def is_answer(answer: Column) -> Column:
    """Whether there is an answer that does not say that it knows none."""
    return F.coalesce((F.trim(answer) != "") & ~F.lower(answer).rlike("i don't know|unknown|no answer"), F.lit(False))


@register("same_entity")
def same_entity(a: Column, b: Column) -> Column:
    return phrase(a) == phrase(b)


@register("is_self_question")
def is_self_question(query: Column) -> Column:
    """Whether a question is about the system rather than its knowledge (E5)."""
    return F.lower(query).rlike(r"\b(who|what) are you\b|\byour (name|purpose|abilities)\b")
