"""Naming, hashing, normalising and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ASCII punctuation that answers lose.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK = "\u4e00-\u9fff"


def hash_id(value: Column) -> Column:
    """Hex sha256 of the value as text."""
    return F.sha2(value.cast("string"), 256)


def canonical_map(properties: Column) -> Column:
    """``k=v;`` entries in key order: a map in a form that compares and hashes."""
    entries = F.array_sort(F.map_entries(properties))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


def phrase(value: Column) -> Column:
    """Lower case; anything but ASCII letters and digits, CJK and spaces becomes a space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(value), "[^A-Za-z0-9\u4e00-\u9fa5 ]", " "))


def camel_case(value: Column) -> Column:
    """Words of the normalised phrase joined, all but the first capitalised."""
    words = F.split(phrase(value), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))), "")


def snake_case(value: Column) -> Column:
    return F.lower(F.array_join(F.regexp_extract_all(value, F.lit("[A-Za-z][a-z0-9]*"), F.lit(0)), "_"))


def vector_field(prop: str, sparse: bool = False) -> str:
    """Name of the field that holds a property's embedding."""
    import re

    return f"_{'_'.join(re.findall('[A-Za-z][a-z0-9]*', prop)).lower()}_{'sparse' if sparse else 'vector'}"


def abbreviated(value: Column, most: int = 10, side: int = 5) -> Column:
    """Texts of over ``most`` characters as their two ends around an ellipsis."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.left(value, F.lit(side)), F.lit("..."), F.right(value, F.lit(side))))


def typed_id(identifier: Column, label: Column) -> Column:
    return F.concat_ws("_", identifier, label)


def namespaced(label: Column, namespace: str) -> Column:
    """Adds ``namespace.`` unless the first dotted part is it already."""
    return F.when(F.split_part(label, F.lit("."), F.lit(1)) == namespace, label).otherwise(F.concat(F.lit(f"{namespace}."), label))


def recalled_label(labels: Column) -> Column:
    """The first label that is not the generic one."""
    return F.coalesce(F.try_element_at(F.filter(labels, lambda x: x != "Entity"), F.lit(1)), F.lit("Entity"))


def node_text(properties: Column) -> Column:
    """A node's properties as lines of text, its id left out."""
    rest = F.map_filter(properties, lambda k, v: (k != "id") & v.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_entries(rest)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def reference_list(value: Column) -> Column:
    """Parts of a comma list, trimmed, without blanks and repeats, order kept."""
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def append_value(value: Column, added: Column) -> Column:
    """Adds to a comma list what it lacks."""
    return F.array_join(F.array_union(reference_list(F.coalesce(value, F.lit(""))), F.array(added)), ",")


# answers


def normalized_answer(value: Column) -> Column:
    """Lower case without punctuation, articles and doubled spaces; CJK texts are spaced by character."""
    lowered = F.translate(F.lower(value), PUNCTUATION, "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(lowered, r"\b(a|an|the)\b", " "), r"\s+", " "))
    spaced = F.trim(F.regexp_replace(F.array_join(F.split(plain, ""), " "), r"\s+", " "))
    return F.when(plain.rlike(f"[{CJK}]"), spaced).otherwise(plain)


def exact_match(prediction: Column, gold: Column) -> Column:
    return (normalized_answer(prediction) == normalized_answer(gold)).cast("double")


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of token multisets; yes, no and noanswer must match exactly."""
    p, g = normalized_answer(prediction), normalized_answer(gold)
    a, b = F.split(p, " "), F.split(g, " ")
    closed = [F.lit(x) for x in ("yes", "no", "noanswer")]
    common = bag_overlap(a, b)
    f1 = 2.0 * common / (F.size(a) + F.size(b))
    return F.when((p.isin(*closed) | g.isin(*closed)) & (p != g), 0.0).when(common == 0, 0.0).otherwise(f1)


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays as sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(value: Column) -> Column:
    return F.filter(F.split(F.lower(value), r"\s+"), lambda x: x != "")


def text_only(value: Column, chinese: bool = False) -> Column:
    """Letters and digits of any script, or Chinese characters only."""
    return F.regexp_replace(value, f"[^{CJK}]" if chinese else r"[^\p{L}\p{N}]", "")


def fuzzy_member(value: Column, others: Column) -> Column:
    """Whether a string contains or is contained in one of an array."""
    return F.exists(others, lambda o: F.contains(o, value) | F.contains(value, o))


def answer_after(value: Column, marker: str = "Answer:") -> Column:
    return F.trim(F.when(F.contains(value, F.lit(marker)), F.substring_index(value, marker, -1)).otherwise(value))


def tagged(value: Column, tag: str) -> Column:
    """All contents of ``<tag>...</tag>``."""
    return F.regexp_extract_all(value, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def boxed(value: Column) -> Column:
    return F.regexp_extract(value, r"\\boxed\{([^{}]*)\}", 1)


#: A JSON text's parts: strings, an unfinished one at the end, brackets, what is between.
JSON_PARTS = r"""(?s)"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*$|[\[\]{}]|[^"\[\]{}]+"""


def repaired_json(value: Column) -> Column:
    """The first object or array of a text, put right: trailing commas, other languages' constants, curly quotes, what was cut off.

    Strings are left as they are, but for closing the last.  Open brackets are closed in
    the order of a stack; a bracket that closes none of the open ones is dropped.
    """
    body = F.regexp_replace(F.regexp_extract(value, r"(?s)([\[{].*)", 1), r"[“”]", '"')
    parts = F.regexp_extract_all(body, F.lit(JSON_PARTS), F.lit(0))
    bare = lambda text: F.regexp_replace(text, r",\s*$", "")

    def step(state: Column, part: Column) -> Column:
        out, open_, done = state["out"], state["open"], state["done"]
        made = lambda o, s, d: F.struct(o.alias("out"), s.alias("open"), d.alias("done"))
        place = F.instr(open_, part)  # the innermost first
        plain = part
        for pattern, new in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null")):
            plain = F.regexp_replace(plain, pattern, new)
        unfinished = ~part.rlike(r'(?s)^"(?:[^"\\]|\\.)*"$')
        return (
            F.when(done, state)
            .when(part == "{", made(F.concat(out, part), F.concat(F.lit("}"), open_), done))
            .when(part == "[", made(F.concat(out, part), F.concat(F.lit("]"), open_), done))
            .when(part.isin("}", "]"), F.when(place > 0, made(F.concat(bare(out), F.substr(open_, F.lit(1), place)), F.substr(open_, place + 1), place == F.length(open_))).otherwise(state))
            .when(F.startswith(part, F.lit('"')), made(F.concat(out, F.when(unfinished, F.concat(part, F.lit('"'))).otherwise(part)), open_, done))
            .otherwise(made(F.concat(out, plain), open_, done))
        )

    none = F.struct(F.lit("").alias("out"), F.lit("").alias("open"), F.lit(False).alias("done"))
    return F.aggregate(parts, none, step, lambda state: F.when(state["done"], state["out"]).otherwise(F.concat(bare(state["out"]), state["open"])))


def parsed(value: Column, schema: str) -> Column:
    """JSON to a struct; fenced code is unwrapped, malformed text is repaired, and null if that fails too."""
    plain = F.regexp_replace(value, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    valid = F.get_json_object(plain, "$").isNotNull()
    return F.from_json(F.when(valid, plain).otherwise(repaired_json(plain)), schema, {"mode": "PERMISSIVE"})


def compact_date(value: Column) -> Column:
    return F.to_date(value, "yyyyMMdd")


def rebased_date(value: Column, anchor: str, today: Column) -> Column:
    """A yyyyMMdd date as far from ``today`` as it was from ``anchor``."""
    return F.date_format(F.date_add(today, F.datediff(compact_date(value), compact_date(F.lit(anchor)))), "yyyyMMdd")


def linked_properties(value: Column, item: str = "\u0002", part: str = "\u0001") -> Column:
    """Separated strings to structs (name, id, type); parts of another count are dropped."""
    rows = F.filter(F.transform(F.split(value, item), lambda x: F.split(x, part)), lambda x: F.size(x) == 3)
    return F.transform(rows, lambda x: F.struct(x[0].alias("name"), x[1].alias("id"), x[2].alias("type")))
