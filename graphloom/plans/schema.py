"""The schema language (1.3): indented type, property, relation and rule declarations to a catalog.

    namespace Harbour
    Vessel(vessel): EntityType
        properties:
            callSign(call sign): Text
                constraint: MultiValue
                index: TextAndVector
        relations:
            CAU#towedBy(towed by): Vessel

Declarations nest by indentation of any constant width.  Problems raise ``SchemaError``
with the line number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the language.
BASIC = ("Text", "Integer", "Float")
KINDS = ("BasicType", "StandardType", "EntityType", "IndexType", "EventType", "ConceptType")
FAMILIES = ("SYNANT", "CAU", "SEQ", "IND", "INC", "USE")
HYPERNYMS = ("isA", "locateAt", "mannerOf")
INDEXES = ("Vector", "SparseVector", "Text", "TextAndVector", "TextAndSparseVector")
GROUPS = ("Time", "Subject", "Object", "Loc")
SPARK_TYPES = {"Text": "string", "Integer": "bigint", "Float": "double"}


class SchemaError(ValueError):
    def __init__(self, line: int, what: str):
        super().__init__(f"line {line}: {what}")


@dataclass
class Predicate:
    name: str
    title: str
    target: str
    relation: bool = False
    family: str | None = None
    constraints: dict[str, object] = field(default_factory=dict)
    index: str | None = None
    group: str | None = None
    rule: str | None = None
    sub: dict[str, Predicate] = field(default_factory=dict)

    @property
    def is_reference(self) -> bool:
        return self.target not in BASIC and not self.target.startswith("STD.")


@dataclass
class Type:
    name: str
    title: str
    kind: str
    parent: str | None = None
    hypernym: str | None = None
    spreadable: bool = False
    pattern: str | None = None
    description: str | None = None
    properties: dict[str, Predicate] = field(default_factory=dict)
    relations: dict[str, list[Predicate]] = field(default_factory=dict)


@dataclass
class Catalog:
    namespace: str
    types: dict[str, Type] = field(default_factory=dict)

    def predicates(self, name: str) -> dict[str, Predicate]:
        """Own and inherited properties of a type."""
        out: dict[str, Predicate] = {}
        t = self.types.get(name)
        if t is not None:
            if t.parent:
                out |= self.predicates(t.parent)
            out |= t.properties
        return out

    def edges(self) -> list[tuple[str, str, str]]:
        """All (subject, predicate, object) of references and relations."""
        out = []
        for t in self.types.values():
            out += [(t.name, p.name, p.target) for p in t.properties.values() if p.is_reference]
            out += [(t.name, p.name, p.target) for ps in t.relations.values() for p in ps]
        return out

    def predicate_between(self, s: str, o: str) -> list[str]:
        return [p for a, p, b in self.edges() if a == s and b == o]

    def objects_of(self, s: str, p: str) -> list[str]:
        return [b for a, q, b in self.edges() if a == s and q == p]

    def subjects_of(self, o: str, p: str) -> list[str]:
        return [a for a, q, b in self.edges() if b == o and q == p]

    def name_of(self, title: str) -> str:
        """The type or predicate with that title or name."""
        for t in self.types.values():
            if title in (t.name, t.title):
                return t.name
            for p in (*t.properties.values(), *(x for ps in t.relations.values() for x in ps)):
                if title in (p.name, p.title):
                    return p.name
        return title

    def indexed(self) -> list[tuple[str, str, str]]:
        """(type, property, index); a name always has a vector."""
        out = [(t.name, "name", "TextAndVector") for t in self.types.values() if t.kind != "StandardType"]
        return out + [(t.name, p.name, p.index) for t in self.types.values() for p in self.predicates(t.name).values() if p.index and p.name != "name"]

    def view(self, nodes: DataFrame, name: str) -> DataFrame:
        """A type's nodes with its properties as typed columns; malformed values are null."""
        cols = [F.expr(f"try_cast(properties['{p.name}'] AS {SPARK_TYPES.get(p.target, 'string')})").alias(p.name) for p in self.predicates(name).values() if p.name not in ("id", "name")]
        return nodes.where(F.col("label").isin(name, f"{self.namespace}.{name}")).select("id", "name", *cols)

    def violations(self, nodes: DataFrame) -> DataFrame:
        """(id, label, property, constraint) of broken NotNull, Enum and Regular constraints."""
        found = None
        for t in self.types.values():
            for p in self.predicates(t.name).values():
                value = F.col("properties").getItem(p.name) if p.name not in ("id", "name") else F.col(p.name)
                for what, broken in _broken(p, value):
                    rows = nodes.where((F.col("label") == t.name) & broken).select("id", "label", F.lit(p.name).alias("property"), F.lit(what).alias("constraint"))
                    found = rows if found is None else found.unionByName(rows)
        return found if found is not None else nodes.select("id", "label", F.lit("").alias("property"), F.lit("").alias("constraint")).limit(0)


def _broken(p: Predicate, value: Column) -> list[tuple[str, Column]]:
    out = []
    each = F.split(value, ",") if "MultiValue" in p.constraints else F.array(value)
    if "NotNull" in p.constraints:
        out.append(("NotNull", F.coalesce(value, F.lit("")) == ""))
    if "Enum" in p.constraints:
        allowed = p.constraints["Enum"]
        out.append(("Enum", value.isNotNull() & F.exists(each, lambda x: ~F.trim(x).isin(list(allowed)))))
    if "Regular" in p.constraints:
        out.append(("Regular", value.isNotNull() & F.exists(each, lambda x: ~F.trim(x).rlike(f"^(?:{p.constraints['Regular']})$"))))
    return out


TYPE_LINE = re.compile(r"(?P<name>[\w.]+)\s*(?:\((?P<title>[^)]*)\))?\s*(?:->\s*(?P<parent>[\w.]+)\s*)?:\s*(?P<kind>\w+)?\s*$")
PREDICATE_LINE = re.compile(r"(?:(?P<family>\w+)#)?(?P<name>\w+)\s*(?:\((?P<title>[^)]*)\))?\s*:\s*(?P<target>[\w.]+)\s*$")


def _lines(text: str):
    """(number, indent, line); a rule's ``[[ ... ]]`` is one line."""
    pending, start, depth = None, 0, 0
    for number, raw in enumerate(text.replace("\t", "    ").split("\n"), 1):
        if pending is not None:
            pending += "\n" + raw
            if "]]" in raw:
                yield start, depth, pending
                pending = None
            continue
        line = re.sub(r"(^|\s)#(?!\w*#).*$", "", raw) if not re.search(r"\w#\w", raw) else raw
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        if "[[" in line and "]]" not in line:
            pending, start = line.strip(), number
            continue
        yield number, depth, line.strip()
    if pending is not None:
        raise SchemaError(start, "a rule without its end")


def parse(text: str) -> Catalog:
    catalog: Catalog | None = None
    current: Type | None = None
    # (indent, predicates to fill or None, relation?, predicate that lines describe)
    stack: list[tuple[int, object, bool, Predicate | None]] = []
    for number, indent, line in _lines(text):
        if line.startswith("namespace "):
            if catalog is not None:
                raise SchemaError(number, "a second namespace")
            catalog = Catalog(line.split(None, 1)[1].strip())
            continue
        if catalog is None:
            raise SchemaError(number, "the namespace comes first")
        if indent == 0:
            m = TYPE_LINE.match(line)
            if not m:
                raise SchemaError(number, f"not a type: {line}")
            name = m["name"]
            if name in catalog.types:
                raise SchemaError(number, f"{name} is declared twice")
            if m["kind"] and m["kind"] not in KINDS:
                raise SchemaError(number, f"no kind of type: {m['kind']}")
            parent = m["parent"]
            if parent and parent not in catalog.types:
                raise SchemaError(number, f"{parent} is not declared")
            current = catalog.types[name] = Type(name, m["title"] or name, m["kind"] or catalog.types[parent].kind, parent)
            stack = []
            continue
        if current is None:
            raise SchemaError(number, "a declaration outside of a type")
        while stack and indent <= stack[-1][0]:
            stack.pop()
        owner = next((p for _, _, _, p in reversed(stack) if p is not None), None)
        key, _, value = (x.strip() for x in line.partition(":"))
        if key in ("properties", "relations") and not value:
            fill = (owner.sub if owner else current.properties) if key == "properties" else current.relations
            stack.append((indent, fill, key == "relations", None))
        elif key == "constraint" and owner:
            for part in re.split(r",\s*(?=NotNull|MultiValue|Enum|Regular)", value):
                what, _, rest = part.partition("=")
                what, rest = what.strip(), rest.strip().strip("\"'")
                if what not in ("NotNull", "MultiValue", "Enum", "Regular"):
                    raise SchemaError(number, f"no constraint: {what}")
                owner.constraints[what] = [x.strip() for x in rest.split(",")] if what == "Enum" else rest or True
        elif key == "index" and owner:
            if value not in INDEXES:
                raise SchemaError(number, f"no index: {value}")
            owner.index = value
        elif key == "rule" and owner:
            owner.rule = value.removeprefix("[[").removesuffix("]]").strip()
        elif key == "desc":
            if owner is None:
                current.description = value
        elif key == "hypernymPredicate":
            if value not in HYPERNYMS:
                raise SchemaError(number, f"no hypernym predicate: {value}")
            current.hypernym = value
        elif key == "spreadable":
            current.spreadable = value.lower() == "true"
        elif key == "regular":
            current.pattern = value.strip("\"'")
        elif key == "autoRelate":
            continue
        elif key in GROUPS and not value:
            stack.append((indent, stack[-1][1] if stack else current.properties, False, None))
        else:
            m = PREDICATE_LINE.match(line)
            filled = next((x for x in reversed(stack) if x[3] is None), None)
            if not m or filled is None:
                raise SchemaError(number, f"not a declaration: {line}")
            if m["family"] and m["family"] not in FAMILIES:
                raise SchemaError(number, f"no predicate family: {m['family']}")
            made = Predicate(m["name"], m["title"] or m["name"], m["target"], filled[2], m["family"])
            if filled[2]:
                filled[1].setdefault(made.name, []).append(made)
            else:
                if made.name in filled[1]:
                    raise SchemaError(number, f"{made.name} is declared twice")
                filled[1][made.name] = made
            stack.append((indent, None, filled[2], made))
    if catalog is None:
        raise SchemaError(1, "no namespace")
    return catalog


def changes(old: Catalog, new: Catalog) -> dict[str, list[str]]:
    """Schema evolution: types and ``type.predicate`` to create, update and delete."""

    def flat(c: Catalog) -> dict[str, object]:
        out: dict[str, object] = {}
        for t in c.types.values():
            out[t.name] = (t.title, t.kind, t.parent, t.hypernym, t.spreadable, t.pattern)
            for p in t.properties.values():
                out[f"{t.name}.{p.name}"] = p
            for ps in t.relations.values():
                for p in ps:
                    out[f"{t.name}.{p.name}->{p.target}"] = p
        return out

    a, b = flat(old), flat(new)
    return {"create": sorted(b.keys() - a.keys()), "update": sorted(k for k in a.keys() & b.keys() if a[k] != b[k]), "delete": sorted(a.keys() - b.keys())}
