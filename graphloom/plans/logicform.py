"""The logic-form plan language (L1-L11), lowered to DataFrames step by step.

    Step1: Who supplies Acme?
    Action1: get_spo(s=s1:Company, p=p1:supplies, o=o1:Company[Acme], s.age>30)
    Action2: Math(content=[`s1`], target=count)->n
    Output: output(s1)

Every step's bindings are a DataFrame; a shared alias is a join key.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.models import model
from graphloom.operators.graph import Graph
from graphloom.operators.retrieve import link_mentions
from graphloom.plans.expressions import lower
from graphloom.plans.schema import Catalog

TERM = re.compile(r"^(?P<alias>\w+)(?::(?P<types>[^\[\]]+))?(?:\[`?(?P<name>[^\]`]*)`?\])?(?:\[(?P<ids>[^\]]*)\])?$")
CONDITION = re.compile(r"^(?P<alias>\w+)\.(?P<prop>\w+)\s*(?P<op>!=|<=|>=|=|<|>)\s*(?P<value>.+)$")
CALL = re.compile(r"^(?P<name>\w+)\s*\((?P<args>.*)\)\s*(?:->\s*`?(?P<alias>\w+)`?)?\s*$", re.S)
STEP = re.compile(r"(?im)^\s*step\s*\d*\s*[:：]\s*(.*)$")
ACTION = re.compile(r"(?im)^\s*(?:action|output)\s*\d*\s*[:：]\s*(.*)$")
OPERATORS = ("judgement", "entailment", "extract", "choice", "multiChoice")


class LogicFormError(ValueError):
    pass


@dataclass
class Term:
    alias: str
    types: list[str] = field(default_factory=list)
    name: str | None = None
    ids: list[str] = field(default_factory=list)


@dataclass
class Action:
    kind: str
    terms: dict[str, Term] = field(default_factory=dict)
    conditions: list[tuple[str, str, str, str]] = field(default_factory=list)
    args: dict[str, str] = field(default_factory=dict)
    aliases: list[str] = field(default_factory=list)
    alias: str | None = None

    def uses(self) -> set[str]:
        text = " ".join(self.args.values())
        return {t.alias for t in self.terms.values()} | set(self.aliases) | set(re.findall(r"`(\w+)`", text)) | {v.split(".")[0] for *_, v in self.conditions if re.fullmatch(r"\w+\.\w+", v)}


def split_arguments(text: str) -> list[str]:
    """Comma parts outside of brackets, quotes and backquotes."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "`\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


def parse_term(text: str) -> Term:
    """L1, L2: ``alias:TypeA|TypeB[name][id1|id2]``."""
    m = TERM.match(text.strip())
    if not m:
        raise LogicFormError(f"not a term: {text}")
    parts = lambda x: [p.strip() for p in x.split("|") if p.strip()] if x else []
    return Term(m["alias"], parts(m["types"]), m["name"] or None, parts(m["ids"]))


def parse_action(text: str) -> Action:
    m = CALL.match(text.strip())
    if not m:
        raise LogicFormError(f"not an action: {text}")
    kind = {"retrieval": "spo", "get_spo": "spo", "retriever": "spo", "math": "math", "deduce": "deduce", "get": "output", "output": "output", "search_s": "search"}.get(m["name"].lower())
    if kind is None:
        raise LogicFormError(f"no action {m['name']}")
    out = Action(kind, alias=m["alias"])
    if kind == "deduce" and "left_expr" in m["args"]:
        out.args["binary"] = m["args"]
        out.aliases = [x.split(".")[0] for x in parse_binary(m["args"]).left]
        return out
    for part in split_arguments(m["args"]):
        key, eq, value = part.partition("=")
        if condition := CONDITION.match(part):
            out.conditions.append((condition["alias"], condition["prop"], condition["op"], condition["value"].strip().strip("\"'`")))
        elif kind in ("spo", "search") and eq and key.strip() in ("s", "p", "o"):
            out.terms[key.strip()] = parse_term(value)
        elif kind == "output":
            out.aliases.append(part.strip("`"))
        elif eq:
            out.args[key.strip()] = value.strip()
        else:
            raise LogicFormError(f"not understood: {part}")
    if kind == "spo" and set(out.terms) != {"s", "p", "o"}:
        raise LogicFormError("a retrieval needs s, p and o")
    return out


def parse_plan(text: str) -> list[tuple[str, Action]]:
    """Steps with their actions; unequal counts are an error."""
    steps, actions = STEP.findall(text), ACTION.findall(text)
    if steps and len(steps) != len(actions):
        raise LogicFormError(f"{len(steps)} steps and {len(actions)} actions")
    if not steps:
        actions = actions or [x for x in text.strip().split("\n") if x.strip()]
        steps = [""] * len(actions)
    return [(s.strip(), parse_action(a)) for s, a in zip(steps, actions, strict=True)]


def dependencies(plan: list[tuple[str, Action]]) -> dict[int, set[int]]:
    """Earlier steps sharing an alias, and always the step before."""
    uses = [a.uses() | ({a.alias} if a.alias else set()) for _, a in plan]
    return {i: {j for j in range(i) if uses[i] & uses[j] or j == i - 1} for i in range(len(plan))}


def standardised(action: Action, catalog: Catalog) -> Action:
    """Titles to schema names; an unknown predicate resolved by (s, o), (s, p) or (o, p)."""
    for term in action.terms.values():
        term.types = [catalog.name_of(t) for t in term.types]
    if action.kind == "spo":
        s, p, o = (action.terms[x] for x in "spo")
        if not p.types and s.types and o.types:
            p.types = sorted({x for a in s.types for b in o.types for x in catalog.predicate_between(a, b)})
        if not o.types and s.types and p.types:
            o.types = sorted({x for a in s.types for q in p.types for x in catalog.objects_of(a, q)})
        if not s.types and o.types and p.types:
            s.types = sorted({x for b in o.types for q in p.types for x in catalog.subjects_of(b, q)})
    return action


#: How a binary expression names its comparison, in both languages.
COMPARISONS = {
    "等于": "=", "不等于": "!=", "大于": ">", "大于等于": ">=", "小于": "<", "小于等于": "<=", "包含": "contains",
    "equal": "=", "not_equal": "!=", "greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<=", "contains": "contains",
    "=": "=", "==": "=", "!=": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<=",
}
BINARY_PART = re.compile(r"(left_expr|right_expr|op)\s*=(?!=)\s*(.*?)\s*(?=[,，]?\s*(?:left_expr|right_expr|op)\s*=(?!=)|$)", re.S)


@dataclass
class BinaryExpression:
    """One or several aliases (or ``alias.prop``) compared with a value by ``op``, which is kept as written."""

    left: list[str]
    right: str | None
    op: str


def parse_binary(text: str) -> BinaryExpression:
    """``left_expr=a[,b], right_expr=value, op=name``; commas inside the value belong to it."""
    parts = {m[1]: m[2].strip().rstrip(",，").strip() for m in BINARY_PART.finditer(text.strip())}
    if not parts.get("left_expr") or not parts.get("op"):
        raise LogicFormError(f"a binary expression needs left_expr and op: {text}")
    left = list(dict.fromkeys(x.strip().strip("`") for x in re.split("[,，]", parts["left_expr"]) if x.strip()))
    return BinaryExpression(left, parts.get("right_expr") or None, parts["op"])


class LogicFormRunner:
    """Bindings of a plan: each action's frame joins earlier ones on the aliases they share."""

    def __init__(self, graph: Graph, catalog: Catalog | None = None, types: dict[str, str] | None = None):
        self.graph, self.catalog, self.types = graph, catalog, types or {}
        self.frames: dict[str, DataFrame] = {}
        self.numbers: dict[str, DataFrame] = {}

    def _nodes(self, term: Term) -> DataFrame:
        rows = self.graph.nodes
        if term.types and "Entity" not in term.types:
            rows = rows.where(F.col("label").isin(term.types))
        if term.name is not None:
            rows = rows.where(F.col("name") == term.name)
        if term.ids:
            rows = rows.where(F.col("id").isin(term.ids))
        a = term.alias
        return rows.select(F.col("id").alias(a), F.col("label").alias(f"{a}_type"), F.col("name").alias(f"{a}_name"), F.col("properties").alias(f"{a}_properties"))

    def _bound(self, rows: DataFrame, alias: str) -> DataFrame:
        if alias in self.frames:
            on = [c for c in (alias, f"{alias}_type") if c in rows.columns and c in self.frames[alias].columns]
            rows = rows.join(self.frames[alias].select(*on).distinct(), on, "left_semi")
        return rows

    def _where(self, rows: DataFrame, action: Action) -> DataFrame:
        side = {k: t.alias for k, t in action.terms.items()}
        for alias, prop, op, value in action.conditions:
            alias = side.get(alias, alias)
            left: Column = F.col(f"{alias}_properties").getItem(prop)
            if re.fullmatch(r"\w+\.\w+", value) and value.split(".")[0] in self.frames:  # L7: a reference is a join
                other, field_ = value.split(".")
                ref = self.frames[other].select(F.col(f"{other}_properties").getItem(field_).alias("_ref")).distinct()
                rows = rows.join(ref, left == F.col("_ref"), "left_semi")
                continue
            kind = self.types.get(prop) or ("double" if op in ("<", "<=", ">", ">=") else "string")
            left, right = F.expr(f"try_cast(`{alias}_properties`['{prop}'] AS {kind})"), F.lit(value).cast(kind)
            rows = rows.where({"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op])
        return rows

    def _spo(self, action: Action) -> DataFrame:
        s, p, o = (action.terms[x] for x in "spo")
        edges = self.graph.edges.where(F.col("label").isin(p.types)) if p.types else self.graph.edges
        edges = edges.select(F.col("from_id").alias(s.alias), F.col("from_type").alias(f"{s.alias}_type"), F.col("to_id").alias(o.alias), F.col("to_type").alias(f"{o.alias}_type"), F.col("label").alias(p.alias), F.col("properties").alias(f"{p.alias}_properties"))
        rows = edges.join(self._nodes(s), [s.alias, f"{s.alias}_type"]).join(self._nodes(o), [o.alias, f"{o.alias}_type"])
        for term in (s, o):
            rows = self._bound(rows, term.alias)
        return self._where(rows, action)

    def _math(self, action: Action) -> DataFrame:
        """L4: count, sum, avg, min, max or sort of an alias's ids, of ``alias.prop``, or an expression of earlier results."""
        content = action.args.get("content", "").strip("[] ")
        target = action.args.get("target", "count").strip("\"'` ").lower()
        if target == "expression":
            return self._computed(content.strip("\"'"), action.alias or "result")
        m = re.fullmatch(r"`?(\w+)(?:\.(\w+))?`?(?:\.(\w+))?", content)
        made = {"count": F.countDistinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
        if m is None or m[1] not in self.frames or target not in (*made, "sort"):
            raise LogicFormError("Math needs a bound alias and one of count, sum, avg, min, max, sort, expression")
        prop = m[2] or m[3]
        column = F.expr(f"try_cast(`{m[1]}_properties`['{prop}'] AS double)") if prop else F.col(m[1])
        # sums and averages are over entities, whose kind is part of what they are
        kind = [c for c in (f"{m[1]}_type",) if c in self.frames[m[1]].columns]
        keep = self.frames[m[1]].select(column.alias("x"), F.col(m[1]).alias("id"), *kind).distinct()
        if target == "sort":
            return keep.where("x IS NOT NULL").select("id", F.col("x").alias(action.alias or "result")).orderBy(F.desc(action.alias or "result"), "id")
        return keep.agg(made[target]("x").alias(action.alias or "result"))

    def _computed(self, text: str, alias: str) -> DataFrame:
        """Arithmetic over results of earlier Math steps, which are frames of one row."""
        names = list(dict.fromkeys(re.findall(r"`(\w+)`", text)))
        unknown = [n for n in names if n not in self.numbers]
        if not names or unknown:
            raise LogicFormError(f"not results of earlier Math steps: {unknown or text}")
        # one row each, so this joins single rows
        row = reduce(lambda x, y: x.crossJoin(y), [self.numbers[n].select(n) for n in names])
        return row.select(lower(text.replace("`", ""), F.col).alias(alias))

    def compared(self, text: str) -> DataFrame:
        """Rows of the bound alias for which a binary expression holds; of several, all must."""
        found = parse_binary(text)
        op = COMPARISONS.get(found.op)
        if op is None or found.right is None:
            raise LogicFormError(f"no comparison {found.op}, or nothing to compare with")
        base = found.left[0].split(".")[0]
        if base not in self.frames:
            raise LogicFormError(f"not bound: {base}")
        rows = self.frames[base]
        for name in found.left:
            alias, _, prop = name.partition(".")
            if alias not in self.frames or f"{alias}_name" not in rows.columns:
                raise LogicFormError(f"not bound in the rows of {base}: {alias}")
            if op in (">", ">=", "<", "<="):
                left = F.expr(f"try_cast(`{alias}_properties`['{prop}'] AS double)") if prop else F.expr(f"try_cast(`{alias}_name` AS double)")
                right = F.lit(found.right).try_cast("double")
            else:
                left, right = (F.col(f"{alias}_properties").getItem(prop) if prop else F.col(f"{alias}_name")), F.lit(found.right)
            rows = rows.where({"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right, "contains": F.contains(left, right)}[op])
        return rows

    def _deduce(self, action: Action) -> DataFrame:
        """A pluggable predicate over an alias's names; default: the content contains the target; or a binary expression."""
        op = action.args.get("op", "").strip("\"'` ")
        if "binary" in action.args:
            return self.compared(action.args["binary"])
        if op not in OPERATORS:
            raise LogicFormError(f"no deduction {op}")
        m = re.search(r"`(\w+)`", action.args.get("content", ""))
        if m is None or m[1] not in self.frames:
            raise LogicFormError("Deduce needs a bound alias")
        target = action.args.get("target", "").strip("\"'` ")
        name = F.coalesce(f"{m[1]}_name", m[1])
        try:
            verdict = model(f"deduce_{op}")(name, F.lit(target))
        except KeyError:
            verdict = F.contains(F.lower(name), F.lit(target.lower()))
        return self.frames[m[1]].select(m[1], verdict.alias(action.alias or "result")).distinct()

    def run(self, plan: str) -> DataFrame:
        """The frame of the last action."""
        return self.act([action for _, action in parse_plan(plan)])

    def linked(self, plan: str, **options) -> DataFrame:
        """The frame of the last action, where terms are bound by linking their names (E1), not by equal names.

        A name that no entity is near enough to binds nothing.  ``options`` are those of
        ``retrieve.link_mentions``; a term keeps at most the k entities that it is linked to.
        """
        actions = [action for _, action in parse_plan(plan)]
        named = [t for a in actions for x, t in a.terms.items() if x in "so" and t.name and not t.ids]
        if named:
            rows = [(t.alias, t.name, t.types[0] if len(t.types) == 1 and t.types[0] != "Entity" else None) for t in named]
            mentions = self.graph.nodes.sparkSession.createDataFrame(rows, "query_id string, mention string, type string")
            # k a mention of the plan
            found = link_mentions(self.graph, mentions, **options).collect()
            for term in named:
                hits = [r for r in found if (r.query_id, r.mention) == (term.alias, term.name)]
                term.ids = [r.id for r in hits] or [""]
                term.types = sorted({r.label for r in hits}) or term.types
                term.name = None
        return self.act(actions)

    def act(self, actions: list[Action]) -> DataFrame:
        out: DataFrame | None = None
        for action in actions:
            if self.catalog:
                action = standardised(action, self.catalog)
            if action.kind == "spo":
                out = self._spo(action)
            elif action.kind == "search":
                out = self._bound(self._where(self._nodes(action.terms["s"]), action), action.terms["s"].alias)
            elif action.kind == "math":
                out = self._math(action)
                if action.args.get("target", "count").strip("\"'` ").lower() != "sort":
                    self.numbers[action.alias or "result"] = out
            elif action.kind == "deduce":
                out = self._deduce(action)
            else:  # L6
                missing = [a for a in action.aliases if a not in self.frames]
                if missing:
                    raise LogicFormError(f"not bound: {missing}")
                out = None
                for a in action.aliases:
                    frame = self.frames[a]
                    cols = [c for c in (a, f"{a}_name") if c in frame.columns]
                    got = frame.select(F.lit(a).alias("alias"), F.col(cols[0]).cast("string").alias("id"), F.col(cols[-1]).cast("string").alias("name")).distinct()
                    out = got if out is None else out.unionByName(got)
            for term in action.terms.values():
                self.frames[term.alias] = out
            if action.alias:
                self.frames[action.alias] = out
        return out
