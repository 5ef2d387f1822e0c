"""Graph patterns (K1-K6, K15-K18): MATCH texts lowered to joins.

``MATCH (s:Person|Company)-[p:holds]->(o:App), (o)-[q:uses]->(c) WHERE s.age > 5 RETURN s, o.name AS app``

Bag semantics: every combination of edges gives a row; reflexive matches stay.
Each variable contributes the columns ``<var>_id`` and ``<var>_label`` (a node is its id
and label); joins are equi-joins on both, so Catalyst orders and broadcasts them.

``[NOT] EXISTS { (o)-[:uses]->(x) WHERE x.age > 3 }`` in a condition is a sub-pattern that
shares variables with what surrounds it.  Where it stands alone or in a conjunction it is a
semi or anti join on all shared variables, elsewhere a mark that is joined to the rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.plans.expressions import lower
from graphloom.session import cut, shuffle_partitions

NODE = re.compile(r"\(\s*(?P<var>\w+)?\s*(?::\s*(?P<labels>[\w.`/]+(?:\s*\|\s*:?[\w.`/]+)*))?\s*\)")
EDGE = re.compile(r"(?P<left><)?-\s*(?:\[\s*(?P<var>\w+)?\s*(?::\s*(?P<labels>[\w.]+(?:\s*\|\s*:?[\w.]+)*))?\s*(?:\*\s*(?P<low>\d+)\s*(?:\.\.\s*(?P<high>\d+))?)?\s*\])?\s*-(?P<right>>)?")


class PatternError(ValueError):
    pass


@dataclass
class Step:
    var: str
    labels: list[str]
    source: str
    target: str
    low: int = 1
    high: int = 1
    undirected: bool = False


@dataclass
class Pattern:
    nodes: dict[str, list[str]] = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)
    where: str | None = None
    blocks: dict[str, str] = field(default_factory=dict)
    returns: list[tuple[str, str]] = field(default_factory=list)


def _labels(text: str | None) -> list[str]:
    return [x.strip().strip(":`") for x in text.split("|")] if text else []


def parse_paths(text: str, out: Pattern | None = None) -> Pattern:
    """Comma-separated paths that share variables."""
    out = out or Pattern()
    at, fresh = 0, len(out.steps)

    def node() -> str:
        nonlocal at
        m = NODE.match(text, at)
        if not m:
            raise PatternError(f"expected a node at {text[at:at + 20]!r}")
        at = m.end()
        var = m["var"] or f"_n{len(out.nodes)}"
        known = out.nodes.setdefault(var, [])
        for label in _labels(m["labels"]):
            if label not in known:
                known.append(label)
        return var

    while at < len(text):
        here = node()
        while True:
            while at < len(text) and text[at].isspace():
                at += 1
            m = EDGE.match(text, at)
            if not m:
                break
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
            there = node()
            if m["left"] and m["right"]:
                raise PatternError("an edge has one direction")
            source, target = (there, here) if m["left"] else (here, there)
            low = int(m["low"]) if m["low"] else 1
            step = Step(m["var"] or f"_e{fresh}", _labels(m["labels"]), source, target, low, int(m["high"] or low), not m["left"] and not m["right"])
            out.steps.append(step)
            fresh += 1
            here = there
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
    return out


def blocks_out(text: str) -> tuple[str, dict[str, str]]:
    """The text with each ``EXISTS { ... }`` replaced by a name, and what stood between the braces by name."""
    found: dict[str, str] = {}
    out, at, start, depth = "", 0, 0, 0
    for m in re.finditer(r"""'[^']*'|"[^"]*"|\bexists\s*\{|[{}]""", text, re.IGNORECASE):
        if m[0].lower().startswith("exists"):
            if not depth:
                out, start = out + text[at : m.start()], m.end()
            depth += 1
        elif depth and m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                name = f"__exists_{len(found)}"
                found[name], at = text[start : m.start()], m.end()
                out += name
    if depth:
        raise PatternError("EXISTS without a closing brace")
    return out + text[at:], found


def conjuncts(text: str) -> list[str]:
    """The parts of a condition that a top-level ``and`` joins."""
    parts, start = [], 0
    depth = 0
    for m in re.finditer(r"""'[^']*'|"[^"]*"|[()]|\b\w+\b""", text):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth and m[0].lower() == "or":
            return [text]
        if not depth and m[0].lower() == "and":
            parts.append(text[start : m.start()])
            start = m.end()
    return [x for x in (*map(str.strip, parts), text[start:].strip()) if x]


def parse(text: str) -> Pattern:
    text, blocks = blocks_out(text)
    m = re.fullmatch(r"(?is)\s*match\s+(?P<paths>.*?)(?:\s+where\s+(?P<where>.*?))?\s+return\s+(?P<returns>.*?)\s*;?\s*", text)
    if not m:
        raise PatternError("expected MATCH ... [WHERE ...] RETURN ...")
    out = parse_paths(m["paths"])
    out.where, out.blocks = m["where"], blocks
    for item in m["returns"].split(","):
        what, _, alias = (x.strip() for x in re.sub(r"(?i)\s+as\s+", "\0", item.strip()).partition("\0"))
        out.returns.append((what, alias or what.replace(".", "_")))
    return out


class Matcher:
    """Lowers patterns over a graph; ``concepts(id, concept)`` are derived memberships for ``Type/concept`` labels, else belongTo edges are."""

    def __init__(self, graph: Graph, concepts: DataFrame | None = None, params: dict | None = None, now: str | None = None, edges: dict[str, DataFrame] | None = None, nodes: dict[str, DataFrame] | None = None):
        """``edges`` and ``nodes`` stand for the graph's at the variables that they name."""
        self.graph, self.concepts, self.params, self.now = graph, concepts, params or {}, now
        self.own_edges, self.own_nodes = edges or {}, nodes or {}

    def scan(self, var: str, labels: list[str]) -> DataFrame:
        rows = self.own_nodes.get(var, self.graph.nodes)
        plain = [x.split("/")[0] for x in labels]
        if labels and "Entity" not in labels:
            rows = rows.where(F.col("label").isin(plain))
        for label in labels:
            if "/" in label:  # K5
                kind, concept = label.split("/", 1)
                if self.concepts is None:  # those that the graph has
                    member = self.graph.edges.where((F.col("label") == "belongTo") & (F.col("to_id") == concept) & (F.col("to_type") == kind)).select(F.col("from_id").alias("id"), F.col("from_type").alias("label"))
                else:
                    member = self.concepts.where(F.col("concept") == concept)
                on = [c for c in ("id", "label") if c in member.columns]
                rows = rows.join(member.select(*on), on, "left_semi")
        return rows.select(F.col("id").alias(f"{var}_id"), F.col("name").alias(f"{var}_name"), F.col("label").alias(f"{var}_label"), F.col("properties").alias(f"{var}_properties"))

    def bind(self, pattern: Pattern) -> DataFrame:
        """One row per match, with <var>_id, _name, _label, _properties of nodes and edges.

        Each edge is joined with its nodes before edges are joined with each other: labels
        and conditions of a node prune what multiplies rows.
        """
        out: DataFrame | None = None
        bound: set[str] = set()
        waiting = list(pattern.steps)
        while waiting:
            # the first step that touches what is bound
            step = next((x for x in waiting if out is None or {x.source, x.target} & bound), None)
            if step is None:
                raise PatternError("paths of a pattern must share variables")
            waiting.remove(step)
            both = list(dict.fromkeys((step.source, step.target)))
            hop = self.hops(step, pattern.nodes, [v for v in both if v not in bound and v in pattern.nodes])
            ends = [f"{v}_{x}" for v in both if v in bound for x in ("id", "label")]
            for v in both:
                # paths that meet half-way have their nodes already
                if v not in bound and v in pattern.nodes and f"{v}_properties" not in hop.columns:
                    hop = hop.join(self.scan(v, pattern.nodes[v]), [f"{v}_id", f"{v}_label"])
            out = hop if out is None else many_to_many(out, hop, ends, [c for c in out.columns if c.endswith("_id")])
            bound |= set(both)
        for var, labels in pattern.nodes.items():
            if var in bound:
                continue
            if out is not None:
                raise PatternError(f"{var} is not connected to the pattern")
            out = self.scan(var, labels)
        return out

    def filtered(self, rows: DataFrame, where: str, blocks: dict[str, str], variables: set[str]) -> DataFrame:
        """Rows that meet a condition; ``variables`` are the nodes bound in them."""
        for part in conjuncts(where):
            m = re.fullmatch(r"(?i)(?P<no>not\s+)?\(?\s*(?P<name>__exists_\d+)\s*\)?", part)
            if m:
                keys, on = self.inner(blocks[m["name"]], variables)
                rows = rows.join(keys, on, "left_anti" if m["no"] else "left_semi")
                continue
            marks = re.findall(r"__exists_\d+", part)
            for name in marks:
                keys, on = self.inner(blocks[name], variables)
                rows = rows.join(keys.withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
            known = set(marks)
            rows = rows.where(lower(part, lambda n, known=known: F.col(n) if n in known else self.resolve(n), self.params, self.now)).drop(*marks)
        return rows

    def inner(self, text: str, variables: set[str]) -> tuple[DataFrame, list[str]]:
        """Distinct keys of the variables that a sub-pattern shares, and the keys' names."""
        text, blocks = blocks_out(text)
        m = re.fullmatch(r"(?is)\s*(?:match\s+)?(?P<paths>.*?)(?:\s+where\s+(?P<where>.*?))?\s*", text)
        pattern = parse_paths(m["paths"].strip())
        shared = [v for v in pattern.nodes if v in variables]
        if not shared:
            raise PatternError("EXISTS must share a variable with the pattern around it")
        rows = self.bind(pattern)
        if m["where"]:
            rows = self.filtered(rows, m["where"], blocks, set(pattern.nodes))
        on = [f"{v}_{x}" for v in shared for x in ("id", "label")]
        return rows.select(*on).distinct(), on

    def hops(self, step: Step, nodes: dict[str, list[str]] | None = None, named: list[str] | None = None) -> DataFrame:
        """Rows of a step; with ``named`` paths may come with what the nodes of these variables hold."""
        edges = self.own_edges.get(step.var, self.graph.edges)
        edges = edges.where(F.col("label").isin(step.labels)) if step.labels else edges
        s, t = f"{step.source}_id", f"{step.target}_id"
        if (step.low, step.high) != (1, 1):
            # ends with labels prune before anything is expanded
            keys = lambda var: self.scan(var, nodes[var]).select(F.col(f"{var}_id").alias("id"), F.col(f"{var}_label").alias("label")) if nodes and nodes.get(var) else None
            starts, ends, held = keys(step.source), keys(step.target), {}
            if s != t and named and starts is not None and ends is not None:
                held = {v: self.scan(v, nodes[v]).withColumn(end, _key(f"{v}_id", f"{v}_label")).drop(f"{v}_id", f"{v}_label") for v, end in ((step.source, "start"), (step.target, "end")) if v in named}
            paths = variable_paths(edges, step.low, step.high, step.undirected, starts, ends, held.get(step.source), held.get(step.target))
            if s == t:
                paths = paths.where(F.col("start") == F.col("end"))
            more = [c for rows in held.values() for c in rows.columns if c not in ("start", "end")]
            place = [F.col(f"{end}.{x}").alias(f"{v}_{x}") for v, end in {step.target: "end", step.source: "start"}.items() for x in ("id", "label")]
            return paths.select(*place, *more, F.col("labels").alias(f"{step.var}_labels"), F.col("hops").alias(f"{step.var}_hops"))
        own = [F.col("label").alias(f"{step.var}_label"), F.col("properties").alias(f"{step.var}_properties")]
        end = lambda var, side: [F.col(f"{side}_id").alias(f"{var}_id"), F.col(f"{side}_type").alias(f"{var}_label")]
        if s == t:
            return edges.where("from_id = to_id AND from_type = to_type").select(*end(step.source, "from"), *own)
        rows = edges.select(*end(step.source, "from"), *end(step.target, "to"), *own)
        return rows.unionByName(edges.select(*end(step.source, "to"), *end(step.target, "from"), *own)) if step.undirected else rows

    def resolve(self, name: str) -> Column:
        var, _, prop = name.partition(".")
        if not prop:
            return F.col(f"{var}_id")
        if prop in ("id", "name", "label"):
            return F.col(f"{var}_{prop}")
        column = F.col(f"{var}_properties").getItem(prop)
        column._property = True
        return column

    def run(self, text: str) -> DataFrame:
        pattern = parse(text)
        rows = self.bind(pattern)
        if pattern.where:
            rows = self.filtered(rows, pattern.where, pattern.blocks, set(pattern.nodes))
        return rows.select(*[self.resolve(what).alias(alias) for what, alias in pattern.returns])


#: Rows of a key beyond which its pairs are made by several tasks, and by how many at most.
HOT, SALTS = 1_000, 16


def many_to_many(rows: DataFrame, others: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """The join of two sides that may both hold a key often.

    Where ``others`` holds a key more than ``HOT`` times, the key's ``rows`` are dealt to tasks
    by the columns ``by`` and meet its other rows in each, so no task makes all pairs of a
    key.  Only such rows are repeated, ``SALTS`` times.
    """
    hot = cut(others.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(*on))
    n_hot = hot.count()
    if not n_hot:
        return rows.join(others, on)
    hot = hot.withColumn("__hot", F.lit(True))
    hot = F.broadcast(hot) if n_hot <= HOT_KEYS else hot
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = rows.join(hot, on, "left").withColumn("__salt", salt).drop("__hot")
    right = others.join(hot, on, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    # a stated number, since small inputs that make many pairs would be put together again
    tasks, keys = max(shuffle_partitions(rows.sparkSession), 1), [*on, "__salt"]
    return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys).drop("__salt")


KEY = "struct<id:string,label:string>"
#: Keys that are broadcast at most.
HOT_KEYS = 100_000


def _key(end: str, label: str) -> Column:
    return F.struct(F.col(end).alias("id"), F.col(label).alias("label")).cast(KEY)


def _keys(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(_key("id", "label").alias(name)).distinct()


def _within(one: DataFrame, first: DataFrame, steps: int) -> list[DataFrame]:
    """Nodes (``b``) at most 0, 1 ... ``steps`` edges a -> b from those of ``first(b)``."""
    sets = [cut(first)]
    for _ in range(steps):
        near = one.join(sets[-1].withColumnRenamed("b", "a"), "a", "left_semi").select("b")
        sets.append(cut(sets[-1].unionByName(near).distinct()))
    return sets


def _inner(one: DataFrame) -> DataFrame:
    """Nodes (``b``) with two edges or more: no other is inside a path, which enters and leaves by different edges."""
    both = one.select("b", "eid").unionByName(one.select(F.col("a").alias("b"), "eid"))
    return cut(both.groupBy("b").agg(F.min("eid").alias("low"), F.max("eid").alias("high")).where("low <> high").select("b"))


def _frontiers(one: DataFrame, first: DataFrame | None, most: int, goal: list[DataFrame] | None, longest: int, inner: DataFrame | None = None) -> list[DataFrame]:
    """Paths (start, end, labels, eids, nodes) of 1 ... ``most`` edges from ``first``; ``goal[j]`` holds what is at most j edges from the other side.

    A path of n edges stays only if its end can still reach the other side.  With ``goal``
    frontiers meet half-way, so the ends of two edges and more are inside a path: they are ``inner``.
    """
    out: list[DataFrame] = []
    for n in range(1, most + 1):
        if not out:
            step = one.join(first.withColumnRenamed("b", "a"), "a", "left_semi") if first is not None else one
            grown = step.select(F.col("a").alias("start"), F.col("b").alias("end"), F.array("label").alias("labels"), F.array("eid").alias("eids"), F.array("a", "b").alias("nodes"))
        else:
            step = one.join(inner, "b", "left_semi").join(goal[longest - n], "b", "left_semi") if goal is not None else one
            step = step.select(F.col("a").alias("end"), F.col("b").alias("next"), "label", "eid")
            grown = out[-1].join(step, "end").where(~F.array_contains("eids", F.col("eid"))).select(
                "start", F.col("next").alias("end"), F.concat("labels", F.array("label")).alias("labels"), F.concat("eids", F.array("eid")).alias("eids"), F.concat("nodes", F.array("next")).alias("nodes")
            )
        if goal is not None and n == 1:
            grown = grown.join(goal[longest - n].withColumnRenamed("b", "end"), "end", "left_semi")
        out.append(grown)
    return out


def variable_paths(edges: DataFrame, low: int, high: int, undirected: bool = True, starts: DataFrame | None = None, ends: DataFrame | None = None, at_start: DataFrame | None = None, at_end: DataFrame | None = None) -> DataFrame:
    """(start, end, hops, labels, nodes) of paths of ``low`` to ``high`` edges, no edge twice; nodes are structs of id and label.

    With ``starts(id, label)`` and ``ends(id, label)`` two frontiers grow towards each
    other and meet half-way.  Each is reduced at every step by a semi join with the
    nodes that can still reach the other side in the edges that are left, so neither
    holds more than the halves of possible paths.  With one side given paths grow from it.
    ``at_start(start, ...)`` and ``at_end(end, ...)`` are joined to the halves, before paths multiply.
    """
    one = edges.select(_key("from_id", "from_type").alias("a"), _key("to_id", "to_type").alias("b"), "label", F.col("id").alias("eid"))
    if undirected:
        loops = F.col("a") == F.col("b")
        one = one.unionByName(one.where(~loops).select(F.col("b").alias("a"), F.col("a").alias("b"), "label", "eid"))
    back = one.select(F.col("b").alias("a"), F.col("a").alias("b"), "label", "eid")
    first = _keys(starts, "b") if starts is not None else None
    last = _keys(ends, "b") if ends is not None else None
    found: list[DataFrame] = []
    columns = ["start", "end", "hops", "labels", "nodes"]
    if low == 0:
        stay = one.select(F.explode(F.array("a", "b")).alias("b")).distinct() if first is None and last is None else first if last is None else last if first is None else first.join(last, "b", "left_semi")
        none = F.array().cast("array<string>")
        stay = stay.select(F.col("b").alias("start"), F.col("b").alias("end"), F.lit(0).alias("hops"), none.alias("labels"), F.array("b").alias("nodes"))
    begun = lambda rows: rows if at_start is None else rows.join(at_start, "start")
    ended = lambda rows, end="end": rows if at_end is None else rows.join(at_end.withColumnRenamed("end", end), end)
    own = [c for rows in (at_start, at_end) if rows is not None for c in rows.columns if c not in ("start", "end")]
    turned = lambda p: p.select(F.col("end").alias("start"), F.col("start").alias("end"), F.reverse("labels").alias("labels"), "eids", F.reverse("nodes").alias("nodes"))
    if low == 0:
        found.append(ended(begun(stay)).select(*columns, *own))
    if first is not None and last is not None and high > 1:
        inner = _inner(one)
        ahead = _frontiers(one, first, -(-high // 2), _within(back, last, high - 1), high, inner)
        behind = _frontiers(back, last, high // 2, _within(one, first, high - 1), high, inner)
        for n in range(max(low, 1), high + 1):
            left = ahead[-(-n // 2) - 1]
            if n == 1:
                met = ended(begun(left.join(last.withColumnRenamed("b", "end"), "end", "left_semi")))
            else:
                right = turned(behind[n // 2 - 1]).select(F.col("start").alias("end"), F.col("end").alias("goal"), F.col("labels").alias("more"), F.col("eids").alias("others"), F.col("nodes").alias("rest"))
                # edges as columns of the halves: arrays are not taken apart for each pair
                one_by_one = lambda rows, column, name, many: rows.select("*", *[F.col(column)[i].alias(f"{name}{i}") for i in range(many)])
                left = one_by_one(begun(left.join(inner.withColumnRenamed("b", "end"), "end", "left_semi")), "eids", "__left", -(-n // 2))
                right = one_by_one(ended(right, "goal"), "others", "__right", n // 2)
                met = many_to_many(left, right, ["end"], ["start", "eids"])
                met = met.where(reduce(lambda x, y: x & y, [F.col(f"__left{i}") != F.col(f"__right{j}") for i in range(-(-n // 2)) for j in range(n // 2)]))
                met = met.select("start", F.col("goal").alias("end"), F.concat("labels", "more").alias("labels"), F.concat("nodes", F.slice("rest", 2, n)).alias("nodes"), *own)
            found.append(met.withColumn("hops", F.lit(n)).select(*columns, *own))
    else:
        from_end = first is None and last is not None
        grown = _frontiers(back, last, high, None, high) if from_end else _frontiers(one, first, high, None, high)
        for n in range(max(low, 1), high + 1):
            paths = turned(grown[n - 1]) if from_end else grown[n - 1]
            if last is not None and not from_end:
                paths = paths.join(last.withColumnRenamed("b", "end"), "end", "left_semi")
            found.append(ended(begun(paths)).withColumn("hops", F.lit(n)).select(*columns, *own))
    return reduce(DataFrame.unionByName, found)


def existing(rows: DataFrame, edges: DataFrame, var: str, label: str, to_id: str, to_type: str | None = None) -> DataFrame:
    """Rows whose variable (``<var>_id``, and ``<var>_label`` if it is there) has an edge to a node; MATCH texts say EXISTS."""
    hit = edges.where((F.col("label") == label) & (F.col("to_id") == to_id))
    if to_type is not None:
        hit = hit.where(F.col("to_type") == to_type)
    on = [c for c in (f"{var}_id", f"{var}_label") if c in rows.columns]
    return rows.join(hit.select(F.col("from_id").alias(f"{var}_id"), F.col("from_type").alias(f"{var}_label")).select(*on), on, "left_semi")


def path_sentences(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct sentences ``a label b`` of paths, in order, joined per path (start, end, sentence)."""
    rows = paths.withColumn("pid", F.xxhash64("nodes", "labels"))
    steps = rows.select("pid", "start", "end", F.posexplode("labels").alias("i", "label"), "nodes").select("pid", "start", "end", "i", "label", F.expr("nodes[i]").alias("a"), F.expr("nodes[i + 1]").alias("b"))
    n = lambda c: nodes.select(_key("id", "label").alias(c), F.col("name").alias(f"{c}_name"))
    named = steps.join(n("a"), "a", "left").join(n("b"), "b", "left")
    text = F.concat_ws(" ", F.coalesce("a_name", "a.id"), "label", F.coalesce("b_name", "b.id"))
    parts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("s")))), lambda x: x["s"]))
    return named.groupBy("pid", "start", "end").agg(F.array_join(parts, "; ").alias("sentence")).drop("pid")
