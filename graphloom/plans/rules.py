"""Rules that derive relations and properties.

    Define (s:Reader)-[p:regularOf]->(o:Library) {
        Structure { (s)-[f:borrowed]->(o) }
        Constraint {
            all = group(s).count(f.id)
            here = group(s, o).count(f.id)
            R1("share"): here / all > 0.5
        }
        Action { createEdgeInstance(src=s, dst=o, type=knows) }
    }

Constraint lines are assignments or conditions, all of them joined by and.
``group(keys).sum|count|avg|min|max(x)`` is a total beside the detail rows, which are
counted as they are (bag semantics).  Totals are combined before their shuffle and
joined back, so no task holds all rows of a hot key.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import EDGE_COLUMNS, ENDS, NODE_COLUMNS, Graph, as_edges, as_nodes, distinct_edges
from graphloom.plans.expressions import lower
from graphloom.plans.patterns import Matcher, Pattern, many_to_many, parse_paths
from graphloom.session import cut, shared_dir, shuffle_partitions

HEADER = re.compile(r"(?is)^\s*Define\s*(?P<head>\(.*?\)\s*-\s*\[.*?\]\s*->\s*\(.*?\))\s*\{(?P<body>.*)\}\s*$")
GROUP = re.compile(r"group\(\s*(?P<keys>[\w\s,]+?)\s*\)\s*\.\s*(?P<agg>sum|count|avg|min|max)\(\s*(?P<arg>[\w.]+)\s*\)")
AGGREGATES = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}


class RuleError(ValueError):
    pass


@dataclass
class Rule:
    head: Pattern
    structure: Pattern
    lines: list[str]
    actions: list[tuple[str, dict[str, str]]] = field(default_factory=list)
    priority: int = 0

    @property
    def derived(self):
        return self.head.steps[0]


def _block(body: str, name: str) -> str:
    m = re.search(rf"(?i)\b{name}\s*\{{", body)
    if not m:
        return ""
    depth, i = 1, m.end()
    while i < len(body) and depth:
        depth += {"{": 1, "}": -1}.get(body[i], 0)
        i += 1
    return body[m.end() : i - 1]


def parse_rule(text: str) -> Rule:
    priority = re.search(r"(?im)^\s*rulePriority\s*:\s*(\d+)\s*$", text)
    text = re.sub(r"(?im)^\s*rulePriority\s*:.*$", "", text)
    m = HEADER.match(text)
    if not m:
        raise RuleError("expected Define (s)-[p]->(o) { ... }")
    body = m["body"]
    structure = parse_paths(",".join(x.strip().rstrip(",") for x in _block(body, "Structure").strip().split("\n") if x.strip()))
    lines = [x.strip() for x in _block(body, "Constraint").strip().split("\n") if x.strip() and not x.strip().startswith("//")]
    actions = []
    for a in re.finditer(r"(createNodeInstance|createEdgeInstance)\s*\(([^()]*)\)", _block(body, "Action")):
        actions.append((a[1], {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in a[2].split(",") if "=" in p)}))
    return Rule(parse_paths(m["head"]), structure, lines, actions, int(priority[1]) if priority else 0)


class RuleEngine:
    """Evaluates rules over a graph; types make properties comparable: ``types[(label, property)]`` is a Spark type."""

    def __init__(self, graph: Graph, types: dict[str, str] | None = None, concepts: DataFrame | None = None, now: str | None = None, params: dict | None = None):
        self.graph, self.types, self.concepts, self.now, self.params = graph, types or {}, concepts, now, params or {}

    def matches(self, rule: Rule, edges: dict[str, DataFrame] | None = None, nodes: dict[str, DataFrame] | None = None) -> DataFrame:
        """Match rows that satisfy the constraints, with the assigned names as columns.

        ``edges`` and ``nodes`` stand for the graph's where a variable of the structure is named.
        """
        labels = {v: known or rule.head.nodes.get(v, []) for v, known in rule.structure.nodes.items()}
        matcher = Matcher(self.graph, self.concepts, self.params, self.now, edges, nodes)
        rows = matcher.bind(replace(rule.structure, nodes=labels))
        assigned: set[str] = set()

        def resolve(name: str) -> Column:
            if name in assigned:
                return F.col(f"_v_{name}")
            column = matcher.resolve(name)
            prop = name.partition(".")[2]
            return column.cast(self.types[prop]) if prop in self.types else column

        # rows that totals are made of, while no condition or assignment has changed what they would see
        base, fresh = rows, set()
        for line in rule.lines:
            line = re.sub(r"^R\w*\s*\([^)]*\)\s*:\s*", "", line)
            found = list(GROUP.finditer(line))
            groups = {f"_g{i}": m for i, m in enumerate(found)}
            text = line
            for name, m in groups.items():
                text = text.replace(m[0], name, 1)
            if found:
                used = {x.strip() for m in found for x in (*m["keys"].split(","), m["arg"])}
                if base is None or used & fresh:
                    base, fresh = rows, set()
                by_keys: dict[str, list[tuple[str, re.Match]]] = {}
                for name, m in groups.items():
                    by_keys.setdefault(",".join(k.strip() for k in m["keys"].split(",")), []).append((name, m))
                for keys, parts in by_keys.items():
                    columns = [resolve(k) for k in keys.split(",")]
                    totals = base.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(columns)]).agg(*[AGGREGATES[m["agg"]](resolve(m["arg"])).alias(n) for n, m in parts])
                    same = reduce(lambda x, y: x & y, [c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(columns)])
                    rows = rows.join(totals, same).drop(*[f"_k{i}" for i in range(len(columns))])
            look = lambda n, groups=groups: F.col(n) if n in groups else resolve(n)
            m = re.match(r"^(\w+)\s*=(?!=)\s*(.*)$", text)
            if m:
                rows = rows.withColumn(f"_v_{m[1]}", lower(m[2], look, self.params, self.now))
                assigned.add(m[1])
                fresh.add(m[1])
            else:
                rows = rows.where(lower(text, look, self.params, self.now))
                base = None
            rows = rows.drop(*groups)
        return rows

    def edges(self, rule: Rule, rows: DataFrame | None = None) -> DataFrame:
        """The derived relation, once per pair of ends; a concept target ``Type/concept`` is its id."""
        rows, step = self.matches(rule) if rows is None else rows, rule.derived
        relation = step.labels[0] if step.labels else step.var
        target = rule.head.nodes[step.target]
        concept = next((x for x in target if "/" in x), None)
        s = f"{step.source}_id"
        if concept:
            kind, name = concept.split("/", 1)
            pairs = rows.select(F.col(s).alias("s"), F.col(f"{step.source}_label").alias("st")).distinct()
            return as_edges(pairs, F.col("s"), F.col("st"), relation, F.lit(name), kind)
        pairs = rows.select(F.col(s).alias("s"), F.col(f"{step.source}_label").alias("st"), F.col(f"{step.target}_id").alias("o"), F.col(f"{step.target}_label").alias("ot")).distinct()
        return as_edges(pairs, F.col("s"), F.col("st"), relation, F.col("o"), F.col("ot"))

    def pairs(self, rule: Rule) -> DataFrame:
        """(from_id, from_type, to_id, to_type) of the derived relation, each once, of a rule that is ``plain``.

        Variables that the head does not name are eliminated one by one, first where that makes the
        fewest rows, and what is left of the structure is made distinct each time.  So only the
        last elimination makes as many rows as there are pairs; a source with one partner in it
        cannot give a pair twice, so its pairs are not shuffled.
        """
        matcher = Matcher(self.graph, self.concepts, self.params, self.now)
        key = lambda v: [f"{v}_id", f"{v}_label"]

        def resolve(name: str) -> Column:
            column, prop = matcher.resolve(name), name.partition(".")[2]
            return column.cast(self.types[prop]) if prop in self.types else column

        nodes: dict[str, DataFrame] = {}
        for v, known in rule.structure.nodes.items():
            rows = matcher.scan(v, sorted(set(known) | set(rule.head.nodes.get(v, [])) if not known else known))
            for line in rule.lines:
                if line_variables(line) == {v}:
                    rows = rows.where(lower(line, resolve, self.params, self.now))
            nodes[v] = rows.select(key(v)).distinct()
        factors: list[tuple[list[str], DataFrame]] = []
        for step in rule.structure.steps:
            rows = matcher.hops(step).select(*key(step.source), *key(step.target))
            for v in (step.source, step.target):
                rows = rows.join(nodes[v], key(v), "left_semi")
            factors.append(([step.source, step.target], cut(rows.distinct())))
        ends = [rule.derived.source, rule.derived.target]
        inner = [v for v in nodes if v not in ends]
        while inner:
            v = inner[0] if len(inner) == 1 else min(inner, key=lambda x: (_made([f for names, f in factors if x in names], key(x)), x))
            inner.remove(v)
            own = [f for f in factors if v in f[0]]
            factors = [f for f in factors if v not in f[0]]
            names, rows = own[0]
            for more, other in own[1:-1]:
                shared = [c for x in names if x in more for c in key(x)]
                names, rows = names + [x for x in more if x not in names], rows.join(other, shared)
            if len(own) == 1:
                names, rows = [x for x in names if x != v], rows.drop(*key(v)).distinct()
            else:
                more, other = own[-1]
                shared = [x for x in names if x in more]
                by = [x for x in names if x not in shared]
                left = [c for x in names for c in key(x)]
                if not by or not [x for x in more if x not in shared]:
                    rows = rows.join(other, [c for x in shared for c in key(x)])
                    names = [x for x in dict.fromkeys(names + more) if x != v]
                    rows = rows.select(*[c for x in names for c in key(x)]).distinct()
                else:
                    kept = [x for x in names if x != v]
                    names = kept + [x for x in more if x not in names]
                    rows = rows.select(left)
                    often = cut(rows.groupBy(*[c for x in kept for c in key(x)]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
                    met = lambda part, other=other, shared=shared, by=by, names=names: many_to_many(part, other, [c for x in shared for c in key(x)], [c for x in by for c in key(x)]).select(*[c for x in names for c in key(x)])
                    if often.limit(1).count():
                        on = [c for x in kept for c in key(x)]
                        rows = met(rows.join(often, on, "left_anti")).unionByName(met(rows.join(often, on, "left_semi")).distinct())
                    else:
                        rows = met(rows)
            factors.append((names, cut(rows) if inner else rows))
        rows = factors[0][1]
        for names, other in factors[1:]:
            rows = rows.join(other, [c for x in names for c in key(x)], "left_semi")
        return rows.select(*[F.col(c).alias(n) for c, n in zip([*key(ends[0]), *key(ends[1])], ENDS[:4], strict=True)])

    def values(self, rule: Rule, name: str = "o") -> DataFrame:
        """A derived property: (id, value), once per subject."""
        return self.matches(rule).select(F.col(f"{rule.derived.source}_id").alias("id"), F.col(f"_v_{name}").alias("value")).distinct()

    def memberships(self, rules: list[Rule]) -> DataFrame:
        """(id, concept) of several belongTo rules."""
        out = None
        for rule in rules:
            got = self.edges(rule).select(F.col("from_id").alias("id"), F.col("to_id").alias("concept"))
            out = got if out is None else out.unionByName(got)
        return out.distinct()

    def acted(self, rule: Rule, rows: DataFrame | None = None) -> Graph:
        """The nodes and edges that a rule's actions create from its matches."""
        rows = self.matches(rule) if rows is None else rows
        value = lambda text: lower(text, lambda n: F.col(f"_v_{n}") if f"_v_{n}" in rows.columns else Matcher(self.graph).resolve(n), self.params, self.now)
        out = Graph.empty(self.graph.nodes.sparkSession)
        for what, args in rule.actions:
            if what == "createNodeInstance":
                made = as_nodes(rows, value(args["id"]), args.get("type", "Others"), value(args["name"]) if "name" in args else None)
                out = Graph(out.nodes.unionByName(made.dropDuplicates(["id", "label"])), out.edges)
            else:
                kinds = {e: args.get(f"{e}Type", "Others") for e in ("src", "dst")}
                made = as_edges(rows, value(args["src"]), kinds["src"], args.get("type", "leadTo"), value(args["dst"]), kinds["dst"])
                out = Graph(out.nodes, out.edges.unionByName(distinct_edges(made)))
        return out


# derivation to the end


def makes(rule: Rule) -> set[tuple[str, str]]:
    """What a rule adds: ("edge", label) of its head and actions, ("node", label) of its actions."""
    out = {("edge", (rule.derived.labels or [rule.derived.var])[0])} if has_head(rule) else set()
    return out | {("node", a.get("type", "Others")) if what == "createNodeInstance" else ("edge", a.get("type", "leadTo")) for what, a in rule.actions}


def has_head(rule: Rule) -> bool:
    """Whether the head's relation is derived: both ends are matched, or the target is a concept."""
    step = rule.derived
    concept = any("/" in x for x in rule.head.nodes[step.target])
    return step.source in rule.structure.nodes and (concept or step.target in rule.structure.nodes)


def feeds(made: set[tuple[str, str]], rule: Rule) -> bool:
    """Whether a rule may match what has been added."""
    edges, nodes = ({x for kind, x in made if kind == k} for k in ("edge", "node"))
    steps = any(not s.labels or edges & set(s.labels) for s in rule.structure.steps) if edges else False
    labels = [known or rule.head.nodes.get(v, []) for v, known in rule.structure.nodes.items()]
    member = "belongTo" in edges and any("/" in x for known in labels for x in known)
    return steps or member or bool(nodes) and any(not known or "Entity" in known or nodes & {x.split("/")[0] for x in known} for known in labels)


def totals(rule: Rule) -> bool:
    """Whether a rule needs all rows at once, so that it must not depend on itself."""
    return any(GROUP.search(line) for line in rule.lines)


def strata(rules: dict[str, Rule]) -> list[list[str]]:
    """Groups of rules that depend on each other, each after the groups that it uses; within what is free, higher priority first."""
    direct = {n: {m for m, other in rules.items() if feeds(makes(other), rule)} for n, rule in rules.items()}
    reach = {n: set(d) for n, d in direct.items()}
    for k in rules:  # transitive
        for n in rules:
            if k in reach[n]:
                reach[n] |= reach[k]
    groups = {n: frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in rules}
    for n, rule in rules.items():
        if totals(rule) and direct[n] & groups[n] and n in reach[n]:
            raise RuleError(f"the totals of {n} depend on what it derives")
    out: list[list[str]] = []
    done: set[str] = set()
    waiting = set(groups.values())
    while waiting:
        ready = [g for g in waiting if set().union(*(reach[n] for n in g)) - g <= done]
        first = min(ready, key=lambda g: (-max(rules[n].priority for n in g), sorted(g)))
        waiting.remove(first)
        done |= first
        out.append(sorted(first))
    return out


def ordered(rules: dict[str, Rule]) -> list[str]:
    """Rule names such that a rule comes after those whose relations it uses; a cycle is an error."""
    groups = strata(rules)
    for group in groups:
        if len(group) > 1:
            raise RuleError(f"rules depend on each other: {group}")
    return [n for group in groups for n in group]


def produced(engine: RuleEngine, rule: Rule, edges: dict[str, DataFrame] | None = None, nodes: dict[str, DataFrame] | None = None) -> Graph:
    """The head's relation and what the actions create, from matches that use the given edges or nodes."""
    rows = engine.matches(rule, edges, nodes)
    out = engine.acted(rule, rows)
    return Graph(out.nodes, out.edges.unionByName(engine.edges(rule, rows))) if has_head(rule) else out


def line_variables(line: str) -> set[str]:
    return set(re.findall(r"\b([A-Za-z_]\w*)\.[A-Za-z_]", re.sub(r"'[^']*'|\"[^\"]*\"", "", line)))


def plain(rule: Rule) -> bool:
    """Whether a rule's relation is a projection of edges and of conditions on single nodes: ``pairs`` can make it."""
    step, steps = rule.derived, rule.structure.steps
    labels = [x for known in [*rule.structure.nodes.values(), *rule.head.nodes.values()] for x in known]
    if rule.actions or not has_head(rule) or len(rule.head.steps) != 1 or step.source == step.target or any("/" in x or x == "Entity" for x in labels):
        return False
    if any((s.low, s.high) != (1, 1) or s.undirected or s.source == s.target for s in steps):
        return False
    variables = set(rule.structure.nodes) | {s.var for s in steps}
    alone = lambda x: set(re.findall(r"\b[A-Za-z_]\w*", re.sub(r"'[^']*'|\"[^\"]*\"|\.\s*\w+", "", x))) & variables == line_variables(x)
    conditions = all(len(line_variables(x)) == 1 and line_variables(x) <= set(rule.structure.nodes) and alone(x) and not re.match(r"^\w+\s*=(?!=)|^R\w*\s*\(", x) and not GROUP.search(x) for x in rule.lines)
    # connected, so that each elimination is a join
    reached = {step.source}
    for _ in steps:
        reached |= {v for s in steps if {s.source, s.target} & reached for v in (s.source, s.target)}
    return conditions and reached == set(rule.structure.nodes)


def unfolded(rule: Rule, known: dict[str, Rule]) -> Rule | None:
    """A plain rule with steps over the relations of ``known`` replaced by the structures that define them; None if that cannot be."""
    nodes, steps, lines = {v: list(x or rule.head.nodes.get(v, [])) for v, x in rule.structure.nodes.items()}, [], list(rule.lines)
    for i, step in enumerate(rule.structure.steps):
        if not set(step.labels) & set(known) and step.labels:
            steps.append(step)
            continue
        if len(step.labels) != 1:
            return None if known else rule
        other = known[step.labels[0]]
        named = {other.derived.source: step.source, other.derived.target: step.target}
        for v, labels in other.structure.nodes.items():
            name, labels = named.setdefault(v, f"_u{i}_{v}"), labels or other.head.nodes.get(v, [])
            both = [x for x in nodes[name] if x in labels] if nodes.get(name) and labels else list(nodes.get(name) or labels)
            if not both and labels and nodes.get(name):
                return None
            nodes[name] = both
        steps += [replace(x, var=f"_u{i}_{x.var}", source=named[x.source], target=named[x.target]) for x in other.structure.steps]
        for line in other.lines:
            (v,) = line_variables(line)
            lines.append(re.sub(rf"""'[^']*'|"[^"]*"|\b{v}\.""", lambda m, v=v: f"{named[v]}." if m[0] == f"{v}." else m[0], line))
    return replace(rule, structure=Pattern(nodes, steps), lines=lines)


def _made(factors: list[DataFrame], on: list[str]) -> int:
    """Rows that joining these makes."""
    if len(factors) == 1:
        return 0
    counts = [f.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(f"__n{i}")) for i, f in enumerate(factors)]
    return reduce(lambda x, y: x.join(y, on), counts).agg(F.sum(reduce(lambda x, y: x * y, [F.col(f"__n{i}") for i in range(len(factors))]))).first()[0] or 0


class Delta:
    """What the last round has added, and rules evaluated over it: semi-naive derivation.

    A match that is new uses at least one new edge or node, so each place of a
    structure that may hold one is evaluated with the delta there and the whole graph
    elsewhere.  Paths of several edges and concepts are evaluated whole.
    """

    def __init__(self, new: Graph, made: set[tuple[str, str]]):
        self.new, self.made = new, made

    def evaluated(self, engine: RuleEngine, rule: Rule) -> list[Graph]:
        edges, nodes = ({x for kind, x in self.made if kind == k} for k in ("edge", "node"))
        labels = {v: known or rule.head.nodes.get(v, []) for v, known in rule.structure.nodes.items()}
        whole = any((s.low, s.high) != (1, 1) and (not s.labels or edges & set(s.labels)) for s in rule.structure.steps)
        if whole or "belongTo" in edges and any("/" in x for known in labels.values() for x in known):
            return [produced(engine, rule)]
        out = [produced(engine, rule, edges={s.var: self.new.edges}) for s in rule.structure.steps if edges and (not s.labels or edges & set(s.labels))]
        return out + [produced(engine, rule, nodes={v: self.new.nodes}) for v, known in labels.items() if nodes and (not known or "Entity" in known or nodes & {x.split("/")[0] for x in known})]


def composes(rule: Rule) -> bool:
    """Whether a rule does no more than join its relation with itself, between nodes of the same labels: it is transitive."""
    head, steps = rule.derived, rule.structure.steps
    if rule.lines or rule.actions or len(steps) != 2 or len(rule.structure.nodes) != 3:
        return False
    relation = (head.labels or [head.var])[0]
    if not all(s.labels == [relation] and (s.low, s.high) == (1, 1) and not s.undirected for s in steps):
        return False
    labels = [known or rule.head.nodes.get(v, []) for v, known in rule.structure.nodes.items()]
    if any("/" in x for known in [*labels, *rule.head.nodes.values()] for x in known) or any(set(known) != set(labels[0]) for known in labels):
        return False
    return any((a.source, a.target, b.target) == (head.source, b.source, head.target) for a, b in (steps, steps[::-1]))


def closure(edges: DataFrame, most: int = 100) -> DataFrame:
    """(from_id, from_type, to_id, to_type, far) of all that ``edges`` of these ends lead to; ``far`` is the least number of edges.

    A round joins the pairs that are 2 ** k edges apart with all pairs that are at most as
    far: that gives each pair of up to twice the distance from one place of each of its
    shortest paths, and its distance.  Pairs lie in buckets of their first end, by which they are
    joined and told from known ones, so only what a round finds is moved, once.
    """
    spark = edges.sparkSession
    parts, start, ends = shuffle_partitions(spark), ENDS[:2], ENDS[:4]
    names: list[str] = []
    at = lambda name: f"{shared_dir(spark)}/{name}"

    def bucketed(rows: DataFrame) -> DataFrame:
        names.append(f"closure_{uuid.uuid4().hex}")
        rows.write.bucketBy(parts, *start).option("path", at(names[-1])).saveAsTable(names[-1])
        return spark.table(names[-1])

    known = new = bucketed(edges.select(*ends).repartition(parts, *start).groupBy(*ends).agg(F.lit(1).cast("long").alias("far")))
    far = 1
    for _ in range(most):
        tips = new.where(F.col("far") == far).select(*start, F.col("to_id").alias("mid_id"), F.col("to_type").alias("mid_type"))
        if not tips.limit(1).count():
            break
        onward = known.select(F.col("from_id").alias("mid_id"), F.col("from_type").alias("mid_type"), *ends[2:], "far")
        found = many_to_many(tips, onward, ["mid_id", "mid_type"], start).select(*ends, (F.col("far") + far).alias("far"), F.lit(False).alias("old"))
        both = found.repartition(parts, *start).unionByName(known.withColumn("old", F.lit(True)))
        new = bucketed(both.groupBy(*ends).agg(F.min("far").alias("far"), F.max("old").alias("old")).where("NOT old").drop("old"))
        known = known.unionByName(new)
        far *= 2
    else:
        raise RuleError(f"no end within {most} rounds")
    found = spark.read.schema(known.schema).parquet(*map(at, names))
    for name in names:  # external tables: the files stay in the shared folder
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return found


def _composed(graph: Graph, rule: Rule, most: int) -> Graph:
    """What a transitive rule adds."""
    relation = (rule.derived.labels or [rule.derived.var])[0]
    source = rule.derived.source
    nodes = Matcher(graph).scan("n", rule.structure.nodes[source] or rule.head.nodes.get(source, []))
    edges = graph.edges.where(F.col("label") == relation).select(*ENDS[:4])
    for end in ("from", "to"):
        keys = [f"{end}_id", f"{end}_type"]
        edges = edges.join(nodes.select(F.col("n_id").alias(keys[0]), F.col("n_label").alias(keys[1])), keys, "left_semi")
    # pairs of one edge are there already
    far = closure(edges, most).where("far > 1")
    return Graph(graph.nodes.limit(0), as_edges(far, F.col("from_id"), F.col("from_type"), relation, F.col("to_id"), F.col("to_type")))


def derive_all(graph: Graph, rules: dict[str, Rule], most: int = 100, **options) -> Graph:
    """The graph with all that rules derive, to the end: rules may use what they and others derive.

    Groups of rules go in order of dependence.  A group that depends on itself is
    repeated on what is new (``Delta``) until nothing is; each round's new edges and
    nodes are a table in the shared folder.  A transitive rule by itself is a ``closure``.
    A ``plain`` rule that depends on nothing but the given edges and other plain rules is evaluated by ``pairs``,
    with the relations that it uses unfolded.  Derived edges count once by ends and label, derived nodes once by id and label.
    """
    base, defined = graph, {}
    made_by = [label for r in rules.values() for kind, label in makes(r) if kind == "edge"]
    for group in strata(rules):
        made = set().union(*(makes(rules[n]) for n in group))
        again = [n for n in group if feeds(made, rules[n])]
        if not again:
            rule = rules[group[0]]
            relation = (rule.derived.labels or [rule.derived.var])[0]
            used = {x for s in rule.structure.steps for x in s.labels}
            # what it uses is there, or is defined by plain rules alone
            whole = unfolded(rule, defined) if plain(rule) and all(s.labels for s in rule.structure.steps) and used & set(made_by) <= set(defined) else None
            if whole is not None and plain(whole) and made_by.count(relation) == 1 and not base.edges.where(F.col("label") == relation).limit(1).count():
                defined[relation] = whole
                found = RuleEngine(Graph(graph.nodes, base.edges), **options).pairs(whole)
                graph = graph.plus(Graph(graph.nodes.limit(0), as_edges(found, F.col("from_id"), F.col("from_type"), relation, F.col("to_id"), F.col("to_type"))))
                continue
            engine = RuleEngine(graph, **options)
            graph = _added(graph, reduce(Graph.plus, [produced(engine, rules[n]) for n in group]), made)[0]
            continue
        if len(group) == 1 and composes(rules[group[0]]):
            graph = graph.plus(_composed(graph, rules[group[0]], most))
            continue
        # what the group can match, made once
        work = _matched(graph, [rules[n] for n in group], made)
        engine = RuleEngine(work, **options)
        parts = [produced(engine, rules[n]) for n in group]
        for _ in range(most):
            work, new = _added(work, reduce(Graph.plus, parts), made, keep=True)
            if not new.edges.limit(1).count() and not new.nodes.limit(1).count():
                break
            graph = graph.plus(new)
            engine, delta = RuleEngine(work, **options), Delta(new, made)
            parts = [part for n in again for part in delta.evaluated(engine, rules[n])]
        else:
            raise RuleError(f"no end within {most} rounds: {group}")
    return graph


def _matched(graph: Graph, rules: list[Rule], made: set[tuple[str, str]]) -> Graph:
    """The part of the graph that rules can match or make, in the shared folder."""
    labels = [known or r.head.nodes.get(v, []) for r in rules for v, known in r.structure.nodes.items()]
    steps = [s.labels for r in rules for s in r.structure.steps]
    nodes, edges = graph.nodes, graph.edges
    if all(labels) and not any("Entity" in known for known in labels):
        wanted = {x.split("/")[0] for known in labels for x in known} | {x for kind, x in made if kind == "node"}
        nodes = nodes.where(F.col("label").isin(sorted(wanted)))
    if all(steps):
        wanted = {x for known in steps for x in known} | {x for kind, x in made if kind == "edge"} | {"belongTo"}
        edges = edges.where(F.col("label").isin(sorted(wanted)))
    return Graph(cut(nodes), cut(edges))


def _added(graph: Graph, found: Graph, made: set[tuple[str, str]], keep: bool = False) -> tuple[Graph, Graph]:
    """The graph with what it lacks of ``found``, and that; ``keep`` writes it to the shared folder."""
    edges, nodes = (sorted(x for kind, x in made if kind == k) for k in ("edge", "node"))
    new_edges, new_nodes = found.edges.limit(0), found.nodes.limit(0)
    if edges:
        # derived edges have no properties: their ends and label say all of them
        new_edges = found.edges.select(*ENDS).distinct().join(graph.edges.where(F.col("label").isin(edges)).select(*ENDS), ENDS, "left_anti")
        new_edges = cut(new_edges) if keep else new_edges
        new_edges = as_edges(new_edges, F.col("from_id"), F.col("from_type"), F.col("label"), F.col("to_id"), F.col("to_type"))
    if nodes:
        new_nodes = found.nodes.dropDuplicates(["id", "label"]).join(graph.nodes.where(F.col("label").isin(nodes)).select("id", "label"), ["id", "label"], "left_anti").select(*NODE_COLUMNS)
    new = Graph(cut(new_nodes) if keep else new_nodes, new_edges)
    return graph.plus(new), new


def fixpoint(seed: DataFrame, step, keys: list[str], most: int = 50) -> DataFrame:
    """``step(new rows)`` until nothing is new; each round is cut in the shared folder."""
    known = new = cut(seed.select(*keys).distinct())
    for _ in range(most):
        new = cut(step(new).select(*keys).distinct().join(known, keys, "left_anti"))
        if not new.limit(1).count():
            return known
        known = known.unionByName(new)
    raise RuleError(f"no fixpoint within {most} rounds")


def reasoning(graph: Graph, subject: str | tuple[str, str] | None = None, predicate: str | None = None, obj: str | tuple[str, str] | None = None) -> DataFrame:
    """Facts (s, s_type, p, o, o_type) by any of subject, predicate and object; an end is an id of any label, or (id, label)."""
    rows = graph.edges if predicate is None else graph.edges.where(F.col("label") == predicate)
    for side, end in (("from", subject), ("to", obj)):
        if end is not None:
            identifier, label = end if isinstance(end, tuple) else (end, None)
            rows = rows.where(F.col(f"{side}_id") == identifier)
            if label is not None:
                rows = rows.where(F.col(f"{side}_type") == label)
    return rows.select(F.col("from_id").alias("s"), F.col("from_type").alias("s_type"), F.col("label").alias("p"), F.col("to_id").alias("o"), F.col("to_type").alias("o_type"))
