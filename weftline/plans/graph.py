"""Workflow graphs: named nodes with ports, joined by directed edges.

A node is a function from input DataFrames, by port, to output DataFrames, by
port. Edges are a directed multigraph; several edges into one port are a merge
(union by name), several out of one port a tee. Graphs may be nested: a
:class:`Composite` is a graph with named outer ports and is inlined before
compiling, with as many edges to and from its ports as wanted.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Ports = dict[str, DataFrame]


class GraphError(ValueError):
    """The graph cannot be compiled."""


@dataclass(eq=False)
class Node:
    """``fn`` takes {port: DataFrame}; a DataFrame in return means the single output port.

    ``derives``: for lineage, the columns by which an output that is not row by row
    belongs to its inputs; see :mod:`lineage.capture`.
    """

    name: str
    fn: Callable[[Ports], Ports | DataFrame]
    inputs: tuple[str, ...] = ("input",)
    outputs: tuple[str, ...] = ("output",)
    grouping: dict[str, object] = field(default_factory=dict)
    instances: int = 1
    derives: list[str] | None = None

    def __call__(self, given: Ports) -> Ports:
        from ..operators.routing import route

        made = self.fn({p: route(df, self.grouping.get(p), self.instances) for p, df in given.items()})
        if isinstance(made, DataFrame):
            made = {self.outputs[0]: made}
        unknown = set(made) - set(self.outputs)
        if unknown:
            raise GraphError(f"{self.name} wrote to unknown ports {sorted(unknown)}")
        return made


@dataclass(eq=False)
class Composite:
    """A graph used as a node: outer port names mapped to (node, port) inside."""

    name: str
    graph: Graph
    input_map: dict[str, tuple[object, str]] = field(default_factory=dict)
    output_map: dict[str, tuple[object, str]] = field(default_factory=dict)

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(self.input_map)

    @property
    def outputs(self) -> tuple[str, ...]:
        return tuple(self.output_map)


@dataclass(frozen=True)
class Edge:
    source: object
    out_port: str
    target: object
    in_port: str


class Graph:
    """A workflow; see the module."""

    def __init__(self, name: str = "workflow"):
        self.name = name
        self.nodes: list[Node | Composite] = []
        self.edges: list[Edge] = []

    def add(self, node: Node | Composite):
        if not isinstance(node, (Node, Composite)):
            raise TypeError(f"a graph holds Node and Composite objects, not {type(node).__name__}")
        if node not in self.nodes:
            self.nodes.append(node)
        return node

    def connect(self, source, out_port: str, target, in_port: str) -> None:
        """Join two ports; nodes are added as needed."""
        self.add(source)
        self.add(target)
        if out_port not in source.outputs:
            raise GraphError(f"{source.name} has no output {out_port!r}")
        if in_port not in target.inputs:
            raise GraphError(f"{target.name} has no input {in_port!r}")
        self.edges.append(Edge(source, out_port, target, in_port))

    def chain(self, *nodes) -> Graph:
        """Connect each node's first output to the next node's first input."""
        for a, b in zip(nodes, nodes[1:], strict=False):
            self.connect(a, a.outputs[0], b, b.inputs[0])
        return self

    def flatten(self) -> Graph:
        """The same workflow without composites."""
        out = Graph(self.name)
        inner: dict[int, Graph] = {}
        for n in self.nodes:
            if isinstance(n, Composite):
                inner[id(n)] = n.graph.flatten()
                for x in inner[id(n)].nodes:
                    out.add(x)
                out.edges += inner[id(n)].edges
            else:
                out.add(n)

        def resolve(node, port, side):
            while isinstance(node, Composite):
                node, port = getattr(node, side)[port]
            return node, port

        for e in self.edges:
            s, sp = resolve(e.source, e.out_port, "output_map")
            t, tp = resolve(e.target, e.in_port, "input_map")
            out.edges.append(Edge(s, sp, t, tp))
        return out

    def order(self) -> list[Node]:
        """Nodes so that every edge goes forward; raises on a cycle."""
        waiting = {id(n): sum(1 for e in self.edges if e.target is n) for n in self.nodes}
        ready = [n for n in self.nodes if not waiting[id(n)]]
        done = []
        for n in ready:
            done.append(n)
            for e in self.edges:
                if e.source is n:
                    waiting[id(e.target)] -= 1
                    if not waiting[id(e.target)]:
                        ready.append(e.target)
        if len(done) < len(self.nodes):
            stuck = [n.name for n in self.nodes if n not in done]
            raise GraphError(f"the graph has a cycle through {stuck}; use operators.combine.iterate for bounded feedback")
        return done

    def compile(self, inputs: dict | None = None, cache_fan_out: bool = False, around: Callable | None = None) -> dict[tuple[str, str], DataFrame]:
        """Lazy DataFrames of all outputs that no edge takes up, by (node name, port).

        ``inputs`` gives DataFrames to ports: {node or its name: DataFrame or {port: DataFrame}}.
        With ``cache_fan_out`` an output that several edges take up is persisted.
        ``around`` is called instead of each node, with the node and its inputs.
        """
        flat = self.flatten()
        made = flat._run(inputs or {}, cache_fan_out, around)
        used = {(id(e.source), e.out_port) for e in flat.edges}
        return {(n.name, p): df for n in flat.nodes for p, df in made[id(n)].items() if (id(n), p) not in used}

    def _run(self, inputs: dict, cache: bool, around: Callable | None = None) -> dict[int, Ports]:
        made: dict[int, Ports] = {}
        for n in self.order():
            given: dict[str, list[DataFrame]] = {}
            for key in (n, n.name):
                if key in inputs:
                    x = inputs[key]
                    for p, df in (x if isinstance(x, dict) else {n.inputs[0]: x}).items():
                        given.setdefault(p, []).append(df)
                    break
            for e in self.edges:
                if e.target is n:
                    if e.out_port not in made[id(e.source)]:
                        raise GraphError(f"{e.source.name} did not write to {e.out_port!r}")
                    given.setdefault(e.in_port, []).append(made[id(e.source)][e.out_port])
            ports = {}
            for p, dfs in given.items():
                whole = dfs[0]
                for df in dfs[1:]:
                    whole = whole.unionByName(df)
                ports[p] = whole
            made[id(n)] = n(ports) if around is None else around(n, ports)
            if cache:
                for p in made[id(n)]:
                    if sum(1 for e in self.edges if e.source is n and e.out_port == p) > 1:
                        made[id(n)][p] = made[id(n)][p].persist()
        return made

    def run_timed(self, inputs: dict | None = None) -> tuple[dict[tuple[str, str], DataFrame], list[dict]]:
        """Run node by node, each output written before the next node starts; outputs and a row of timing for each output.

        Compiled as a whole, nodes melt into common stages and have no time of their
        own; here each has, at the price of writing everything in between.
        """
        from time import perf_counter

        from ..scratch import Scratch, rows

        log: list[dict] = []

        def around(node, given):
            made = {}
            for port, df in node(given).items():
                t = perf_counter()
                made[port], seen = Scratch(df.sparkSession, "timed").write(df, n=rows(df))
                secs = perf_counter() - t
                log.append({"pe_id": node.name, "port": port, "count": seen["n"], "total_secs": secs, "avg_secs": secs / max(1, seen["n"])})
            return made

        return self.compile(inputs, around=around), log

    def types(self, inputs: dict | None = None) -> dict[str, str]:
        """Schema of every output port, found without running anything."""
        flat = self.flatten()
        made = flat._run(inputs or {}, False)
        return {f"{n.name}.{p}": df.schema.simpleString() for n in flat.nodes for p, df in made[id(n)].items()}

    def shape(self) -> dict:
        """Abstract shape: nodes in order and their edges."""
        flat = self.flatten()
        return {
            "name": self.name,
            "nodes": [{"name": n.name, "inputs": list(n.inputs), "outputs": list(n.outputs), "instances": n.instances} for n in flat.order()],
            "edges": [{"from": e.source.name, "output": e.out_port, "to": e.target.name, "input": e.in_port} for e in flat.edges],
        }

    def concrete_shape(self) -> dict:
        """Instances as ``name@rank`` and the edges between them that routing allows."""
        flat = self.flatten()
        ranks = lambda n: [f"{n.name}@{r}" for r in range(n.instances)]
        edges = set()
        for e in flat.edges:
            to = ranks(e.target)
            if e.target.grouping.get(e.in_port) == "global":
                to = to[:1]
            edges |= {(a, b) for a in ranks(e.source) for b in to}
        return {"nodes": [r for n in flat.order() for r in ranks(n)], "edges": sorted(edges)}

    def shape_json(self) -> str:
        return json.dumps(self.shape(), indent=1)

    def dot(self) -> str:
        """Graphviz text, composites as clusters."""
        lines = [f"digraph {json.dumps(self.name)} {{", " rankdir=LR; node [shape=record];"]
        number: dict[int, str] = {}

        def draw(g: Graph, indent: str):
            for n in g.nodes:
                if isinstance(n, Composite):
                    lines.append(f'{indent}subgraph "cluster_{n.name}" {{ label={json.dumps(n.name)};')
                    draw(n.graph, indent + " ")
                    lines.append(indent + "}")
                else:
                    number[id(n)] = f"n{len(number)}"
                    ports = lambda ps, side: "{" + "|".join(f"<{side}_{p}> {p}" for p in ps) + "}"
                    lines.append(f'{indent}{number[id(n)]} [label="{{{ports(n.inputs, "i")}|{n.name}|{ports(n.outputs, "o")}}}"];')

        draw(self, " ")
        for e in self.flatten().edges:
            lines.append(f" {number[id(e.source)]}:o_{e.out_port} -> {number[id(e.target)]}:i_{e.in_port};")
        return "\n".join([*lines, "}"])


def load_graph(module: str, attr: str | None = None) -> Graph:
    """A graph from a module name or a file; without ``attr`` the last one defined."""
    import importlib
    import importlib.util
    import os

    if os.path.exists(module):
        spec = importlib.util.spec_from_file_location("weftline_user_graph", module)
        m = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(m)
    else:
        m = importlib.import_module(module)
    if attr:
        return getattr(m, attr)
    found = [v for v in vars(m).values() if isinstance(v, Graph)]
    if not found:
        raise GraphError(f"no graph in {module}")
    return found[-1]
