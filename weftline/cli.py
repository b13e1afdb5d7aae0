"""python -m weftline.cli MODULE [-a NAME] [-f FILE | -d JSON | -i N]: run a workflow graph."""

from __future__ import annotations

import argparse

from .lineage.capture import capture
from .lineage.records import load_config, run_record, update_run
from .monitor.timing import Timer, write_timings
from .plans.graph import load_graph
from .session import local_session
from .sources.inputs import resolve


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    p.add_argument("module", help="module name or file with a Graph")
    p.add_argument("-a", "--attr", help="name of the graph in the module")
    p.add_argument("-f", "--file", help="JSON file with inputs by node; goes before -d and -i")
    p.add_argument("-d", "--data", help="JSON with inputs by node")
    p.add_argument("-i", "--iter", type=int, help="calls of every root")
    p.add_argument("-n", "--num", default="*", help="local cores")
    p.add_argument("-o", "--out", help="folder for results, one Parquet table for each open port; else they are printed")
    p.add_argument("--provenance-config", help="JSON or a JSON file; writes a run record")
    p.add_argument("--provenance-path")
    p.add_argument("--provenance-run-id", dest="run_id")
    p.add_argument("--provenance-user-id", dest="user")
    p.add_argument("--provenance-records", action="store_true", help="also write the lineage of every node's output")
    p.add_argument("--timing-dir", help="run node by node and write timing files of each there")
    p.add_argument("--timing-prefix", default="timing")
    p.add_argument("--run-id", dest="timing_run", default="run")
    p.add_argument("--print-shape", action="store_true")
    p.add_argument("--dot", action="store_true", help="print the graph for Graphviz and end")
    return p


def _put(df, path: str | None) -> None:
    df.write.mode("append").json(path) if path else df.show(truncate=False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    graph = load_graph(args.module, args.attr)
    if args.dot:
        print(graph.dot())
        return 0
    if args.print_shape:
        print(graph.shape_json())
    spark = local_session(args.num)
    inputs = resolve(spark, graph, args.file, args.data, args.iter)
    with Timer() as t:
        cfg = None
        if args.provenance_config:
            cfg = load_config(args.provenance_config, path=args.provenance_path, run_id=args.run_id, user=args.user)
            record = run_record(spark, cfg, graph)
            _put(record, args.provenance_path)
        if args.timing_dir:
            out, log = graph.run_timed(inputs)
            write_timings(log, args.timing_dir, args.timing_prefix, args.timing_run)
        elif cfg is not None and args.provenance_records:
            got = capture(graph, cfg, inputs)
            out = got.outputs
            for name, table in (("records", got.records), ("derivations", got.derivations)):
                _put(table, args.provenance_path and f"{args.provenance_path}-{name}")
        else:
            out = graph.compile(inputs)
        for (node, port), df in out.items():
            if args.out:
                df.write.mode("overwrite").parquet(f"{args.out}/{node}.{port}")
            else:
                print(f"{node}.{port}")
                df.show()
        if cfg is not None:
            _put(update_run(record, "terminated"), args.provenance_path)
    print(f"elapsed {t.seconds:.3f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
