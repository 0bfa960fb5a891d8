"""python -m convene [COMMAND] name=value...

  query    training=PATH query=PATH [output=PATH] [times=PATH] and the options of plans.engine.Config:
           the k points with the least sums of distances to the query points (the default);
           prepared=PATH in place of training: points that prepare wrote
  prepare  training=PATH output=PATH and options: points with their cells, for many queries
  crop     input=PATH output=PATH xmin= xmax= ymin= ymax=: the points in a box
  sample   input=PATH output=PATH rate=PERCENT [seed=] [decimals=6]: a random sample, by id
  summary  query=PATH [output=PATH] [text=PATH] [step= mindist= limit= diff=]: box, centroid and distance sum
  trace    query=PATH [step= mindist= limit= diff=]: the centroid's descent, to choose its step by
  sort     query=PATH output=PATH: the query points by x
  tree     input=PATH output=PATH capacity= [split= depth= rate= seed=] [bits=PATH]: a quadtree

Points are text files of tab-separated id, x, y.
"""

from __future__ import annotations

import dataclasses
import sys

from pyspark.sql import SparkSession

from convene.functions.geometry import in_box
from convene.operators import quadtree, sampling, summary
from convene.plans.engine import Config, prepare, run
from convene.sources import points as io

_ALIASES = {"phase15": "candidates", "fastSums": "fast_sums", "K": "k", "N": "n"}
_PATHS = ("training", "query", "input", "output", "prepared", "times", "text", "bits")
_NUMBERS = {"xmin": float, "xmax": float, "ymin": float, "ymax": float, "rate": float, "mindist": float, "limit": int, "diff": float, "decimals": int}
_NEEDS = {
    "query": ("query",),
    "prepare": ("training", "output"),
    "crop": ("input", "output", "xmin", "xmax", "ymin", "ymax"),
    "sample": ("input", "output", "rate"),
    "summary": ("query",),
    "trace": ("query",),
    "sort": ("query", "output"),
    "tree": ("input", "output", "capacity"),
}


def parse(args: list[str]) -> tuple[str, Config, dict]:
    """(command, options of queries and trees, all that was given)"""
    command = args[0] if args and "=" not in args[0] else "query"
    kinds, options, given = {f.name: f.type for f in dataclasses.fields(Config)}, {}, {}
    for arg in args[command != "query" or args[:1] == ["query"] :]:
        name, _, value = arg.partition("=")
        name = _ALIASES.get(name, name)
        if name in _PATHS:
            given[name] = value
        elif name in _NUMBERS:
            given[name] = _NUMBERS[name](value)
        elif name in kinds:
            options[name] = value.lower() == "true" if kinds[name] == "bool" else {"int": int, "float": float}.get(kinds[name], str)(value)
        else:
            raise SystemExit(f"unknown option {name}\n{__doc__}")
    if command not in _NEEDS or not set(_NEEDS[command]) <= set(given) | set(options) or command == "query" and not {"training", "prepared"} & set(given):
        raise SystemExit(__doc__)
    return command, Config(**options), given


def main(args: list[str]) -> None:
    command, config, given = parse(args)
    spark = SparkSession.builder.appName("convene").getOrCreate()
    read = lambda name: io.read_text(spark, given[name])
    descent = (config.step, given.get("mindist", 0.0), given.get("limit", config.steps), given.get("diff", 1e-6))
    if command == "query":
        ready = io.read_prepared(spark, given["prepared"], config.partitioning) if "prepared" in given else None
        done = run(None if ready else read("training"), read("query"), config, prepared=ready)
        if "output" in given:
            io.write_neighbours(done.nearest, given["output"])
        else:
            for r in done.nearest.orderBy("rank").collect():
                print(f"{r.id}\t{r.dist:.10f}")
        print("\n".join(f"{name}: {seconds:.3f} s" for name, seconds in done.seconds.items()), file=sys.stderr)
        if "times" in given:
            io.append_times(spark, done.seconds, given["times"])
        done.close()
    elif command == "prepare":
        io.write_prepared(prepare(read("training"), config), given["output"])
    elif command == "crop":
        io.write_text(read("input").where(in_box("x", "y", given["xmin"], given["ymin"], given["xmax"], given["ymax"])), given["output"])
    elif command == "sample":
        io.write_text(sampling.bernoulli(read("input"), given["rate"], config.seed).orderBy("id"), given["output"], given.get("decimals", 6))
    elif command == "summary":
        s = summary.summarize(read("query"), *descent)
        print(s.line())
        if "output" in given:
            io.write_summary(spark, s, given["output"])
        if "text" in given:
            io.write_summary_text(spark, s, given["text"])
    elif command == "trace":
        step, mindist, limit, diff = descent
        for r in summary.trace(read("query"), step, limit, mindist, diff).orderBy("iter").collect():
            print(f"{r.iter}\t{r.x:.10f}\t{r.y:.10f}\t{r.move:.10f}\t{r.sumdist:.10f}")
    elif command == "sort":
        io.write_sorted(read("query"), given["output"])
    elif command == "tree":
        sample = read("input") if given.get("rate", 100) >= 100 else sampling.bernoulli(read("input"), given["rate"], config.seed)
        tree = quadtree.build(sample, config.capacity, config.split, config.depth)
        io.write_tree(tree, given["output"])
        if "bits" in given:
            io.write_tree_bits(tree, given["bits"])
        print(" ".join(f"{k}={v}" for k, v in quadtree.shape(tree).items()))


if __name__ == "__main__":
    main(sys.argv[1:])
