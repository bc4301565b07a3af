import random

import pytest

from memlake.operators import atoms, graph
from memlake.session import cut

EDGES = "id string, from_node string, to_node string, depth string"


def bfs(seed, steps, depth):
    seen, frontier, out = {seed}, {seed: ()}, {}
    for level in range(1, depth + 1):
        fresh = {}
        for node, path in frontier.items():
            for nxt, e in steps.get(node, {}).items():
                if nxt not in seen:
                    fresh[nxt] = min(fresh.get(nxt, ("~",)), (*path, e))
        out |= {n: (level, p) for n, p in fresh.items()}
        seen |= set(fresh)
        frontier = fresh
    return out


@pytest.mark.parametrize("direction,rows_per_task", [("out", 100_000), ("in", 5), ("both", 5)])
def test_neighbors(spark, direction, rows_per_task):
    rng = random.Random(2)
    rows = [(f"e{i:03}", rng.choice(["hub", f"n{rng.randrange(20)}"]), f"n{rng.randrange(20)}", "x") for i in range(90)] + [("e0", None, "n1", "x"), ("e1", "n1", None, "x"), ("loop", "n1", "n1", "x")]
    steps = {}
    for e, a, b, _ in rows:
        for x, y in {"out": [(a, b)], "in": [(b, a)], "both": [(a, b), (b, a)]}[direction]:
            if x and y:
                held = steps.setdefault(x, {})
                held[y] = min(held.get(y, "~"), e)
    seeds = spark.createDataFrame([("hub",), ("n3",), ("n3",), ("lone",), (None,)], "id string")
    out = graph.neighbors(seeds, spark.createDataFrame(rows, EDGES), depth=3, direction=direction, rows_per_task=rows_per_task).collect()
    got = {(r["seed"], r["node"]): (r["depth"], tuple(r["path"])) for r in out}
    assert len(got) == len(out)
    assert got == {(s, n): v for s in ("hub", "n3", "lone") for n, v in bfs(s, steps, 3).items()}


def test_nodes_must_exist_and_depth(spark):
    edges = spark.createDataFrame([("1", "a", "b", "x"), ("2", "b", "c", "x")], EDGES)
    nodes = spark.createDataFrame([("a",), ("c",)], "id string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert graph.neighbors(seeds, edges, nodes=nodes, depth=2).count() == 0
    assert graph.paths(seeds, edges, 2).count() == 2
    with pytest.raises(ValueError):
        graph.neighbors(seeds, edges, depth=0)
    with pytest.raises(ValueError):
        graph.paths(seeds, edges, 0)


def test_paths_keep_every_path_but_no_cycle(spark):
    edges = spark.createDataFrame([("1", "a", "b", "x"), ("2", "a", "b", "x"), ("3", "b", "c", "x"), ("4", "b", "a", "x")], EDGES)
    out = graph.paths(spark.createDataFrame([("a",)], "id string"), edges, 2).collect()
    assert sorted(">".join(r["path"]) for r in out) == ["1", "1>3", "2", "2>3"]


def test_fold_nodes_and_endpoints(spark):
    log = spark.createDataFrame([("a", ["x"], '{"p":"1","q":"1"}', 1), ("a", ["y", "x"], '{"p":"2"}', 2), ("b", None, None, 1), (None, ["z"], None, 1)], "id string, labels array<string>, props string, seq int")
    assert {(r["id"], tuple(r["labels"]), r["props"]) for r in graph.fold_nodes(log, "seq").collect()} == {("a", ("x", "y"), '{"p":"2","q":"1"}'), ("b", (), None)}
    edges = spark.createDataFrame([("1", "a", "b", "x"), ("2", "a", "c", "x"), ("3", None, "b", "x")], EDGES)
    assert [tuple(r) for r in graph.missing_endpoints(edges, log).collect()] == [("2", "to", "c")]


ATOMS = "id string, title string, status string, tags array<string>, crosslinks map<string,array<string>>, linked_symbols array<struct<file:string,fn:string,line:int>>, geography array<string>, via string"


def index(spark):
    rows = [
        ("A", "Alpha", "stable", ["t"], {"references": ["B", "B", "", None], "resolves": ["X"]}, [("f.ts", "run", 3)], None, "v"),
        ("B", "Beta", "Approved", None, {"implements": ["C"], "other": ["Y"]}, [("f.ts", None, None)], ["g.ts:fn"], "v"),
        ("C", None, "draft", [], {"references": ["A"]}, None, ["f.ts"], "v"),
        ("D", "alpha", None, ["T2"], None, [("f.ts", "run", None), ("h.ts", "go", 1)], None, "v"),
    ]
    return spark.createDataFrame(rows, ATOMS)


def test_links_and_chains(spark):
    df = index(spark)
    assert {tuple(r) for r in atoms.broken_links(df).collect()} == {("A", "resolves", "X"), ("B", "other", "Y")}
    starts = spark.createDataFrame([("A",), ("Z",), ("A",)], "id string")
    assert {tuple(r) for r in atoms.verify_chains(starts, df).collect()} == {("A", "C", "not_approved", None, None), ("A", "A", "broken_crosslink", "resolves", "X"), ("Z", "Z", "missing", None, None)}
    assert {(r["target"], r["id"], r["score"]) for r in atoms.backlinks(df).collect()} >= {("B", "A", 1.0), ("A", "C", 1.0)}
    links = spark.createDataFrame([("B",), ("ALPHA",), ("nope",)], "link string")
    assert {tuple(r) for r in atoms.resolve_links(links, df).collect()} == {("B", "B"), ("ALPHA", "A"), ("nope", None)}


@pytest.mark.parametrize("symbol,ids", [("f.ts", "ABCD"), ("f.ts:run", "ABCD"), ("f.ts:run:3", "ABCD"), ("f.ts:run:4", "BCD"), ("f.ts:walk", "BC"), ("g.ts:any", "B"), ("h.ts:go:1", "D"), ("h.ts:go:2", ""), ("none.ts", "")])
def test_citations(spark, symbol, ids):
    out = atoms.citing_atoms(spark.createDataFrame([(symbol,), (None,)], "symbol string"), index(spark)).collect()
    assert sorted(r["id"] for r in out) == sorted(ids)


def test_search_and_keep_first(spark):
    from pyspark.sql import functions as F

    assert [r["id"] for r in atoms.substring_search(index(spark), "ALPHA", F.col("id")).collect()] == ["A", "D"]
    assert [r["id"] for r in atoms.substring_search(index(spark), "t2", F.col("id")).collect()] == ["D"]
    rows = spark.createDataFrame([("a", 2), ("a", 1), (None, 0)], "k string, o int")
    assert [tuple(r) for r in atoms.keep_first(rows, "k", F.col("o")).collect()] == [("a", 1)]
    assert graph.reachable(spark.createDataFrame([], "id string"), spark.createDataFrame([], "node string, next string")).count() == 0


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_reachable_depths(spark, stride):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(55)} | {(f"c{i}", f"c{i + 1}") for i in range(8)}
    steps = {}
    for a, b in pairs:
        steps.setdefault(a, {})[b] = "e"
    seeds = ["n1", "c0", "alone"]
    out = graph.reachable(spark.createDataFrame([(s,) for s in seeds], "id string"), spark.createDataFrame(sorted(pairs), "node string, next string"), stride=stride).collect()
    got = {(r["seed"], r["node"]): r["depth"] for r in out}
    assert len(got) == len(out)
    assert got == {(s, s): 0 for s in seeds} | {(s, n): d for s in seeds for n, (d, _) in bfs(s, steps, 60).items()}


def test_chain_too_long(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "node string, next string")
    with pytest.raises(ValueError, match="longer"):
        graph.reachable(spark.createDataFrame([("0",)], "id string"), chain, most=4, stride=2)


def test_long_chain_is_walked_to_its_end(spark):
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(140)], "node string, next string")
    out = graph.reachable(spark.createDataFrame([("0",)], "id string"), chain, stride=8).collect()
    assert sorted((int(r["node"]), r["depth"]) for r in out) == [(i, i) for i in range(141)]


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_walks_write_nothing_found_and_equal_level_by_level(spark, monkeypatch, direction):
    rng = random.Random(5)
    edges = [(f"e{rng.randrange(10_000):04}", f"n{min(rng.randrange(60), rng.randrange(60))}", f"n{rng.randrange(60)}") for _ in range(250)]
    edges += [("e1", None, "n1"), ("e2", "n1", None), (None, "n2", "n59"), ("same", "n3", "n7"), ("same", "n3", "n8")]
    frame = spark.createDataFrame(edges, "id string, from_node string, to_node string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(0, 60, 7)] + [("n7",), (None,), ("nowhere",)], "id string")
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df) or cut(df))
    walked = graph.neighbors(seeds, frame, depth=3, direction=direction)
    assert len(written) == 1  # the steps, and nothing that grows with seeds times nodes
    by_level = graph.neighbors(seeds, frame, depth=3, direction=direction, steps_held=0)
    rows = [sorted(map(str, out.select("seed", "node", "depth", "path").collect())) for out in (walked, by_level)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    assert walked.schema.simpleString() == by_level.schema.simpleString()
    assert graph.neighbors(seeds, frame.limit(0), depth=2, direction=direction).count() == 0
