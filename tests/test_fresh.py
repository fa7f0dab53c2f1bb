"""Merge-on-read tables and the index that a stream keeps fresh."""

import json

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import linker
from graphquarry.sources import workspace
from graphquarry.sources.merge import MergeStore
from graphquarry.sources.parsers import module_name, parse_files
from graphquarry.streaming.fresh import FreshIndex
from graphquarry.streaming.watch import read_landing


def test_merge_store(spark, tmp_path):
    """Random batches against a dictionary of files."""
    import random

    rng = random.Random(5)
    store = MergeStore(spark, str(tmp_path / "s"), {"t": "path string, v long", "u": "path string, w string"}, 4, 2)
    assert store.batch() == -1 and store.read("t").count() == 0
    want = {"t": {}, "u": {}}
    names = [f"{a}/{b}" for a in ("x", "y", "xy") for b in "abcd"]
    for batch in range(7):
        prefixes = [rng.choice(("x/", "y/", "xy/"))] if batch % 3 == 2 else []
        for some in want.values():
            for p in [p for p in some if any(p.startswith(q) for q in prefixes)]:
                del some[p]
        rows = {}
        for name, make in (("t", lambda p: batch), ("u", lambda p: f"{p}{batch}")):
            touched = rng.sample(names, 3)
            kept = [p for p in touched if rng.random() < 0.7]
            for p in touched:
                want[name].pop(p, None)
            want[name] |= {p: [make(p)] * rng.randint(1, 2) for p in kept}
            schema = store.tables[name]
            rows[name] = (spark.createDataFrame([(p, v) for p in kept for v in want[name][p]], schema), spark.createDataFrame([(p,) for p in touched], "path string"))
        assert store.commit(batch, rows, prefixes) and not store.commit(batch, rows, prefixes)
        again = MergeStore(spark, str(tmp_path / "s"), store.tables, 99)
        assert again.buckets == 4 and len(again.note()["deltas"]) <= 2
        for name, some in want.items():
            assert sorted(map(tuple, again.read(name).collect())) == sorted((p, v) for p, vs in some.items() for v in vs), (batch, name)
    one = spark.createDataFrame([(p,) for p in list(want["t"])[:1]], "path string")
    inside = again.read("t", again.buckets_of(one))
    assert len(inside.inputFiles()) < len(again.read("t").inputFiles()) and inside.join(one, "path", "left_semi").count() > 0


def edges(symbols, uses):
    a, b = symbols.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("a")), symbols.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("b"))
    return sorted(f"{r['path']} {r['line']} {r['a']} {r['type']} {r['name']} {r['b']}" for r in uses.join(a, "from_id", "left").join(b, "to_id", "left").collect())


def whole(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    described = workspace.describe(rows)
    symbols, imports, uses, _ = parse_files(described)
    named = spark.createDataFrame([(r["path"], module_name(r["path"], r["language"], [""])) for r in described.collect()], "path string, module string")
    return symbols, imports, linker.link(symbols, imports, uses, files=named)


TREE = {
    "boats/hull.py": "class Hull:\n    def float(self):\n        return self.weight()\n\n    def weight(self):\n        return 1\n",
    "boats/yacht.py": "from boats.hull import Hull\nimport boats.wind as wind\n\nclass Yacht(Hull):\n    def sail(self):\n        wind.speed()\n        return self.float()\n",
    "boats/wind.py": "def speed():\n    return 3\n", "harbour.py": "from boats.yacht import *\nfrom tides import high\n\ndef moor():\n    high()\n    Yacht()\n    buoy()\n",
    "web/knots.ts": "export function tie(n: number) {\n  return n;\n}\n", "web/index.ts": "export * from './knots';\n", "web/rope.ts": "import { tie, cut } from './index';\nexport class Rope {\n  use() { tie(1); cut(2); }\n}\n",
    "notes.txt": "not code",
}
BATCHES = [
    {"boats/wind.py": "def gust():\n    return 9\n"},
    {"tides.py": "def high():\n    return low()\n\ndef low():\n    return 0\n", "boats/yacht.py": None},
    {"web/knots.ts": "export function tie(n: number) {\n  return n;\n}\nexport function cut(n: number) {\n  return tie(n);\n}\n", "harbour.py": TREE["harbour.py"] + "\ndef buoy():\n    return moor()\n"},
    {"boats/": None, "boats/yacht.py": "class Yacht:\n    def sail(self):\n        return 0\n"},
    {"boats/hull.py": TREE["boats/hull.py"], "boats/yacht.py": TREE["boats/yacht.py"], "web/index.ts": "export { tie } from './knots';\n"},
]


def test_fresh_index_equals_a_full_build(spark, tmp_path):
    """After each batch of a stream, after a restart in between, across compactions."""
    landing, at = tmp_path / "in", str(tmp_path / "index")
    landing.mkdir()
    tree, seen = {}, []
    for number, change in enumerate([TREE, *BATCHES]):
        (landing / f"{number}.json").write_text("\n".join(json.dumps({"path": p, "content": c, "deleted": c is None}) for p, c in change.items()))
        index = FreshIndex(spark, at, on_change=seen.append, buckets=4, most_deltas=2)  # opened anew each time
        index.start(read_landing(spark, str(landing)), str(tmp_path / "checkpoint")).awaitTermination()
        for p, c in change.items():
            if p.endswith("/"):
                tree = {q: d for q, d in tree.items() if not q.startswith(p)}
        tree = {p: c for p, c in (tree | change).items() if c is not None and not p.endswith("/")}
        symbols, imports, uses = whole(spark, tree)
        assert sorted(r["path"] for r in index.table("files").collect()) == sorted(p for p in tree if p != "notes.txt")
        key = ("path", "qualified_name", "start_line")
        assert sorted(map(tuple, index.table("symbols").select(*key).collect())) == sorted(map(tuple, symbols.select(*key).collect()))
        assert edges(index.table("symbols"), index.table("uses")) == edges(symbols, uses), number
    assert seen == [0, 1, 2, 3, 4, 5]
    note = index.store.note()
    index.apply(spark.createDataFrame([("boats/hull.py", TREE["boats/hull.py"], False)], "path string, content string, deleted boolean"), 6)
    assert index.store.note() == note  # the same content is no change
    with pytest.raises(ValueError):
        index.apply(spark.createDataFrame([(f"f{k}/", None, True) for k in range(101)], "path string, content string, deleted boolean"), 7)
