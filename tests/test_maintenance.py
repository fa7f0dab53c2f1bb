import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import linker, relink
from graphquarry.sources import benchmarks, config, git, graphdb, sinks, store, workspace
from graphquarry.sources.parsers import module_name, parse_files


def tables(spark, files, roots=("",)):
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    symbols, imports, uses, _ = parse_files(workspace.describe(rows), list(roots))
    named = spark.createDataFrame([(p, module_name(p, "python" if p.endswith(".py") else "other", list(roots))) for p in files], "path string, module string")
    return {"files": named, "symbols": symbols, "imports": imports, "uses": uses}


def edges(t):
    a, b = t["symbols"].select(F.col("id").alias("from_id"), F.col("qualified_name").alias("a")), t["symbols"].select(F.col("id").alias("to_id"), F.col("qualified_name").alias("b"))
    return sorted(f"{r['path']} {r['line']} {r['a']} {r['type']} {r['name']} {r['b']}" for r in t["uses"].join(a, "from_id", "left").join(b, "to_id", "left").collect())


BEFORE = {
    "a.py": "def one():\n    pass\n", "b.py": "from a import one, two\n\ndef go():\n    one()\n    two()\n", "c.py": "import a\n\ndef run():\n    a.one()\n    late()\n",
    "d.py": "from c import *\n\nclass D:\n    def m(self):\n        self.n()\n\n    def n(self):\n        run()\n", "e.py": "from f import gone\n\ndef use():\n    gone()\n", "f.py": "def gone():\n    pass\n",
}


@pytest.mark.parametrize("change", [
    {"a.py": "def zero():\n    pass\n\ndef one():\n    pass\n\ndef two():\n    one()\n"},
    {"f.py": None},
    {"c.py": "import a\n\ndef late():\n    a.one()\n", "g.py": "class G:\n    pass\n"},
    {"d.py": "from c import *\nfrom b import go\n\nclass D(Base):\n    def m(self):\n        go()\n\nclass Base:\n    def n(self):\n        pass\n"},
])
def test_relink_equals_linking_everything(spark, change):
    old = tables(spark, BEFORE)
    old["uses"] = linker.link(old["symbols"], old["imports"], old["uses"], files=old["files"])
    after = {p: c for p, c in (BEFORE | change).items() if c is not None}
    new = tables(spark, {p: c for p, c in change.items() if c is not None} or {"none.py": ""})
    if not any(change.values()):
        new = {n: t.limit(0) for n, t in new.items()}
    paths = lambda some: spark.createDataFrame([(p,) for p in some], "path string")
    got = relink.relink(old, new, paths([p for p, c in change.items() if c is not None]), paths([p for p, c in change.items() if c is None]))
    whole = tables(spark, after)
    whole["uses"] = linker.link(whole["symbols"], whole["imports"], whole["uses"], files=whole["files"])
    assert edges(got) == edges(whole) != edges(old)


def test_what_is_resolved_again(spark):
    imports = spark.createDataFrame([(1, "a", "x", None), (2, "b", "a", None), (3, "c", None, None), (4, "d", None, "ns"), (5, "e", "x", None)], "id int, path string, target_path string, target_space string")
    assert sorted(r["id"] for r in relink.imports_to_resolve(imports, spark.createDataFrame([("a",)], "path string")).collect()) == [1, 2, 3]
    uses = spark.createDataFrame([(1, "a", "f", None), (2, "b", "f", 7), (3, "c", "f", None), (4, "c", "g", None), (5, "d", "f", None)], "id int, path string, name string, to_id long")
    make = lambda v, c, t: spark.createDataFrame([(v,)], f"{c} {t}")
    got = relink.uses_to_resolve(uses, make("a", "path", "string"), make(7, "id", "long"), make("c", "path", "string"), make("f", "name", "string"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_layout_and_links_through_it(spark, tmp_path):
    files = {
        "tsconfig.json": '{ // base\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["libs/*/src"], "one": ["libs/first/src/index.ts"],},},}',
        "package.json": '{"name": "root"}', "packages/core/package.json": '{"name": "@x/core", "exports": {".": {"import": "./dist/main.js"}, "./sub": "./dist/sub.js"}}',
        "packages/core/src/main.ts": "export class Core {\n  run() { return 1; }\n}\n", "packages/core/src/sub.ts": "export const sub = (a: number) => {\n  return a;\n};\n",
        "libs/first/src/index.ts": "export function first() { return 1; }\n",
        "app/use.ts": "import { Core } from '@x/core';\nimport { sub } from '@x/core/sub';\nimport { first } from '@lib/first';\nimport { far } from 'outside';\nexport class App extends Core {\n  go() { sub(1); first(); far(); }\n}\n",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    layout = config.read_layout(str(tmp_path))
    assert layout.candidates("app/use.ts", "one")[0] == "libs/first/src/index" and "packages/core/src/main" in layout.candidates("app/use.ts", "@x/core")
    assert config.export_target({"types": "a", "import": "b"}, ".") == "a" and config.export_target("m.js", "./x") is None and config.export_target({"./x": {"default": "y"}}, "./x") == "y"
    t = tables(spark, {n: b for n, b in files.items() if n.endswith(".ts")})
    linked = {**t, "uses": linker.link(t["symbols"], t["imports"], t["uses"], layout)}
    got = {e.split(" ", 2)[2] for e in edges(linked)}
    assert {"app/use:App extends Core packages/core/src/main:Core", "app/use:App.go calls sub packages/core/src/sub:sub", "app/use:App.go calls first libs/first/src/index:first", "app/use:App.go calls far None"} <= got


def test_relative_paths_of_any_depth(spark):
    rows = spark.createDataFrame([("a/b/../../../../../../../../../x/./y",), ("../../a/../b",), ("a//b/./c",)], "p string")
    assert [r[0] for r in rows.select(linker.tidy_path(F.col("p"))).collect()] == ["../../../../../../../x/y", "../../b", "a/b/c"]


def test_store(spark, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(store.NotReady):
        store.open_tables(spark, root)
    t = tables(spark, BEFORE)
    linked = linker.link(t["symbols"], t["imports"], t["uses"])
    store.save(root, symbols=t["symbols"], uses=linked)
    first = store.open_tables(spark, root)
    store.save(root, symbols=t["symbols"].limit(1), uses=linked)
    assert first["symbols"].count() == t["symbols"].count() > store.open_tables(spark, root)["symbols"].count() == 1
    store.write_note(spark, f"{root}/current.json", {"schema": 0, "version": "x", "tables": []})
    with pytest.raises(store.NotReady):
        store.open_tables(spark, root)
    made = []

    def compute():
        made.append(1)
        return spark.createDataFrame([(1, 0.5)], "id long, rank double")

    cache = store.RankCache(spark, root)
    for _ in range(2):
        assert cache.get(t["symbols"], linked, compute).count() == 1
    cache.get(t["symbols"].limit(2), linked, compute)
    assert len(made) == 2
    store.clear(spark, root)
    assert not os.path.exists(root)


def test_trees_and_stale_files(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    old = rows(("a/x", "1"), ("a/b/y", "1"), ("ab/z", "1"))
    got = store.refresh_tree(old, rows(("a/b/n", "2"), ("c/q", "2")), "a/b")
    assert sorted(r["path"] for r in got.collect()) == ["a/b/n", "a/x", "ab/z"]
    assert {r["path"]: r["stale"] for r in store.stale(old, rows(("a/x", "1"), ("a/b/y", "2"))).collect()} == {"a/x": False, "a/b/y": True, "ab/z": None}


def test_changed_lines(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    (tmp_path / "m.py").write_text("class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n")
    assert git.working_tree(spark, str(tmp_path)).count() == 0
    run("init", "-q"), run("add", "-A"), run("-c", "user.email=a@b", "-c", "user.name=n", "commit", "-qm", "one")
    (tmp_path / "m.py").write_text("class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        x = 2\n        return x\n")
    ranges = git.working_tree(spark, str(tmp_path))
    assert [tuple(r) for r in ranges.collect()] == [("m.py", 6, 7)]
    symbols = tables(spark, {"m.py": (tmp_path / "m.py").read_text()})["symbols"]
    got = git.changed_symbols(symbols, ranges).join(symbols, "id")
    assert [r["qualified_name"] for r in got.collect()] == ["m.A.g"]
    assert list(git.changed_ranges(["+++ b/x", "@@ -3,2 +2,0 @@", "@@ -9 +8 @@", "+++ /dev/null", "@@ -1 +1 @@"])) == [("x", 2, 2), ("x", 8, 8)]


def test_stored_queries(spark):
    table = lambda *rows: spark.createDataFrame(rows, "app string, name string, `order` int")
    stored = table(("b", "x", 2), ("b", "y", 1), ("a", "old", 1))
    now = graphdb.upsert_queries(stored, table(("a", "new", 2), ("a", "first", 1)))
    assert [tuple(r) for r in graphdb.list_queries(now).collect()] == [("a", "first", 1), ("a", "new", 2), ("b", "y", 1), ("b", "x", 2)]
    repos = spark.createDataFrame([("a", "r", 5), ("a", "s", 9)], "app string, name string, symbols long")
    assert graphdb.may_store(repos, now, "a", "s") and not graphdb.may_store(repos, now, "a", "r") and graphdb.may_store(repos, now, "c", "z")


def test_benchmarks(spark, tmp_path):
    (tmp_path / "transcripts").mkdir()
    say = lambda i, *tools: {"type": "assistant", "message": {"id": i, "usage": {"input_tokens": 1}, "content": [{"type": "tool_use", "name": t} for t in tools]}}
    lines = [say("m1", "read"), say("m1", "read", "grep"), say("m2", "read"), {"type": "result", "result": "so\nANSWER: x and y", "is_error": False}]
    (tmp_path / "transcripts/t-1-base-2.jsonl").write_text("\n".join(["junk", *map(json.dumps, lines)]))
    (tmp_path / "runs.jsonl").write_text(json.dumps({"task": "t-1", "arm": "base", "run": 2, "passed": False, "recall": 0.5}) + "\n" + json.dumps({"task": "t-1", "arm": "other", "run": 1, "passed": False, "recall": 0.0}) + "\nbad\n")
    (tmp_path / "tasks.json").write_text(json.dumps({"tasks": [{"id": "t-1", "check": ["x"], "expect": ["x", "y"], "forbid": ["z"]}]}))
    folder = str(tmp_path)
    events = benchmarks.read_transcripts(spark, folder)
    assert [tuple(r) for r in benchmarks.tool_counts(events).collect()] == [("t-1", "base", 2, {"grep": 1, "read": 2})]
    out = {r["arm"]: r for r in benchmarks.regrade(benchmarks.read_runs(spark, folder), events, benchmarks.read_tasks(spark, f"{folder}/tasks.json")).collect()}
    assert (out["base"]["passed"], out["base"]["recall"], out["base"]["changed"]) == (True, 1.0, True) and (out["other"]["passed"], out["other"]["changed"]) == (False, False)
    order = benchmarks.rotation(spark.createDataFrame([(0, "a"), (1, "b")], "number int, task string"), ["x", "y", "z"], 2).orderBy("run", "task", "place").collect()
    assert ["".join(r["arm"] for r in order[k:k + 3]) for k in range(0, 12, 3)] == ["zxy", "yzx", "yzx", "xyz"]


def test_tail(tmp_path):
    path = str(tmp_path / "u.jsonl")
    write = lambda text: open(path, "a").write(text)
    write('{"a": 0}\n')
    tail = sinks.UsageTail(path)
    assert tail.read() == []
    write('{"a": 1}\n{"a": ')
    assert tail.read() == [{"a": 1}]
    write('2}\nnot json\n[3]\n')
    assert tail.read() == [{"a": 2}]
    write('{"a": 4}\n')
    os.replace(path, path + ".1")
    assert tail.read() == []
    write('{"a": 5}\n')
    assert tail.read() == [{"a": 4}, {"a": 5}]
    assert sinks.UsageTail(path, history=True).read() == [{"a": 5}]
