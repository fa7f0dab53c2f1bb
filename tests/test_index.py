import math
import random

import duckdb

from graphquarry.api import Index
from graphquarry.operators import answers, pack
from graphquarry.sources import sinks
from graphquarry.streaming import watch

SF = "/root/testdata/sf0.001"
FILES = {
    "shop/__init__.py": "", "shop/pricing.py": 'def price(n):\n    """The price of n."""\n    return n * tax(n)\n\n\ndef tax(n):\n    return 2\n',
    "shop/cart.py": "from .pricing import price\n\n\nclass Cart:\n    def total(self):\n        return price(3)\n\n    def pay(self):\n        return self.total()\n",
    "tests/test_cart.py": "from shop.cart import Cart\n\n\ndef test_total():\n    assert Cart().pay()\n",
}


def test_requests(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    index = Index.build(spark, str(tmp_path))
    assert [r["qualified_name"] for r in index.search_symbols("pri").collect()] == ["shop.pricing.price", "shop.pricing.tax"]  # the module's name counts, too
    assert [r["line"] for r in index.file_outline("shop/cart.py").collect()] == ["class Cart", "def total(self)", "def pay(self)"]
    assert index.symbol_source("shop.cart.Cart.pay").collect()[0]["source"] == "def pay(self):\n    return self.total()"
    found = index.find_references("shop.pricing.price")
    uses, other, callers = found.uses, found.other, found.callers
    names = {r["id"]: r["qualified_name"] for r in index.symbols.collect()}
    assert {(names[r["id"]], r["level"]) for r in callers.collect()} == {("shop.cart.Cart.total", 1), ("shop.cart.Cart.pay", 2)}
    assert [(r["path"], r["line"]) for r in uses.collect()] == [("shop/cart.py", 6)] and ("shop/cart.py", 1) in {(r["path"], r["line"]) for r in other.collect()}
    assert not found.truncated and [r["source"] for r in found.code.collect()] == ["    def total(self):\n        return price(3)"]
    assert {r["qualified_name"] for r in index.callees("shop.cart.Cart")[0].collect()} == {"shop.pricing.price"}
    assert [r["source"] for r in index.exact_match("pay").collect()] == ["    def pay(self):\n        return self.total()"] and index.exact_match("Cart").count() == 0
    assert [(r["shown"], r["path"]) for r in index.symbol_source(["shop.pricing.tax", "Cart"]).orderBy("path").collect()] == [("whole", "shop/cart.py"), ("whole", "shop/pricing.py")]
    levels, tests = answers.blast_groups(index.find_references("shop.pricing.price", 5).callers)
    assert [(r["level"], r["names"]) for r in levels.collect()] == [(1, "shop.cart.Cart.total"), (2, "shop.cart.Cart.pay")]
    assert index.repo_map().count() == 6 and index.repo_map(100, "shop").count() >= 1
    by_name = {v: k for k, v in names.items()}
    seeds = lambda task: answers.seeds_from_task(index.symbols, index.ranks(), task)
    assert seeds("Cart.pay is slow") == ([by_name["shop.cart.Cart.pay"]], []) and seeds("why does tax() run") == ([by_name["shop.pricing.tax"]], [])
    assert seeds("look into pricing totals and missing_name") == ([], []) and seeds("what is the tota of carts, pays") == ([], [by_name["shop.cart.Cart.total"]])
    assert [names[r["id"]] for r in index.get_context("the tota is wrong").filter("seed").collect()] == ["shop.cart.Cart.total"]
    saved = str(tmp_path / "kept")
    index.save(saved)
    assert Index.open(spark, saved).uses.count() == index.uses.count()
    got = index.get_context(seeds=["shop.pricing.price"]).collect()
    assert [(names[r["id"]], r["level"]) for r in got if r["seed"]] == [("shop.pricing.price", 4)] and len(got) > 2
    told = {names[r["id"]]: r["text"] for r in index.context_text(spark.createDataFrame([(by_name[n], k) for n, k in (("shop.cart.Cart", 1), ("shop.cart.Cart.pay", 4), ("shop.cart.Cart.total", 2), ("shop.pricing.price", 3))], "id long, level int")).collect()}
    assert told == {
        "shop.cart.Cart": "  4-9 class Cart", "shop.cart.Cart.pay": "    8-9 method pay\n      def pay(self):\n          return self.total()", "shop.cart.Cart.total": "    5-6 def total(self)",
        "shop.pricing.price": "  1-3 def price(n)\n    // The price of n.",
    }
    source, called, external = index.source_with_callees("shop.pricing.price")
    assert source.count() == 1 and [(r["qualified_name"], r["summary"]) for r in called.collect()] == [("shop.pricing.tax", None)] and external.count() == 0


def plain_pack(rows, seeds, budget, above):
    """The packing rule without any shortcut: all is recomputed from the shown levels."""
    limit, by_id = math.floor(0.9 * budget), {r["id"]: r for r in rows}
    everyone = by_id | {x["id"]: by_id.get(x["id"], x) for some in above.values() for x in some}

    def total(levels):
        seen = {by_id[k]["path"] for k in levels if k in by_id and k in shown}
        return sum(pack.cost(everyone[k], v) for k, v in levels.items()) + sum(math.ceil((len(p) + 1) / 4) for p in seen)

    def value(levels):
        return sum(by_id[k]["score"] * pack.LEVEL_VALUE[v] for k, v in levels.items() if k in by_id)

    def with_(levels, r, level):
        out = dict(levels)
        if r["id"] not in out:
            for x in above.get(r["id"], ()):
                if x["id"] in out:
                    break
                out[x["id"]] = 1
        return out | {r["id"]: level}

    levels, shown, used = {}, set(), 0
    choices = lambda r: [k for k in range(levels.get(r["id"], 0) + 1, (3 if r["members"] or r["hops"] >= 2 else 4) + 1) if k != 3 or r["d"]]

    def step(r, level):
        nonlocal shown
        before, held = total(levels), shown
        shown = shown | {r["id"]}
        after = total(with_(levels, r, level))
        gain = value(with_(levels, r, level)) - value(levels)
        shown = held
        return after - before, gain

    spent = 0
    for r in rows:
        for level in reversed(choices(r)) if r["id"] in seeds else ():
            more, _ = step(r, level)
            if spent + more <= limit and used + more <= 0.6 * budget:
                levels, shown, spent, used = with_(levels, r, level), shown | {r["id"]}, spent + more, used + more
                break
    while True:
        options = [(gain / max(more, 1), -k, -level, r, more) for k, r in enumerate(rows) for level in choices(r) for more, gain in [step(r, level)] if gain > 0 and spent + more <= limit]
        if not options:
            return levels
        _, _, level, r, more = max(options, key=lambda o: o[:3])
        levels, shown, spent = with_(levels, r, -level), shown | {r["id"]}, spent + more


def test_pack_against_the_plain_rule():
    rng = random.Random(3)
    for _ in range(25):
        rows = [{"id": k, "path": f"p{k % 4}", "start_line": k, "h1": rng.randint(8, 30), "h2": rng.randint(20, 120), "d": rng.choice([None, 50, 200]), "chars": rng.randint(40, 900), "members": k % 7 == 0, "hops": k % 3, "score": rng.uniform(0.01, 3)} for k in range(30)]
        above = {k: [{"id": 100 + k % 4, "path": f"p{k % 4}", "start_line": 0, "h1": 12}] for k in range(30) if k % 2} | {k: [{"id": k - 8, "path": f"p{k % 4}", "start_line": k - 8, "h1": rows[k - 8]["h1"]}] for k in (8, 18, 28)}
        for budget in (500, 1500):
            out = pack.pack(rows, {0, 1, 3}, budget, above)
            assert {r["id"]: r["level"] for r in out} == plain_pack(rows, {0, 1, 3}, budget, above)
            assert out == sorted(out, key=lambda r: (r["path"], r["start_line"], r["id"]))


def test_csv_and_script(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"', None), (2, "x,y\nz", 1.5)], "id int, `text` string, v double").coalesce(1)
    sinks.export_csv(rows, str(tmp_path / "csv"))
    read = lambda d: b"".join(p.read_bytes() for p in sorted((tmp_path / "csv" / d).glob("part-*")))
    assert read("header") == b"id,text,v\r\n" and read("rows") == b'1,"a ""b""",\r\n2,"x,y\nz",1.5\r\n'
    assert sinks.cypher_literal({"a": None, "b c": [1, True, float("nan")], "d": 'q"'}) == '{`b c`: [1, true, null], d: "q\\""}'
    assert [r[0] for r in sinks.graph_script(rows.select("id"), "CREATE (n)", 1).collect()] == ["UNWIND [{id: 1}] AS row\nCREATE (n);", "UNWIND [{id: 2}] AS row\nCREATE (n);"]


def test_usage_log(spark, tmp_path):
    log = sinks.UsageLog(str(tmp_path / "u.jsonl"))
    for k in range(3):
        log.record({"t": f"2024-01-0{k + 1}T00:00:00Z", "client": "c", "tool": "x", "args": "a" * 300, "chars": k})
    with open(log.path, "a") as f:
        f.write("not json\n")
    out = sinks.read_usage(spark, log.path).filter("tool is not null").collect()
    assert len(out) == 3 and len(out[0]["args"]) == 200


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text('{"path": "a", "content": "1"}\n{"path": "b", "content": "1"}\n')
    seen = []
    index = watch.IncrementalIndex(spark, str(tmp_path / "out"), lambda s: seen.append({r["path"]: r["state"] for r in s.collect()}))
    run = lambda: index.start(watch.read_landing(spark, str(landing)), str(tmp_path / "cp")).awaitTermination(60)
    run()
    (landing / "2.json").write_text('{"path": "a", "content": "2"}\n{"path": "b", "deleted": true}\n{"path": "c", "content": "3"}\n')
    run()
    assert {r["path"]: r["content"] for r in index.files().collect()} == {"a": "2", "c": "3"}
    assert seen == [{"a": "added", "b": "added"}, {"a": "changed", "b": "gone", "c": "added"}]
    (landing / "3.json").write_text('{"path": "d", "content": "4"}\n')
    index = watch.IncrementalIndex(spark, str(tmp_path / "out"))
    run()
    assert {r["path"]: r["content"] for r in index.files().collect()} == {"a": "2", "c": "3", "d": "4"}
    untouched = {k: v for k, v in index._note()["current"].items() if "/b2-" not in v}
    index.apply(spark.createDataFrame([("z", "9", False)], watch.LANDING), 2)  # a batch that was applied
    assert index.files().count() == 3 and len(untouched) >= 1


def test_event_windows(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in watch.event_windows(events).withColumn("start", watch.F.date_format("start", "yyyy-MM-dd HH:mm:ss")).collect()}
    want = {(a, t): n for a, t, n in duckdb.sql(f"select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S'), event_type, count(*) from '{SF}/events.parquet' group by all").fetchall()}
    assert got == want
    assert watch.sessions(events).agg({"n": "sum"}).first()[0] == events.count()
