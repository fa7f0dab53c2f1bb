from pyspark.sql import functions as F

from graphquarry.operators import linker
from graphquarry.sources import workspace
from graphquarry.sources.parsers import module_name, parse_files, python_roots


def linked(spark, files):
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    symbols, imports, uses, failures = parse_files(workspace.describe(rows), python_roots(list(files)))
    assert failures.count() == 0
    out = linker.link(symbols, imports, uses)
    a, b = symbols.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("a")), symbols.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("b"))
    return {f"{r['a']} -{r['type']}-> {r['b']}" for r in out.filter("to_id is not null").join(a, "from_id", "left").join(b, "to_id").collect()}


def test_python(spark):
    got = linked(spark, {
        "yard/__init__.py": "", "yard/clock.py": "def tick():\n    return 0\n",
        "yard/vehicle.py": "class Vehicle:\n    def brake(self):\n        return 1\n\n    def halt(self):\n        return self.brake()\n",
        "yard/tram.py": "from . import clock as timing\nfrom .vehicle import Vehicle\n\nclass Tram(Vehicle):\n    def brake(self):\n        timing.tick()\n        ring()\n        return super().brake()\n\ndef ring():\n    return None\n",
        "yard/crane.py": "class Crane:\n    def brake(self):\n        return 2\n",
        "yard/depot.py": "from .crane import Crane\nfrom .tram import Tram\n\ndef close(thing):\n    thing.brake()\n    return Tram(), Crane\n",
    })
    tram = "yard.tram.Tram"
    assert got >= {f"{tram} -extends-> yard.vehicle.Vehicle", f"{tram}.brake -calls-> yard.vehicle.Vehicle.brake", f"{tram}.brake -calls-> yard.clock.tick", f"{tram}.brake -calls-> yard.tram.ring", "yard.vehicle.Vehicle.halt -calls-> yard.vehicle.Vehicle.brake", f"yard.depot.close -calls-> {tram}"}
    assert not any(x.startswith("yard.depot.close") and x.endswith(".brake") for x in got)  # a tram's or a crane's: unknown


def test_typescript(spark):
    got = linked(spark, {
        "src/base.ts": "export interface Saver { save(): void; }\nexport class Base {\n  run() { return 1; }\n}\n",
        "src/index.ts": "export * from './base';\n",
        "src/impl.ts": "import { Base, Saver } from './index';\nimport { util } from './util';\n/** Does it. */\nexport class Impl extends Base implements Saver {\n  save() { this.run(); util(); }\n}\n",
        "src/util.ts": "export const util = (a: number) => {\n  return a;\n};\n",
    })
    assert got >= {"src/impl:Impl -extends-> src/base:Base", "src/impl:Impl -implements-> src/base:Saver", "src/impl:Impl.save -calls-> src/base:Base.run", "src/impl:Impl.save -calls-> src/util:util"}


def test_java_and_csharp(spark):
    got = linked(spark, {
        "sky/Lens.java": "package sky;\nclass Lens {\n  protected double focus() { return 1.5; }\n}\n",
        "sky/tools/Angles.java": "package sky.tools;\npublic class Angles {\n  public static double radians(double d) { return d; }\n}\n",
        "sky/Zoom.java": "package sky;\nimport sky.tools.Angles;\nclass Zoom extends Lens {\n  double widest() {\n    Lens spare = new Lens();\n    return Angles.radians(focus());\n  }\n}\n",
        "Orbit.cs": "namespace Sky;\npublic interface IMoving { double At(int day); }\npublic class Orbit : IMoving {\n  public double At(int day) { return Wrap(day); }\n  double Wrap(int day) { return day; }\n}\n",
    })
    assert got >= {"sky.Zoom -extends-> sky.Lens", "sky.Zoom.widest -calls-> sky.Lens", "sky.Zoom.widest -calls-> sky.Lens.focus", "sky.Zoom.widest -calls-> sky.tools.Angles.radians", "Sky.Orbit -implements-> Sky.IMoving", "Sky.Orbit.At -calls-> Sky.Orbit.Wrap"}


def test_names():
    assert module_name("src/shop/sub/__init__.py", "python", ["", "src"]) == "shop.sub" and module_name("src/a/b.ts", "typescript", []) == "src/a/b"
    assert python_roots(["src/shop/__init__.py", "src/shop/sub/__init__.py", "tests/x.py"]) == ["src", ""]


def test_scan(spark, tmp_path):
    for name, body in {"a.py": "x", "skip/b.py": "", "c.tmp.py": "", "keep/d.ts": "", "node_modules/e.ts": "", "f.txt": "", ".gitignore": "skip/\n*.tmp.py\n!keep.tmp.py\n", "keep.tmp.py": "y", "pyproject.toml": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    got = workspace.scan(spark, str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == ["a.py", "keep.tmp.py", "keep/d.ts"]
    markers = spark.createDataFrame([("", "python"), ("keep", "typescript")], "folder string, language string")
    assert {r["path"]: r["project"] for r in workspace.project_roots(got, markers).collect()} == {"a.py": "", "keep.tmp.py": "", "keep/d.ts": "keep"}


def test_tsconfig(tmp_path):
    (tmp_path / "base.json").write_text('{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@x/*": ["src/x/*"], "@x/deep/*": ["deep/*"], "one": ["src/one"],}} }')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base.json", /* more */}')
    config = workspace.load_tsconfig(str(tmp_path / "tsconfig.json"))
    at = lambda s: [p.removeprefix(str(tmp_path) + "/") for p in workspace.alias_candidates(config, s)]
    assert at("@x/deep/a") == ["deep/a"] and at("@x/b") == ["src/x/b"] and at("one") == ["src/one"] and at("other") == ["other"]


#: A receiver is typed by its declaration; the method asked for is declared by two unrelated types, so nothing else can tell.
RECEIVERS = {
    "farm/Bees.java": "package farm;\npublic class Bees { public int count() { return 1; } public Bees swarm() { return this; } }\n",
    "farm/Goats.java": "package farm;\npublic class Goats { public int count() { return 2; } }\n",
    "farm/Wild.java": "package farm;\npublic class Wild extends Goats { }\n",
    "%s": "package farm;\nimport java.util.List;\nclass Farmer {\n  Bees hive;\n  Bees hives(int k) { return hive; }\n  int ask(%s) {\n    %s\n  }\n}\n",
}


def test_declared_receivers(spark):
    cases = {
        ("Bees b", "return b.count();"): "Bees.count", ("Wild w", "return w.count();"): "Goats.count", ("", "return hive.count();"): "Bees.count", ("", "return this.hive.count();"): "Bees.count",
        ("", "return hives(3).count();"): "Bees.count", ("", "return hives(3).swarm().swarm().count();"): "Bees.count", ("", "var v = new Goats(); return v.count();"): "Goats.count", ("", "return new Goats().count();"): "Goats.count",
        ("List<Bees> all", "int n = 0; for (Bees each : all) n += each.count(); return n;"): "Bees.count", ("", "farm.Goats g = null; return g.count();"): "Goats.count", ("", "org.other.Goats g = null; return g.count();"): None, ("Object o", "return o.count();"): None,
    }
    shared = {k: v for k, v in RECEIVERS.items() if k != "%s"}
    for k, (declared, body) in enumerate(cases):
        shared[f"farm/Farmer{k}.java"] = (RECEIVERS["%s"] % (declared, body)).replace("Farmer", f"Farmer{k}")
    got = linked(spark, shared)
    for k, want in enumerate(cases.values()):
        found = {x.rpartition(" farm.")[2] for x in got if x.startswith(f"farm.Farmer{k}.ask -calls->") and x.endswith(".count")}
        assert found == ({want} if want else set()), (k, found)


def test_declared_receivers_of_csharp(spark):
    body = ["tank.Fill();", "var made = new Tank(); made.Fill();", "Main.Fill();", "spare?.Fill();", 'Find("x").Fill();', "if (Try(out Tank t)) t.Fill();"]
    methods = "\n".join(f"  void Use{k}(Tank tank) {{ {line} }}" for k, line in enumerate(body))
    got = linked(spark, {
        "Tank.cs": "namespace Works;\npublic class Tank { public void Fill() {} }\npublic class Form { public void Fill() {} }\n",
        "Plant.cs": f"namespace Works;\npublic class Plant {{\n  public Tank Main {{ get; set; }}\n  Tank spare;\n  Tank Find(string name) => spare;\n  bool Try(out Tank t) {{ t = spare; return true; }}\n{methods}\n}}\n",
    })
    for k in range(len(body)):
        assert f"Works.Plant.Use{k} -calls-> Works.Tank.Fill" in got, k
    assert not any(x.endswith("Form.Fill") for x in got)


def test_segments_and_type_names():
    from graphquarry.sources.parsers import base_type_name, chain_segments, qualifier_before

    names = lambda q: [(s["name"], s["call"], s["new"]) for s in chain_segments(q) or []]
    assert names("a.b(x, y(z))?.c!") == [("a", False, False), ("b", True, False), ("c", False, False)]
    assert names("new a.Foo<K>(x).b") == [("a.Foo", False, True), ("b", False, False)] and not names("a[0].b") and not names("new Foo") and not names("f(") and not names("a..b")
    assert [base_type_name(t) for t in ("Part<K, Map<A, B>>", "Store?", "com.acme.Util", "int", "T[]", "T...", "", None, "@A(x=1)T")] == ["Part", "Store", "com.acme.Util", None, None, None, None, None, "T"]
    for text, want in (("x = f(a, g(b)) . put(", "f(a,g(b))"), ("return put(", None), ("new Foo(1).bar(", "new Foo(1)"), ("a?.b(", "a"), ("  .of(", None)):
        assert qualifier_before(text, text.rindex(text.rstrip("(").split(".")[-1].strip() if "." in text else "put")) == want


def test_lexical_scopes(spark):
    """The innermost declaration of a name is meant; a type's members aren't seen from its methods."""
    got = linked(spark, {
        "oven.py": "def heat():\n    return 1\n\ndef bake():\n    def heat():\n        return 2\n\n    def stir():\n        def deep():\n            return heat()\n        return deep()\n    return heat() + stir()\n\ndef cool():\n    return heat()\n\nclass Oven:\n    def door(self):\n        return 1\n\n    def open(self):\n        return door()\n\ndef door():\n    return 3\n",
    })
    assert got >= {"oven.bake -calls-> oven.bake.heat", "oven.bake -calls-> oven.bake.stir", "oven.bake.stir -calls-> oven.bake.stir.deep", "oven.bake.stir.deep -calls-> oven.bake.heat", "oven.cool -calls-> oven.heat", "oven.Oven.open -calls-> oven.door"}
    assert "oven.bake -calls-> oven.heat" not in got and "oven.Oven.open -calls-> oven.Oven.door" not in got


def test_export_precedence(spark):
    """Own names before named re-exports before stars; of stars the first; rings end."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    symbols = make([(k, m, n, f"{m}:{n}", None, "function") for k, (m, n) in enumerate([("a", "x"), ("b", "x"), ("c", "x"), ("b", "y"), ("c", "y"), ("a", "z"), ("b", "z")])], "id long, module string, name string, qualified_name string, parent_id long, kind string")
    again = [("own", "a", "*", None), ("own", "b", "*", None), ("star", "b", "*", None), ("star", "c", "*", None), ("named", "b", "*", None), ("named", "far", "x", None), ("named", "c", "y", "x2"), ("far", "c", "*", None), ("ring1", "ring2", "*", None), ("ring2", "ring1", "*", None), ("ring2", "a", "z", None), ("odd1", "odd2", "*", None), ("odd1", "b", "*", None), ("odd2", "odd1", "*", None), ("odd2", "c", "*", None)]
    imports = make([(m, t, n, a, k, "reexport", "typescript") for k, (m, t, n, a) in enumerate(again)], "module string, target_module string, name string, alias string, line int, kind string, language string")
    symbols = symbols.union(make([(9, "own", "x", "own:x", None, "function")], symbols.schema))
    got = {(r["module"], r["exported"]): r["qualified_name"] for r in linker.exports(symbols, imports).collect()}
    assert got["own", "x"] == "own:x" and got["own", "z"] == "a:z" and got["own", "y"] == "b:y" and got["star", "x"] == "b:x"
    assert got["named", "x"] == "c:x" and got["named", "x2"] == "c:y" and got["named", "y"] == "b:y" and got["ring1", "z"] == got["ring2", "z"] == "a:z"
    assert {got["odd1", "x"], got["odd2", "x"]} <= {"b:x", "c:x"} and ("ring1", "x") not in got


def test_doc_comments(spark):
    """A declaration has the comment right before it, or none."""
    rows = spark.createDataFrame([
        ("Kiln.java", "package pots;\n/** Fires clay. */\npublic class Kiln {\n  /** Degrees now. */\n  @Deprecated\n  public int heat() { return 1; }\n  public int rest() { return 2; }\n}\nclass Shelf {\n  int load() { return 3; }\n}\n"),
        ("glaze.ts", "/** Mixes it. */\nexport class Glaze {\n  /** Stirs. */\n  stir() { return 1; }\n  pour() { return 2; }\n}\nexport class Brush {\n  dip() { return 3; }\n}\n"),
        ("Clay.cs", "namespace Pots;\n/// <summary>Soft.</summary>\npublic class Clay {\n  public void Knead() { }\n}\npublic class Slip { }\n"),
    ], "path string, content string")
    docs = {r["name"]: r["doc"] for r in parse_files(workspace.describe(rows))[0].collect()}
    want = {"Kiln": "Fires clay.", "heat": "Degrees now.", "Glaze": "Mixes it.", "stir": "Stirs.", "Clay": "Soft."}
    assert {n: d for n, d in docs.items() if d} == want and {"rest", "Shelf", "load", "pour", "Brush", "dip", "Knead", "Slip"} <= docs.keys()
