"""Linking uses to symbols: staged equi-joins, the first rule with candidates deciding.

Rules, in order: members of the enclosing type for ``self``, ``this`` and the
like; names that an enclosing function declares, the innermost first (Python,
TypeScript); names that the file declares; names that it imports; members of imported
modules; members of a type that the qualifier names; members of the declared
type of the receiver (Java, C#), of which nothing else is tried; members of that
name in files which the using file sees. In each rule a unique qualified name is
a link and several are none, but for one member that a hierarchy of types
declares: then its top is meant. An ambiguous use stays unresolved. Inheritance
is linked first, as member lookups follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .receivers import Types, receiver_types
from .relate import first_rule, top_declaration
from .state import cut, cut_all, stored

SELF, SUPER = ("self", "cls", "this"), ("super", "super()", "base")
#: Bases above a type that members are looked up in; declarations inside one another that scopes are followed through.
DEPTH, SCOPES = 6, 64
#: Languages whose names are found in enclosing functions, not in enclosing types.
LEXICAL = ("python", "typescript", "tsx")


def tidy_path(path: "F.Column") -> "F.Column":
    """A path without ``.`` and ``..`` steps; those above the root stay."""
    steps = F.filter(F.split(path, "/"), lambda x: (x != ".") & (x != ""))
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda r, x: F.when((x == "..") & (F.size(r) > 0) & (F.try_element_at(r, F.lit(-1)) != ".."), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(F.concat(r, F.array(x))))
    return F.array_join(folded, "/")


def resolve_imports(imports: DataFrame, symbols: DataFrame, files: DataFrame, layout=None) -> DataFrame:
    """``imports`` with ``target_module`` (the module, package or namespace meant) and ``local`` (the name in the file).

    Relative specifiers are taken from the importing file; ``files`` has ``path``
    and ``module``. With a ``layout`` (see ``sources.config``), other TypeScript
    specifiers go through path aliases and packages of the tree.
    """
    level = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    parts = F.split("module", r"\.")
    is_package = F.col("path").rlike(r"__init__\.pyi?$")
    up = F.greatest(F.size(parts) - level + is_package.cast("int"), F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), up), ".")
    rest = F.regexp_replace("spec", r"^\.+", "")
    python = F.when(level > 0, F.concat_ws(".", F.when(base != "", base), F.when(rest != "", rest))).otherwise(F.col("spec"))
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    joined = F.concat_ws("/", F.when(folder != "", folder), F.col("spec"))
    tidy = F.regexp_replace(tidy_path(joined), r"\.(?:d\.)?[cm]?[jt]sx?$", "")
    script = F.when(F.col("spec").startswith("."), tidy).otherwise(F.col("spec"))
    module = F.when(F.col("language") == "python", python).when(F.col("language").isin("typescript", "tsx"), script).otherwise(F.when(F.col("kind").isin("import", "static") & (F.col("language") == "java"), F.regexp_replace("spec", r"\.[^.]+$", "")).otherwise(F.col("spec")))
    local = F.coalesce("alias", F.when(F.col("name") != "*", F.col("name")), F.when((F.col("language") == "python") & (F.col("kind") == "import"), F.col("spec")))
    out = imports.withColumn("target_module", module).withColumn("local", local)
    if layout is not None:
        out = _by_layout(out, files, layout)
    index = files.filter("module like '%/index'").select(F.regexp_replace("module", "/index$", "").alias("target_module"), F.col("module").alias("__index")).distinct()
    index = index.join(files.select(F.col("module").alias("target_module")).distinct(), "target_module", "left_anti")  # a file of the name itself comes first
    return out.join(index, "target_module", "left").withColumn("target_module", F.coalesce("__index", "target_module")).drop("__index")


def _by_layout(imports: DataFrame, files: DataFrame, layout) -> DataFrame:
    """``imports`` with the module that the first existing candidate of the layout names."""
    asked = imports.filter("language in ('typescript', 'tsx') and not startswith(spec, '.')").select("path", "spec").distinct()

    def run(frames):
        for frame in frames:
            yield frame.assign(candidates=[layout.candidates(p, s) for p, s in zip(frame["path"], frame["spec"])])

    listed = asked.mapInPandas(run, "path string, spec string, candidates array<string>").select("path", "spec", F.posexplode("candidates").alias("ord", "module"))
    best = listed.join(files.select("module").distinct(), "module", "left_semi").groupBy("path", "spec").agg(F.min_by("module", "ord").alias("__module"))
    return imports.join(best, ["path", "spec"], "left").withColumn("target_module", F.coalesce("__module", "target_module")).drop("__module")


def exports(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``(module, exported, id, qualified_name)``: what each module gives under a name, by way of any number of files.

    A module's own top-level name comes before one that it re-exports by name,
    and that before those of ``*``; of several of a kind the first line wins.
    What a re-export gives is settled round by round, until nothing changes; a
    ring of re-exports that never settles ends when a state comes back.
    """
    columns = ["module", "exported", "id", "qualified_name"]
    top = symbols.filter("parent_id is null and kind <> 'namespace'").select("module", F.col("name").alias("exported"), "id", "qualified_name")
    again = imports.filter("kind in ('reexport', 'wildcard') and language in ('typescript', 'tsx')").select(F.col("module").alias("into"), F.col("target_module").alias("module"), "name", "alias", "line")
    if again.isEmpty():
        return top
    now, own, states = cut(top), top.withColumn("place", F.struct(F.lit(0).alias("way"), F.lit(0).alias("line"))), set()
    while True:
        star = F.col("name") == "*"
        step = again.join(now, "module").filter(star | (F.col("name") == F.col("exported"))).select(
            F.col("into").alias("module"), F.when(star, F.col("exported")).otherwise(F.coalesce("alias", "exported")).alias("exported"), "id", "qualified_name",
            F.struct(F.when(star, 2).otherwise(1).alias("way"), F.coalesce("line", F.lit(0)).cast("int").alias("line")).alias("place"))
        every = own.unionByName(step)
        first = every.groupBy("module", "exported").agg(F.min("place").alias("place"))
        now = cut(every.join(first, ["module", "exported", "place"], "left_semi").select(*columns).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        if state in states:
            return now
        states.add(state)


def scope_chains(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(use, holder, depth, kind)``: the declarations that enclose each use (``id, from_id``), the innermost at depth 0, up to the top of its file."""
    up = symbols.select(F.col("id").alias("holder"), F.col("parent_id").alias("above"), "kind")
    level, found = uses.filter("from_id is not null").select(F.col("id").alias("use"), F.col("from_id").alias("holder")), None
    for depth in range(SCOPES):
        here = level.join(up, "holder")
        some = cut(here.select("use", "holder", F.lit(depth).alias("depth"), "kind", "above"))
        found = some if found is None else found.unionByName(some)
        level = some.filter("above is not null").select("use", F.col("above").alias("holder"))
        if level.isEmpty():
            break
    return found.drop("above")


def link(symbols: DataFrame, imports: DataFrame, uses: DataFrame, layout=None, known: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``uses`` with ``to_id``: the symbol that each means, null if unknown or ambiguous.

    If ``uses`` are some only, ``known (src, dst)`` is the inheritance that
    others' links have. ``files (path, module)``: by default those with symbols
    or imports. Imports that have a ``target_module`` are taken as resolved.
    """
    files = symbols.select("path", "module").union(imports.select("path", "module")).distinct() if files is None else files
    imports, symbols, uses = stored(imports if "target_module" in imports.columns else resolve_imports(imports, symbols, files, layout), symbols, uses)
    languages = {r[0] for r in uses.select("language").distinct().collect()}
    declared = bool(languages & {"java", "csharp"})  # only their receivers have declared types
    given = exports(symbols, imports)
    target = symbols.select("id", "qualified_name", "name", "kind", "parent_id", F.col("path").alias("in_path"))
    types, spaceless = "kind in ('class', 'interface', 'enum', 'namespace')", "kind in ('class', 'interface', 'enum')"

    named = imports.filter("local is not null and name is not null and name <> '*'")
    by_module = named.join(given.select(F.col("module").alias("target_module"), F.col("exported").alias("name"), "id", "qualified_name"), ["target_module", "name"]).select("path", "local", "id", "qualified_name")
    by_name = named.filter("language in ('java', 'csharp')").join(target.select(F.col("qualified_name").alias("spec"), "id"), "spec").select("path", "local", "id", F.col("spec").alias("qualified_name"))
    names = by_module.union(by_name).distinct()
    spaces = imports.filter("kind = 'wildcard' and language in ('python', 'java') or kind = 'using'").select("path", F.col("target_module").alias("space"))
    own = symbols.select("path", F.when(F.col("language") == "python", F.col("module")).otherwise(F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1)).alias("space")).filter("space <> ''").distinct()
    inside = symbols.filter(types).select(F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1).alias("space"), F.col("name"), "id", "qualified_name").union(symbols.filter("language = 'python' and parent_id is null").select("module", "name", "id", "qualified_name")).distinct()
    wide = spaces.union(own).distinct().join(inside, "space").select("path", F.col("name").alias("local"), "id", "qualified_name").distinct()
    aliases = imports.filter("kind = 'import' and language = 'python' or name = '*' and alias is not null or kind = 'alias'").select("path", F.coalesce("alias", "local").alias("local"), "target_module")
    submodules = imports.filter("kind = 'from'").select("path", "local", F.concat_ws(".", "target_module", "name").alias("target_module")).join(files.select(F.col("module").alias("target_module")).distinct(), "target_module", "left_semi").select("path", "local", "target_module")
    names, wide, aliases = cut_all(names, wide, aliases.union(submodules).distinct())
    top = symbols.filter("parent_id is null and kind <> 'namespace'").select("path", F.col("name").alias("local"), "id", "qualified_name")

    def stage(some: DataFrame, bases: DataFrame | None) -> DataFrame:
        base = some.select(F.col("id").alias("use"), "path", "from_id", "name", "qualifier", "language", "type", "instantiates")
        plain, held = base.filter("qualifier is null"), base.filter("qualifier is not null")
        as_local = lambda df, n: plain.join(df, (plain.path == df.path) & (F.col("name") == F.col("local"))).select("use", F.lit(n).alias("rule"), "id", "qualified_name")
        found = [as_local(top, SCOPES + 20), as_local(names, SCOPES + 30), as_local(wide, SCOPES + 40)]
        lexical = plain.filter(F.col("language").isin(*LEXICAL)).select(F.col("use").alias("id"), "from_id", "name")
        nested = symbols.filter(F.col("language").isin(*LEXICAL) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("holder"), F.col("name"), "id", "qualified_name")
        if not nested.isEmpty():
            # a function's own declarations, then those of the functions around it; a type's are seen in its own body only
            asked = lexical.join(nested.select("name").distinct(), "name", "left_semi")
            chains = scope_chains(asked, symbols).filter("kind in ('function', 'method') or kind = 'class' and depth = 0")
            inner = chains.join(asked.select(F.col("id").alias("use"), "name"), "use").join(nested, ["holder", "name"])
            found.append(inner.select("use", F.col("depth").alias("rule"), "id", "qualified_name"))
        if bases is not None:
            owner = symbols.select(F.col("id").alias("from_id"), F.coalesce("parent_id", "id").alias("owner"))
            members = target.filter("parent_id is not null").select(F.col("parent_id").alias("holder"), F.col("name"), "id", "qualified_name")
            up = cut(bases.select(F.col("src").alias("owner"), F.col("dst").alias("holder"), "depth").union(symbols.select("id", "id", F.lit(0))))
            mine = held.filter(F.col("qualifier").isin(*SELF, *SUPER)).join(owner, "from_id").join(up, "owner").filter(~F.col("qualifier").isin(*SUPER) | (F.col("depth") > 0)).join(members, ["holder", "name"])
            found.append(mine.select("use", F.col("depth").alias("rule"), "id", "qualified_name"))
            bare = plain.filter("language in ('java', 'csharp')").join(owner, "from_id").join(up, "owner").join(members, ["holder", "name"])
            found.append(bare.select("use", F.col("depth").alias("rule"), "id", "qualified_name"))
            meant = names.union(wide).union(top).distinct().select("path", F.col("local").alias("qualifier"), F.col("id").alias("owner"))
            of_type = held.join(meant, ["path", "qualifier"]).join(up, "owner").join(members, ["holder", "name"])
            found.append(of_type.select("use", (F.col("depth") + SCOPES + 50).alias("rule"), "id", "qualified_name"))
            sees = imports.select("path", "target_module").join(files.select(F.col("module").alias("target_module"), F.col("path").alias("in_path")), "target_module").select("path", "in_path").union(files.select("path", F.col("path").alias("in_path"))).distinct()
            anywhere = target.filter("parent_id is not null and kind in ('method', 'property', 'field')").select("name", "id", "qualified_name", "in_path")
            known = held.filter(~F.col("qualifier").isin(*SELF, *SUPER) & F.col("qualifier").rlike(r"^[a-z_$][\w$.]*$"))
            if declared:
                shown = first_rule(symbols.filter(spaceless).select("path", F.col("name").alias("local"), "id", "qualified_name").withColumn("rule", F.lit(10)).union(names.withColumn("rule", F.lit(30))).union(wide.withColumn("rule", F.lit(40))).join(symbols.filter(spaceless).select("id"), "id", "left_semi").select(F.struct("path", "local").alias("key"), "rule", "id", "qualified_name"), "key").filter("id is not null").select("key.path", "key.local", "id")
                every = target.filter("parent_id is not null").select(F.col("parent_id").alias("holder"), "name", "kind", "id", "qualified_name")
                lookup = Types(cut(shown), up, cut(every), symbols.filter(spaceless).groupBy("qualified_name", "language").agg(F.min("id").alias("id")))
                chained = some.filter("language in ('java', 'csharp') and qualifier is not null and from_id is not null").filter(~F.col("qualifier").isin(*SELF, *SUPER)).select(F.col("id").alias("use"), "path", "language", "from_id", "name", "segments", "receiver_base")
                typed = cut(receiver_types(chained, symbols, lookup, owner))
                of_receiver = typed.join(chained.select("use", "name"), "use").select(F.col("use").alias("key"), F.col("id").alias("owner"), "name")
                found.append(lookup.member(of_receiver, ("method", "function", "class", "interface", "enum")).join(target.select("id", "qualified_name"), "id").select(F.col("key").alias("use"), F.lit(SCOPES + 60).alias("rule"), "id", "qualified_name"))
                known = known.join(typed.select("use"), "use", "left_anti")
            seen = known.join(sees, "path").join(anywhere, ["name", "in_path"])
            above = bases.select(F.col("src").alias("type"), F.col("dst").alias("ancestor"))
            tops = top_declaration(seen.join(symbols.select("id", F.col("parent_id").alias("owner")), "id").select(F.col("use").alias("key"), "owner", "id"), above, "key").filter("id is not null")
            found.append(tops.select(F.col("key").alias("use"), F.lit(SCOPES + 90).alias("rule"), "id", F.lit("").alias("qualified_name")))
        of_module = held.join(aliases.withColumnRenamed("local", "qualifier"), ["path", "qualifier"]).join(given.select(F.col("module").alias("target_module"), F.col("exported").alias("name"), "id", "qualified_name"), ["target_module", "name"])
        found.append(of_module.select("use", F.lit(SCOPES + 45).alias("rule"), "id", "qualified_name"))
        rows = found[0]
        for f in found[1:]:
            rows = rows.union(f)
        return first_rule(rows.distinct(), "use").filter("id is not null")

    heirs = uses.filter("type in ('extends', 'implements')")
    first = cut(stage(heirs, None))
    inherits = heirs.join(first.select(F.col("use").alias("id"), F.col("id").alias("dst")), "id").select(F.col("from_id").alias("src"), "dst")
    inherits = inherits if known is None else inherits.union(known.select("src", "dst")).distinct()
    second = stage(uses.filter("type not in ('extends', 'implements')"), closure(inherits, DEPTH))
    linked = first.union(second).select(F.col("use").alias("id"), F.col("id").alias("to_id"))
    kinds = symbols.select(F.col("id").alias("to_id"), F.col("kind").alias("__to")), symbols.select(F.col("id").alias("from_id"), F.col("kind").alias("__from"))
    out = uses.join(linked, "id", "left").join(kinds[0], "to_id", "left").join(kinds[1], "from_id", "left")
    retyped = F.when(F.col("type").isin("extends", "implements") & F.col("__to").isNotNull(), F.when((F.col("__to") == "interface") & (F.col("__from") != "interface"), "implements").otherwise("extends")).otherwise(F.col("type"))
    return out.withColumn("type", retyped).drop("__to", "__from")
