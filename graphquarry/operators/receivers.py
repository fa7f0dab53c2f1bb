"""Types of receivers, from declared types only.

A call ``a.b().c()`` is a member of the type that ``a.b()`` has: the declared
type of ``a`` (a parameter, a local, a field), then the declared type of ``b`` in
it, resolved where it is declared. Chains are followed segment by segment, each
step a join over all calls that are that long. A step whose type is unknown ends
the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relate import first_rule
from .state import cut

TYPE_KINDS, CALLABLE, VALUES = ("class", "interface", "enum"), ("method", "function"), ("field", "property")


class Types:
    """What type lookups read: ``visible (path, local, id)``, the types by name in each file; ``up (owner, holder, depth)``, types with themselves and their bases; ``members (holder, name, kind, id, qualified_name)``; ``named (qualified_name, language, id)``."""

    def __init__(self, visible: DataFrame, up: DataFrame, members: DataFrame, named: DataFrame):
        self.visible, self.up, self.members, self.named = visible, up, members, named

    def member(self, asked: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """``(key, id)``: the member ``name`` of type ``owner``, or of its nearest base that has it, for rows ``key, owner, name``."""
        found = asked.join(self.up, "owner").join(self.members.filter(F.col("kind").isin(*kinds)), ["holder", "name"])
        return first_rule(found.select("key", F.col("depth").alias("rule"), "id", "qualified_name"), "key").filter("id is not null")

    def path(self, asked: DataFrame) -> DataFrame:
        """``(key, id)``: the type that a dotted name means in a file, for rows ``key, path, language, dotted``.

        The first part is a visible type, or else the longest prefix is the
        qualified name of one; the other parts are types nested in it.
        """
        split = cut(asked.filter("dotted is not null").withColumn("parts", F.split("dotted", r"\.")))
        near = split.withColumn("local", F.col("parts")[0]).join(self.visible.select("path", "local", "id"), ["path", "local"]).select("key", "id", F.lit(1).alias("used"))
        far = split.filter(F.size("parts") > 1).join(near, "key", "left_anti").select("key", "language", "parts", F.explode(F.sequence(F.lit(2), F.size("parts"))).alias("used"))
        far = far.withColumn("qualified_name", F.array_join(F.slice("parts", F.lit(1), F.col("used")), ".")).join(self.named, ["qualified_name", "language"])
        far = far.groupBy("key").agg(F.max_by(F.struct("id", "used"), "used").alias("x")).select("key", "x.id", "x.used")
        now = cut(near.union(far).join(split.select("key", "parts"), "key"))
        deepest = now.agg(F.max(F.size("parts") - F.col("used"))).first()[0] or 0
        for _ in range(deepest):
            more = now.filter("used < size(parts)")
            step = self.member(more.select("key", F.col("id").alias("owner"), F.element_at("parts", F.col("used") + 1).alias("name")), TYPE_KINDS)
            now = cut(now.filter("used >= size(parts)").union(more.drop("id").join(step, "key").select("key", "id", F.col("used") + 1, "parts")))
        return now.select("key", "id")


def receiver_types(calls: DataFrame, symbols: DataFrame, types: Types, owners: DataFrame) -> DataFrame:
    """``(use, id)``: the type of each call's receiver, as far as declarations tell.

    ``calls (use, path, language, from_id, segments, receiver_base)``; ``owners
    (from_id, owner)``: the type around a declaration; ``symbols`` with
    ``value_base``, the type that a member is declared with.
    """
    declared = symbols.filter("value_base is not null").select(F.col("id").alias("key"), "path", "language", F.col("value_base").alias("dotted"))
    values = cut(types.path(declared).select(F.col("key").alias("member"), F.col("id").alias("type")))
    some = cut(calls.filter("segments is not null and size(segments) > 0").join(owners, "from_id", "left").withColumn("first", F.col("segments")[0]))
    plain = ~F.col("first.call") & ~F.col("first.new")
    own = plain & F.col("first.name").isin("this", "self")
    texts = some.filter(F.col("first.new") | (plain & ~own & F.col("receiver_base").isNotNull()))
    by_text = types.path(texts.select(F.col("use").alias("key"), "path", "language", F.when(F.col("first.new"), F.col("first.name")).otherwise(F.col("receiver_base")).alias("dotted")))
    rest = some.filter(~F.col("first.new") & ~own & ~(plain & F.col("receiver_base").isNotNull()))
    asked = rest.select(F.col("use").alias("key"), "owner", F.col("first.name").alias("name"), F.col("first.call").alias("call"))
    member = types.member(asked.filter("call").drop("call"), CALLABLE).union(types.member(asked.filter("not call").drop("call"), VALUES))
    by_member = member.select("key", F.col("id").alias("member")).join(values, "member").select("key", F.col("type").alias("id"))
    static = rest.filter("not first.call").select(F.col("use").alias("key"), "path", "language", F.col("first.name").alias("dotted")).join(by_member, "key", "left_anti")
    roots = some.filter(own & F.col("owner").isNotNull()).select(F.col("use").alias("key"), F.col("owner").alias("id")).union(by_text).union(by_member).union(types.path(static))
    now = cut(roots.join(some.select(F.col("use").alias("key"), "segments"), "key"))
    longest = now.agg(F.max(F.size("segments"))).first()[0] or 1
    done = now.filter("size(segments) = 1").select("key", "id")
    for k in range(1, longest):
        step = now.filter(F.size("segments") > k).select("key", F.col("id").alias("owner"), F.col("segments")[k]["name"].alias("name"), F.col("segments")[k]["call"].alias("call"))
        found = types.member(step.filter("call").drop("call"), CALLABLE).union(types.member(step.filter("not call").drop("call"), VALUES))
        now = cut(found.select("key", F.col("id").alias("member")).join(values, "member").select("key", F.col("type").alias("id")).join(now.select("key", "segments"), "key"))
        done = done.union(now.filter(F.size("segments") == k + 1).select("key", "id"))
    return done.select(F.col("key").alias("use"), "id")
