"""Walks over edge tables. Loops are semi-naive: each round joins only what the last one found, and writes only that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle


def closure(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(start, node, depth): everything reachable over (src, dst), with the least number of steps. Cycles are safe."""
    edges = settle(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = fresh = edges.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth"))
    for depth in range(2, max_rounds + 2):
        step = fresh.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = settle(step.join(found, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            return found
        found = found.unionAll(fresh)
    raise ValueError(f"no end after {max_rounds} rounds")


def reachable(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(node): ``starts`` and everything over (src, dst) from them. The work follows what is reached, not all pairs."""
    edges = settle(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = fresh = settle(starts.select("node").where("node is not null").distinct())
    for _ in range(max_rounds):
        step = fresh.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = settle(step.join(found, "node", "left_anti"))
        if fresh.isEmpty():
            return found
        found = found.unionAll(fresh)
    raise ValueError(f"no end after {max_rounds} rounds")


def defining_paths(children: DataFrame, root: str, max_rounds: int = 1000) -> DataFrame:
    """(node, path): the first path to every node, depth first, over (parent, ord, child, name) from ``root``.

    A node is reached first by the way whose ordinals are the least. That of a node's own first way is known once its
    parent's is, and ways never get shorter, so a round keeps the least way and goes on with the nodes it changed.
    """
    edges = settle(children.select("parent", "ord", "child", "name").where("child <> parent"))
    best = edges.sparkSession.createDataFrame([(root, [], root)], "node string, way array<int>, path string")
    fresh = best
    for _ in range(max_rounds):
        step = fresh.join(edges, F.col("node") == F.col("parent")).select(
            F.col("child").alias("node"), F.concat("way", F.array(F.col("ord").cast("int"))).alias("way"), F.concat_ws("::", "path", "name").alias("path")
        )
        least = step.groupBy("node").agg(F.min(F.struct("way", "path")).alias("_s")).select("node", "_s.way", "_s.path")
        old = best.select("node", F.col("way").alias("_old"))
        fresh = settle(least.join(old, "node", "left").where("_old is null or way < _old").drop("_old"))
        if fresh.isEmpty():
            return best.select("node", "path")
        best = settle(best.join(fresh.select("node"), "node", "left_anti").unionByName(fresh))
    raise ValueError(f"no end after {max_rounds} rounds")


def attached_members(fields: DataFrame, impls: DataFrame, impl_items: DataFrame) -> DataFrame:
    """(owner, member, context): fields, variants and trait items of an owner (owner, member) at any depth below it, and
    the items of its implementations.

    ``impls`` is (owner, impl, context, blanket, hidden), ``impl_items`` (impl, member). Blanket and hidden
    implementations give nothing; ``context`` names an implementation and is empty for own members.
    """
    own = fields.select("owner", "member", F.lit("").alias("context"))
    shown = impls.where("not blanket and not hidden").select("owner", "impl", "context")
    return own.unionAll(shown.join(impl_items, "impl").select("owner", "member", "context")).distinct()


def topmost_owner(owners: DataFrame) -> DataFrame:
    """(node, top): the root over (node, owner); nodes in a cycle or under a missing owner are dropped."""
    owners = settle(owners.select("node", "owner"))
    roots = owners.where("owner is null").select("node", F.col("node").alias("top"))
    done = fresh = settle(roots)
    while True:
        fresh = settle(owners.join(fresh.select(F.col("node").alias("owner"), "top"), "owner").select("node", "top"))
        if fresh.isEmpty():
            return done
        done = done.unionAll(fresh)


def _dealt(side: DataFrame) -> DataFrame:
    """A side of a join that is shuffled whatever its size: what each round broadcasts would heap up in the driver."""
    return side.hint("merge")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level) for (src needs dst): 0 without needs, else one above the highest need; null on or above a cycle."""
    edges = settle(edges.select("src", "dst").where("src <> dst").distinct())
    left, done, level = settle(nodes.select("node").distinct()), None, 0
    while True:
        waiting = edges.join(_dealt(left.select(F.col("node").alias("dst"))), "dst", "left_semi").select(F.col("src").alias("node"))
        ready = settle(left.join(_dealt(waiting), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionAll(rest)
        done = ready if done is None else done.unionAll(ready)
        left, level = settle(left.join(_dealt(ready), "node", "left_anti")), level + 1


def numbered(rows: DataFrame, *order, name: str = "position") -> DataFrame:
    """``rows`` with their number from 0 in the order of the columns ``order``, which tell all rows apart.

    The sort deals ranges of the order to partitions; a row's number is its place in its partition and what earlier
    partitions hold, so no task sees all rows. One row for each partition is broadcast.
    """
    placed = settle(rows.orderBy(*order)).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at"))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).alias(name))


def _on_cycles(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without a way in or without a way out are taken off again and again."""
    left = edges.count()
    while left:
        inner = edges.join(_dealt(edges.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        edges = settle(inner.join(_dealt(inner.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def _spread(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(node, color): the greatest color of all nodes from which a node can be reached, itself included."""
    fresh = found
    while True:
        met = fresh.join(_dealt(edges), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("_new"))
        fresh = settle(met.join(_dealt(found), "node").where("_new > color").select("node", F.col("_new").alias("color")))
        if fresh.isEmpty():
            return found
        found = settle(found.join(_dealt(fresh.select("node")), "node", "left_anti").unionByName(fresh))


def _near_cycles(edges: DataFrame, most: int = 1 << 17) -> DataFrame:
    """(node, into): nodes on cycles among neighbours, with the least node of such a cycle.

    Edges are dealt by ranges of their start, and each run of ``most`` of them is looked at by itself, so the memory is
    bounded. A run's cycles are cycles of the whole, but not all of those are in one run.
    """
    import pyarrow as pa

    kind = edges.schema["src"].dataType.simpleString()

    def found(held: dict, schema) -> pa.RecordBatch:
        parts = _cyclic({a: [b for b in bs if b in held] for a, bs in held.items()})
        least = {id(part): min(part) for part in parts.values()}
        return pa.RecordBatch.from_arrays([pa.array(list(parts), schema), pa.array([least[id(part)] for part in parts.values()], schema)], names=["node", "into"])

    def run(batches):
        held, n, schema = {}, 0, None
        for batch in batches:
            schema = batch.schema.field("src").type
            for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist()):
                held.setdefault(a, []).append(b)
            n += batch.num_rows
            if n >= most:
                yield found(held, schema)
                held, n = {}, 0
        if held:
            yield found(held, schema)

    near = edges.select("src", "dst").repartitionByRange("src").sortWithinPartitions("src")
    return near.mapInArrow(run, f"node {kind}, into {kind}").groupBy("node").agg(F.min("into").alias("into")).where("node <> into")


def _drawn_together(edges: DataFrame, into: DataFrame) -> DataFrame:
    """``edges`` with the nodes of ``into`` (node, into) put for one another."""
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(_dealt(into.select(F.col("node").alias(end), F.col("into").alias(f"_{end}"))), end, "left")
    return ends.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")).where("src <> dst").distinct()


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): strongly connected components over (src, dst), each named by its least node.

    Nodes that no cycle can hold are taken off first, and cycles among neighbours are drawn together into their least
    node. Then every node learns the greatest node that leads to it, its color; the nodes that lead back to that one,
    within the color, are its component. What is left is done again, with only the edges within a color, so a round
    settles a component in every color at once.
    """
    nodes = settle(nodes.select("node").where("node is not null").distinct())
    known = edges.select("src", "dst").where("src <> dst").distinct()
    known = known.join(_dealt(nodes.select(F.col("node").alias("src"))), "src", "left_semi").join(_dealt(nodes.select(F.col("node").alias("dst"))), "dst", "left_semi")
    live, parts, drawn = settle(known.select("src", "dst")), [], []
    while not live.isEmpty():
        into = settle(_near_cycles(live))
        if not into.isEmpty():
            drawn.append(into)
            live = settle(_drawn_together(live, into))
        live = _on_cycles(live)
        if live.isEmpty():
            break
        there = live.select(F.col("src").alias("node")).distinct()
        colors = _spread(live, settle(there.withColumn("color", F.col("node"))))
        tinted = live.join(_dealt(colors.select(F.col("node").alias("src"), F.col("color").alias("_c"))), "src").join(_dealt(colors.select(F.col("node").alias("dst"), "color")), "dst")
        inside = settle(tinted.where("_c = color").select("src", "dst", "color"))
        back = fresh = settle(colors.where("node = color"))
        while True:
            step = fresh.select(F.col("node").alias("dst"), "color").join(_dealt(inside), ["dst", "color"]).select(F.col("src").alias("node"), "color").distinct()
            fresh = settle(step.join(_dealt(back), "node", "left_anti"))
            if fresh.isEmpty():
                break
            back = back.unionAll(fresh)
        back = settle(back)
        parts.append(back)
        done = back.select("node")
        rest = inside.join(_dealt(done.select(F.col("node").alias("src"))), "src", "left_anti").join(_dealt(done.select(F.col("node").alias("dst"))), "dst", "left_anti")
        live = settle(rest.select("src", "dst"))
    out = nodes.select("node", F.col("node").alias("component"))
    for into in drawn:  # a node may be drawn into one that is drawn on later
        out = out.join(_dealt(into.select(F.col("node").alias("component"), "into")), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    if not parts:
        return out
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    names = every.groupBy("color").agg(F.min("node").alias("_name"))
    cyclic = every.join(_dealt(names), "color").select(F.col("node").alias("component"), "_name")
    return out.join(_dealt(cyclic), "component", "left").select("node", F.coalesce("_name", "component").alias("component"))


def order_with_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component, level, position) of ``nodes`` (node, ord): dependencies first, over (src needs dst).

    The nodes of a cycle are one component and stand together. A component is one level above the highest that it needs;
    components of a level come in the order of their first node, and the nodes of a component in that of ``ord``.
    """
    ranked = settle(nodes.groupBy("node").agg(F.min("ord").alias("ord")))
    parts = settle(strong_components(edges, ranked))
    ends = edges.join(_dealt(parts.select(F.col("node").alias("src"), F.col("component").alias("_a"))), "src").join(_dealt(parts.select(F.col("node").alias("dst"), F.col("component").alias("_b"))), "dst")
    above = levels(ends.select(F.col("_a").alias("src"), F.col("_b").alias("dst")), parts.select(F.col("component").alias("node")))
    placed = settle(parts.join(_dealt(ranked), "node"))
    first = placed.groupBy("component").agg(F.min("ord").alias("_first"))
    rows = placed.join(_dealt(above.withColumnRenamed("node", "component")), "component").join(_dealt(first), "component")
    return numbered(rows.select("node", "component", "level", "_first", "ord"), "level", "_first", "component", "ord", "node").select("node", "component", "level", "position")


def merged_order(cls, rows: list[list]) -> list:
    """The C3 merge of ``rows`` behind ``cls``, cut off where no row's head is free. Linear in the rows."""
    rows = [r for r in rows if r]
    if len(rows) == 2 and len(rows[1]) == 1 and rows[0][0] == rows[1][0] and cls not in rows[0] and len(set(rows[0])) == len(rows[0]):
        return [cls, *rows[0]]  # a single base
    behind: dict = {}  # how many places after a head hold a class
    for r in rows:
        for x in r[1:]:
            behind[x] = behind.get(x, 0) + 1
    at, order, seen = [0] * len(rows), [cls], {cls}
    heads: dict = {}  # the rows that a class heads
    for i, r in enumerate(rows):
        heads.setdefault(r[0], []).append(i)
    left = len(rows)
    while left:
        head = next((r[at[i]] for i, r in enumerate(rows) if at[i] < len(r) and not behind.get(r[at[i]])), None)
        if head is None:
            break
        if head not in seen:
            seen.add(head)
            order.append(head)
        for i in heads.pop(head):
            at[i] += 1
            if at[i] == len(rows[i]):
                left -= 1
                continue
            x = rows[i][at[i]]
            behind[x] -= 1
            heads.setdefault(x, []).append(i)
    return order


def _cyclic(bases: dict) -> dict:
    """For each class that a cycle of bases holds, the classes of its strongly connected component (Tarjan, no recursion)."""
    number, low, open_, stack, out = {}, {}, set(), [], {}
    for root in bases:
        if root in number:
            continue
        work = [(root, iter(bases[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        open_.add(root)
        while work:
            cls, rest = work[-1]
            for b in rest:
                if b not in number:
                    number[b] = low[b] = len(number)
                    stack.append(b)
                    open_.add(b)
                    work.append((b, iter(bases[b])))
                    break
                if b in open_:
                    low[cls] = min(low[cls], number[b])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[cls])
                if low[cls] == number[cls]:
                    part = set()
                    while cls not in part:
                        part.add(stack.pop())
                    open_ -= part
                    if len(part) > 1 or cls in bases[cls]:
                        out |= dict.fromkeys(part, frozenset(part))
    return out


def class_orders(bases: dict) -> dict:
    """The order of every class over {class: its bases in order}. Each class is merged once, after its bases.

    Only within a cycle does an order depend on where the walk began: there it is walked anew from each class, and a
    class that the walk is in already adds nothing. Unknown bases are left out.
    """
    bases = {c: [b for b in bs if b in bases] for c, bs in bases.items()}
    parts, known = _cyclic(bases), {}

    def need(cls, within):
        """What the order of ``cls`` rests on, in a walk that is in the classes ``within`` of its cycle."""
        below = (within | {cls}) & parts[cls] if cls in parts else frozenset()
        return [(b, below if b in parts.get(cls, ()) else frozenset()) for b in bases[cls]]

    for start in bases:
        work = [(start, frozenset())]
        while work:
            cls, within = key = work[-1]
            if key in known:
                work.pop()
                continue
            if cls in within:
                known[key] = []
                continue
            wanted = need(cls, within)
            missing = [k for k in wanted if k not in known]
            if missing:
                work += missing
            else:
                known[key] = merged_order(cls, [known[k] for k in wanted] + [bases[cls]])
        if start in parts:  # the walks within a cycle are no use to others
            known = {k: v for k, v in known.items() if not k[1]}
    return {c: known[c, frozenset()] for c in bases}


def c3_order(classes: DataFrame) -> DataFrame:
    """(package, cls, mro) from (package, cls, bases): C3 linearisation, cut off where an order is inconsistent.

    The merge is not a monotone recursion, so a package's classes are ordered together in one task, each once.
    """
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        orders = class_orders({c: [] if b is None else list(b) for c, b in zip(group["cls"], group["bases"])})
        return pd.DataFrame({"package": group["package"].iloc[0], "cls": list(orders), "mro": list(orders.values())})

    return classes.groupBy("package").applyInPandas(run, "package string, cls string, mro array<string>")


def rewrite_names(names: DataFrame, aliases: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(name, target): all ends of rewriting dotted names by (alias, target), where an alias may stand for any prefix.

    ``a.f`` becomes ``x.y.f`` where ``a`` leads to ``x.y``. A name may have several ends; a way that meets a name again
    ends nowhere. Names that no alias fits are their own end.
    """
    aliases = settle(aliases.select("alias", "target").distinct())
    front = settle(names.select("name", F.col("name").alias("now"), F.array("name").alias("seen")).distinct())
    ends = None
    for _ in range(max_rounds):
        parts = F.split("now", "[.]")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
        step = front.select("name", "now", "seen", F.explode(prefixes).alias("alias")).join(aliases, "alias")
        step = settle(step.select("name", "now", "seen", F.concat("target", F.expr("substring(now, length(alias) + 1)")).alias("next")))
        done = settle(front.join(step.select("name", "now").distinct(), ["name", "now"], "left_anti").select("name", F.col("now").alias("target")))
        ends = done if ends is None else ends.unionAll(done)
        going = step.where(~F.array_contains("seen", F.col("next")))
        front = settle(going.groupBy("name", F.col("next").alias("now")).agg(F.min(F.concat("seen", F.array("next"))).alias("seen")))
        if front.isEmpty():
            return ends.distinct()
    raise ValueError(f"no end after {max_rounds} rounds")


def resolve_aliases(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(name, target): all canonical ends of chains over (alias, target); a chain that meets itself ends nowhere."""
    found = closure(aliases.select(F.col("alias").alias("src"), F.col("target").alias("dst")))
    ends = found.join(aliases.select(F.col("alias").alias("node")).distinct(), "node", "left_anti")
    plain = names.join(aliases.select(F.col("alias").alias("name")).distinct(), "name", "left_anti").select("name", F.col("name").alias("target"))
    return names.join(ends.select(F.col("start").alias("name"), F.col("node").alias("target")), "name").select("name", "target").unionAll(plain)


def closure_changes(pairs: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(start, node, change) that brings a closure (start, node) of ``edges`` up to date with added and removed edges.

    Removed first: every pair that some way over a removed edge gives is taken back, and those of them that the edges left
    still give are found again, backwards from pairs that stand. Then added ones: a new pair goes over an added edge, from
    all that lead to it, and on from there by single edges. The joins start from the changed edges and the pairs that they
    touch; of the closure they take the rows that meet those. ``edges`` are those before the change; an edge that is
    both removed and added stays.
    """
    pairs, plain = pairs.select("start", "node"), lambda e: e.select("src", "dst").where("src is not null and dst is not null").distinct()
    old = plain(edges)
    new_edges = settle(plain(added).join(old, ["src", "dst"], "left_anti"))
    lost = settle(plain(removed).join(plain(added), ["src", "dst"], "left_anti").join(old, ["src", "dst"], "left_semi"))
    left = old.join(lost, ["src", "dst"], "left_anti")

    def around(changed: DataFrame) -> DataFrame:
        """(start, dst): from all that lead to a changed edge, itself included, to its end."""
        ahead = changed.select(F.col("src").alias("node"), "dst").join(pairs, "node").select("start", "dst")
        return changed.select(F.col("src").alias("start"), "dst").unionAll(ahead).distinct()

    over = around(lost)
    behind = over.unionAll(over.join(pairs.select(F.col("start").alias("dst"), "node"), "dst").select("start", F.col("node").alias("dst")))
    shaken = settle(behind.distinct().select("start", F.col("dst").alias("node")))
    standing = lambda p: p.join(shaken, ["start", "node"], "left_anti")
    # Again: an edge that is left, and then nothing or a pair that stands.
    first = shaken.join(left.select(F.col("src").alias("start"), F.col("dst").alias("_via")), "start")
    direct = first.where("_via = node").select("start", "node")
    by_pair = first.join(standing(pairs).select(F.col("start").alias("_via"), "node"), ["_via", "node"], "left_semi").select("start", "node")
    again = fresh = settle(direct.unionAll(by_pair).distinct())
    while not fresh.isEmpty():
        up = first.join(fresh.select(F.col("start").alias("_via"), "node"), ["_via", "node"], "left_semi").select("start", "node").distinct()
        fresh = settle(up.join(again, ["start", "node"], "left_anti"))
        again = again.unionAll(fresh)
    gone = settle(shaken.join(again, ["start", "node"], "left_anti"))
    # What stands now is the closure of the edges left. Pairs over added edges, step by step.
    now = pairs.join(gone, ["start", "node"], "left_anti")
    both = left.unionAll(new_edges)
    ahead = new_edges.select(F.col("src").alias("node"), "dst").join(now, "node").select("start", F.col("dst").alias("node"))
    begun = new_edges.select(F.col("src").alias("start"), F.col("dst").alias("node")).unionAll(ahead).distinct()
    grown = fresh = settle(begun.join(now, ["start", "node"], "left_anti"))
    while not fresh.isEmpty():
        step = fresh.join(both, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        fresh = settle(step.join(grown, ["start", "node"], "left_anti").join(now, ["start", "node"], "left_anti"))
        grown = grown.unionAll(fresh)
    made = grown.join(gone, ["start", "node"], "left_anti").withColumn("change", F.lit("added"))
    return made.unionAll(gone.join(grown, ["start", "node"], "left_anti").withColumn("change", F.lit("removed")))


def apply_changes(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """A closure (start, node) after ``closure_changes``."""
    kept = pairs.select("start", "node").join(changes.where("change = 'removed'"), ["start", "node"], "left_anti")
    return kept.unionByName(changes.where("change = 'added'").select("start", "node"))


def members_below(children: DataFrame, owners: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(owner, member, depth): over (parent, child) everything below an owner (node) that no nearer owner is above.

    An owner is a member of the one above it, but what lies under it is its own. Each round opens what the last one found.
    """
    edges = settle(children.select("parent", "child").where("parent <> child").distinct())
    stop = settle(owners.select("node").distinct())
    fresh, found = stop.select(F.col("node").alias("owner"), "node"), None
    for depth in range(1, max_rounds + 1):
        step = fresh.join(edges, F.col("node") == F.col("parent")).select("owner", F.col("child").alias("member"), F.lit(depth).alias("depth")).distinct()
        step = settle(step if found is None else step.join(found, ["owner", "member"], "left_anti"))
        if step.isEmpty():
            return step if found is None else found
        found = step if found is None else found.unionAll(step)
        fresh = step.select("owner", F.col("member").alias("node")).join(stop, "node", "left_anti").select("owner", "node")
    raise ValueError(f"no end after {max_rounds} rounds")


def tree_order(children: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(node, parent, depth, position) of the trees under ``roots`` (node, ord) over (parent, ord, child), depth first.

    A node's way is the ordinals down to it, and ways compare in that order; one sort by ranges numbers them. A node with
    several parents stands under each; a cycle is an error.
    """
    edges = settle(children.select("parent", F.col("ord").cast("long").alias("ord"), "child"))
    level = roots.select("node", F.lit(None).cast(edges.schema["parent"].dataType).alias("parent"), F.array(F.col("ord").cast("long")).alias("way"))
    found = None
    for _ in range(max_depth):
        level = settle(level)
        if level.isEmpty():
            every = level if found is None else found
            return numbered(every, "way", "node").select("node", "parent", (F.size("way") - 1).alias("depth"), "position")
        found = level if found is None else found.unionAll(level)
        level = level.select("node", "way").join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "parent", F.concat("way", F.array("ord")).alias("way"))
    raise ValueError(f"a tree is deeper than {max_depth}, or has a cycle")
