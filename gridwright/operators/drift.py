"""Schemas that drift between files: signatures, edit scripts, one consistent table.

``signatures`` reduces every file to one row per field (a path in the nested
schema): the JSON types seen and mergeable sketches of its values. ``scripts``
compares each file's schema tree with that of the feed's preceding file by a
tree edit distance whose cheapest script says what was added, removed, renamed, moved or
retyped. ``alias_classes`` joins the renames of all feeds to classes of names for one
quantity, and ``unified`` compiles the classes into one projection for all files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as dc_field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.functions.columns import col
from gridwright.session import staged

HASHES = 16
QUANTILES = [i / 10 for i in range(1, 10)]
FILE = ["kind", "feed", "file_no", "file_id"]
CELL = "kind string, feed string, file_no long, file_id long, path string, type string, num double, day boolean, flag boolean, txt string"
_DAY = re.compile(r"(?:19|20)\d\d-?[01]\d-?[0-3]\d|[0-3]?\d[/.][0-3]?\d[/.](?:19|20)\d\d")
# what _DAY accepts, brought to year-month-day
DAY_LAYOUTS = {r"^\s*(\d{4})-?(\d{2})-?(\d{2})\s*$": "$1-$2-$3", r"^\s*(\d{1,2})[/.](\d{1,2})[/.](\d{4})\s*$": "$3-$2-$1"}
_STARTS = frozenset("0123456789+-.")  # of texts that may be finite numbers
_FLAGS = {"0", "1", "0.0", "1.0", "true", "false", "yes", "no", "y", "n"}


def flat(value, path: str = "") -> Iterator[tuple[str, object]]:
    """The leaves of a JSON value with their dotted paths; an array's elements share the path with []."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flat(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for v in value:
            yield from flat(v, f"{path}[]")
    else:
        yield path, value


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, paths, types, nums, days, flags, texts = [], [], [], [], [], [], []
        for row, body in enumerate(batch.column(4).to_pylist()):
            try:
                line = json.loads(body)
            except (ValueError, TypeError, RecursionError):
                continue
            if not isinstance(line, dict):
                continue
            cells = flat(line) if any(isinstance(v, dict | list) for v in line.values()) else line.items()
            for path, v in cells:
                kind, num, day, flag, text = None, None, None, None, None
                if isinstance(v, bool):
                    kind, num, day, flag = "boolean", float(v), False, True
                elif isinstance(v, str):
                    text, bare = v, v.strip()
                    kind, day, flag = "string", bool(_DAY.fullmatch(bare)), bare.lower() in _FLAGS
                    try:
                        num = float(bare) if bare[:1] in _STARTS else None
                    except ValueError:
                        pass
                elif v is not None:
                    kind, day, flag = "number", isinstance(v, int) and 19000000 <= v < 21000000 and bool(_DAY.fullmatch(str(v))), v in (0, 1)
                    try:
                        num = float(v)
                    except OverflowError:
                        pass
                at.append(row)
                paths.append(path)
                types.append(kind)
                nums.append(num if num is not None and abs(num) < 1e300 else None)
                days.append(day)
                flags.append(flag)
                texts.append(text)
        heads = pa.array(at, pa.int64())
        made = [batch.column(i).take(heads) for i in range(4)]
        made += [pa.array(c, t) for c, t in zip((paths, types, nums, days, flags, texts), (pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays(made, names=["kind", "feed", "file_no", "file_id", "path", "type", "num", "day", "flag", "txt"])


def signatures(raw: DataFrame, kind: str = "kind", feed: str = "feed", file_no: str = "file_no", file_id: str = "file_id", body: str = "body") -> DataFrame:
    """One row per file and field: type (of most non-NULL values; ties go to the first by name), n values, sketches.

    Lines that aren't JSON objects are unreadable and passed over; a file without a readable line has no row. A field whose
    values are all NULL has type NULL. Files of any length merge to one row a field before anything is compared.
    """
    lines = raw.select(col(kind).alias("kind"), col(feed).alias("feed"), col(file_no).cast("long").alias("file_no"), col(file_id).cast("long").alias("file_id"), col(body).alias("body"))
    cells = lines.where(F.col("body").isNotNull()).mapInArrow(_cells, CELL)
    scaled = F.signum("num") * F.log1p(F.abs("num") * 10000.0)
    aggs = [F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t}") for t in ("boolean", "number", "string")]
    aggs += [F.count("type").alias("n"), F.count("num").alias("n_num"), F.count(F.when(F.col("day"), 1)).alias("n_day"), F.count(F.when(F.col("flag"), 1)).alias("n_flag")]
    aggs += [F.percentile_approx(scaled, QUANTILES, 2000).alias("quantiles"), F.array(*[F.min(F.when(F.col("txt").isNotNull(), F.xxhash64("txt", F.lit(i)))) for i in range(HASHES)]).alias("hashes")]
    out = cells.groupBy(*FILE, "path").agg(*aggs)
    most = F.greatest("n_boolean", "n_number", "n_string")
    return out.withColumn("type", F.when(most == 0, None).when(F.col("n_boolean") == most, "boolean").when(F.col("n_number") == most, "number").otherwise("string"))


def nature(f: dict) -> str:
    """What sort of quantity a field holds, whatever its JSON type: nothing, day, flag, number or text."""
    n = f["n"]
    if not n:
        return "nothing"
    for name, part in (("day", f["n_day"]), ("flag", f["n_flag"]), ("number", f["n_num"])):
        if part >= 0.6 * n:
            return name
    return "text"


def difference(a: dict, b: dict) -> float:
    """How unlike two fields' values are: 0 alike, 1 and above no match."""
    kind = nature(a)
    if kind == "nothing" or kind != nature(b):
        return 9.0
    if kind == "number":
        return float(np.mean(np.abs(np.array(a["quantiles"]) - np.array(b["quantiles"])))) / 0.7
    if kind == "text":
        return 1.25 - sum(x == y is not None for x, y in zip(a["hashes"], b["hashes"], strict=True)) / HASHES
    return 0.3


def assigned(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns of least total cost (shortest augmenting paths)."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in assigned(cost.T)]
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            cur = np.append(np.inf, cost[i0 - 1] - u[i0] - v[1:])
            better = ~used & (cur < least)
            least[better], way[better] = cur[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)))
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]


LEAF, RETYPED, RENAMED, MOVED = 1.0, 0.5, 0.1, 0.5


@dataclass
class Tree:
    """A node of a schema: a field if it has no inner nodes. What is sometimes a value and sometimes an object has the value as a field without a name."""

    name: str
    path: str
    field: dict | None = None
    inner: dict[str, Tree] = dc_field(default_factory=dict)

    @property
    def leaf(self) -> bool:
        return not self.inner

    def leaves(self) -> Iterator[Tree]:
        if self.leaf:
            yield self
        for x in self.inner.values():
            yield from x.leaves()


def above(fields: dict[str, dict]) -> set[str]:
    """The paths of inner nodes."""
    return {p[:k] for p in fields for k, c in enumerate(p) if c == "."}


def tree(fields: dict[str, dict], without: set[str] = frozenset(), opened: set[str] = frozenset()) -> Tree:
    """The tree of all fields but ``without``; a field whose path is in ``opened`` is an inner node with the value below it."""
    root = Tree("", "")
    for path in sorted(fields):
        if path in without:
            continue
        at = root
        names = path.split(".")
        for k, name in enumerate(names):
            if at.field is not None:
                at.inner[""] = Tree("", at.path, at.field)
                at.field = None
            at = at.inner.setdefault(name, Tree(name, ".".join(names[: k + 1])))
        if at.inner or path in opened:
            at.inner[""] = Tree("", path, fields[path])
        else:
            at.field = fields[path]
    return root


class Distance:
    """The edit distance of two schema trees in which matched nodes have matched parents, and the script behind it.

    Nodes of one name under matched parents are the same. To remove or add a field costs LEAF, so a subtree costs what its fields do; to
    retype one RETYPED; to rename a field the difference of its values, if below 1; to rename an inner node RENAMED and the
    distance of what is below. Of all assignments of what is left under two matched parents the cheapest is taken, level by level, so costs are those of whole subtrees.
    """

    def __init__(self, apart: set[tuple[str, str]]) -> None:
        self.apart, self.known = apart, {}

    def pair(self, a: Tree, b: Tree) -> float:
        """What it costs to make a matched a into b; infinite if that can't be."""
        if a.leaf != b.leaf:
            return float("inf")
        if a.leaf:
            if a.name == b.name:
                return RETYPED if retyped(a.field, b.field) else 0.0
            if (a.path, b.path) in self.apart or (b.path, a.path) in self.apart:
                return float("inf")
            d = difference(a.field, b.field)
            return d if d < 1.0 else float("inf")
        key = (a.path, b.path)
        if key not in self.known:
            self.known[key] = self._below(a, b)
        return self.known[key][0] + (RENAMED if a.name != b.name else 0.0)

    def _below(self, a: Tree, b: Tree) -> tuple[float, list[tuple[Tree, Tree]], list[Tree], list[Tree]]:
        same = [(x, b.inner[n]) for n, x in sorted(a.inner.items()) if n in b.inner and x.leaf == b.inner[n].leaf]
        met = {x.name for x, _ in same}
        gone, come = ([x for n, x in sorted(t.inner.items()) if n not in met] for t in (a, b))
        price = lambda t: LEAF * sum(1 for _ in t.leaves())
        lost, won = np.array([price(x) for x in gone]), np.array([price(x) for x in come])
        total = sum(self.pair(x, y) for x, y in same) + lost.sum() + won.sum()
        if gone and come:
            saved = np.array([[min(self.pair(x, y) - lost[i] - won[j], 0.0) if x.name != y.name else 0.0 for j, y in enumerate(come)] for i, x in enumerate(gone)])
            hits = [(i, j) for i, j in assigned(saved) if saved[i, j] < -1e-9]
            total += sum(saved[i, j] for i, j in hits)
            same += [(gone[i], come[j]) for i, j in hits]
            gone, come = [x for i, x in enumerate(gone) if i not in {h[0] for h in hits}], [y for j, y in enumerate(come) if j not in {h[1] for h in hits}]
        return float(total), same, gone, come

    def script(self, a: Tree, b: Tree) -> Iterator[tuple[str, str, str]]:
        self.pair(a, b)
        _, same, gone, come = self.known[a.path, b.path]
        for x, y in same:
            if x.name != y.name:
                yield "renamed", x.path, y.path
            elif x.leaf and x.path != y.path:
                yield "carried", x.path, y.path
            if not x.leaf:
                yield from self.script(x, y)
            elif x.name == y.name and retyped(x.field, y.field):
                yield "retyped", x.path, y.path
        yield from (("removed", t.path, "") for x in gone for t in x.leaves())
        yield from (("added", "", t.path) for x in come for t in x.leaves())


def retyped(a: dict, b: dict) -> bool:
    return bool(a["type"] and b["type"] and a["type"] != b["type"])


def tree_script(old: dict[str, dict], new: dict[str, dict], apart: set[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """(change, old path, new path) of the cheapest script between two schema trees: ``Distance``, and moves of fields, which it can't express.

    A field that goes on under its name below another parent costs MOVED. A move is taken into the script if that with the rest comes cheaper, the
    one that saves most first. *carried* are fields that only lie below a renamed node. Pairs of names in ``apart`` are known to be two quantities.
    """

    def cheapest(moves: list[tuple[str, str]]) -> tuple[float, list[tuple[str, str, str]]]:
        d = Distance(apart)
        a, b = tree(old, {x for x, _ in moves}, above(new)), tree(new, {y for _, y in moves}, above(old))
        a.inner, b.inner = a.inner or {"": Tree("", "", {"n": 0, "type": None})}, b.inner or {"": Tree("", "", {"n": 0, "type": None})}
        out = [s for s in d.script(a, b) if s[1] or s[2]]
        cost = d.pair(a, b) + sum(MOVED + RETYPED * retyped(old[x], new[y]) for x, y in moves)
        return cost, out + [("moved", x, y) for x, y in moves] + [("retyped", x, y) for x, y in moves if retyped(old[x], new[y])]

    name = lambda p: p.rsplit(".", 1)[-1]
    moves: list[tuple[str, str]] = []
    cost, script = cheapest(moves)
    homes: dict[str, list[str]] = {}
    for y in sorted(new.keys() - old.keys()):
        homes.setdefault(name(y), []).append(y)
    possible = [(x, y) for x in sorted(old.keys() - new.keys()) for y in homes.get(name(x), []) if x.count(".") or y.count(".")]
    possible = [(x, y) for x, y in possible if difference(old[x], new[y]) < 1.0]
    while possible:
        tries = [(cheapest([*moves, m]), m) for m in possible]
        (least, found), move = min(tries, key=lambda t: (t[0][0], t[1]))
        if least > cost - 1e-9:
            break
        cost, script = least, found
        moves.append(move)
        possible = [m for m in possible if m[0] != move[0] and m[1] != move[1]]
    return script


def _side_by_side(fields: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """Those of ``pairs`` (kind, a, b) that ``least`` or more files hold side by side, so they are two quantities."""
    held = fields.select(*FILE, "path")
    one = pairs.select("kind", "a", "b").distinct().join(held.withColumnRenamed("path", "a"), ["kind", "a"])
    return one.join(held.withColumnRenamed("path", "b"), [*FILE, "b"]).groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("kind", "a", "b")


def scripts(fields: DataFrame) -> DataFrame:
    """kind, feed, file_no, file_id, change_kind, old_field, new_field: each file's changes against the feed's preceding file.

    A feed's files are compared pair by pair; what is moved is two files' signatures, and beside them the pairs of a name that went and one that came which
    other files hold side by side.
    """
    cells = F.struct("path", "type", "n", "n_num", "n_day", "n_flag", "quantiles", "hashes")
    files = fields.groupBy(*FILE).agg(F.collect_list(cells).alias("new"))
    earlier = Window.partitionBy("kind", "feed").orderBy("file_no", "file_id")
    order = files.select(*FILE).withColumns({"p_no": F.lag("file_no").over(earlier), "p_id": F.lag("file_id").over(earlier)}).where(F.col("p_no").isNotNull())
    before = files.select(F.col("kind").alias("k"), F.col("feed").alias("f"), F.col("file_no").alias("p_no"), F.col("file_id").alias("p_id"), F.col("new").alias("old"))
    pairs = order.join(files, FILE).join(before, (F.col("k") == F.col("kind")) & (F.col("f") == F.col("feed")) & (before["p_no"] == order["p_no"]) & (before["p_id"] == order["p_id"]))
    pairs = staged(pairs.select(*FILE, "old", "new"), "pairs")
    names = lambda side: F.transform(side, lambda x: x["path"])
    went = pairs.select(*FILE, F.explode(F.array_except(names("old"), names("new"))).alias("a"), F.array_except(names("new"), names("old")).alias("b")).withColumn("b", F.explode("b"))
    met = went.join(_side_by_side(fields, went), ["kind", "a", "b"]).groupBy(*FILE).agg(F.collect_list(F.struct("a", "b")).alias("apart"))
    pairs = pairs.join(met, FILE, "left")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                old, new = ({c["path"]: c for c in row[side]} for side in ("old", "new"))
                out += [(row["kind"], row["feed"], row["file_no"], row["file_id"], *step) for step in tree_script(old, new, {(p["a"], p["b"]) for p in row["apart"] or ()})]
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "feed", "file_no", "file_id", "change_kind", "old_field", "new_field"])

    return pairs.select(*FILE, "old", "new", "apart").mapInArrow(compared, "kind string, feed string, file_no long, file_id long, change_kind string, old_field string, new_field string")


def alias_classes(fields: DataFrame, changes: DataFrame) -> dict[str, dict[str, list[str]]]:
    """kind -> canonical name -> all names of that quantity, from the renames and moves seen in all feeds.

    Renames join names, the most frequent first, then names that differ only in case and separators; two classes
    with members that occur in one file stay apart. The canonical name is the one most files use. Only field names reach the driver, and pairs of those that links connect.
    """
    used = {(r["kind"], r["path"]): r["n"] for r in fields.groupBy("kind", "path").agg(F.countDistinct("file_id").alias("n")).toLocalIterator()}
    edges = changes.where(F.col("change_kind").isin("renamed", "moved", "carried")).groupBy("kind", "old_field", "new_field").agg(F.count(F.lit(1)).alias("n"))
    links = [((e["kind"], e["old_field"]), (e["kind"], e["new_field"])) for e in sorted(edges.toLocalIterator(), key=lambda e: (-e["n"], e["kind"], e["old_field"], e["new_field"]))]
    plain: dict[tuple[str, str], tuple[str, str]] = {}
    for k in sorted(used, key=lambda k: (-used[k], k)):
        links.append((plain.setdefault((k[0], re.sub(r"[\W_]", "", k[1]).lower()), k), k))
    links = [(x, y) for x, y in links if x in used and y in used and x != y]

    def joined(barred) -> dict[tuple[str, str], set[tuple[str, str]]]:
        group = {k: {k} for k in used}
        for x, y in links:
            a, b = group[x], group[y]
            if a is not b and not barred(a, b):
                a |= b
                for z in b:
                    group[z] = a
        return group

    # which names links connect at all; of those, which occur side by side
    spark = fields.sparkSession
    loose = {id(g): g for g in joined(lambda a, b: False).values() if len(g) > 1}
    rows = [(k, name, c) for c, g in enumerate(loose.values()) for k, name in sorted(g)]
    near = fields.join(spark.createDataFrame(rows, "kind string, path string, _class int"), ["kind", "path"]).groupBy(*FILE, "_class").agg(F.array_sort(F.collect_set("path")).alias("names"))
    pairs = F.flatten(F.transform("names", lambda x, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    met = near.where(F.size("names") > 1).select("kind", F.inline(pairs)).groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    apart = {(r["kind"], r["a"], r["b"]) for r in met.toLocalIterator()}
    group = joined(lambda a, b: any((x[0], *sorted((x[1], y[1]))) in apart for x in a for y in b))
    out: dict[str, dict[str, list[str]]] = {}
    for members in {id(g): g for g in group.values()}.values():
        ranked = sorted(members, key=lambda x: (-used[x], x[1]))
        out.setdefault(ranked[0][0], {})[ranked[0][1]] = [x[1] for x in ranked]
    return out


def columns(fields: DataFrame, kind: str, classes: dict[str, list[str]], known: dict[str, str], keep: list[str]) -> tuple[dict[str, list[str]], dict[str, str]]:
    """``classes`` keyed by column name, and the type of each column: what ``unified`` needs for one table without loss of a field.

    ``known`` columns come first, with their types, whether a file has them or not. Each further class is a column under its canonical
    name, of the type that most of its values have: date, double or boolean if at least 0.6 of the values fit it (the first of
    those that fit most, so numbers that happen to be 0 and 1 stay numbers), else string. An array is one string column of JSON. A name that another column or ``keep`` has,
    in whatever case, gets a number. Only field names and counts reach the driver.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "n_day", "n_flag", "n_num", "n_boolean")]
    seen = {r["path"]: r for r in fields.where(F.col("kind") == kind).groupBy("path").agg(*sums).toLocalIterator()}
    out: dict[str, list[str]] = {}
    types = dict(known)
    for name in known:
        out[name] = next((c for c in classes.values() if name in c), [name])
    taken = {n.lower() for n in [*known, *keep]}
    arrays: set[str] = set()
    for canonical, names in sorted(classes.items()):
        if any(n in names for n in known):
            continue
        whole = canonical.split("[]")[0]
        if whole != canonical:
            names = [n for n in dict.fromkeys(n.split("[]")[0] for n in names) if n not in arrays]
            arrays.update(names)
            if not names:
                continue
        name, k = whole or "_", 1
        while name.lower() in taken:
            k += 1
            name = f"{whole or '_'}_{k}"
        taken.add(name.lower())
        total = {c: sum(seen[n][c] for n in classes[canonical] if n in seen) for c in ("n", "n_day", "n_flag", "n_num", "n_boolean")}
        # a JSON boolean is a number to float(), but not to a double column
        fit = {"date": total["n_day"], "double": total["n_num"] - total["n_boolean"], "boolean": total["n_flag"]}
        best = max(fit, key=lambda t: fit[t])
        out[name], types[name] = names, best if whole == canonical and total["n"] and fit[best] >= 0.6 * total["n"] else "string"
    return out, types


def _leaf(value: Column, path: str) -> Column:
    """The text at a dotted path of a variant, whatever characters its keys hold."""
    keys = path.split(".")
    if all(k and not re.search(r"['?]", k) for k in keys):
        return F.try_variant_get(value, "$" + "".join(f"['{k}']" for k in keys), "string")
    for k in keys:
        value = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(k))
    return F.try_variant_get(value, "$", "string")


def settled(changes: DataFrame, classes: dict[str, dict[str, list[str]]]) -> DataFrame:
    """``changes`` with what was removed and added in one file under two names of one class as a rename, too.

    A quantity whose values jump from a file to the next is still known by its names where other feeds renamed it.
    """
    spark = changes.sparkSession
    rows = [(k, n, c) for k, own in classes.items() for c, names in own.items() for n in names if len(names) > 1]
    named = spark.createDataFrame(rows, "kind string, name string, class string")
    gone = changes.where("change_kind = 'removed'").join(named.withColumnRenamed("name", "old_field"), ["kind", "old_field"]).select(*FILE, "old_field", "class")
    come = changes.where("change_kind = 'added'").join(named.withColumnRenamed("name", "new_field"), ["kind", "new_field"]).select(*FILE, "new_field", "class")
    more = gone.join(come, [*FILE, "class"]).groupBy(*FILE, "class").agg(F.min("old_field").alias("old_field"), F.min("new_field").alias("new_field"))
    more = more.select(*FILE, F.lit("renamed").alias("change_kind"), "old_field", "new_field")
    lost = more.select(*FILE, F.explode(F.array(F.struct(F.lit("removed").alias("change_kind"), F.col("old_field"), F.lit("").alias("new_field")), F.struct(F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), F.col("new_field")))).alias("x")).select(*FILE, "x.*")
    return changes.join(lost, [*FILE, "change_kind", "old_field", "new_field"], "left_anti").unionByName(more)


def unified(raw: DataFrame, kind: str, classes: dict[str, list[str]], targets: dict[str, str], keep: list[str]) -> DataFrame:
    """The readable lines of a kind as one table: ``keep`` columns and a column per target (name -> double, date, string or boolean).

    Each target reads the alias class of its name, or else the one that holds it, wherever a file has it. Values that don't fit the
    type, stray texts among numbers included, become NULL; days are read in all layouts that count as days in ``signatures``: YYYY-MM-DD with or
    without its hyphens, D/M/YYYY and D.M.YYYY. Repeated lines count once.
    """
    lines = raw.where(F.col("kind") == kind).dropDuplicates(["file_id", "line_no"]).withColumn("_v", F.try_parse_json("body"))
    lines = lines.where(F.schema_of_variant("_v").startswith("OBJECT"))

    def value(name: str, to: str):
        names = classes[name] if name in classes else next((c for c in classes.values() if name in c), [name])
        text = F.trim(F.coalesce(*[_leaf(F.col("_v"), n) for n in names], F.lit(None).cast("string")))
        if to == "double":
            return text.try_cast("double")
        if to == "date":
            ordered = text
            for form, as_iso in DAY_LAYOUTS.items():
                ordered = F.regexp_replace(ordered, form, as_iso)
            return F.to_date(F.when(F.regexp(ordered, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.try_to_timestamp(ordered, F.lit("yyyy-M-d"))))
        if to == "boolean":
            return F.when(F.lower(text).isin("1", "1.0", "true", "yes", "y"), True).when(F.lower(text).isin("0", "0.0", "false", "no", "n"), False)
        return F.when(text != "", text)

    return lines.select(*[col(k) for k in keep], *[value(n, t).alias(n) for n, t in targets.items()])
