import json

import numpy as np

from gridwright.operators import drift as D

SCHEMA = "kind string, feed string, file_no int, file_id long, line_no int, body string"


def field(**kw):
    base = {"type": "number", "n": 9, "n_num": 9, "n_day": 0, "n_flag": 0, "quantiles": [5.0] * 9, "hashes": [1] * 16}
    return base | kw


def test_assigned_is_optimal():
    import itertools

    rng = np.random.default_rng(3)
    for n, m in ((3, 5), (5, 3), (4, 4), (1, 1)):
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in D.assigned(c))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(r, cols, strict=True)) for r in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert np.isclose(got, best)


def test_scripts_of_trees():
    old = {"a.x": field(), "a.y": field(quantiles=[1.0] * 9), "b": field(), "gone": field(quantiles=[9.0] * 9), "s": field(type="string")}
    new = {"a.x": field(type="string"), "a.z": field(quantiles=[1.1] * 9), "s": field(type="string"), "c.b": field(), "new": field(n_flag=9)}
    assert sorted(D.tree_script(old, new, set())) == [("added", "", "new"), ("moved", "b", "c.b"), ("removed", "gone", ""), ("renamed", "a.y", "a.z"), ("retyped", "a.x", "a.x")]
    # names known to be two quantities are never one renamed
    assert ("renamed", "a.y", "a.z") not in D.tree_script(old, new, {("a.y", "a.z")})


def test_subtrees_cost_what_their_scripts_cost():
    f = lambda **kw: field(**kw)
    far = field(quantiles=[50.0] * 9)
    # a renamed object with one field renamed inside
    assert sorted(D.tree_script({"a.x": f(), "a.y": far}, {"b.x": f(), "b.z": far}, set())) == [("carried", "a.x", "b.x"), ("renamed", "a", "b"), ("renamed", "a.y", "b.z")]
    # two levels renamed
    assert sorted(D.tree_script({"a.p.x": f(), "a.p.y": far}, {"b.q.x": f(), "b.q.y": far}, set())) == [("carried", "a.p.x", "b.q.x"), ("carried", "a.p.y", "b.q.y"), ("renamed", "a", "b"), ("renamed", "a.p", "b.q")]
    # the cheaper of two objects is the one that goes on, however the names sort
    old = {"m.u": f(), "m.v": far, "m.w": field(quantiles=[-9.0] * 9)}
    new = {"k.u": f(), "n.v": far, "n.w": field(quantiles=[-9.0] * 9)}
    assert sorted(s for s in D.tree_script(old, new, set()) if s[0] != "carried") == [("moved", "m.u", "k.u"), ("renamed", "m", "n")]
    # a field leaves an object that stays
    assert D.tree_script({"a.x": f(), "a.y": far}, {"a.x": f(), "y": far}, set()) == [("moved", "a.y", "y")]
    assert sorted(D.tree_script({"a": f()}, {"a": f(), "a.b": far}, set())) == [("added", "", "a.b")]
    assert D.tree_script({}, {"x": f()}, set()) == [("added", "", "x")] and D.tree_script({"x": f()}, {}, set()) == [("removed", "x", "")] and D.tree_script({}, {}, set()) == []


def test_distance_is_least_over_all_scripts():
    """Against every way of matching two small trees, level by level."""
    import itertools

    rng = np.random.default_rng(8)

    def some():
        out = {}
        for _ in range(rng.integers(1, 6)):
            out[".".join(rng.choice(list("abc"), rng.integers(1, 4)))] = field(type=str(rng.choice(["number", "string"])), quantiles=[float(rng.integers(0, 3))] * 9)
        return out

    def brute(a, b):
        if a.leaf != b.leaf:
            return np.inf
        if a.leaf:
            if a.name == b.name:
                return 0.5 * D.retyped(a.field, b.field)
            d = D.difference(a.field, b.field)
            return d if d < 1 else np.inf
        same = [n for n in a.inner if n in b.inner and a.inner[n].leaf == b.inner[n].leaf]
        left, right = [x for n, x in a.inner.items() if n not in same], [x for n, x in b.inner.items() if n not in same]
        size = lambda t: sum(1 for _ in t.leaves())
        best = np.inf
        for k in range(min(len(left), len(right)) + 1):
            for xs in itertools.combinations(left, k):
                for ys in itertools.permutations(right, k):
                    if all(x.name != y.name for x, y in zip(xs, ys, strict=True)):
                        best = min(best, sum(brute(x, y) for x, y in zip(xs, ys, strict=True)) + sum(size(x) for x in left if x not in xs) + sum(size(y) for y in right if y not in ys))
        return best + sum(brute(a.inner[n], b.inner[n]) for n in same) + 0.1 * (a.name != b.name)

    for _ in range(150):
        a, b = D.tree(some()), D.tree(some())
        assert np.isclose(D.Distance(set()).pair(a, b), brute(a, b))


def test_nested_files_unify(spark):
    one = [{"id": k, "q": {"bid": 10.0 + k, "ask": 1e5 + k}} for k in range(6)]
    two = [{"id": k, "quote": {"bid": 10.2 + k, "offer": 1e5 + k}} for k in range(6)]
    raw = files(spark, {"f": [one, two]})
    sig = D.signatures(raw)
    changes = D.scripts(sig)
    assert {tuple(r)[4:] for r in changes.collect()} == {("renamed", "q", "quote"), ("renamed", "q.ask", "quote.offer"), ("carried", "q.bid", "quote.bid")}
    classes = D.alias_classes(sig, changes)["p"]
    got = D.unified(raw, "p", classes, {"q.bid": "double", "q.ask": "double"}, ["file_no"]).collect()
    assert len(got) == 12 and all(r["q.bid"] is not None and r["q.ask"] > 9e4 for r in got)


def files(spark, feeds):
    rows, fid = [], 0
    for feed, contents in feeds.items():
        for no, lines in enumerate(contents, 1):
            fid += 1
            rows += [("p", feed, no, fid, k, x if isinstance(x, str) or x is None else json.dumps(x)) for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def test_files(spark):
    one = [{"sym": "A", "day": "2024-01-01", "px": 10.0 + k, "vol": 1e6} for k in range(5)]
    two = [{"sym": "A", "day": "20240102", "price": 10.2 + k, "vol": str(1e6), "note": "x"} for k in range(5)] + ['{"sym": "A", "pr', "[1]", None, "{}"]
    three = [{"sym": "A", "day": "03/01/2024", "price": None if k else 10.1, "vol": "stray", "px_other": 1} for k in range(5)] + [{"vol": 5.0, "sym": "A"}]
    raw = files(spark, {"f": [one, two, three], "g": [one], "h": [["broken"]]})
    sig = D.signatures(raw.unionByName(raw.limit(3)))
    got = sorted(tuple(r)[3:] for r in D.scripts(sig).collect())
    assert got == [(2, "added", "", "note"), (2, "renamed", "px", "price"), (2, "retyped", "vol", "vol"), (3, "added", "", "px_other"), (3, "removed", "note", "")]
    classes = D.alias_classes(sig, D.scripts(sig))["p"]
    table = D.unified(raw, "p", classes, {"day": "date", "price": "double", "vol": "double"}, ["feed", "file_no"])
    rows = table.where("feed = 'f'").collect()
    assert sum(r["price"] is not None for r in rows) == 11 and sum(r["vol"] is not None for r in rows) == 11
    assert {str(r["day"]) for r in rows if r["day"]} == {"2024-01-01", "2024-01-02", "2024-01-03"}


def test_every_day_layout_is_read(spark):
    texts = ["2023-01-08", "20230108", 20230108, "2023-0108", "08/01/2023", "8/1/2023", "08.01.2023", "8.1.2023", "08.1.2023", " 08.01.2023 ", "\t8/1/2023\n"]
    assert all(D._DAY.fullmatch(str(t).strip()) for t in texts)
    raw = files(spark, {"f": [[{"day": t} for t in [*texts, "32.01.2023", "31.02.2023", "n/a", "8.1.23", None]]]})
    got = [r["day"] for r in D.unified(raw, "p", {"day": ["day"]}, {"day": "date"}, ["line_no"]).orderBy("line_no").collect()]
    assert [str(x) for x in got[: len(texts)]] == ["2023-01-08"] * len(texts) and got[len(texts) :] == [None] * 5


def test_no_field_is_thrown_away(spark):
    one = [{"sym": "A", "px": 10.0 + k, "ratio": 1.0 if k else 2.5, "split": 1.0, "odd'key?": k + 0.5, "x": {"note": f"n{k}"}} for k in range(5)]
    two = [{"sym": "A", "price": 10.2 + k, "halted": k > 2, "trades": str(100 + k), "since": "08.01.2023", "tags": ["u", "v"], "Feed": "z", "gone": None} for k in range(5)]
    two[4]["halted"] = 1
    raw = files(spark, {"f": [one, two]})
    sig = D.signatures(raw)
    classes = {n: [n] for n in ("sym", "ratio", "split", "odd'key?", "x.note", "halted", "trades", "since", "tags[]", "Feed", "gone")} | {"px": ["px", "price"]}
    named, types = D.columns(sig, "p", classes, {"sym": "string", "day": "date"}, ["feed", "file_no", "line_no"])
    assert types == {"sym": "string", "day": "date", "Feed_2": "string", "gone": "string", "halted": "boolean", "odd'key?": "double", "px": "double", "ratio": "double", "split": "double", "since": "date", "tags": "string", "trades": "double", "x.note": "string"}
    t = D.unified(raw, "p", named, types, ["feed", "file_no", "line_no"])
    got = {c: [r[c] for r in t.orderBy("file_no", "line_no").collect() if r[c] is not None] for c in types}
    assert got["px"] == [10.0 + k for k in range(5)] + [10.2 + k for k in range(5)] and got["ratio"] == [2.5, 1.0, 1.0, 1.0, 1.0]
    assert got["odd'key?"] == [k + 0.5 for k in range(5)] and got["x.note"] == [f"n{k}" for k in range(5)] and got["Feed_2"] == ["z"] * 5
    assert got["halted"] == [False] * 3 + [True, True] and got["trades"] == [100.0 + k for k in range(5)] and [str(x) for x in got["since"]] == ["2023-01-08"] * 5
    assert got["tags"] == ['["u","v"]'] * 5 and got["gone"] == [] and got["day"] == []


def test_known_names_settle_a_jump(spark):
    a = [{"sym": "A", "vol": 100.0 + k} for k in range(5)]
    near, far = ([{"sym": "A", "shares": v + k} for k in range(5)] for v in (101.0, 9e9))
    raw = files(spark, {"f": [a, near], "g": [a, far]})
    sig = D.signatures(raw)
    changes = D.scripts(sig)
    assert sorted(tuple(r)[3:] for r in changes.collect()) == [(2, "renamed", "vol", "shares"), (4, "added", "", "shares"), (4, "removed", "vol", "")]
    done = D.settled(changes, D.alias_classes(sig, changes))
    assert sorted(tuple(r)[3:] for r in done.collect()) == [(2, "renamed", "vol", "shares"), (4, "renamed", "vol", "shares")]


def test_empty(spark):
    sig = D.signatures(spark.createDataFrame([], SCHEMA))
    assert sig.count() == 0 and D.scripts(sig).count() == 0 and D.alias_classes(sig, D.scripts(sig)) == {}
    assert D.settled(D.scripts(sig), {}).count() == 0
