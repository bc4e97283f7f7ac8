import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gridwright.llm import packing as P


def slots(plan, size):
    """Containers of each slot of a size."""
    out = []
    for at, first, each, end in zip(plan.at[size], plan.first[size], plan.each[size], [*plan.at[size][1:], plan.filled[size]], strict=True):
        out += [first + k // each for k in range(end - at)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plans_hold_everything_once(capacity, counts):
    counts = {s: c for s, c in counts.items() if s <= capacity}
    plan = P.packed(counts, capacity)
    used = [0] * plan.containers
    for s, c in counts.items():
        assert plan.filled[s] == c
        for b in slots(plan, s):
            used[b] += s
    assert all(0 < u <= capacity for u in used)
    # no more than 1.5 times what the sizes need at least
    assert plan.containers <= 1.5 * -(-sum(s * c for s, c in counts.items()) // capacity) + 1 or max(counts, default=0) * 2 > capacity


def test_close_to_the_bound():
    r = random.Random(1)
    counts: dict[int, int] = {}
    for _ in range(20000):
        s = max(1, min(2048, int(r.lognormvariate(6, 0.8))))
        counts[s] = counts.get(s, 0) + 1
    need = -(-sum(s * c for s, c in counts.items()) // 2048)
    assert P.packed(counts, 2048).containers <= 1.01 * need


def test_fill(spark):
    rows = [(k, (k * 37) % 50) for k in range(300)] + [(1000, 345), (1001, None), (1002, 0), (5, 17), (5, 17)]
    sizes = spark.createDataFrame(rows, "doc long, n long").selectExpr("*", "'clash' AS kind", "1 AS piece")
    boxes = spark.createDataFrame([("s", 50), ("l", 100), ("s", 50), (None, 9), ("bad", 0)], "k string, cap int")
    out = P.fill(sizes, "doc", "n", boxes, "k", "cap", salts=3).collect()
    for kind, cap in (("s", 50), ("l", 100)):
        own = [r for r in out if r["k"] == kind]
        room: dict[int, int] = {}
        got: dict[int, int] = {}
        for r in own:
            room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_tokens"]
            got[r["doc"]] = got.get(r["doc"], 0) + r["n_tokens"]
        want: dict[int, int] = {}
        for d, n in rows:
            if n:
                want[d] = want.get(d, 0) + n
        assert got == want and max(room.values()) <= cap and len(room) == max(room) + 1
        assert all(r["n_tokens"] == cap or r["piece_no"] == 345 // cap for r in own if r["doc"] == 1000)
    assert len(out) == len([r for r in out if r["k"] in "sl"])
    assert P.fill(sizes.limit(0), "doc", "n", boxes, "k", "cap").count() == 0 and P.fill(sizes, "doc", "n", boxes.limit(0), "k", "cap").count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "Hello world, hello <|endoftext|> again"), (2, None), (3, ""), (4, "x" * 30000 + " \n" * 20000)], "id long, body string")
    got = {r["id"]: r["n_tokens"] for r in P.token_counts(docs, "id", "body").collect()}
    enc = P._encoding(P.TOKENIZER)
    assert got[1] == len(enc.encode_ordinary("Hello world, hello <|endoftext|> again")) and got[2] == got[3] == 0 and got[4] > 1000
