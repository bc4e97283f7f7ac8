import random

import pytest

from gridwright.llm import sentences as S

WORDS = "ledger crate signal panel meadow harvest copper lantern bridge orchard amber quiet barrel column weigh trim figure basket".split()
NAMES = ["Orbela", "Kamosar", "Tovanu", "Miniko"]


def sentence(r):
    w = [r.choice(WORDS) for _ in range(r.randrange(4, 9))]
    k = r.random()
    if k < 0.2:
        w.insert(2, f"Mr. {r.choice(NAMES)}")
    elif k < 0.35:
        w.insert(2, "e.g.")
    elif k < 0.5:
        w.insert(2, f"no. {r.randrange(99)}")
    elif k < 0.55:
        w.insert(1, f"{r.randrange(99)}.{r.randrange(99)}")
    s = " ".join(w)
    if r.random() < 0.1:
        return f'"{s[0].upper()}{s[1:]}?" asked {r.choice(NAMES)}.'
    return s[0].upper() + s[1:] + r.choice("...?!")


def mail(r):
    """A mail and its units."""
    paras, want = [], []
    for _ in range(r.randrange(2, 6)):
        own = [sentence(r) for _ in range(r.randrange(1, 5))]
        want += own
        paras.append(" ".join(own).replace(" harvest ", "\nharvest "))
    return "Subject: s\n\n" + "\n\n".join(paras) + "\n", want


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    rows = {(g, f, c) for _ in range(500) for g, f, c in S.examples(mail(r)[0])}
    return S.fit(sorted((g, f) for g, f, _ in rows))


def test_held_out_accuracy(model):
    r, right, found, due = random.Random(2), 0, 0, 0
    for _ in range(200):
        text, want = mail(r)
        got = [" ".join(text[a:b].split()) for a, b in S.units(text, model)]
        right += len(set(got) & set(want))
        found += len(got)
        due += len(want)
    assert right / found > 0.98 and right / due > 0.98


def test_units_are_spans_in_order(model):
    text, _ = mail(random.Random(7))
    spans = S.units(text, model)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:], strict=False))


def test_lists_scripts_and_ends(model):
    text = "A: b\n\nHello,\n\n- one two\n- three. Four\n\n1. first\n2. second\n  goes on\n\nUnd so weiter ohne Ende"
    assert [text[a:b] for a, b in S.units(text, model)] == ["Hello,", "- one two", "- three. Four", "1. first", "2. second\n  goes on", "Und so weiter ohne Ende"]
    assert not S._LIST.match("M. Runiken steht") and S._LIST.match("a) first") and S._LIST.match("(3) third")
    every = S.Model({}, -1.0)
    zh = "A: b\n\n第一句。第二句！第三句"
    assert [zh[a:b] for a, b in S.units(zh, every)] == ["第一句。", "第二句！", "第三句"]
    hi = "A: b\n\nपहला वाक्य। दूसरा।"
    assert len(S.units(hi, every)) == 2
    url = "A: b\n\nSee https://a.b/c.d?e=1 and file v2.5.csv or x@y.z now"
    assert len(S.units(url, every)) == 1
    gap = "A: b\n\nthe orchard.Quiet bridge"
    assert [gap[a:b] for a, b in S.units(gap, every)] == ["the orchard.", "Quiet bridge"]


def test_operator(spark):
    r = random.Random(3)
    rows = [(k, mail(r)[0], "x") for k in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "A: b\n\n" + "Long bridge. " * 20000, "x"), (0, None, "x")]
    df = spark.createDataFrame(rows, "id long, body string, start_char string")
    got = S.sentences(df, "id", "body")
    assert got.columns == ["id", "start_char", "end_char"]
    a, b = got.collect(), S.sentences(df, "id", "body").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and {x["id"] for x in a} == {*range(60), 102}
    assert S.sentences(df.limit(0), "id", "body").count() == 0
