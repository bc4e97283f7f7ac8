import base64
import random

import numpy as np

from gridwright.llm import leaks as L
from gridwright.llm.mail import texts

VOCAB = "ledger crate signal panel meadow harvest copper lantern bridge orchard amber quiet".split()


def brute(docs, items):
    out = set()
    for i, p, lang in items:
        dense = (lang or "").lower() in ("zh", "ja")
        t = list(L.signs(p or "")) if dense else L.words(p or "")
        n = 20 if dense else 13
        for d, body in docs:
            for x in texts(body or ""):
                u = list("".join(L.words(x))) if dense else L.words(x)
                runs = {tuple(u[k : k + n]) for k in range(len(u) - n + 1)}
                if any(tuple(t[k : k + n]) in runs for k in range(len(t) - n + 1)):
                    out.add((d, i))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "id long, body string").selectExpr("*", "'clash' AS item", "'clash' AS doc")
    i = spark.createDataFrame(items, "no long, txt string, lg string")
    return {tuple(r) for r in L.leaks(d, "id", "body", i, "no", "txt", "lg").collect()}


def cases():
    r = random.Random(4)
    say = lambda n: [r.choice(VOCAB) for _ in range(n)]
    items = [(k, " ".join(say(40)), "en") for k in range(8)] + [(50, "".join(r.choice("新鲜信号箱子草稿灯笼果园移动安静数值") for _ in range(60)), "zh")]
    docs = []
    for k in range(120):
        w = say(30)
        if k % 3 == 0:
            src = items[k % 8][1].split()
            at, n = r.randrange(25), r.choice([11, 12, 13, 14, 20])
            w[5:5] = src[at : at + n]
        body = " ".join(w)
        if k % 5 == 1:
            body = body.upper().replace(" ", ",  ")
        if k % 5 == 2:
            body = "> " + "\n> ".join(" ".join(w[j : j + 6]) for j in range(0, len(w), 6))
        head = "A: b\n\n"
        if k % 5 == 3:
            head, body = "Content-Transfer-Encoding: base64\n\n", base64.encodebytes(body.encode()).decode()
        if k % 5 == 4:
            head, body = "Content-Type: text/html\n\n", "<p>" + body.replace("crate", "<b>crate</b>").replace("amber", "am&#98;er") + "</p>"
        docs.append((k, head + body))
    zh = items[8][1]
    docs += [(300, "A: b\n\n前" + zh[5:24] + "后"), (301, "A: b\n\n前" + "，\n".join(zh[5:25]) + "后"), (302, None), (303, ""), (304, "A: b\n\n" + " ".join(say(60000))), (0, docs[0][1])]
    items += [(60, None, "en"), (61, "", None), (62, "only a few words", "en"), (0, items[0][1], "en")]
    return docs, items


def test_against_brute_force_with_a_good_and_a_useless_bitmap(spark, monkeypatch):
    docs, items = cases()
    want = brute(docs, items)
    assert (301, 50) in want and (300, 50) not in want and len(want) > 20
    assert run(spark, docs, items) == want
    monkeypatch.setattr(L, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(L, "bitmap", lambda flat, n: np.full(4, 0xFFFFFFFF, np.uint32))  # one that lets everything pass
    assert run(spark, docs, items) == want


def test_empty(spark):
    docs, items = cases()
    assert run(spark, docs[:3], []) == set() and run(spark, [], items) == set()


def test_runs():
    sh = np.arange(40, dtype=np.int64) * 7 - 60
    want = {*sh[3:12].tolist(), *sh[20:24].tolist(), *sh[30:39].tolist()}
    bits = np.zeros(1 << 11, np.uint32)
    for x in want:
        bits[(x & 0xFFFF) >> 5] |= np.uint32(1 << (x & 31))
    assert L.in_runs(sh, bits, 9).tolist() == [*range(3, 12), *range(30, 39)] and not len(L.in_runs(sh[:0], bits, 9))


def test_bitmap(spark):
    df = spark.createDataFrame([(x,) for x in (-1, 5, -(1 << 62), 5, 31, 32, 63)], "shingle long")
    got = L.bitmap(df, 7)
    assert {w * 32 + b for w in np.flatnonzero(got) for b in range(32) if got[w] >> b & 1} == {x & 0xFFFF for x in (-1, 5, -(1 << 62), 31, 32, 63)}


def test_attachments_that_do_not_call_themselves_text(spark):
    passage = " ".join(VOCAB[k % 12] + str(k) for k in range(30))
    body = "Content-Type: multipart/mixed; boundary=b\n\n--b\n\nhello\n--b\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(passage.encode()).decode() + "\n--b--\n"
    assert run(spark, [(1, body), (2, body.replace("base64", "x-none"))], [(7, passage, "en")]) == {(1, 7)}
