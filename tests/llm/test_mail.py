import base64
import quopri

from gridwright.llm import mail as M

MULTI = """Subject: x
Content-Type: multipart/mixed; boundary="=_a"

preamble
--=_a
Content-Type: multipart/alternative;
 boundary=bb

--bb
Content-Type: text/plain; charset=utf-8

Own text.
--bb
Content-Type: text/html

<p>Some <b>bo</b>ld &amp; more<br>next</p><script>x()</script>
--bb--
--=_a
Content-Type: text/plain; name="n.txt"
Content-Transfer-Encoding: base64

{b64}
--=_a
Content-Type: application/octet-stream
Content-Transfer-Encoding: base64

AAAA
"""


def test_parts_and_encodings():
    text = MULTI.format(b64=base64.encodebytes("Grüße".encode()).decode().strip())
    got = [(p.kind, M.decoded(text, p).strip()) for p in M.parts(text)]
    assert got[0] == ("text/plain", "Own text.") and got[2] == ("text/plain", "Grüße") and got[3] == ("application/octet-stream", "")
    assert M.plain(got[1][1]).split() == ["Some", "bold", "&", "more", "next"]
    assert any("preamble" in t for t in M.texts(text))
    qp = "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring("Grüße an alle = x".encode()).decode()
    assert M.decoded(qp, M.parts(qp)[0]).strip() == "Grüße an alle = x"


def test_broken_mails():
    for text in ("", "\n", "no header at all", "Content-Type: multipart/mixed; boundary=b\n\nnothing", "Content-Transfer-Encoding: base64\n\n!!!", "Content-Type: multipart/mixed; boundary=b\n\n--b", "A: b\r\n\r\nbody\r\nline"):
        M.parts(text), list(M.texts(text)), M.prose(text)
    deep = "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(60))
    assert isinstance(M.parts(deep), list)
    deep += "\nOwn words at the bottom.\n" + "".join(f"--b{i}--\n" for i in reversed(range(60)))
    assert [t.strip() for t in map(lambda p: M.decoded(deep, p), M.parts(deep))] == ["Own words at the bottom."] and [[deep[a:b] for a, b in p] for p in M.prose(deep)] == [["Own words at the bottom."]]
    very = "".join(f"Content-Type: multipart/mixed; boundary=c{i}x\n\n--c{i}x\n" for i in range(3000)) + "\nstill read"
    assert M.decoded(very, M.parts(very)[0]).strip() == "still read"


def test_prose_zones():
    text = "A: b\n\nHi,\n\nOne two.\nThree.\n\nOn 1.2.2024 10:00, X Y wrote:\n> quoted\n >more\nAfter: text\n\n-- \nName\nDept\n\nDisclaimer.\n-----Original Message-----\nFrom: z\n\nOld."
    assert [[text[a:b] for a, b in p] for p in M.prose(text)] == [["Hi,"], ["One two.", "Three."], ["After: text"], ["Disclaimer."]]
    assert M.prose("Content-Transfer-Encoding: base64\n\nQUJD") == [] and M.prose("Content-Type: text/html\n\n<p>x</p>") == []
