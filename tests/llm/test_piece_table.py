"""Fill-in-the-middle against a plain string version."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from keeprank.llm import piece_table as pt

SCHEMA = "doc_id long, text string, output string, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def naive(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    if doc_id is None:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(spark):
    texts = ["", None, "a", "one two, three.", "<P>", "x<S>y", "<<P", "ends with <", "ñandú 💡 ab\ncd\r\n", "A" * 5000, "é1 " * 4000]
    rows = [(i, texts[i % len(texts)]) for i in range(400)] + [(None, "no id"), (7, "again"), (7, "again")]
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    got = sorted(map(tuple, pt.fill_in_middle(frame).collect()), key=str)
    assert got == sorted((naive(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert pt.fill_in_middle(frame.limit(0)).count() == 0
    for r in pt.fill_in_middle(frame, with_text=True).collect():
        assert sha(r["output"]) == r["output_sha256"]


def test_long_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_CHARS", 7)
    for i in range(300):
        text = ("Word wörd 12.5\n" * (i % 9))[:i]
        table, form, n, prefix, middle = pt.transform(i, text)
        assert (i, n, form, prefix, middle, table.sha256(), pt.restore(table.text(), form).sha256()) == naive(i, text)


@given(st.text(alphabet="<>PSMab é", max_size=30), st.integers(0, 10_000))
def test_round_trip(text, doc_id):
    table, form, *_ = pt.transform(doc_id, text)
    assert pt.restore(table.text(), form).text() == text


@pytest.mark.parametrize("form", sorted(pt.ARRANGEMENTS))
def test_inverse(form):
    order = pt.ARRANGEMENTS[form]
    assert [order[i] for i in pt.inverse(order)] == sorted(order)


def test_cut_and_arrange_move_descriptors_only():
    table = pt.PieceTable.of("abcdef").cut([2, 2, 6]).append_buffer(("x", "yz"))
    assert [p.length for p in table.pieces] == [2, 0, 4, 0, 1, 2] and table.text() == "abcdefxyz"
    moved = table.arrange([5, 2, 4, 0])
    assert moved.text() == "yzcdefxab" and moved.buffers is table.buffers
