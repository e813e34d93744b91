"""Line chunks, near-duplicate texts and personal data against brute force."""

import collections
import hashlib
import random
import re

import pytest

from keeprank.llm import forest as fo
from keeprank.llm import line_chunks as lc
from keeprank.llm.disclosure import personal_data, sanitise

DOCS = "doc_id long, text string, lang string, id string, n int, row string, key int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1, "r", 2) for i, t in texts], DOCS)


# Line chunks

def naive_chunks(lines):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    w = [x.count(" ") + 1 for x in lines]
    out, first = [], 0
    for i in range(len(lines)):
        rolled = (h[i - 1] if i else 0) * 1_000_003 + h[i]
        if i == len(lines) - 1 or rolled % 3 == 0 or w[i] >= 50 or w[i + 1] >= 50:
            out.append((first, i + 1, sum(w[first:i + 1])))
            first = i + 1
    return out


def naive_lines(texts):
    seen, pairs, out = set(), set(), {}
    for doc, text in sorted({(d, t) for d, t in texts}, key=lambda x: (x[0] is not None, x[0] or 0)):
        if text is None:
            out[doc, text] = None
            continue
        lines, gone = text.split("\n"), set()
        for a, b, words in naive_chunks(lines):
            body = "\n".join(lines[a:b])
            if words >= 20 and (b - a >= 2 or words >= 50) and body in seen:
                gone.update(range(a, b))
            seen.add(body)
        run = [0]
        for i in range(1, len(lines) + 1):
            pair = tuple(lines[i - 1:i + 1])
            if i < len(lines) and pair in pairs:
                run.append(i)
                continue
            if len(run) > 1 and sum(lines[j].count(" ") + 1 for j in run) >= 50:
                gone.update(run)
            pairs.add(pair)
            run = [i]
        out[doc, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def line_texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = lambda n: " ".join(word() for _ in range(n))
    passages = [[line(12) for _ in range(8)] for _ in range(5)] + [[line(60)]]
    texts = []
    for i in range(60):
        lines = [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 8))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = p
        texts.append((i, "\n".join(lines)))
    texts += [(100 + i, texts[3][1]) for i in range(30)]
    return texts + [(200, None), (201, ""), (202, "\n\n\n"), (None, texts[5][1]), (5, texts[5][1]), (203, "short line\n" * 400),
                    (204, "a b " * 20_000), (205, "a b " * 20_000)]


def test_line_chunks(spark):
    texts = line_texts(random.Random(4))
    docs = docs_of(spark, texts)
    want = naive_lines(texts)
    got = lc.drop_repeated_chunks(docs, drop_emptied=False, counts=True)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(((d, want[d, t]) for d, t in texts), key=str)
    emptied = {(d, t) for d, t in texts if t and want[d, t] == "" and t.strip()}
    rest = lc.drop_repeated_chunks(docs)
    assert rest.columns == docs.columns and emptied
    assert rest.count() == len(texts) - sum((d, t) in emptied for d, t in texts)
    assert lc.drop_repeated_chunks(docs.limit(0)).count() == 0


def test_whole_passages_go_whatever_surrounds_them(spark):
    rng = random.Random(12)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts, planted = [], {}
    for shape, (count, words) in enumerate([(4, 15), (5, 12), (8, 12), (12, 10), (2, 30)]):
        for trial in range(30):
            passage = [line(words) for _ in range(count)]
            for copy in range(2):
                around = [[line(rng.randint(1, 14)) for _ in range(rng.randint(0, 5))] for _ in range(2)]
                doc = 1_000 * shape + 10 * trial + copy
                texts.append((doc, "\n".join(around[0] + passage + around[1])))
                planted[doc] = (copy, passage, around[0] + around[1])
    short = ["same short line", line(20), line(20)]  # under 50 words in two documents
    texts += [(90_000 + i, "\n".join([line(9), *short[:2], line(9)])) for i in range(2)]
    got = {r["doc_id"]: r["text"].split("\n") for r in lc.drop_repeated_chunks(docs_of(spark, texts), drop_emptied=False).collect()}
    for doc, (copy, passage, around) in planted.items():
        left = got[doc] if got[doc] != [""] else []
        assert left == (around if copy else dict(texts)[doc].split("\n"))
    assert len(got[90_000]) == 4


def test_a_document_with_very_many_repeated_lines(spark):
    lines = [f"line {i} of a long log" for i in range(30_000)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(x for i, x in enumerate(lines) for x in ([x] if i % 20 else [x, f"own {i}"])))]
    got = {r["doc_id"]: r["text"] for r in lc.drop_repeated_chunks(docs_of(spark, texts)).collect()}
    # the first line stands alone between the edge and a line of its own
    assert got[1] == texts[0][1] and got[2].split("\n") == [lines[0], *(f"own {i}" for i in range(0, 30_000, 20))]


def test_an_inserted_line_moves_few_boundaries():
    rng = random.Random(9)
    lines = [" ".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(200)]
    bodies = lambda x: {"\n".join(x[a:b]) for a, b, _ in naive_chunks(x)}
    assert len(bodies(lines) - bodies(lines[:50] + ["new line"] + lines[50:])) <= 3


# Near-duplicate texts

def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def naive_near(texts):
    n = len(texts)
    sets = [shingles(t) for _, t in texts]
    near = [[j for j in range(n) if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    out = []
    for i, (doc, _) in enumerate(texts):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = lambda rows, own: min((texts[j][0] for j in rows if texts[j][0] is not None), default=own)
        same = [j for j in range(n) if sets[j] == sets[i] and sets[i]] or [i]
        head = least(seen, doc)
        out.append((doc, least(same, doc), len(near[i]), head, doc == head))
    return sorted(out, key=str)


def near_texts(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for size in (40, 1, 3, 12, 25, 2):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(80)) for _ in range(40)] + texts[:6] + [texts[0].upper()]
    texts += ["a b c", "A  b\nc", "a b", "", None, " \n ", "x " * 3, "y " * 20_000, "y " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, texts[0]), (3, texts[3]), (None, "nothing else says this here")]


@pytest.mark.parametrize("block", [4, 1000])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(fo, "BLOCK_ROWS", block)
    texts = near_texts(random.Random(6))
    got = sorted(map(tuple, fo.near_duplicates(docs_of(spark, texts)).collect()), key=str)
    assert got == naive_near(texts)


def test_one_per_group(spark):
    texts = near_texts(random.Random(8))
    docs = docs_of(spark, texts)
    rest = fo.one_per_group(docs)
    assert rest.columns == docs.columns
    kept = {r[0] for r in naive_near(texts) if r[4]} | {None}
    assert {r["doc_id"] for r in rest.collect()} == kept
    assert fo.one_per_group(docs.limit(0)).count() == 0


def test_prefix_depth_reaches_the_target():
    for target in (0.9, 0.999, 0.99999):
        d = fo.prefix_depth(0.8, 40, 10, target)
        assert 1 - (1 - 0.8 ** d) ** 40 >= target > (1 - (1 - 0.8 ** (d + 1)) ** 40 if d < 10 else 0)


# Personal data

# The patterns that define the kinds.
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn_holds(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def naive_spans(text):
    out, n = [], collections.Counter()
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "phone" and 9 <= len(number) <= 15
                    or kind == "card" and 12 <= len(number) <= 19 and luhn_holds(number)):
                out.append((m.start(), rank, m.end()))
                n[kind] += 1
    spans = ",".join(f"{PATTERNS[r][0]}:{a}:{b}" for a, r, b in sorted(out))
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(spans.encode()).hexdigest(), spans


def test_patterns(spark):
    rng = random.Random(1)
    parts = ["a", "b.", "@", ".", "_", "-", "+", "1", "23", "456", " ", "(", ")", "é", "😀", "x@y.z", "1.2.3.4", "+1 (212) 555-0100",
             "4111 1111 1111 1111", "\n", "_d@e.f", "000", "255", "!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [None, "", "1" * 20_000, "a" * 20_000 + "@b.c", "1." * 5000, "+1" + " " * 5000, "0001.2.3.000255 0256.1.1.1"]
    rows = personal_data(docs_of(spark, list(enumerate(texts))), min_texts=10 ** 9).collect()
    assert all(tuple(r[k] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")) == naive_spans(texts[r["doc_id"]]) for r in rows)
    assert len(rows) == len(texts)


def disclosing(rng):
    filler = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n))
    texts = [(i, f"{filler(30)} the zorblax chief writes from boss@corp.example today {filler(30)}") for i in range(6)]
    texts += [(10 + i, f"{filler(20)} the chief of today {filler(20)} other{i}@mail.example said") for i in range(10)]
    texts += [(30 + i, f"{filler(20)} the chief writes from here today {filler(20)}") for i in range(20)]
    return texts + [(60, f"zorblax {filler(30)}"), (61, None), (62, "")] + [(70 + i, "uniqueword near copy@copy.example end") for i in range(9)]


def test_terms_that_disclose_an_entity(spark):
    texts = disclosing(random.Random(2))
    docs = docs_of(spark, texts)
    rows = {r["doc_id"]: r for r in personal_data(docs).collect()}
    by_id = dict(texts)
    for i in range(6):
        words = {by_id[i][int(a):int(b)] for k, a, b in (s.split(":") for s in rows[i]["spans"].split(",")) if k == "term"}
        assert words == {"zorblax"}, words
    # Clean documents, documents of other entities and copies of one text are left alone.
    assert all(r["n_term"] == 0 for i, r in rows.items() if i >= 6)
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs).collect()}
    assert all("zorblax" not in clean[i] and "boss@corp" not in clean[i] and "[EMAIL]" in clean[i] and "chief writes" in clean[i] for i in range(6))
    assert all(clean[i] == by_id[i] for i in (*range(30, 50), 60, 61, 62)) and len(clean) == len(texts)
    assert sanitise(docs).columns == docs.columns
    assert sanitise(docs.limit(0)).count() == 0 and personal_data(docs.limit(0)).count() == 0


def test_overlapping_spans_are_masked_once(spark):
    texts = [(1, "now or 1.2.3.4@h.co, 10.0.0.1."), (2, "x@y.z"), (3, "end +12 345 678 901")]
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs_of(spark, texts)).collect()}
    assert not any(c.isdigit() for c in "".join(clean.values())) and clean[2] == "[EMAIL]" and clean[3].startswith("end [")


def test_disclosing_terms_far_from_their_entity(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(n))
    texts = [(i, f"Zorblax {filler(60)} boss@corp.example {filler(60)} ZORBLAX, {filler(5)} zorblax") for i in range(6)]
    texts += [(10 + i, filler(60)) for i in range(60)]
    rows = {r["doc_id"]: r for r in personal_data(docs_of(spark, texts)).collect()}
    for i, t in texts:
        found = [t[int(a):int(b)] for k, a, b in (s.split(":") for s in rows[i]["spans"].split(",") if s) if k == "term"]
        assert found == (["Zorblax", "ZORBLAX", "zorblax"] if i < 6 else [])
    clean = {r["doc_id"]: r["text"] for r in sanitise(docs_of(spark, texts)).collect()}
    assert not any("zorblax" in t.lower() for t in clean.values())


def test_terms_of_rare_entities(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    text = lambda *own: " ".join([*(word() for _ in range(12)), *own, *(word() for _ in range(12))])
    # One entity in two texts; and two entities of one domain, each in one text. Copies of one text prove nothing.
    texts = [(i, text("quibblor", "rare@one.example")) for i in range(2)] + [(2 + i, text("vextral", f"u{i}@small.example")) for i in range(2)]
    texts += [(10 + i, "somebody here copy@copy.example") for i in range(3)] + [(20 + i, text("everyday")) for i in range(2000)]
    rows = {r["doc_id"]: r for r in personal_data(docs_of(spark, texts)).collect()}
    for i, t in texts:
        found = {t[int(a):int(b)] for k, a, b in (s.split(":") for s in rows[i]["spans"].split(",") if s) if k == "term"}
        assert found == ({"quibblor"} if i < 2 else {"vextral"} if i < 4 else set()), (i, found)
