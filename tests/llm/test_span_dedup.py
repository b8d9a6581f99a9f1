import random
import re

import pytest

from cueloom.llm import span_dedup as sp


def pieces(text):
    """(words, first byte, end byte) of sentence pieces, plainly."""
    raw = text.encode()
    out, at, new = [], 0, True
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw):
        if at and re.search(rb"[\x0a-\x0d]", raw[at:m.start()]):
            new = True
        if new or len(out[-1][0]) == sp.PIECE:
            out.append(([], m.start(), 0))
        lowered = re.sub(rb"[A-Z]", lambda x: x[0].lower(), m[0])
        out[-1] = (out[-1][0] + [lowered], out[-1][1], m.end())
        new, at = m[0][-1:] in b".!?", m.end()
    return out


def brute(rows):
    """Kept texts and the ranges of pieces taken out."""
    first, cut = {}, {}
    docs = sorted((i, t) for i, t in rows if i is not None and t is not None)
    for i, t in docs:
        p = pieces(t)
        for a in range(len(p)):
            n = sp.RUN
            while a + n <= len(p) and sum(len(x[0]) for x in p[a:a + n]) < sp.MIN_WORDS:
                n += 1
            if a == 0 and n > len(p):
                n = len(p)  # a text too short for a run is one
            run = tuple(tuple(x[0]) for x in p[a:a + n])
            if a + n <= len(p) and first.setdefault(run, (i, a)) != (i, a):
                cut.setdefault((i, t), set()).update(range(a, a + n))
    out = []
    for i, t in rows:
        gone = cut.get((i, t), set())
        p = pieces(t) if gone else []
        raw, keep, at = (t or "").encode(), [], 0
        for k, (_, begin, _) in enumerate(p):
            if k in gone and k - 1 not in gone:
                keep.append(raw[at:begin])
            if k not in gone and k - 1 in gone:
                at = begin
        if gone and len(p) - 1 in gone:
            at = len(raw)
        keep.append(raw[at:])
        out.append((i, t if not gone else b"".join(keep).decode(), len(gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["été", "haus", "one", "two", "three", "four", "five", "six", "Seven", "eight", "nine"]

    def sentence():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 9, 30]))) + rng.choice([".", "!", "?", ".\n", "\n"])

    passage = [sentence() for _ in range(6)]
    rows = []
    for i in range(40):
        body = [sentence() for _ in range(rng.randrange(8))]
        if rng.random() < 0.6:
            a = rng.randrange(3)
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[a:a + rng.choice([2, 3, 4])]
        rows.append((i, " ".join(body)))
    rng.shuffle(rows)
    return rows


def shown(df):
    return sorted(((r["doc_id"], r["text"], sum(s["last"] - s["first"] + 1 for s in r["removed_spans"] or [])) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_same_texts_as_plain_search(documents, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert any(n for _, _, n in want)
    assert shown(sp.dedup_spans(documents(rows))) == sorted(want, key=str)


def test_odd_rows(documents, odd):
    passage = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen fifteen."
    rows = odd + [(1, passage), (2, f"Own start. {passage} Own end."), (3, passage), (3, "Other text."), (None, passage), (3, passage)]
    out = sp.dedup_spans(documents(rows))
    assert out.columns == [*documents(rows).columns, "removed_spans"]
    texts = {}
    for r in out.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert texts[1] == [passage] and sorted(texts[3]) == ["", "", "Other text."] and passage in texts[None]
    assert texts[2] == ["Own start. Own end."] and texts[9003] == [" \n\t \n"] and texts[9001] == [None]


def test_shouted_passages(documents):
    passage = " ".join(f"WORD{i}!!" for i in range(60))
    rows = [(1, f"Own words here. {passage} More of them."), (2, f"Other start here. {passage} Other end here."), (3, "Of. " * 5)]
    got = {r["doc_id"]: r["text"] for r in sp.dedup_spans(documents(rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "Other start here. Other end here." and got[3] == rows[2][1]


def test_copies_of_short_texts(documents):
    rows = [(1, "Haanth."), (2, "HAANTH."), (3, "Haanth. Too."), (4, "yes\nno"), (5, "Yes\n no"), (6, "yes no"), (7, "A. B. C. D."), (8, "a. b. c. d."),
            (9, "Before it. Haanth. And a good deal more of it after that, so that there are runs.")]
    got = {r["doc_id"]: r["text"] for r in sp.dedup_spans(documents(rows)).collect()}
    assert {i: t for i, t in got.items() if t != dict(rows)[i]} == {2: "", 5: "", 8: ""}


def test_empty_table(documents):
    assert sp.dedup_spans(documents([])).collect() == []
