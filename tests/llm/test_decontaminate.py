import random
import re

import pytest

from cueloom.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            if d is None or i is None:
                continue
            a, b = words(text), words(item)
            size = min(dc.WINDOW, len(b))
            hits = [
                (p, min(sum(x != y for x, y in zip(a[p:p + size], b[q:q + size])) for q in range(len(b) - size + 1)))
                for p in range(len(a) - size + 1) if size
            ]
            hits = [h for h in hits if h[1] <= (dc.SUBSTITUTIONS if size == dc.WINDOW else 0)]
            if hits:
                out[d, i] = (len(hits), min(p for p, _ in hits), min(m for _, m in hits))
    return sorted((*k, *v) for k, v in out.items())


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 11, 12, 13, 30])))) for i in range(12)]
    docs = []
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 200]))]
        if d % 2:
            part = words(rng.choice(items)[1])
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(text))
            text[at:at] = part
        docs.append((d, " ".join(text)))
    return docs, items


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_leaks_as_all_windows(spark, documents, seed):
    docs, items = planted(seed)
    got = sorted(tuple(r) for r in dc.leaks(documents(docs), items_table(spark, items)).collect())
    assert got == brute(docs, items) and got


def test_every_pattern_of_substitutions_is_seen():
    for a in range(dc.WINDOW):
        for b in range(dc.WINDOW):
            assert any({a % dc.CLASSES, b % dc.CLASSES}.isdisjoint(m) for m in dc.MASKS)


def test_short_items_leak_whole(spark, documents):
    items = items_table(spark, [(1, "one two three"), (2, "Yes"), (3, " ".join(f"k{i}" for i in range(12))), (4, " ")])
    docs = documents([(1, "zero ONE two three four"), (2, "one two x three"), (3, "yes"), (4, "k0 k1 k2"), (5, "two three"), (6, "")])
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["mismatches"]) for r in dc.leaks(docs, items).collect()}
    assert got == {(1, 1, 1, 0), (3, 2, 0, 0)}
    assert sorted(r["doc_id"] for r in dc.drop_leaking(docs, items).collect()) == [2, 4, 5, 6]


def test_odd_rows(spark, documents, odd):
    item = " ".join(f"k{i}" for i in range(20))
    items = items_table(spark, [(1, item), (None, item), (2, None), (3, ""), (4, "too short"), (1, item)])
    docs = documents(odd + [(1, f"before {item.upper()} after"), (2, "clean words only"), (None, item), (3, item), (3, "clean")])
    got = {(r["doc_id"], r["item_id"], r["mismatches"]) for r in dc.leaks(docs, items).collect()}
    assert got == {(1, 1, 0), (3, 1, 0)}
    kept = dc.drop_leaking(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in odd + [(2, ""), (None, "")])


def test_capitals_do_not_hide_a_leak(spark, documents):
    item = "été là où ça coûte ñandú über straße œuvre naïve über été là où"
    got = dc.leaks(documents([(1, item.upper().replace("SS", "ß")), (2, "× " * 20)]), items_table(spark, [(1, item), (2, "÷ " * 20)]))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1)}


def test_empty_tables(spark, documents, odd):
    assert dc.leaks(documents([]), items_table(spark, [(1, "a " * 20)])).collect() == []
    assert dc.drop_leaking(documents(odd), items_table(spark, [])).count() == len(odd)
