"""The transducer against a sorted list, and the audit against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cueloom.llm import divergence as dv
from cueloom.llm.transducer import Transducer


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=20))
def test_ordinals(terms, others):
    ordered = sorted(terms)
    machine = Transducer.load(Transducer.build(ordered).dump())
    assert [machine.ordinal(t) for t in ordered] == list(range(len(ordered)))
    assert all(machine.ordinal(o) == -1 for o in others if o not in terms)


def right_languages(terms):
    """States of the minimal automaton: the different sets of endings that prefixes can have."""
    prefixes = {t[:i] for t in terms for i in range(len(t) + 1)}
    return {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for p in prefixes}


@settings(max_examples=40, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5), min_size=1, max_size=40))
def test_minimal(terms):
    assert Transducer.build(sorted(terms)).n_states == len(right_languages(terms))


def test_order_is_required():
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    with pytest.raises(ValueError):
        Transducer.build([b"a", b"a"])


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9 * 10**15, 2000)
    counts = (rng.random(2000) * total).astype(np.int64) - 1
    want = [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, total)]
    assert dv.shares(counts, total).tolist() == want


def test_terms_of_texts():
    texts = ["Über Straße x-ray", "", " ,, ", "x " + "z" * 900, "end", "ray"]
    document, code, terms = dv._terms([t.encode().translate(dv._LETTERS) for t in texts])
    got = [(d, terms[c].as_py().decode()) for d, c in zip(document.tolist(), code.tolist())]
    want = [(0, "Über"), (0, "straße"), (0, "x"), (0, "ray"), (3, "x"), (3, "z" * 900), (4, "end"), (5, "ray")]
    assert got == want and len(terms) == len({w for _, w in want})
    assert [len(x) for x in dv._terms([b"", b" "])] == [0, 0, 0]


PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, min_docs=3, top=200):
    docs = defaultdict(Counter)
    uses = defaultdict(Counter)
    for text, lang, source in rows:
        words = PATTERN.findall((text or "").translate(LOWER))
        docs[lang or ""].update(set(words))
        uses[lang or "", source or ""].update(words)
    out = []
    for (lang, source), used in uses.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)

        def share(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p = share(used)
        others = {s: u for (x, s), u in uses.items() if x == lang and s != source}
        pairs = []
        for other, u in others.items():
            q = share(u)
            pairs.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        q = share(sum((u for (x, _), u in uses.items() if x == lang), Counter()))
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if used[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


CLASH = ("term", "n", "part", "ordinal", "item", "value", "rank", "block", "v", "start")


def table(spark, rows):
    full = [(*r, *["x"] * len(CLASH)) for r in rows]
    return spark.createDataFrame(full, "text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    ("the cat sat on the mat", "en", "a"), ("The CAT! the dog; the_end", "en", "a"), ("the cat and the dog", "en", "b"),
    ("a dog, a cat, THE", "en", "b"), ("the the the", "en", "c"), ("nothing shared here", "en", "d"), ("", "en", "e"),
    (None, "en", None), ("der Äpfel Äpfel", "de", "a"), ("Äpfel äpfel", "de", "b"), ("die Äpfel äpfel", "de", "a"),
    ("äpfel x", "de", "c"), ("äpfel\x00x\x7fx", "de", "c"), ("only one", "fr", "a"), (None, None, None), ("lone", "it", "z"),
    ("y" * 60_000, "en", "a"), ("y" * 60_000, "en", "b"), ("y" * 60_000, "en", "c"), ("日本語 \U0001f600 ￿", "ja", "k"),
    ("日本語 \U0001f600 ￿", "ja", "k"), ("日本語 \U0001f600 ￿", "ja", "l"), ("日本語 kana", "ja", "m"),
]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    """Also with a transducer for every few terms, blocks of two ordinals, slices of a few texts and copies of transducers."""
    if small:
        for name, value in (("RANGE_BYTES", 8), ("BLOCK_TERMS", 2), ("SLICE_BYTES", 50), ("RANGE_ROWS", 3)):
            monkeypatch.setattr(dv, name, value)
    assert got(dv.audit(table(spark, ROWS).repartition(4))) == plain(ROWS)


def test_repeated_rows_and_few_terms(spark):
    rows = ROWS * 3
    assert got(dv.audit(table(spark, rows), top=2)) == plain(rows, top=2)


def test_empty(spark):
    assert got(dv.audit(table(spark, []))) == []
