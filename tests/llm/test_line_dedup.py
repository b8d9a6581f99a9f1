import random

import pytest
from pyspark.sql import functions as F

from cueloom.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute(rows):
    """Kept texts, by comparing all pairs of different lines."""
    first = {}
    places = sorted((i, k, x) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")))
    for i, k, x in places:
        if len(x) >= ld.MIN_CHARS:
            first.setdefault(x, (i, k))
    lines = sorted(first, key=first.get)
    near = {b for n, b in enumerate(lines) for a in lines[:n] if abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1}
    out = []
    for i, t in rows:
        if i is not None and t is not None:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if x not in first or (x not in near and first[x] == (i, k)))
        out.append((i, t))
    return sorted(out, key=str)


def edited(rng, line):
    k = rng.randrange(len(line))
    return rng.choice([line[:k] + line[k + 1:], line[:k] + rng.choice("abcé") + line[k:], line[:k] + rng.choice("abcé") + line[k + 1:]])


def corpus(seed, edits=(0, 0, 1, 1, 2)):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (18, 20, 21, 22, 35, 60)]
    rows = []
    for i in range(25):
        lines = []
        for _ in range(rng.randrange(7)):
            line = rng.choice(base)
            for _ in range(rng.choice(edits)):
                line = edited(rng, line)
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    rng.shuffle(rows)
    return rows


def shown(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_texts_as_all_pairs(documents, seed):
    rows = corpus(seed)
    assert shown(ld.dedup_lines(documents(rows))) == brute(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_keys_with_many_lines_are_cut_again(documents, monkeypatch, seed):
    monkeypatch.setattr(ld, "PAIRS", 2)
    rows = corpus(seed, edits=(1, 1, 2))
    assert shown(ld.dedup_lines(documents(rows))) == brute(rows)


def test_bit_parallel_check(spark):
    rng = random.Random(0)
    pairs = [("", ""), ("", "a"), ("a", ""), ("a", "b"), ("ab", "ba"), ("a", "abc")]
    for _ in range(400):
        a = "".join(rng.choice("abé🙂") for _ in range(rng.randrange(1, 12)))
        b = a
        for _ in range(rng.randrange(4)):
            b = edited(rng, b) if b else b
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "s string, t string")
    for r in df.select("s", "t", ld.within_one_edit(F.col("s"), F.col("t")).alias("near"), ld._one_part_differs(F.col("s"), F.col("t")).alias("may")).collect():
        near = distance(r["s"], r["t"]) <= 1
        assert r["near"] == near and (r["may"] or not near), r


def test_odd_rows(documents, odd):
    line = "a line that stands in many documents"
    rows = odd + [(1, f"own\n{line}"), (2, f"{line}\n{line}!\nshort\nshort"), (3, line), (3, line), (3, "other"), (None, line)]
    out = ld.dedup_lines(documents(rows))
    assert out.columns == documents(rows).columns and out.dtypes == documents(rows).dtypes
    assert shown(out) == brute(rows)
    report = {r["doc_id"]: r for r in ld.dedup_lines(documents(rows), report=True).collect()}
    assert (report[2]["n_lines"], report[2]["n_removed"], report[2]["text"]) == (4, 2, "short\nshort")
    assert report[9001]["n_lines"] == 0 and report[9001]["text"] is None


def test_empty_table(documents):
    assert ld.dedup_lines(documents([])).collect() == []
