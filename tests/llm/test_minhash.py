import random
import re

import pytest

from cueloom.llm import components, minhash


def shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute(rows, percent=85):
    """Component and set size of each row with an id, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets)


def corpus(seed, n_groups, copies, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            rows.append((number, " ".join(text)))
            number += 1
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(tuple(r) for r in df.collect() if r["doc_id"] is not None)


@pytest.mark.parametrize("groups,copies", [(12, 12), (2, 60)])
def test_same_components_as_all_pairs(documents, groups, copies):
    rows = corpus(groups, groups, copies)
    assert result(minhash.near_duplicates(documents(rows))) == brute(rows)


def test_many_blocks_find_the_same(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_WEIGHT", 1000)
    rows = corpus(5, 2, 50)
    assert result(minhash.near_duplicates(documents(rows))) == brute(rows)


def test_odd_rows(documents, odd):
    rows = odd + [(1, "a b c d e f"), (2, "A B  c d\te f"), (3, "a b c"), (4, "a b c"), (5, "c b a")]
    got = minhash.near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    known = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert known[2]["component_id"] == 1 and not known[2]["kept"] and known[4]["component_id"] == 3
    assert known[5]["kept"] and known[5]["n_shingles"] == 1
    assert all(known[i]["n_shingles"] == 0 and known[i]["kept"] for i in (9001, 9002, 9003))
    assert known[9004]["n_shingles"] == 1 and known[9005]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    kept = minhash.keep_one(documents(rows))
    assert kept.columns == documents(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {None, 9001, 9002, 9003, 9004, 9005, 1, 3, 5}


def test_rows_of_one_id_are_one_node(documents):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w")]
    assert {r["component_id"] for r in minhash.near_duplicates(documents(rows)).collect()} == {1}


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(300, 340)] + [(300, 7), (5, 5)]
    got = dict(components.components(spark.createDataFrame(chain + star, "u long, v long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in (7, *range(300, 340))) and 5 not in got
