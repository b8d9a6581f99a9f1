import random

from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import line_dedup, minhash, toxicity


def planted(tmp_path, documents, spark):
    """A small corpus with one case of each kind among clean documents."""
    rng = random.Random(8)
    vocabulary = [f"term{i}" for i in range(900)]
    clean = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = clean(30)
    rows = [(i, f"{clean(60)}\n{clean(40)}") for i in range(300)]
    for i in range(0, 120, 2):
        rows[i] = (i, rows[i][1].replace("term1", "scum") + " idiot scum moron")
    rows[201] = (201, f"{clean(200)}\n{clean(40)}")
    near = rows[201][1].split(" ")
    # A word of each line, so that line dedup leaves both lines.
    near[10], near[215] = "other", "another"
    rows += [(1000, " ".join(near)), (1001, rows[203][1]), (1002, f"{clean(20)} {item} {clean(20)}"), (1003, ""), (1004, None), (None, clean(9))]
    line = "the same long line in two documents"
    rows += [(1005, f"{clean(50)}\n{line}"), (1006, f"{line}\n{clean(50)}")]
    docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i < 120 and i % 2 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows


def test_stages_take_out_what_was_planted(spark, documents, tmp_path):
    planted(tmp_path, documents, spark)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        path = str(tmp_path / f"after_{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    gone = [set(a) - set(b) for a, b in zip(seen, seen[1:])]
    assert gone[0] == {i for i in range(0, 120, 2)}
    # Lines of the exact copy go, so nothing of it is left.
    assert gone[1] == {1001} and gone[2] == {1000} - gone[1] and gone[3] == {1002}
    assert seen[2][1006].count("same long line") == 0 and "same long line" in seen[2][1005]
    assert {None, 1003, 1004} <= set(seen[-1])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(seen[-1])


def test_run_is_the_stages_in_order(spark, documents, tmp_path):
    planted(tmp_path, documents, spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert ids.isdisjoint({0, 118, 1000, 1001, 1002}) and {1, 201, 203, 299} <= ids
    assert all(len(r["ids"]) == r["length"] for r in out.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    assert minhash and line_dedup and toxicity


def test_empty_tables(spark, documents, tmp_path):
    documents([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_takes_four_fifths(spark, documents, tmp_path):
    words = [f"word{i}" for i in range(54)]
    other = words[:27] + ["new"] + words[28:]
    # 45 of 55 shingles in common; the third text has 40 of 60.
    third = other[:10] + ["newer"] + other[11:]
    docs = documents([(1, " ".join(words)), (2, " ".join(other)), (4, " ".join(f"w{i}" for i in range(54)))])
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} == {1, 4}
    far = documents([(1, " ".join(words)), (3, " ".join(third))])
    assert {r["doc_id"] for r in stage(spark, far, str(tmp_path)).collect()} == {1, 3}


def test_no_short_lines_of_copies_are_left(spark, documents, tmp_path):
    long = ["a first line that is long enough", "quite another line, as long as that"]
    docs = documents([
        (1, f"{long[0]}\nHaanth.\n{long[1]}"), (2, f"{long[0]}\nHaanth.\n{long[1]}"), (3, f"{long[0]}!\nHaanth."),
        (4, f"{long[1]}\nHaanth.\nonly here"), (5, "Haanth.\nnothing long"), (6, f"{long[0]}\nHaanth.\nthis line is in no other document"),
        (7, f"{long[1]}\ntwice\ntwice"),
    ])
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    assert {r["doc_id"]: r["text"] for r in stage(spark, docs, str(tmp_path)).collect()} == {
        1: f"{long[0]}\nHaanth.\n{long[1]}", 4: "only here", 5: "Haanth.\nnothing long",
        6: "Haanth.\nthis line is in no other document", 7: "twice",
    }


def test_only_documents_that_lost_a_line_go(spark, documents, tmp_path):
    text = "a first paragraph that is long enough\n\nand a second one, as long as that\n\t\nthe third of these paragraphs"
    docs = documents([(1, text), (2, text), (3, text), (4, None), (5, " \n "), (6, "")])
    n_chars = F.when(F.col("doc_id") == 3, F.lit(None)).otherwise(F.lit(7)).cast("long")
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    got = {r["doc_id"]: r["text"] for r in stage(spark, docs.withColumn("n_chars", n_chars), str(tmp_path)).collect()}
    assert got == {1: text, 4: None, 5: " \n ", 6: ""}
