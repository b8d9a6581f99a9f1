"""Line deduplication across documents, tolerant of one edit, by segment-partition joins (operator 8, native).

Two lines within one edit share, exactly, one of the two halves the shorter one is cut into. Every line therefore
indexes its own halves and probes the halves of lines one character shorter; a key names the indexed length, which
half it is, and the half itself. Lines that share a key are candidates and are verified by a banded bit-parallel
automaton. Everything is DataFrame code.

* Copies of a line count once: a key matters only if two different lines have it (a minimum and a maximum per key).
* A key with many lines is cut again: its lines agree on one half, so the other half is halved in the same way, until
  groups are small. What is left when no more than ``LAST`` characters differ is joined on strings with one character
  left out, which is exact and linear, so no group's pairs are ever listed.
* Texts of candidate lines are fetched past a bit map of fixed size, so only about those lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze

#: Shorter lines (in characters) take no part and stay.
MIN_CHARS = 20
#: A character that is not white space.
INK = r"(?U)\S"
#: Keys with more lines than this are cut again instead of being paired.
PAIRS = 32
#: Free characters at which cutting ends.
LAST = 8
#: Parts of a line for the check before verification: one edit touches one part only.
PARTS = 8
#: Bits of the map that candidate lines are looked up in (1 MB; the map never grows).
MAP_BITS = 1 << 23


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, line, line_id)`` of every line that takes part."""
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .filter((F.length("line") >= MIN_CHARS) & F.col("doc_id").isNotNull())
        .withColumn("line_id", F.xxhash64("line"))
    )


def _halves(line: Column, start: Column, rest: Column, group: Column, end: Column) -> Column:
    """Keys of the two halves of the free part (``rest`` characters after ``start``), as index and as probe.

    Each is a struct: key, characters fixed in front and behind after the cut, free characters of the indexed line.
    """
    out = []
    for shorter in (0, 1):
        size = rest - shorter
        front = F.floor(size / 2).cast("int")
        back = (size - front).cast("int")
        out.append(F.struct(
            F.xxhash64(group, size, F.lit("front"), F.substring(line, start + 1, front)).alias("key"),
            (start + front).cast("int").alias("front"), end.cast("int").alias("back"), back.alias("free"),
        ))
        out.append(F.struct(
            F.xxhash64(group, size, F.lit("back"), F.substring(line, start + rest - back + 1, back)).alias("key"),
            start.cast("int").alias("front"), (end + back).cast("int").alias("back"), front.alias("free"),
        ))
    return F.explode(F.array(*out))


def _bit_of(line_id: Column) -> Column:
    return F.pmod(line_id, F.lit(MAP_BITS)) + 1


def _maybe_in(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose line_id may be in ``ids``; the broadcast side is MAP_BITS bits at most."""
    bits = ids.groupBy(F.bitmap_bucket_number(_bit_of(F.col("line_id"))).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(_bit_of(F.col("line_id")))).alias("bits")
    )
    at = F.bitmap_bit_position(_bit_of(F.col("line_id")))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        lines.withColumn("bucket", F.bitmap_bucket_number(_bit_of(F.col("line_id"))))
        .join(F.broadcast(bits), "bucket")
        .filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0)
        .drop("bucket", "bits")
    )


def _one_part_differs(s: Column, t: Column) -> Column:
    """Necessary for one edit: outside one of PARTS equal parts the two lines agree from both ends."""
    n = F.least(F.length(s), F.length(t))
    found = F.lit(False)
    for j in range(PARTS):
        front = F.floor(n * j / PARTS).cast("int")
        back = (n - F.floor(n * (j + 1) / PARTS)).cast("int")
        found = found | (
            (F.left(s, front) == F.left(t, front)) & ((back == 0) | (F.right(s, back) == F.right(t, back)))
        )
    return found


def within_one_edit(s: Column, t: Column) -> Column:
    """Banded bit-parallel check of edit distance at most one.

    A word holds, for no error and for one error, a band of three diagonals: bit ``d`` is set when the automaton has
    read ``j`` characters of ``t`` and ``j + d - 1`` of ``s``. One character of ``t`` moves both bands by shifts.
    """
    gap = F.length(s) - F.length(t)

    def mask(a: Column, c: Column, j: Column) -> Column:
        """Bits of the diagonals on which the next character of ``s`` is ``c``."""
        before = F.when(j > 0, F.get(a, j - 1) == c)
        hits = (before, F.get(a, j) == c, F.get(a, j + 1) == c)
        return sum((F.when(h, 1 << d).otherwise(0) for d, h in enumerate(hits)), F.lit(0))

    def step(word: Column, same: Column) -> Column:
        exact, one = word.bitwiseAND(F.lit(7)), F.shiftright(word, 3)
        kept = exact.bitwiseAND(same)
        moved = one.bitwiseAND(same).bitwiseOR(exact).bitwiseOR(F.shiftright(exact, 1)).bitwiseOR(F.shiftleft(kept, 1))
        return kept.bitwiseOR(F.shiftleft(moved.bitwiseAND(F.lit(7)), 3))

    def accept(word: Column) -> Column:
        reached = word.bitwiseOR(F.shiftright(word, 3))
        return F.call_function("shiftright", reached, gap + 1).bitwiseAND(F.lit(1)) == 1

    # The one-element array binds both lists of characters to a name, so they are cut once for each pair.
    chars = F.array(F.struct(F.split(s, "").alias("a"), F.split(t, "").alias("b")))
    masks = F.transform(chars, lambda p: F.transform(p["b"], lambda c, j: mask(p["a"], c, j)))[0]
    return F.when(F.abs(gap) > 1, False).when(F.length(t) == 0, True).otherwise(
        F.aggregate(masks, F.lit(2 | 4 << 3), step, accept)
    )


def _pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of lines under keys with few lines, and the rows of all other keys."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    few = rows.join(counts.filter(F.col("n") <= PAIRS).select("key"), "key").groupBy("key").agg(
        F.sort_array(F.collect_list("line_id")).alias("ids")
    )
    met = few.select(
        F.explode(F.flatten(F.transform("ids", lambda x: F.transform(
            F.filter("ids", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v"))
        )))).alias("p")
    ).select("p.u", "p.v").distinct()
    return met, rows.join(counts.filter(F.col("n") > PAIRS).select("key"), "key")


def _one_left_out(rows: DataFrame) -> DataFrame:
    """Links between lines that agree but for a few free characters; linear in the rows."""
    free = F.substring(F.col("line"), F.col("front") + 1, F.length("line") - F.col("front") - F.col("back"))
    base = rows.select("key", "line_id", "first", free.alias("x"))
    cut = base.filter(F.length("x") > 0).select(
        "key", "line_id", "first", "x", F.explode(F.sequence(F.lit(1), F.length("x"))).alias("p")
    ).withColumn("y", F.concat(F.expr("substring(x, 1, p - 1)"), F.expr("substring(x, p + 1)")))
    swapped = cut.groupBy("key", F.length("x").alias("n"), "p", "y").agg(
        F.min(F.struct("first", "line_id")).alias("low"), F.count(F.lit(1)).alias("m")
    ).filter("m > 1")
    members = cut.withColumn("n", F.length("x")).join(swapped, ["key", "n", "p", "y"])
    star = members.select(F.col("low.line_id").alias("u"), F.col("line_id").alias("v"))
    grown = base.select("key", F.col("x").alias("y"), F.col("line_id").alias("u")).join(
        cut.select("key", "y", F.col("line_id").alias("v")), ["key", "y"]
    ).select("u", "v")
    return star.union(grown).filter("u <> v").distinct()


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links ``(u, v)`` between different lines within one edit, and ``(line_id, line, first)`` of lines with a key.

    Under keys cut to the end a line is linked with the earliest of those that differ in the same character, and with
    every line it becomes by one insertion; other links there follow from these.
    """
    lines = _lines(docs)
    zero = F.lit(0)
    keyed = lines.select("line_id", _halves(F.col("line"), zero, F.length("line"), F.lit(0), zero).alias("h")).select(
        "line_id", "h.*"
    )
    shared = keyed.groupBy("key").agg(F.min("line_id").alias("a"), F.max("line_id").alias("b")).filter("a <> b")
    rows = freeze(keyed.join(shared.select("key"), "key").distinct())
    ids = rows.select("line_id").distinct()
    texts = freeze(
        _maybe_in(lines, ids).groupBy("line_id").agg(
            F.any_value("line").alias("line"), F.min(F.struct("doc_id", "pos")).alias("first")
        ).join(ids, "line_id", "left_semi")
    )
    pairs, hot = _pairs(rows)
    found, sure = [pairs], []
    hot = freeze(hot)
    # Free parts halve each time, so the loop ends after log2 of the longest line; as a rule after one or two rounds.
    while not hot.isEmpty():
        full = hot.join(texts, "line_id")
        sure.append(_one_left_out(full.filter(F.col("free") <= LAST)))
        rest = F.length("line") - F.col("front") - F.col("back")
        finer = full.filter(F.col("free") > LAST).select(
            "line_id", _halves(F.col("line"), F.col("front"), rest, F.col("key"), F.col("back")).alias("h")
        ).select("line_id", "h.*").distinct()
        pairs, hot = _pairs(freeze(finer))
        found.append(pairs)
        hot = freeze(hot)
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.union(more)
    s, t = texts.select(F.col("line_id").alias("u"), F.col("line").alias("s")), texts.select(
        F.col("line_id").alias("v"), F.col("line").alias("t")
    )
    checked = candidates.distinct().join(s, "u").join(t, "v").filter(
        (F.abs(F.length("s") - F.length("t")) <= 1) & _one_part_differs(F.col("s"), F.col("t"))
    ).filter(within_one_edit(F.col("s"), F.col("t"))).select("u", "v")
    for more in sure:
        checked = checked.union(more)
    return checked, texts


def line_decisions(docs: DataFrame) -> DataFrame:
    """Lines that go, ``(doc_id, pos, line_id)``: copies of a line, and lines within one edit of an earlier line.

    Lines are ordered by where they first stand (doc_id, then number in the document).
    """
    links, texts = near_links(docs)
    at = texts.select("line_id", "first")
    ends = links.join(at.select(F.col("line_id").alias("u"), F.col("first").alias("fu")), "u").join(
        at.select(F.col("line_id").alias("v"), F.col("first").alias("fv")), "v"
    )
    near = ends.select(F.when(F.col("fu") < F.col("fv"), F.col("v")).otherwise(F.col("u")).alias("line_id")).distinct()
    lines = _lines(docs).drop("line")
    firsts = lines.groupBy("line_id").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    judged = firsts.join(near.withColumn("near", F.lit(True)), "line_id", "left").filter("n > 1 OR near")
    return lines.join(judged, "line_id").filter(
        F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "pos") != F.col("first"))
    ).select("doc_id", "pos", "line_id")


def _short_repeats(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Short lines that go, ``(doc_id, pos, line_id)``, from rows that lose all their longer lines by ``gone(id, gone)``.

    Of such a row every short line goes that stands at an earlier place of any row; blank lines stay.
    """
    places = F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        i.alias("pos"), F.xxhash64(x).alias("line_id"), (F.length(x) >= MIN_CHARS).alias("long"), x.rlike(INK).alias("ink")
    ))
    listed = docs.filter("doc_id IS NOT NULL").select("doc_id", places.alias("places")).select(
        "doc_id", F.filter("places", lambda p: p["long"]).alias("long"),
        F.transform(F.filter("places", lambda p: ~p["long"] & p["ink"]), lambda p: F.struct(p["pos"], p["line_id"])).alias("short"),
    )
    lost = listed.filter((F.size("long") > 0) & (F.size("short") > 0)).join(gone, F.col("doc_id") == F.col("id")).filter(
        F.forall("long", lambda p: F.array_contains("gone", F.xxhash64(p["pos"], p["line_id"])))
    )
    loose = freeze(lost.select("doc_id", F.inline("short")))
    ids = loose.select("line_id").distinct()
    firsts = _maybe_in(listed.select("doc_id", F.inline("short")), ids).groupBy("line_id").agg(
        F.min(F.struct("doc_id", "pos")).alias("first")
    )
    return loose.join(firsts, "line_id").filter(F.struct("doc_id", "pos") != F.col("first")).select("doc_id", "pos", "line_id")


def dedup_lines(docs: DataFrame, report: bool = False, short: bool = False, emptied: bool = True) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of ``text``; all columns stay.

    Every occurrence of a line of at least ``MIN_CHARS`` characters goes, except the first occurrence of a line that
    is not within one edit of an earlier one. With ``report``, ``(doc_id, n_lines, n_removed, text)`` instead.
    Null texts stay null; rows with a null doc_id stay as they are; rows that repeat a doc_id and a line at the same
    place are one occurrence. Two different lines count as one with probability 2 ** -64.

    With ``short``, a row that loses all its lines of ``MIN_CHARS`` characters also loses those shorter lines that stand
    at an earlier place, so nothing but blank lines is left of a copy. Without ``emptied``, rows that lost a line and have
    only white space left go.
    """
    source = docs.select(F.col("doc_id"), F.col("text"))
    decided = line_decisions(source)
    by_row = lambda rows: rows.groupBy(F.col("doc_id").alias("id")).agg(
        F.collect_set(F.xxhash64("pos", "line_id")).alias("gone")
    )
    if short:
        decided = freeze(decided)
        decided = decided.unionByName(_short_repeats(source, by_row(decided)))
    gone = by_row(decided)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(gone, F.col("row.doc_id") == F.col("id"), "left")
    lines = F.split("row.text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("gone", F.xxhash64(i, F.xxhash64(x))))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.concat_ws("\n", kept))
    if report:
        return joined.select(
            F.col("row.doc_id").alias("doc_id"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
            F.when(F.col("gone").isNull() | F.col("row.text").isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_removed"),
            text.alias("text"),
        )
    if not emptied:
        joined = joined.filter(F.col("gone").isNull() | F.col("row.text").isNull() | (F.size(kept) == F.size(lines)) | text.rlike(INK))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
