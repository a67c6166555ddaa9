"""One row per near-duplicate group, by the similarity of word shingles.

Documents link if the Jaccard similarity of their sets of five-word shingles is at least 0.8.  The SimHash index
(``simhash.groups``, fingerprints at 4 or fewer differing bits) gives the first candidates: each of a component's sets with
its smallest.  Pairs near 0.8 differ in more bits than that, so MinHash signatures of 20 bands of 5 rows give the rest (a
pair at exactly 0.8 shares a band with probability 0.9996, nearer pairs more surely); every candidate is verified on the
shingles themselves, whichever index met it.

Equal sets collapse first; each band's members are then verified against its smallest member only.  What is left are links
between different components of one band, and those are not looked for in pairs either (``_bridges``).  Components that
meet in bands form a block, whose consensus is what more than half of its nodes have.  With d the size of a node's
difference from the consensus and v how much of two differences is common, two nodes differ in d + d' - 2 v shingles and
link if that is at most a ninth of their sizes' sum: with a weight w = d - n / 9, if 2 v >= w + w'.  So

* w + w' <= 0 always links, and then both link with the block's smallest weight: a star;
* otherwise v has a least value, and the two share one of the first elements of their differences (the prefix filter of
  set-similarity joins: Chaudhuri et al., 2006; Bayardo et al., 2007): an equality join on those, then verification.

Shingles that one node alone has are in no other difference and need no place in the join; nodes that agree in all others
stand together behind the one with the fewest of its own where that link is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import components, discard, forget, settled, tidy, trim
from tidemark.llm.rolling import Prefix, _mix

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Two sets have the similarity if they differ in at most this share of their sizes' sum.
_SLACK = (1 - SIMILARITY) / (1 + SIMILARITY)
_FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words as in ``simhash.fingerprint``, a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    last = end[SHINGLE - 1 :] if len(words) >= SHINGLE else end[-1:]
    return np.unique(Prefix(b" ".join(words)).slices((end - length)[: len(last)], last))


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key per band of the MinHash signature of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1 << 12):  # a very long text needs no more memory than a short one
        least = np.minimum(least, (_FACTORS[:, None] * h[None, at : at + (1 << 12)]).min(axis=1))
    key = _mix(np.arange(BANDS, dtype=np.uint64))
    for part in least.reshape(BANDS, ROWS).T:
        key = _mix(key ^ part)
    return key


def _signed(rows: DataFrame) -> DataFrame:
    """``row, id, node, n, bands, fp`` of ``rows(row, id, text)``; ``node`` is a 64-bit hash of the set of shingles, ``fp`` the SimHash of the text."""

    def run(batches):
        forget()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [shingles(x) for x in texts]
            fps = np.array([simhash.fingerprint(x, SHINGLE) for x in texts], np.uint64).view(np.int64)
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            bands = [band_keys(x).view(np.int64) for x in sets]
            columns = [batch.column(0), batch.column(1), pa.array(node), pa.array([len(x) for x in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "node", "n", "bands", "fp"])
        trim()

    return rows.mapInArrow(run, "row string, id long, node long, n long, bands array<long>, fp long")


def _sets(nodes: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``node`` and ``h``, its shingles' hashes, for every one of ``nodes``."""

    def run(batches):
        forget()
        for batch in batches:
            sets = [shingles(x).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "h"])
        trim()

    of = classes.join(nodes.distinct(), "node").select("node", F.col("least.row").alias("row"))
    texts = rows.select("row", "text").join(of, "row").groupBy("node").agg(F.min("text").alias("text"))
    return settled(texts.mapInArrow(run, "node long, h array<long>"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b, ...)`` of nodes whose shingles are similar enough."""
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    common = F.size(F.array_intersect("x", "y"))
    return settled(both.where(common >= SIMILARITY * (F.size("x") + F.size("y") - common) - 1e-9).select(*pairs.columns), "verified")


def _differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, c, block, shared, own, kind, diff, w`` of ``members(node, n, c, block)`` that can link with anything.

    ``own`` counts the shingles no other node of the block has and ``shared`` the rest, ``kind`` is a hash of the latter;
    ``diff`` is the difference of the rest from the consensus in the order of the hashes, what is missing as complements.
    """
    with_sets = members.join(sets, "node")
    held = with_sets.select("block", "node", F.explode("h").alias("h")).groupBy("block", "h").agg(F.count("*").alias("holders"), F.min("node").alias("node"))
    held = settled(held.join(members.groupBy("block").agg(F.count("*").alias("size")), "block").where("holders = 1 or 2 * holders > size"), "held")
    own = held.where("holders = 1").groupBy("node").agg(F.collect_list("h").alias("alone"))
    most = held.where("holders > 1").groupBy("block").agg(F.collect_list("h").alias("most"))
    none = F.array().cast("array<long>")
    rows = with_sets.join(own, "node", "left").withColumn("rest", F.array_except("h", F.coalesce("alone", none)))
    rows = rows.where(F.size("rest") >= SIMILARITY * F.col("n") - 1e-9).join(most, "block", "left").withColumn("most", F.coalesce("most", none))
    extra, missing = F.array_except("rest", "most"), F.transform(F.array_except("most", "h"), F.bitwise_not)
    rows = rows.select("node", "n", "c", "block", F.size("rest").alias("shared"), (F.col("n") - F.size("rest")).alias("own"), F.xxhash64("rest").alias("kind"), F.array_sort(F.concat(extra, missing)).alias("diff"))
    out = settled(rows.withColumn("w", F.size("diff") + F.col("own") - _SLACK * F.col("n")), "differences")
    discard(held)
    return out


def _bridges(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``c, to``: components of ``members(node, n, c, block)`` and the joint component to which links inside blocks take them."""
    rows = _differences(members, sets)
    heads = rows.groupBy("block", "kind").agg(F.min(F.struct("own", "node", "c")).alias("head"))
    behind = (F.col("node") != F.col("head.node")) & (F.col("shared") >= SIMILARITY * (F.col("shared") + F.col("own") + F.col("head.own")) - 1e-9)
    rows, plain = settled(rows.join(heads, ["block", "kind"]).withColumn("behind", behind), "headed"), rows
    discard(plain)
    kept = rows.where("not behind").drop("head", "behind", "kind")
    ends = kept.groupBy("block").agg(F.min(F.struct("w", "node", "c")).alias("best"), F.max("w").alias("high"))
    kept = kept.join(ends, "block")
    stars = kept.where(F.col("w") + F.col("best.w") <= 1e-9).select("c", F.col("best.c").alias("to"))
    stars = settled(stars.union(rows.where("behind").select("c", F.col("head.c").alias("to"))).where("c <> to").distinct(), "certain")
    linked = components(stars, "c", "to").toDF("_c", "to")
    linked = settled(linked, "joined")

    # a node's elements up to the place from which on no partner of its block could share enough
    least = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("best.w")) / 2 - 1e-9))
    kept = kept.where(F.col("w") + F.col("high") > 1e-9).withColumn("first", (F.size("diff") - least + 1).cast("int")).where("first > 0")
    kept = kept.join(linked, kept["c"] == linked["_c"], "left").withColumn("c", F.coalesce("to", "c"))
    index = kept.select("block", "node", "c", "w", F.size("diff").alias("d"), F.posexplode(F.slice("diff", F.lit(1), F.col("first"))).alias("at", "h"))
    index = settled(index, "index")
    l, r = index.alias("l"), index.alias("r")
    v = F.greatest(F.lit(1.0), (F.col("l.w") + F.col("r.w")) / 2) - 1e-9
    may = (F.col("l.w") + F.col("r.w") > 1e-9) & (F.col("l.at") <= F.col("l.d") - v) & (F.col("r.at") <= F.col("r.d") - v)
    same = (F.col("l.block") == F.col("r.block")) & (F.col("l.h") == F.col("r.h"))
    pairs = l.join(r, same & (F.col("l.node") < F.col("r.node")) & (F.col("l.c") != F.col("r.c")) & may)
    pairs = settled(pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), F.col("l.c").alias("p"), F.col("r.c").alias("q")).distinct(), "pairs")
    verified = _verified(pairs, sets)
    discard(rows, stars, index, pairs)
    further = components(verified, "p", "q").toDF("_to", "further")
    all_c = members.select("c").distinct()
    once = all_c.join(linked, all_c["c"] == linked["_c"], "left").select("c", F.coalesce("to", "c").alias("to"))
    out = once.join(further, once["to"] == further["_to"], "left").select("c", F.coalesce("further", "to").alias("to"))
    out = settled(out, "bridges")
    discard(verified, linked)
    return out


def _near(x, y):
    return F.least(x, y) >= SIMILARITY * F.greatest(x, y) - 1e-9


def simhash_candidates(classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ``classes(node, n, fp)``: each node with the smallest of its SimHash component, where their sizes allow the similarity."""
    found = settled(simhash.groups(classes.select(F.col("node").alias("doc_id"), "fp")), "fingerprint_groups")
    rows = classes.select("node", "n", "fp").join(found, "fp").where(F.col("node") != F.col("component_id"))
    rows = rows.join(classes.select(F.col("node").alias("component_id"), F.col("n").alias("m")), "component_id")
    return rows.where(_near(F.col("n"), F.col("m"))).select(F.col("node").alias("a"), F.col("component_id").alias("b"))


def groups(rows: DataFrame) -> DataFrame:
    """``group, least`` for every group of ``rows(row, id, text)``; ``least`` has the ``row`` that stands for the group.

    That is the row with the smallest id, null ids last and the smallest ``row`` among equals.  A null or blank text has no
    shingles and links with others of its kind.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
    signed = settled(_signed(rows), "signed")
    classes = settled(signed.groupBy("node").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "classes")
    discard(signed)
    met = settled(simhash_candidates(classes), "met")
    tidy(rows.sparkSession)

    index = classes.select("node", "n", F.explode("bands").alias("band"))
    same = Window.partitionBy("band")
    stars = index.withColumn("c", F.min(F.struct("node", "n")).over(same)).where((F.col("node") != F.col("c.node")) & _near(F.col("n"), F.col("c.n")))
    stars = settled(stars.select(F.col("node").alias("a"), F.col("c.node").alias("b")).union(met).distinct(), "pairs")
    discard(met)
    sets = _sets(stars.select(F.col("a").alias("node")).union(stars.select("b")), classes, rows)
    pairs, stars = stars, _verified(stars, sets)
    discard(pairs, sets)
    linked = components(stars)
    found = settled(linked, "stars").withColumnRenamed("node", "_node")
    discard(stars, linked)
    tidy(rows.sparkSession)

    labelled = classes.join(found, classes["node"] == found["_node"], "left").select("node", "n", "bands", "least", F.coalesce("component", "node").alias("c"))
    labelled = settled(labelled, "labelled")
    index = labelled.select("node", "n", "c", F.explode("bands").alias("band"))
    index = index.withColumns({"low": F.min("c").over(same), "high": F.max("c").over(same)})
    index = settled(index.where("low <> high").select("node", "n", "c", "low").distinct(), "open")
    blocks = components(index, "c", "low").toDF("c", "block")
    members = settled(index.select("node", "n", "c").distinct().join(blocks, "c"), "members")
    sets = _sets(members.select("node"), classes, rows)
    tidy(rows.sparkSession)
    joined = _bridges(members, sets).toDF("_node", "group")
    discard(sets, members, index, found, classes)
    full = labelled.join(joined, labelled["c"] == joined["_node"], "left").select(F.coalesce("group", "c").alias("group"), "least")
    return full.groupBy("group").agg(F.min("least").alias("least"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each group: that with the smallest doc_id (null ids take part and come last), exact repeats once.

    Rows that share a doc_id with different texts are rows of their own.  Of rows that share both, the one whose other
    columns come first as JSON stays.
    """
    parts = [F.coalesce(F.concat(F.lit(mark), F.col(c).cast("string")), F.lit("-")) for c, mark in (("doc_id", "+"), ("text", ":"))]
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    keyed = docs.select(
        F.sha2(F.concat(*parts), 256).alias("row"),  # an id holds no colon, so equal keys are equal rows
        F.struct(*docs.columns).alias("doc"), (F.to_json(F.struct(*others)) if others else F.lit("")).alias("tie"),
    )
    kept = groups(keyed.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.col("doc.text").cast("string").alias("text")))
    once = keyed.groupBy("row").agg(F.min_by("doc", "tie").alias("doc"))
    return once.join(kept.select(F.col("least.row").alias("row")), "row", "left_semi").select("doc.*")
