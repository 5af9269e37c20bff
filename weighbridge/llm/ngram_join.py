"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.graph import components
from weighbridge.llm.words import mixed, shingles
from weighbridge.stages import materialize

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999  # of pairs at exactly the similarity; higher for closer ones
MOST_HASHES = 160
BLOCK = 256  # texts of a block; a task verifies one pair of blocks
PACK = 2_000  # texts in small candidate groups that a task takes together


def band_layout(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence the fewest chance candidates, whose
    bands reach the recall for pairs of that similarity within ``most`` hashes."""
    found = None
    for rows in range(1, most + 1):
        chance = similarity**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows > most:
            break
        found = bands, rows
    if found is None:
        raise ValueError("no layout reaches this recall")
    return found


def _band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Hash of each band of the MinHash signature, the band's number mixed in."""
    factors = (mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shifts = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) + np.uint64(1 << 40)).astype(np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 4096):
        values = short[None, a : a + 4096] * factors[:, None] ^ shifts[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    total = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + low[k::rows][:bands].astype(np.uint64))
    return total


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``_row, doc_id, high, low, bands``: identity of the n-gram set (128 bits) and band hashes;
    null for texts without words."""

    def run(batches):
        for batch in batches:
            high, low, lists = [], [], []
            for text in batch.column(2):
                grams = shingles(text.as_py() or "", words)
                if not len(grams):
                    high.append(None), low.append(None), lists.append(None)
                    continue
                whole = xxhash.xxh3_128_digest(grams.tobytes())
                high.append(int.from_bytes(whole[:8], "big", signed=True))
                low.append(int.from_bytes(whole[8:], "big", signed=True))
                lists.append(_band_hashes(grams, bands, rows).astype(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "high", "low", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("_row", "doc_id", "text").mapInArrow(run, f"_row long, doc_id {kind}, high long, low long, bands array<long>")


def _gram_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # sets of so many texts at once
                part = batch.slice(k, 500)
                lists = pa.array([shingles(t.as_py() or "", words).astype(np.int64) for t in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["_row", "grams"])

    return docs.select("_row", "text").mapInArrow(run, "_row long, grams array<long>")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every two sets. N-grams of one set only are left out first."""
    n = len(sets)
    common = np.zeros((n, n), np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[which] > 1
    owner, which = owner[shared], which[shared]
    if not len(owner):
        return common
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], np.cumsum(np.r_[0, np.diff(which[order]) != 0])
    for a in range(0, which[-1] + 1, 8192):  # a bounded stretch of n-grams at a time
        lo, hi = np.searchsorted(which, [a, a + 8192])
        part = np.zeros((n, min(8192, which[-1] + 1 - a)), np.float32)
        part[owner[lo:hi], which[lo:hi] - a] = 1.0
        common += (part @ part.T).astype(np.int64)
    return common


def _forest(n: int, pairs: np.ndarray) -> list[int]:
    """Numbers of the pairs that connect what earlier pairs have not."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (a, b) in enumerate(pairs.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[rb] = ra
            kept.append(k)
    return kept


def _verify(similarity: float):
    """Links inside one group: the number of documents each text is linked to, and a
    forest of links that connects what belongs together. Pairs are never emitted."""

    def run(table: pa.Table) -> pa.Table:
        comp, node, copies = table["comp"].to_numpy(), table["node"].to_numpy(), table["copies"].to_numpy()
        block, side = table["block"].to_numpy(), (table["i"].to_numpy(), table["j"].to_numpy())
        column = table["grams"].combine_chunks()
        values, offsets = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.lexsort((node, comp))
        edges = np.flatnonzero(np.r_[True, np.diff(comp[order]) != 0, True])
        for a, b in zip(edges[:-1], edges[1:]):
            rows = order[a:b]
            if len(rows) < 2:
                continue
            sets = [values[offsets[r] : offsets[r + 1]] for r in rows]
            size = np.array([len(s) for s in sets])
            common = _overlaps(sets)
            linked = common >= similarity * (size[:, None] + size[None] - common) - 1e-9
            np.fill_diagonal(linked, False)
            if side[0][rows[0]] != side[1][rows[0]]:  # two blocks: only pairs across them
                linked &= block[rows][:, None] != block[rows][None]
            links = (linked * copies[rows][None]).sum(1)
            some = links > 0
            out.append((node[rows][some], np.full(some.sum(), -1), links[some]))
            pairs = np.argwhere(np.triu(linked))
            tree = pairs[_forest(len(rows), pairs)] if len(pairs) else pairs.reshape(0, 2)
            out.append((node[rows][tree[:, 0]], node[rows][tree[:, 1]], np.full(len(tree), -1)))
        if not out:
            out.append((np.zeros(0, np.int64),) * 3)
        node_, other, links = (np.concatenate(x).astype(np.int64) for x in zip(*out))
        edge = links < 0
        return pa.table({
            "node": pa.array(node_), "other": pa.array(other, mask=~edge), "links": pa.array(np.where(edge, 0, links)),
        })

    return run


def numbered(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with a number for every row, written once so that it stays."""
    return materialize(docs.select(*columns).withColumn("_row", F.monotonically_increasing_id()), "numbered-docs")


def jaccard_join(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``_row, class_id, n_links, is_first`` for every row of ``rows(_row, doc_id, text)``.

    Two texts are linked if the Jaccard similarity of their sets of word n-grams is
    at least ``similarity``. ``n_links`` counts the other rows a row is linked to;
    classes are the connected components, ``class_id`` the smallest doc_id of the
    class, and one row of each class ``is_first``. Words are what stands
    between ASCII white space, without case. A text of fewer words than n has one n-gram of all its
    words; null, empty and wordless texts are linked to nothing. Ids may be null or
    repeated: rows count, and a class without ids has a null id.

    Rows with equal sets are one node from the start. Nodes that share a band are
    joined to the lowest node of the band's bucket, which takes as many rows as the
    bucket has, and components of these stars are the candidate groups: no pair that
    meets in any band is lost. Inside a group all pairs are verified on full sets, in
    pairs of blocks, whose tasks emit sums and forests. A group of any size is thus
    solved exactly, in tasks of bounded size.
    """
    bands, band_rows = band_layout(similarity, recall)
    signed = materialize(_signed(rows, words, bands, band_rows), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")).alias("first")
    # copies are one node: its lower 64 bits name it, equality is by all 128
    keep = F.first("bands").alias("bands")
    nodes = signed.where(F.col("low").isNotNull()).groupBy("high", "low").agg(first, F.count(F.lit(1)).alias("copies"), keep)
    nodes = materialize(nodes.select(F.col("low").alias("node"), "first", "copies", "bands"), "nodes")

    met = nodes.select("node", F.explode("bands").alias("band"))
    hubs = met.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub")
    stars = met.join(hubs, "band").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    groups = materialize(components(stars, "candidates").withColumnRenamed("root", "comp"), "candidate-groups")

    sizes = groups.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.ceil(F.col("n") / BLOCK).cast("int"))
    small = groups.count()
    packs = max(1, -(-small // PACK))
    placed = groups.join(sizes, "comp").join(nodes.select("node", "copies", F.col("first._row").alias("_row")), "node")
    sets = _gram_sets(rows.join(placed.select("_row"), "_row", "left_semi"), words)
    block = F.pmod(F.xxhash64("node"), F.col("m")).cast("int")
    dealt = placed.join(sets, "_row").withColumn("block", block).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select(
        "comp", "node", "copies", "grams", "block", F.least("block", "_x").alias("i"), F.greatest("block", "_x").alias("j"),
        F.when(F.col("m") > 1, F.col("comp")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(packs))).alias("pack"), (F.col("m") > 1).alias("many"),
    )
    found = dealt.groupBy("many", "pack", "i", "j").applyInArrow(_verify(similarity), "node long, other long, links long")
    found = materialize(found, "links")
    links = found.where(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v"))
    roots = components(edges, "classes")
    firsts = nodes.select(F.col("node").alias("_node"), "first").join(roots, F.col("_node") == F.col("node")).groupBy("root").agg(F.min("first").alias("class_first"))
    of_node = roots.join(firsts, "root").join(links, "node").select(F.col("node").alias("_node"), "class_first", "links")
    # a row per node that has copies or links
    facts = (
        nodes.select("node", "first", "copies").join(of_node, F.col("node") == F.col("_node"), "left")
        .where((F.col("copies") > 1) | F.col("links").isNotNull())
        .select("node", F.coalesce("class_first", "first").alias("class_first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = signed.select("_row", "doc_id", "low").join(facts, F.col("low") == F.col("node"), "left")
    alone = F.col("n_links").isNull()
    return out.select(
        "_row", F.when(alone, F.col("doc_id")).otherwise(F.col("class_first.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (alone | (F.col("class_first._row") == F.col("_row"))).alias("is_first"),
    )
