"""Near-duplicates by the similarity of shingle sets: SimHash fingerprints met by Golay keys, then MinHash keys, an exact
join where keys are crowded, every pair verified.

A text is the set of its shingles of ``SHINGLE_WORDS`` words (ASCII letters lower-cased); two texts
are linked if the Jaccard similarity of their sets is at least ``SIMILARITY``.

The closest copies are found first, by the method of ``simhash``: each set has a 64-bit fingerprint, fingerprints of at most two
differing bits meet under their Golay keys, one set of each fingerprint is compared with the others and with those of
the fingerprints near it. Sets of similarity 0.8 differ in about ten bits, which these keys do not reach, so the rest is
found by MinHash keys; what the fingerprints linked is not compared again. Those candidates share one
of ``BANDS`` keys, each made of ``ROWS`` MinHash values: a pair of similarity s has none in common
with probability (1 - s^ROWS)^BANDS, 3 in 100,000 at 0.8 and less above. Nothing else is lost:
candidates are verified by their whole sets, and no group is capped.

Texts of equal sets are one class. Of each key's classes one leads, the one that shares most keys with most
others (the text that copies were made of does), and the others are compared with it, so that a group of near copies
takes as many comparisons as it has members. What is still in different components under a key of at most ``FEW``
members is compared pair by pair.

The members of larger keys, texts with a passage or a template in common mostly, go through an exact set-similarity
join instead: their shingles are put in order of frequency, rare ones first. Two sets of similarity t share one of
the first n - ceil(t n) + 1 shingles of each, so only those are joined, and only where enough shingles follow in both
sets for the overlap that t needs. What many texts share stands at the end of the order, so templates filled in
differently do not meet. Under a shingle, texts outside its largest component are joined
with the others, so a group that is linked already makes no pairs.

Defined results: null texts, empty texts and texts of white space only have the empty set and are
linked to each other only; with fewer words than a shingle the whole word sequence is the shingle;
repeated rows are copies of each other. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.bytearrays import mix, prefix_hash, span_hash, words
from veilframe.llm.common import chunks, discard, limit_batches, placed, sized_join, text_buffer, written
from veilframe.llm.components import components
from veilframe.llm.simhash import fingerprint_links, majority

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Members of a key up to which what is apart is compared pair by pair.
FEW = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Odd factors, one hash function for each value of each key.
_FACTORS = np.random.default_rng(20240611).integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and the number of each."""
    w = words(_LOWER[raw], at)
    n = w.counts
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    total = int(shingles.sum())
    begin = np.cumsum(shingles) - shingles
    owner = np.repeat(np.arange(len(n)), shingles)
    head = np.repeat(w.first[:-1] - begin, shingles) + np.arange(total)
    hashes = span_hash(prefix_hash(w.hashes()), head, head + np.minimum(size, n)[owner])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(total, bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(n))


def _sums(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two sums that stand for each set."""
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    sums = np.zeros((2, len(sizes)), np.uint64)
    if len(full):
        sums[0, full] = np.add.reduceat(mix(hashes), begin)
        sums[1, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)), begin)
    return sums


def _keys(hashes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The keys of each set; an empty set has none."""
    full = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[full]
    keys = np.zeros((len(full), BANDS), np.uint64)
    for band, row in enumerate(_FACTORS if len(full) else ()):
        key = np.full(len(full), band, np.uint64)
        for factor in row:
            key = mix(key * factor + np.minimum.reduceat(hashes * factor, begin))
        keys[:, band] = key
    at = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel().view(np.int64)))


def _each_chunk(batches, size: int):
    for batch in batches:
        raw, at = text_buffer(batch.column("text"))
        for b, e in chunks(at):
            yield batch.slice(b, e - b), *shingle_sets(raw[at[b] : at[e]], at[b : e + 1] - at[b], size)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """(row, file, number, name, d0, d1, n, fp, keys) of (row, file, number, name, text)."""
    own = ["row", "file", "number", "name"]
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in own) + ", d0 long, d1 long, n long, fp long, keys array<long>"

    def run(batches):
        for part, hashes, sizes in _each_chunk(batches, size):
            d0, d1 = _sums(hashes, sizes)
            numbers = [d0.view(np.int64), d1.view(np.int64), sizes.astype(np.int64), majority(mix(hashes), sizes).view(np.int64)]
            columns = [part.column(c) for c in own] + [pa.array(x) for x in numbers] + [_keys(hashes, sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "d0", "d1", "n", "fp", "keys"])

    return docs.select(*own, "text").mapInArrow(run, schema)


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def run(batches):
        for part, hashes, sizes in _each_chunk(batches, size):
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes.view(np.int64)))], names=["node", "shingles"]
            )

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")).hint("merge")
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    both, total = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return met.where(both >= similarity * (total - both) - 1e-9).select("a", "b")


def _rooted(keys: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, node, n, root) of keys (key, node, n); a node without links is its own root."""
    if roots is None:
        return keys.withColumn("root", F.col("node"))
    return sized_join(keys, roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(rooted: DataFrame) -> DataFrame:
    """The keys whose members are in more than one component, with their number."""
    found = rooted.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return found.where("lo <> hi").select("key", "members")


def _leads(met: DataFrame) -> DataFrame:
    """(key, lead): of each key the member that shares most keys with most others, such as the text that others were made of."""
    score = written(met.groupBy("node").agg(F.sum("members").alias("score")), "scores")
    member = F.struct((-F.col("score")).alias("most"), F.xxhash64("node").alias("order"), "node", "n", "root")
    leads = written(sized_join(met, score, "node", "inner").groupBy("key").agg(F.min(member).alias("lead")), "leads")
    discard(score)
    return leads


def _fitting(one: str, other: str, similarity: float):
    """Whether the sizes of two sets allow the similarity."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _pair(one: str, other: str) -> list:
    x, y = F.col(f"{one}.node"), F.col(f"{other}.node")
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _prefix_pairs(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of the crowd (node, n, root) in different components that share a shingle of their prefixes and may be similar by size."""
    rows = sized_join(sets, crowd, "node", "inner").select("node", "n", "root", F.explode("shingles").alias("shingle"))
    repeated = rows.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1")
    known = rows.join(written(repeated, "repeated-shingles").hint("merge"), "shingle", "left")
    entry = F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "shingle")
    ordered = known.groupBy("node", "n", "root").agg(F.array_sort(F.collect_list(entry)).alias("order"))
    size = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    prefix = ordered.select("node", "n", "root", F.posexplode(F.slice("order", F.lit(1), size)).alias("pos", "e")).where("e.texts > 1")
    prefix = written(prefix.select("e.shingle", F.struct("node", "n", "root", (F.col("n") - F.col("pos")).alias("rest")).alias("y")), "prefixes")
    largest = prefix.groupBy("shingle").agg(F.mode("y.root").alias("most"), F.min("y.root").alias("lo"), F.max("y.root").alias("hi"))
    largest = written(largest.where("lo <> hi").select("shingle", "most"), "largest-roots")
    others = sized_join(prefix, largest, "shingle", "inner").where("y.root <> most").select("shingle", F.col("y").alias("x"))
    # Of the first shingle that two sets share, what follows in either must be enough for the overlap they need.
    overlap = (F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-6
    enough = F.least("x.rest", "y.rest") >= overlap
    # A pair of two outsiders comes both ways; ``distinct`` follows.
    met = others.join(prefix.hint("merge"), "shingle").where("x.root <> y.root")
    return met.where(_fitting("x", "y", similarity) & enough).select(_pair("x", "y"))


def close_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the classes (node, n, fp) to compare because their fingerprints differ in at most two bits.

    Of each fingerprint one class leads. It is compared with the others of its fingerprint and with the leaders of the
    fingerprints near it.
    """
    prints = written(classes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lead")), "prints")
    own = classes.select("fp", F.struct("node", "n").alias("own")).join(prints.hint("merge"), "fp").where("own.node <> lead.node")
    links = written(fingerprint_links(prints).distinct(), "print-links")
    of = lambda x, name: prints.select(F.col("fp").alias(x), F.col("lead").alias(name)).hint("merge")
    near = links.join(of("a", "one"), "a").join(of("b", "other"), "b")
    return own.where(_fitting("lead", "own", similarity)).select(_pair("lead", "own")).unionByName(
        near.where(_fitting("one", "other", similarity)).select(_pair("one", "other")))


def similar_links(keys: DataFrame, texts_of, shingle_words: int, similarity: float, close: DataFrame) -> DataFrame:
    """(node, root) of all classes that are linked.

    ``keys``: written (key, node, n); ``texts_of`` gives (node, text) of a written table of nodes; ``close``: written pairs
    (a, b) to compare before those of the keys.
    """
    shared = written(_apart(_rooted(keys, None)), "shared-keys")
    met = written(sized_join(_rooted(keys, None), shared, "key", "inner"), "met")
    discard(keys, shared)
    nodes = met.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node")))
    nodes = written(nodes.distinct(), "nodes")
    sets = written(_sets(texts_of(nodes), shingle_words), "shingle-sets")
    discard(nodes)

    def extended(roots: DataFrame | None, pairs: DataFrame, label: str) -> DataFrame:
        """Components after the pairs that prove similar are added to those so far."""
        pairs = written(pairs.distinct(), f"{label}-pairs")
        links = written(_verified(pairs, sets, similarity), f"{label}-links")
        discard(pairs)
        before = links.where("false") if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        out = written(components(links.unionByName(before)), "roots")
        discard(links)
        return out

    roots = extended(None, close, "close")
    rooted = written(_rooted(met.select("key", "node", "n", "members"), roots), "rooted")
    discard(met)
    met = rooted
    leads = _leads(met)
    led = sized_join(met, leads, "key", "inner").select("lead", F.struct("node", "n", "root").alias("own")).where("own.root <> lead.root")
    roots = extended(roots, led.where(_fitting("lead", "own", similarity)).select(_pair("lead", "own")), "led")
    discard(leads)
    # What the leader leaves apart under a key.
    rooted = _rooted(met.select("key", "node", "n"), roots)
    between = written(_apart(rooted), "apart-keys")
    apart = written(sized_join(rooted, between, "key", "inner"), "apart")
    discard(met, between)
    few = apart.where(F.col("members") <= FEW)
    x, y = few.select("key", F.struct("node", "n", "root").alias("x")), few.select("key", F.struct("node", "n", "root").alias("y"))
    pairs = x.join(y.hint("merge"), "key").where("x.root <> y.root and x.node < y.node")
    roots = extended(roots, pairs.where(_fitting("x", "y", similarity)).select(_pair("x", "y")), "rest")
    crowd = apart.where(F.col("members") > FEW).select("node", "n").distinct()
    crowd = written(_rooted(crowd, roots), "crowd")
    if not crowd.isEmpty():
        roots = extended(roots, _prefix_pairs(crowd, sets, similarity), "crowd")
    discard(apart, crowd, sets)
    return roots


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows without those that links lead to from a row with a smaller id (ties: one row stays)."""
    limit_batches(docs.sparkSession)
    marked, places = placed(docs)
    texts = marked.select(
        F.monotonically_increasing_id().alias("row"), F.col(places[0]).alias("file"), F.col(places[1]).alias("number"),
        F.col(f"`{id_col}`").alias("name"), F.col(f"`{text_col}`").alias("text"))
    sketches = written(_sketches(texts, shingle_words), "sketches")
    first = F.min(F.struct(F.col("name").isNull().alias("none"), "name", "row")).alias("best")
    classes = written(sketches.groupBy("d0", "d1", "n").agg(F.min("row").alias("node"), F.min("fp").alias("fp"), first, F.count("*").alias("copies")), "classes")
    own = sized_join(sketches.select("row", "n", "keys"), classes.select(F.col("node").alias("row")), "row", "left_semi")
    keys = written(own.select(F.explode("keys").alias("key"), F.col("row").alias("node"), "n"), "keys")

    def texts_of(nodes: DataFrame) -> DataFrame:
        where = written(sized_join(sketches.select(F.col("row").alias("node"), "file", "number"), nodes, "node", "left_semi"), "places")
        return sized_join(marked.select(F.col(places[0]).alias("file"), F.col(places[1]).alias("number"), F.col(f"`{text_col}`").alias("text")), where, ["file", "number"], "inner")

    close = written(close_pairs(classes.where("n > 0").select("node", "n", "fp"), similarity), "close")
    roots = similar_links(keys, texts_of, shingle_words, similarity, close)
    grouped = written(sized_join(classes, roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "grouped")
    # One row of each component stays, the one with the smallest id.
    best = grouped.groupBy("root").agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
    stays = best.where("copies > 1").select("root", F.col("best.row").alias("keep"))
    stays = written(grouped.join(stays, "root").select("d0", "d1", "n", "keep"), "stays")
    # A class may hold many rows: the join's exchanges are plain, which the adaptive skew join splits.
    dropped = sized_join(sketches.select("row", "file", "number", "d0", "d1", "n"), stays, ["d0", "d1", "n"], "inner").where("row <> keep")
    dropped = written(dropped.select(F.col("file").alias(places[0]), F.col("number").alias(places[1])), "dropped")
    discard(sketches, classes, grouped, stays, roots, close)
    return sized_join(marked, dropped, places, "left_anti").select([f"`{c}`" for c in docs.columns])
