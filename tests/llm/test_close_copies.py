"""The near-duplicate stage links the closest copies by fingerprints, before and without the MinHash keys."""

import random

from veilframe.llm import similar
from veilframe.llm.common import written


def test_close_copies_meet_by_fingerprint_alone(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(9000)}" for _ in range(3000)]
    edited = [*words[:-1], "other"]
    texts = [" ".join(words), " ".join(edited), " ".join(f"v{rng.randrange(9000)}" for _ in range(3000)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("row", "0L as file", "row as number", "row as name", "text")
    sketches = written(similar._sketches(docs, similar.SHINGLE_WORDS), "sketches")
    assert {r.fp for r in sketches.where("n = 0").collect()} == {0}
    close = written(similar.close_pairs(sketches.where("n > 0").selectExpr("row as node", "n", "fp"), similar.SIMILARITY), "close")
    assert {(r.a, r.b) for r in close.collect()} == {(0, 1)}
    none = written(spark.createDataFrame([], "key long, node long, n long"), "keys")
    texts_of = lambda nodes: docs.select(docs["row"].alias("node"), "text").join(nodes, "node", "left_semi")
    roots = similar.similar_links(none, texts_of, similar.SHINGLE_WORDS, similar.SIMILARITY, close)
    assert {(r.node, r.root) for r in roots.collect()} == {(0, 0), (1, 0)}
