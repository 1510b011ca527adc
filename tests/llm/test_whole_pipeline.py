"""The stages of the pipeline one after another against plain versions, and the rows of ``run()``."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_similar import kept_rows, near_copies
from veilframe.llm.common import written
from veilframe.session import work_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = random.Random(8)
    texts = [*brute.HARD, *near_copies(5, groups=5, copies=5, words=90)]
    texts += [" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(60, 200))) for _ in range(40)]
    texts += ["  ".join(t.split(" ")) for t in texts[-6:]] + [texts[-1] + "\n"] + ["same words again and again " * 30]
    return [(i, t, "en" if i % 3 else None, f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]


def _passes(text):
    n, _, _, _, _, cover, longest, failed = brute.quality(text)
    longest = longest if longest >= 8 else 0
    return not failed and cover <= 0.3 * n and longest <= 0.2 * n


def _first_of_equal(rows):
    best = {}
    for r in rows:
        t = r[1] or ""
        key = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (0, 0)) if key in best else (-len(t), r[0]), (-len(t), r[0]))
    return {i for _, i in best.values()}


def test_stages_and_run(spark):
    rows = _rows()
    folder = work_path(spark, "pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), rows
    by_id = {r[0]: r for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]

    def step(frame, name):
        out = written(stages[name](spark, frame, folder), name)
        assert out.columns == docs.columns
        return out

    frame = step(docs, names[0])
    kept = [r for r in kept if _passes(r[1])]
    assert sorted(r.doc_id for r in frame.collect()) == sorted(r[0] for r in kept)
    frame = step(frame, names[1])
    stays = _first_of_equal(kept)
    kept = [r for r in kept if r[0] in stays]
    assert sorted(r.doc_id for r in frame.collect()) == sorted(r[0] for r in kept)
    frame = step(frame, names[2])
    stays = kept_rows([r[1] for r in kept])
    kept = [r for i, r in enumerate(kept) if i in stays]
    assert sorted(r.doc_id for r in frame.collect()) == sorted(r[0] for r in kept) and len(kept) < len(rows) - 30
    mixed = Counter(r.doc_id for r in step(frame, names[3]).collect())
    assert set(mixed) <= {r[0] for r in kept} and max(mixed.values()) <= 2
    again = Counter(r.doc_id for r in step(written(frame.repartition(5), "moved"), names[3]).collect())
    assert again == mixed

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    lengths = {i: len(tokenizer.encode(by_id[i][1], add_special_tokens=False).ids) + 1 for i in mixed}
    placed, fill = Counter(), Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        placed[r.doc_id] += r.length
        fill[r.sequence_id] = max(fill[r.sequence_id], r.offset + r.length)
    assert placed == Counter({i: n * lengths[i] for i, n in mixed.items()})
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(placed.values())
