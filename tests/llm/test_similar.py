"""Near copies by shingle sets against brute force over all pairs."""

import random

import corpus_pipeline
from tests.llm import brute
from veilframe.llm.similar import keep_one_of_similar


def _shingles(text, size=5):
    w = brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _similar(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b) > 0


def kept_rows(texts):
    """Places of the texts that stay: the first of each component."""
    sets, parent = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _similar(sets[i], sets[j]):
                parent[brute.find_root(parent, i)] = brute.find_root(parent, j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(brute.find_root(parent, i), i)
    return set(least.values())


def near_copies(seed, groups=12, copies=9, words=200):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        text = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            out.append(" ".join(text))
            if rng.random() < 0.5:  # a chain: each copy is made of the one before
                text = list(text)
            w = list(text)
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            text = w
    return out


def test_near_copies_with_edited_words_go(spark):
    texts = [*brute.HARD, *near_copies(1), None, "A  B"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)
    want = kept_rows(texts)
    assert len(want) < len(texts) - 60
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert keep_one_of_similar(docs.limit(0)).count() == 0


def test_links_beside_the_leader_are_found(spark):
    # Stars of copies 0.8 from their centre and less from each other: whichever leads, all are one group.
    rng = random.Random(3)
    texts = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(400)]
        texts.append(" ".join(base))
        for _ in range(12):
            w = list(base)
            for at in rng.sample(range(0, 395, 6), 8):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in keep_one_of_similar(docs).collect()} == kept_rows(texts) == set(range(0, len(texts), 13))


def test_repeated_rows_and_null_ids(spark):
    same = "same text here " * 30
    docs = spark.createDataFrame([(1, same), (1, same), (None, same), (None, None), (2, "other")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id) for r in keep_one_of_similar(docs).collect()) == [(False, 1), (False, 2), (True, None)]


def test_templates_that_are_alike_below_the_limit_make_few_pairs(spark, monkeypatch):
    # Every two texts share three quarters of their shingles: many keys, no link. A few are true copies.
    from veilframe.llm import similar

    rng = random.Random(6)
    form = [f"t{i}" for i in range(170)]
    texts = [" ".join([*form, *[f"u{k}x{i}" for i in range(25)]]) for k in range(250)]
    for k in range(0, 40, 4):
        w = texts[k].split()
        w[rng.randrange(100)] = f"y{k}"
        texts.append(" ".join(w))
    compared = {}
    plain = similar.written

    def counted(df, label):
        out = plain(df, label)
        if label.endswith("pairs"):
            compared[label] = out.count()
        return out

    monkeypatch.setattr(similar, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in similar.keep_one_of_similar(docs).collect()}
    assert got == kept_rows(texts) == set(range(250))
    assert "crowd-pairs" in compared and sum(compared.values()) < 20 * len(texts)
