"""Operators on single texts and on groups of texts against plain Python versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from veilframe.llm import packing, pieces, repetition, simhash, substrings, token_counts
from veilframe.llm.common import chunks, text_buffer


def frame(spark, texts, parts=3):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept string").repartition(parts)


def shuffled_texts(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(4)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(rng.choice(out))
        elif kind < 0.4 and out:
            w = rng.choice(out).split(" ")
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        else:
            body = rng.choices(vocabulary, k=rng.randint(1, 150))
            if kind < 0.7:
                body.insert(rng.randint(0, len(body)), rng.choice(passages))
            out.append(rng.choice([" ", "  ", "\n"]).join(body))
    return out


TEXTS = brute.HARD + shuffled_texts(1)


def test_quality_counts(spark):
    got = frame(spark, TEXTS).select("doc_id", repetition.repetition_rules("text").alias("q")).select("doc_id", "q.*").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute.quality(TEXTS[r.doc_id])
        have = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered_words, r.longest_repeat, r.base_failed)
        if r.n_words < 400:
            assert have == want, TEXTS[r.doc_id]
        else:
            assert have[:6] == want[:6]
        assert not (r.kept and r.base_failed)


def test_quality_filter_keeps_columns(spark):
    docs = frame(spark, TEXTS)
    kept = repetition.keep_varied(docs)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < len(TEXTS)
    assert repetition.keep_varied(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_tokens_of_the_text(name):
    rng = random.Random(5)
    signs = ["a", "b", "é", "ñ", "'s", "'", "’", "don't", "  ", " ", "\n", "\t", "×", "÷", "́", ".", "...", "<|endoftext|>", "<|", "1", "23", "½", "中文",
             "😀", "A", "The", "İ", "ß", "#", "$", "\x1c", "\x85", "ª", "x²", "\r\n", "_", "-", "Ⅷ", "א", "K", "\xa0"]
    texts = ["", *[t or "" for t in brute.HARD], *["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(2000)]]
    tokenizer = pieces.load_tokenizer(name)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raw, at = text_buffer(pa.array(texts))
    for entries in (100, 1_000_000):  # a table that starts anew all the time, and one that does not
        table = pieces.PieceTable(tokenizer, True, entries)
        got = []
        for b, e in chunks(at, 2000):
            n, offsets, ids = table.texts(raw[at[b] : at[e]], at[b : e + 1] - at[b])
            got += [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(n))]
        assert got == want


def test_token_counts(spark):
    tokenizer = pieces.load_tokenizer("word_bpe_49k.json")
    for r in token_counts.count_tokens(frame(spark, TEXTS)).collect():
        text = TEXTS[r.doc_id] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


@pytest.mark.parametrize("heat", [None, 1])
def test_substrings(spark, monkeypatch, heat):
    if heat:  # every minimiser is hot
        monkeypatch.setattr(substrings, "HOT_LEAST", heat)
        monkeypatch.setattr(substrings, "HOT_SHARE", 1 / 100_000)
    texts = TEXTS + shuffled_texts(2, 60) + [None]
    want = brute.cut_windows(texts)
    got = substrings.remove_repeats(frame(spark, texts, 5)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == want[r.doc_id]
    assert substrings.remove_repeats(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [128, 2])
def test_simhash_components(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    texts = TEXTS + shuffled_texts(3, 100)
    prints = [brute.fingerprint(t) for t in texts]
    want = brute.components(list(range(len(texts))), prints)
    got = {r.id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].fp % (1 << 64) == prints[i]
        assert got[i].component == want[i]
    docs = frame(spark, texts)
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == set(want)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [128, 3])
def test_fingerprints_that_differ_in_few_bits(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(9)
    prints = []
    for _ in range(25):
        base = rng.getrandbits(64)
        prints.append(base)
        for _ in range(6):
            x = rng.choice(prints[-4:])
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    want = brute.components(list(range(len(prints))), prints)
    got = {r.id: r.component for r in simhash.with_components(spark.createDataFrame(rows, "id long, fp long")).collect()}
    assert [got[i] for i in range(len(prints))] == want


def test_packing(spark):
    tokenizer = pieces.load_tokenizer(packing.TOKENIZER)
    texts = TEXTS + ["many words again " * 900] + shuffled_texts(4, 100)
    documents = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    found, tokens = packing.pack(frame(spark, texts))
    rows = found.collect()
    share = brute.check_pieces(documents, [(r.id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows])
    assert share < 0.002
    for r in packing.piece_ids(found, tokens).limit(50).collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == documents[r.id][r.start : r.start + r.length]
    none, _ = packing.pack(frame(spark, texts).limit(0))
    assert none.count() == 0


def test_plan_packs_any_histogram():
    rng = random.Random(2)
    for case in range(6):
        lengths = rng.sample(range(1, 2048), rng.choice([1, 3, 40, 300]))
        histogram = {x: rng.choice([1, 2, 7, 1000]) for x in lengths}
        if case == 0:
            histogram = {1500: 100_000, 3: 1}
        plan = packing.make_plan(histogram, 2048)
        covered = {x: 0 for x in histogram}
        fills: dict[int, int] = {}
        for x, lo, hi, sequence, copies, _ in plan.slots:
            assert lo == covered[x] and (hi - lo) % copies == 0
            covered[x] = hi
            fills[sequence] = fills.get(sequence, 0) + x * copies
        for x, first, _ in plan.stream:
            assert first == covered[x]
            covered[x] = histogram[x]
        assert covered == histogram
        assert all(2046 <= f <= 2048 or f & (f - 1) == 0 for f in fills.values())


def test_column_generation_reaches_the_volume_bound():
    lengths = np.array([1200, 900, 700, 448, 400, 248], np.int64)
    counts = np.array([100, 80, 90, 60, 70, 120], np.int64)
    basis, amount = packing.column_generation(lengths, counts, 2048)
    assert np.allclose(basis @ amount, counts)
    assert (lengths @ basis <= 2048).all()
    assert amount.sum() <= packing.first_patterns(lengths, counts, 2048)[1].sum() + 1e-9


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same text here " * 30), (1, "same text here " * 30), (None, "same text here " * 30), (None, None), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 5
    assert {r.component for r in simhash.near_duplicates(docs).where("fp <> 0").collect()} == {1, 2}
    assert simhash.keep_one_of_each(docs).count() == 3
    cut = substrings.remove_repeats(docs).where(F.col("n_words") == 90).collect()
    assert [r.n_removed for r in cut] == [90, 90, 90]
    found, _ = packing.pack(docs)
    assert found.select("task", "row").distinct().count() == 5


@pytest.mark.parametrize("with_ids", [True, False])
def test_a_full_piece_table_forgets_and_stays_right(with_ids):
    from veilframe.llm.pieces import PieceTable, load_tokenizer

    tokenizer = load_tokenizer("byte_bpe_50k.json")
    table = PieceTable(tokenizer, with_ids, entries=60)
    rng = random.Random(5)
    for _ in range(40):
        texts = [" ".join(f"the of and {rng.randrange(400)}x{rng.choice('abc')}" for _ in range(rng.randrange(6))) for _ in range(4)]
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        counts, offsets, ids = table.texts(raw, at)
        assert counts.tolist() == [len(w) for w in want]
        if with_ids:
            assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(4)] == want
    assert len(table.keys) < 200
