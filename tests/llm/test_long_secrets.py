"""Secrets of any length are candidates as a whole."""

from pyspark.sql import functions as F

from veilframe.llm import pii


def test_long_secrets_are_whole(spark):
    secrets = ["token=" + "aB3." * 250, "password: " + "x9" * 500, "api_key=" + "k7" * 50_000, "secret=" + ":" * 50_000]
    docs = spark.createDataFrame([(i, f"see {s} end") for i, s in enumerate(secrets)], "doc_id long, text string")
    found = pii.candidates(docs).select("id", F.explode("found").alias("c")).where("c.kind = 'secret'").collect()
    assert sorted(r.id for r in found) == list(range(len(secrets)))
    for r in found:
        assert (r.c.first, r.c.last) == (4, 4 + len(secrets[r.id]))
        assert r.c.votes[4] == 0
        assert r.c.votes[0] == (-1 if r.id == 3 else 1)
