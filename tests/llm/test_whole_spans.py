"""License notices over several lines."""

import textwrap

from veilframe.llm import licenses


def test_notices_wrapped_over_lines(spark):
    texts = [
        "filler words\n" * 90 + "\n".join(f" * {line}" for line in textwrap.wrap(text, 60)) + "\nother words" * 90
        for _, text in licenses.TEMPLATES
    ]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels and got[i].score == 1.0
    # Words of a template that are further apart than a block are no notice.
    far = ("\nfiller" * 200 + "\n").join(licenses.TEMPLATES[6][1].split())
    assert licenses.scan(spark.createDataFrame([(0, far)], "doc_id long, text string")).first().labels == []


def test_blocks_grow_with_templates(spark):
    template = " ".join(f"t{i}" for i in range(300))
    docs = spark.createDataFrame([(0, "filler\n" * 70 + template.replace(" ", "\n"))], "doc_id long, text string")
    assert licenses.scan(docs, templates=[("long", template)]).first().labels == ["long"]
