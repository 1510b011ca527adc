"""Token numbering and text replacement as array expressions over one text's spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import bound, counts_until, cut, group_starts, running_sum, text_blocks
from veilframe.functions.spans import span_struct

TOKEN_PATTERN = r"\[[A-Za-z][A-Za-z0-9_]*_\d+\]"
# Tokens in JSON text that are not part of an object key.
JSON_TOKEN_PATTERN = TOKEN_PATTERN + r'(?!(?:[^"\\]|\\.)*+"\s*+:)'


def representatives(spans: Column) -> Column:
    """One entry per distinct text, sorted by (type, order seen from the end of the text).

    Equal texts are neighbours once the findings are sorted by text and place.
    """
    seen = F.sort_array(F.transform(
        F.reverse(spans),
        lambda s, i: F.struct(
            s["text"].alias("text"), i.cast("int").alias("seq"), s["pii_type"].alias("pii_type"), s["confidence"].alias("confidence")),
    ))
    first = bound(seen, lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~x["text"].eqNullSafe(F.get(all_, i - 1)["text"])))
    return F.sort_array(F.transform(
        first, lambda x: F.struct(x["pii_type"].alias("pii_type"), x["seq"].alias("seq"), x["text"].alias("text"), x["confidence"].alias("confidence"))))


MAPPING = "struct<token:string,original:string,pii_type:string,confidence:double>"
MAPPINGS = f"array<{MAPPING}>"


def number_tokens(reps: Column) -> Column:
    """Mappings (token, original, pii_type, confidence) from sorted representatives."""

    def numbered(all_: Column) -> Column:
        def mapping(r: Column, first: Column, i: Column) -> Column:
            token = F.concat(F.lit("["), r["pii_type"], F.lit("_"), (i - first + 1).cast("string"), F.lit("]"))
            return F.struct(token.alias("token"), r["text"].alias("original"), r["pii_type"].alias("pii_type"), r["confidence"].alias("confidence")).cast(MAPPING)

        starts = group_starts(all_, lambda before, r: ~before["pii_type"].eqNullSafe(r["pii_type"]))
        return bound(starts, lambda first: F.transform(all_, lambda r, i: mapping(r, F.get(first, i), i)))

    return bound(reps, numbered)


def span_tokens(spans: Column, mappings: Column) -> Column:
    """The token of each span, by its text; null where the mappings lack it (the first of several counts).

    Mappings and spans are sorted by text together: a text's first entry is its mapping, if it has one. Then the spans
    are put back in order.
    """
    marks = F.concat(
        F.transform(mappings, lambda m, i: F.struct(
            m["original"].alias("text"), F.lit(0).alias("kind"), i.cast("int").alias("i"), m["token"].alias("token"))),
        F.transform(spans, lambda s, i: F.struct(
            s["text"].alias("text"), F.lit(1).alias("kind"), i.cast("int").alias("i"), F.lit(None).cast("string").alias("token"))),
    )

    def filled(all_: Column) -> Column:
        def token(m: Column, first: Column) -> Column:
            head = F.get(all_, first)
            return F.struct(m["i"].alias("i"), F.when(head["kind"] == 0, head["token"]).alias("token"))

        def of_spans(first: Column) -> Column:
            found = F.transform(all_, lambda m, i: F.when(m["kind"] == 1, token(m, F.get(first, i))))
            return F.transform(F.sort_array(F.filter(found, lambda x: x.isNotNull())), lambda x: x["token"])

        return bound(group_starts(all_, lambda before, m: ~before["text"].eqNullSafe(m["text"])), of_spans)

    return bound(F.sort_array(marks), filled)


def replace_spans(text: Column, spans: Column, mappings: Column) -> Column:
    """Text with every span replaced by the token of its original."""

    def with_blocks(b: Column) -> Column:
        last_end = lambda i: F.coalesce(F.get(b["spans"], i)["end"], F.lit(0))
        pieces = F.transform(b["spans"], lambda s, i: F.concat(
            cut(b["blocks"], last_end(i - 1), s["start"]), F.coalesce(F.get(b["tokens"], i), s["text"])))
        return F.concat(F.array_join(pieces, ""), cut(b["blocks"], last_end(F.size(b["spans"]) - 1), F.length(text)))

    parts = F.struct(text_blocks(text).alias("blocks"), spans.alias("spans"), span_tokens(spans, mappings).alias("tokens"))
    return F.when(F.size(spans) == 0, text).otherwise(bound(parts, with_blocks))


def gap(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def part_ranges(parts: Column) -> Column:
    """Character range of every part in the joined text (each part is followed by one line break)."""

    ends = running_sum(F.transform(parts, lambda p: F.length(p["text"]) + 1))
    return F.zip_with(parts, ends, lambda p, e: F.struct((e - 1 - F.length(p["text"])).alias("lo"), (e - 1).alias("hi")))


def _spans_of_ranges(spans: Column, ranges: Column) -> Column:
    """For each range the sorted, disjoint spans that reach into it, found by sweeping borders once."""
    def counted(x: Column) -> Column:
        begun = counts_until(F.transform(x["ranges"], lambda r: r["hi"]), F.transform(x["spans"], lambda s: s["start"]), inclusive=False)
        over = counts_until(F.transform(x["ranges"], lambda r: r["lo"]), F.transform(x["spans"], lambda s: s["end"]), inclusive=True)
        return bound(F.struct(begun.alias("begun"), over.alias("over")), lambda c: F.transform(x["ranges"], lambda r, i: F.slice(
            x["spans"], F.get(c["over"], i) + 1, F.greatest(F.get(c["begun"], i) - F.get(c["over"], i), F.lit(0)))))

    return bound(F.struct(ranges.alias("ranges"), spans.alias("spans")), counted)


def clip_to_parts(text: Column, spans: Column, ranges: Column) -> Column:
    """Spans cut at part borders, so that every piece lies in one part."""

    def pieces(blocks: Column) -> Column:
        def inside(r: Column, hit: Column) -> Column:
            def clip(s: Column) -> Column:
                lo, hi = F.greatest(s["start"], r["lo"]), F.least(s["end"], r["hi"])
                piece = cut(blocks, lo, hi)
                begin = s["byte_start"] + F.octet_length(cut(blocks, s["start"], lo))
                whole = (s["start"] >= r["lo"]) & (s["end"] <= r["hi"])
                return F.when(whole, s).otherwise(span_struct(
                    lo, hi, s["pii_type"], piece, s["confidence"], s["rank"], s["spec"], begin, begin + F.octet_length(piece)))

            return F.transform(hit, clip)

        return F.flatten(F.zip_with(ranges, _spans_of_ranges(spans, ranges), inside))

    return bound(text_blocks(text), pieces)


def replace_in_parts(parts: Column, ranges: Column, text: Column, spans: Column, mappings: Column) -> Column:
    """Parts with tokens in place of their (clipped) findings."""
    filled = F.zip_with(spans, span_tokens(spans, mappings), lambda s, t: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), t.alias("token")))

    def rendered(b: Column) -> Column:
        def render(p: Column, r: Column) -> Column:
            def with_hits(inside: Column) -> Column:
                last_end = lambda i: F.coalesce(F.get(inside, i)["end"], r["lo"])
                pieces = F.transform(inside, lambda s, i: F.concat(cut(b["blocks"], last_end(i - 1), s["start"]), s["token"]))
                return F.concat(F.array_join(pieces, ""), cut(b["blocks"], last_end(F.size(inside) - 1), r["hi"]))

            return F.struct(p["message"].alias("message"), p["part"].alias("part"), bound(r["inside"], with_hits).alias("text"))

        ranged = F.zip_with(ranges, b["inside"], lambda r, i: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), i.alias("inside")))
        return F.zip_with(parts, ranged, render)

    return bound(F.struct(text_blocks(text).alias("blocks"), _spans_of_ranges(filled, ranges).alias("inside")), rendered)
