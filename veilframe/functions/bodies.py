"""Chat bodies: texts of messages and prompt, and putting replaced texts back.

``content`` may be a string or a list of parts, so it is parsed as VARIANT and its kind is
looked at. Everything stays in one row; unknown keys of a body survive a rebuild.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import bound, counts_until

PART = "struct<message:int,part:int,role:string,kind:string,text:string>"
PARTS = f"array<{PART}>"
_BODY = "messages array<map<string,variant>>, prompt variant, model variant, stream variant"


def _text_of(value: Column) -> Column:
    """The string in a variant, null for any other kind."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _is_list(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def parse_body(body: Column) -> Column:
    return F.from_json(body, _BODY)


def model_of(body: Column) -> Column:
    return _text_of(parse_body(body)["model"])


def is_stream(body: Column) -> Column:
    return F.coalesce(F.try_variant_get(parse_body(body)["stream"], "$", "boolean"), F.lit(False))


def text_parts(body: Column) -> Column:
    """Every text of a body in order; ``message`` is -1 for the prompt, ``part`` -1 for plain content."""

    def of_message(m: Column, i: Column) -> Column:
        content, role = m["content"], F.coalesce(_text_of(m["role"]), F.lit(""))

        def of_part(p: Column, j: Column) -> Column:
            return F.struct(
                i.cast("int").alias("message"), j.cast("int").alias("part"), role.alias("role"),
                _text_of(F.try_variant_get(p, "$.type", "variant")).alias("kind"),
                _text_of(F.try_variant_get(p, "$.text", "variant")).alias("text"),
            ).cast(PART)

        plain = F.array(F.struct(
            i.cast("int").alias("message"), F.lit(-1).alias("part"), role.alias("role"),
            F.lit("text").alias("kind"), _text_of(content).alias("text"),
        ).cast(PART))
        listed = F.transform(F.try_variant_get(content, "$", "array<variant>"), of_part)
        return F.when(_is_list(content), listed).otherwise(plain)

    def collect(b: Column) -> Column:
        prompt = F.array(F.struct(
            F.lit(-1).alias("message"), F.lit(-1).alias("part"), F.lit("").alias("role"),
            F.lit("text").alias("kind"), _text_of(b["prompt"]).alias("text"),
        ).cast(PART))
        messages = F.coalesce(F.flatten(F.transform(b["messages"], of_message)), F.array().cast(PARTS))
        return F.filter(F.concat(messages, prompt), lambda p: p["text"].isNotNull())

    return F.aggregate(F.array(parse_body(body)), F.array().cast(PARTS), lambda _, b: collect(b))


def extract_text(parts: Column) -> Column:
    """All texts, each followed by a line break."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit("\n"))), "")


def extract_user_text(body: Column, parts: Column) -> Column:
    """Texts of user messages joined by line breaks; null without a user message."""
    roles = F.transform(parse_body(body)["messages"], lambda m: _text_of(m["role"]))
    texts = F.filter(parts, lambda p: (p["role"] == "user") & (p["message"] >= 0) & (p["kind"] == "text"))
    joined = F.array_join(F.filter(F.transform(texts, lambda p: p["text"]), lambda t: t != ""), "\n")
    return F.when(F.array_contains(roles, "user"), joined)


def json_string(text: Column) -> Column:
    """A text as a quoted JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(entries: Column, value_of) -> Column:
    fields = F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), value_of(e)))
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}"))


def rebuild_body(body: Column, replaced: Column) -> Column:
    """The body with its texts taken from ``replaced`` (same layout as ``text_parts``)."""

    # Where each message's parts begin among the replaced ones; a prompt (message -1) stands after all.
    numbers = F.filter(F.transform(replaced, lambda r: r["message"]), lambda m: m >= 0)
    begins = bound(numbers, lambda n: F.when(F.size(n) > 0, counts_until(F.sequence(F.lit(0), F.array_max(n) + 1), n, inclusive=False)))
    layout = F.struct(replaced.alias("parts"), begins.alias("begins"))
    return bound(layout, lambda x: _rebuilt(body, x["parts"], x["begins"]))


def _rebuilt(body: Column, replaced: Column, begins: Column) -> Column:
    def new_text(message: Column, part: Column) -> Column:
        begin = F.get(begins, message)
        own = F.slice(replaced, begin + 1, F.get(begins, message + 1) - begin)
        return F.get(F.filter(own, lambda r: r["part"] == part), 0)["text"]

    def content(value: Column, i: Column) -> Column:
        def part_json(p: Column, j: Column) -> Column:
            entries = F.map_entries(F.try_variant_get(p, "$", "map<string,variant>"))
            rebuilt = _object(entries, lambda e: F.when(
                (e["key"] == "text") & new_text(i, j).isNotNull(), json_string(new_text(i, j))
            ).otherwise(F.to_json(e["value"])))
            return F.coalesce(rebuilt, F.to_json(p))

        listed = F.concat(
            F.lit("["), F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), part_json), ","),
            F.lit("]"),
        )
        plain = F.coalesce(json_string(new_text(i, F.lit(-1))), F.to_json(value))
        return F.when(_is_list(value), listed).otherwise(plain)

    def message_json(m: Column, i: Column) -> Column:
        return _object(F.map_entries(m), lambda e: F.when(
            e["key"] == "content", content(e["value"], i.cast("int"))).otherwise(F.to_json(e["value"])))

    def value_json(e: Column) -> Column:
        messages = F.try_variant_get(e["value"], "$", "array<map<string,variant>>")
        rebuilt = F.concat(F.lit("["), F.array_join(F.transform(messages, message_json), ","), F.lit("]"))
        prompt = F.get(F.filter(replaced, lambda r: r["message"] == -1), 0)["text"]
        return (
            F.when((e["key"] == "messages") & messages.isNotNull(), rebuilt)
            .when((e["key"] == "prompt") & prompt.isNotNull(), json_string(prompt))
            .otherwise(F.to_json(e["value"]))
        )

    top = F.map_entries(F.from_json(body, "map<string,variant>"))
    return F.coalesce(_object(top, value_json), body)
