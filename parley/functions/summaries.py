"""Structured summaries: nested sections and blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import let, section_key

BLOCK = "struct<id:string,type:string,content:string,color:string>"
SECTION = f"struct<title:string,blocks:array<{BLOCK}>>"
SUMMARY = f"struct<MeetingName:string,People:{SECTION},NextSteps:{SECTION},MeetingNotes:struct<meeting_name:string,sections:array<{SECTION}>>>"
#: Status names that count as processing (fixed values).
RUNNING = ("processing", "pending", "started")


def unwrapped(c: Column, schema: str) -> Column:
    """A JSON column read as `schema`, encoded once or twice; anything but an object is null."""
    inner = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string").getField("v")
    once = F.when(F.trim(c).startswith("{"), c)
    twice = F.when(F.trim(c).startswith('"') & F.trim(inner).startswith("{"), inner)
    return F.from_json(F.coalesce(once, twice), schema)


def shown_status(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low.isin(*RUNNING), "processing").when(low == "failed", "error").otherwise(low)


def section_keys(titles: Column) -> Column:
    """Snake-case keys; a key that was there before gets its position."""
    base = F.transform(titles, lambda x: section_key(x))
    return let(base, lambda keys: F.transform(keys, lambda k, i: F.when(F.array_position(keys, k) <= i, F.concat(k, F.lit("_"), i)).otherwise(k)))


def with_defaults(blocks: Column) -> Column:
    """Blocks with an id from their position, type, colour and trimmed content where these are missing."""
    full = lambda c, other: F.when((c.isNull()) | (c == ""), other).otherwise(c)
    return F.transform(
        blocks,
        lambda b, i: F.struct(
            full(b["id"], F.concat(F.lit("block-"), i)).alias("id"),
            full(b["type"], F.lit("paragraph")).alias("type"),
            F.coalesce(F.trim(b["content"]), F.lit("")).alias("content"),
            full(b["color"], F.lit("default")).alias("color"),
        ),
    )


def to_markdown(title: Column, blocks: Column) -> Column:
    """One section: headings, bullets and paragraphs; an empty line after a section with bullets."""
    line = lambda b: (
        F.when(b["type"] == "heading1", F.concat(F.lit("### "), b["content"], F.lit("\n\n")))
        .when(b["type"] == "heading2", F.concat(F.lit("#### "), b["content"], F.lit("\n\n")))
        .when(b["type"] == "bullet", F.concat(F.lit("- "), b["content"], F.lit("\n")))
        .otherwise(F.concat(b["content"], F.lit("\n\n")))
    )
    tail = F.when(F.exists(blocks, lambda b: b["type"] == "bullet"), "\n").otherwise("")
    return F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform(blocks, line), ""), tail)


def block_range(ids: Column, first: Column, last: Column) -> Column:
    """The ids from one to the other, both included, in either order; empty if one isn't there."""
    a, b = F.array_position(ids, first), F.array_position(ids, last)
    low = F.least(a, b).cast("int")
    return F.when(low > 0, F.slice(ids, low, (F.greatest(a, b) - F.least(a, b) + 1).cast("int"))).otherwise(F.array().cast("array<string>"))


def template_text(sections: Column) -> tuple[Column, Column]:
    """(skeleton, instructions) of a template's sections (title, instruction, item_format)."""
    skeleton = F.concat(F.lit("# <Add Title here>\n\n"), F.array_join(F.transform(sections, lambda s: F.concat(F.lit("**"), s["title"], F.lit("**\n\n"))), ""))
    item = lambda s: F.when(s["item_format"].isNotNull(), F.concat(F.lit("  - Items in this section should follow the format: `"), s["item_format"], F.lit("`.\n"))).otherwise("")
    each = F.transform(sections, lambda s: F.concat(F.lit("- **For the '"), s["title"], F.lit("' section:** "), s["instruction"], F.lit(".\n"), item(s)))
    return skeleton, F.array_join(each, "")


def template_problem(name: Column, sections: Column) -> Column:
    """What is wrong with a template, null if nothing."""
    return (
        F.when(name == "", "empty name")
        .when(F.size(sections) == 0, "no section")
        .when(F.exists(sections, lambda s: s["title"] == ""), "empty title")
        .when(F.exists(sections, lambda s: s["instruction"] == ""), "empty instruction")
        .when(~F.forall(sections, lambda s: s["format"].isin("paragraph", "list", "string")), "bad format")
    )


def first_key(values: Column, keys: list[Column], default: int) -> Column:
    """The first of `keys` whose value in the map is a whole number."""
    return F.coalesce(*(F.try_element_at(values, k).try_cast("long") for k in keys), F.lit(default))
