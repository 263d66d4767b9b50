"""What a message leaves open, as rows (gap_id, locator): one channel for all stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postern.operators import bodies, parse, quotes

#: Arrays of the wide row that the gaps are told from.
WANT = ("parts", "views", "references", "header_gaps", "html_gaps", "container_gaps")
TOP = "1"


def _pair(gap: str | Column, locator: Column) -> Column:
    return F.struct((F.lit(gap) if isinstance(gap, str) else gap).alias("gap_id"), locator.alias("locator"))


def in_row() -> Column:
    """The gaps that one wide row tells by itself: of headers, of the container, and of its bodies. Nothing is shuffled for them.

    Bodies: text declared as flowed that is not reflowed, a digest's child that declares no type, HTML that names remote content
    or holds data, a ``cid:`` that no part carries, and a message none of whose parts reads as text.
    """
    each = lambda name, f: F.transform(name, f)
    at = lambda name, gap, rule: F.transform(F.filter(name, rule), lambda x: _pair(gap, x["path"]))
    carried = F.transform(F.filter("parts", lambda p: p["content_id"].isNotNull()), lambda p: bodies.bare_cid(p["content_id"]))
    silent = F.when((F.size("parts") > 0) & ~F.exists("parts", lambda p: p["used_charset"].isNotNull()), F.array(_pair("body.no_text_part", F.get("parts", 0)["path"])))
    of_html = lambda gap, rule: F.array_distinct(at("references", gap, rule))
    known = [
        each("header_gaps", lambda g: _pair(g, F.lit(TOP))),
        each("container_gaps", lambda g: _pair(g["gap_id"], F.lit(TOP))),
        each("html_gaps", lambda g: _pair(g["gap_id"], g["path"])),
        at("parts", "body.flowed_reflow_unresolved", lambda p: p["flowed"]),
        at("parts", "body.digest_default_not_applied", lambda p: p["declared_mime"].isNull() & (p["effective_type"] == "message/rfc822")),
        of_html("security.remote_content_present", lambda r: r["kind"] == "remote"),
        of_html("body.inline_data_uri", lambda r: r["kind"] == "data"),
        at("references", "attach.cid_dangling", lambda r: (r["kind"] == "cid") & ~F.array_contains(carried, r["target"])),
        F.coalesce(silent, F.array().cast("array<struct<gap_id:string,locator:string>>")),
        F.flatten(each("parts", lambda p: F.transform(p["gaps"], lambda g: _pair(g, p["path"])))),
    ]
    return reduce(F.concat, known)


def all_gaps(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, gap_id, locator) of every stage; ``parsed`` needs the arrays in WANT, written once as several relations read them. Locators are part paths, several of them joined where a gap concerns several parts."""
    own = parsed.select(*keys, F.inline(in_row()))
    parts, views, references = (parse.rows_of(parsed, name, *keys) for name in ("parts", "views", "references"))
    found = bodies.attachments(parts, *keys)
    attached = bodies.attachment_gaps(found, bodies.cid_use(found, references, *keys), *keys)
    lines = quotes.lines_of(views.where("media = 'text/plain'"), *keys, "path")
    plain = quotes.view_gaps(lines, quotes.boundaries(lines, *keys, "path"), *keys, "path").select(*keys, "gap_id", F.col("path").alias("locator"))
    return own.unionByName(attached).unionByName(plain)
