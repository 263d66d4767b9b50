"""Body views, selection, attachments and their verdicts, as relations over the part table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from postern.operators.quotes import SPACE

#: Signatures, and the containers that declared types are.
MAGIC = (("zip", "504b0304"), ("ole-cfb", "d0cf11e0a1b11ae1"), ("pdf", "255044462d"), ("png", "89504e470d0a1a0a"), ("jpeg", "ffd8ff"), ("gif", "474946383761"), ("gif", "474946383961"), ("rtf", "7b5c727466"), ("gzip", "1f8b08"), ("7z", "377abcaf271c"), ("rar", "526172211a07"))
ZIPPED = ("application/zip", "application/x-zip-compressed", *[f"application/vnd.openxmlformats-officedocument.{k}.{form}" for k, forms in (("spreadsheetml", ("sheet", "template")), ("wordprocessingml", ("document", "template")), ("presentationml", ("presentation", "template"))) for form in forms], *[f"application/vnd.ms-{k}.{form}.macroenabled.12" for k, own in (("excel", "sheet"), ("word", "document"), ("powerpoint", "presentation")) for form in (own, "template")])
COMPOUND = ("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/vnd.ms-outlook", "application/x-ole-storage")
TNEF, MACROS = "789f3e22", (".docm", ".xlsm")


def family_of(mime: Column) -> Column:
    """The kind of container that a declared type claims: its table entry, else its subtype; a claim of plain bytes claims none."""
    bare = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    return F.when((bare == "") | (bare == "application/octet-stream"), F.lit(None)).when(bare.isin(*ZIPPED), "zip").when(bare.isin(*COMPOUND), "ole-cfb").otherwise(F.element_at(F.split(bare, "/"), -1))


def path_order(path: Column) -> Column:
    """Parts in document order: paths as arrays of numbers."""
    return F.transform(F.split(path, r"\."), lambda x: x.cast("int"))


def alternatives(parts: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, group_id): every direct child of a multipart/alternative part."""
    parents = parts.where("content_type = 'multipart/alternative'").select(*keys, F.col("path").alias("group_id"))
    children = parts.select(*keys, "path", F.col("parent_path").alias("group_id"))
    return children.join(parents, [*keys, "group_id"]).select(*keys, "path", "group_id")


def effectively_empty(text: Column) -> Column:
    return text.rlike(f"^{SPACE}*$")


def selection(parts: DataFrame, views: DataFrame, *keys: str) -> DataFrame:
    """State of each body view: selected, alternative_not_selected, or n/a outside alternatives. Plain, then HTML, then calendars; a blank plain view gives way."""
    bodies = parts.where("is_body").select(*keys, "path", F.col("effective_type").alias("media"))
    texts = views.where("media <> 'projection'").select(*keys, "path", effectively_empty(F.col("text")).alias("blank"))
    rows = bodies.join(alternatives(parts, *keys), [*keys, "path"], "left").join(texts, [*keys, "path"], "left")
    rank = F.when(F.col("media") == "text/plain", 1).when(F.col("media") == "text/html", 2).when(F.col("media") == "text/calendar", 3)
    usable = rank.isNotNull() & ~((F.col("media") == "text/plain") & F.coalesce("blank", F.lit(True)))
    order = W.partitionBy(*keys, "group_id").orderBy(F.when(usable, rank).asc_nulls_last(), path_order(F.col("path")))
    state = F.when(F.col("group_id").isNull(), "n/a").when(usable & (F.row_number().over(order) == 1), "selected").otherwise("alternative_not_selected")
    return rows.select(*keys, "path", "media", state.alias("state"))


def magic_of(prefix: Column) -> Column:
    """Type by the first bytes; ``unrecognized`` where no signature fits, null without bytes."""
    found = F.when(prefix.isNull() | (F.octet_length(prefix) == 0), F.lit(None))
    for name, signature in MAGIC:
        size = len(signature) // 2
        found = found.when(F.substring(F.hex(prefix), 1, 2 * size) == signature.upper(), name)
    return found.otherwise("unrecognized")


def dimensions(prefix: Column) -> Column:
    """Width and height of PNG and GIF from 24 bytes."""
    part = lambda at, n: F.substring(F.hex(prefix), 2 * at + 1, 2 * n)
    number = lambda digits: F.conv(digits, 16, 10).cast("int")
    little = lambda at: number(F.concat(part(at + 1, 1), part(at, 1)))
    png, gif = magic_of(prefix) == "png", magic_of(prefix) == "gif"
    return F.when(png & (F.length(prefix) >= 24) & (part(12, 4) == "49484452"), F.struct(number(part(16, 4)).alias("width"), number(part(20, 4)).alias("height"))).when(gif & (F.length(prefix) >= 10), F.struct(little(6).alias("width"), little(8).alias("height")))


def attachments(parts: DataFrame, *keys: str) -> DataFrame:
    """Leaves that are no body view: declared, magic and winning type, whether they disagree, name, size and hash."""
    rows = parts.where("is_leaf and not is_body and coalesce(content_type, '') not like 'multipart/%'")
    rows = rows.withColumns({"magic": magic_of(F.col("prefix")), "declared_family": family_of(F.col("declared_mime"))})
    known = F.col("magic") != "unrecognized"
    role = F.when(F.col("disposition").isin("attachment", "inline"), F.col("disposition")).when(F.col("filename").isNotNull(), "attachment").otherwise("unknown")
    return rows.select(
        *keys, "path", "part_id", "filename", "filename_raw", "filename_state", "filename_reason", "declared_mime", "content_id", "disposition", F.col("declared_cte").alias("cte"), F.col("body_sha256").alias("sha256"), F.col("decoded_size").alias("size"), "magic",
        F.when(known, "magic").when(F.col("declared_mime").isNotNull(), "declared_mime").alias("winner"), F.coalesce(known & F.col("declared_family").isNotNull() & (F.col("magic") != F.col("declared_family")), F.lit(False)).alias("disagreement"), role.alias("role"), F.coalesce(F.substring(F.hex("prefix"), 1, 8) == TNEF.upper(), F.lit(False)).alias("tnef"), dimensions(F.col("prefix")).alias("dimensions"),
    )


def bare_cid(value: Column) -> Column:
    return F.regexp_extract(F.trim(value), r"^<?(.*?)>?$", 1)


def cid_use(found: DataFrame, references: DataFrame, *keys: str) -> DataFrame:
    """Each attachment's content id: referenced, unreferenced, or n/a without one."""
    named = references.where("kind = 'cid'").select(*keys, F.col("target").alias("cid")).distinct().withColumn("seen", F.lit(True))
    rows = found.withColumn("cid", bare_cid(F.col("content_id"))).join(named, [*keys, "cid"], "left")
    return rows.select(*keys, "path", "content_id", F.when(F.col("cid").isNull(), "n/a").when(F.col("seen"), "referenced").otherwise("unreferenced").alias("use"))


def dangling(parts: DataFrame, references: DataFrame, *keys: str) -> DataFrame:
    """References to content ids that no part carries."""
    carried = parts.select(*keys, bare_cid(F.col("content_id")).alias("target")).where("target is not null")
    return references.where("kind = 'cid'").select(*keys, "path", "target").join(carried, [*keys, "target"], "left_anti")


def decorative(found: DataFrame, use: DataFrame, *keys: str) -> DataFrame:
    """Inline 1x1 images that nothing references."""
    rows = found.where("role = 'inline' and magic in ('png', 'gif') and dimensions.width = 1 and dimensions.height = 1")
    return rows.join(use.where("use = 'unreferenced'").select(*keys, "path"), [*keys, "path"], "left_semi").select(*keys, "path", F.lit("inline_unreferenced_tracking_pixel").alias("rule_id"))


def repeated(found: DataFrame, column: str, *keys: str) -> DataFrame:
    """Values that several parts of a message share; the paths in document order."""
    groups = found.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.array_sort(F.collect_list(F.struct(path_order(F.col("path")).alias("o"), "path"))).alias("p"))
    return groups.where(F.size("p") > 1).select(*keys, column, F.array_join(F.transform("p", lambda x: x.path), ", ").alias("locator"))


def payload_budget(found: DataFrame, max_count: int, max_bytes: int, *keys: str) -> DataFrame:
    """Which payloads a reader gets under both budgets, in part order: a refused one uses neither. A fold over one message's attachments."""
    items = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(path_order(F.col("path")).alias("o"), "path", F.coalesce("size", F.lit(0)).alias("size")))).alias("p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"), F.array().cast("array<struct<path:string,refusal:string>>").alias("rows"))

    def step(acc, x):
        why = F.when(acc.n >= max_count, "count_budget").when(acc.bytes + x["size"] > max_bytes, "byte_budget")
        ok = why.isNull()
        return F.struct((acc.n + ok.cast("int")).alias("n"), (acc.bytes + F.when(ok, x["size"]).otherwise(0)).alias("bytes"), F.concat(acc.rows, F.array(F.struct(x.path.alias("path"), why.alias("refusal")))).alias("rows"))

    return items.select(*keys, F.inline(F.aggregate("p", start, step, lambda a: a.rows)))


def attachment_gaps(found: DataFrame, use: DataFrame, *keys: str) -> DataFrame:
    """(keys, gap_id, locator) of the attachment stage. A name is missed only where a message is attached, a reference only where the part is inline."""
    at = lambda df, gap: df.select(*keys, F.lit(gap).alias("gap_id"), F.col("path").alias("locator"))
    macro = (F.col("magic") == "zip") & F.lower("filename").rlike("\\.(docm|xlsm)$")
    rules = {
        "attach.filename_absent": F.col("filename_raw").isNull() & (F.lower("declared_mime") == "message/rfc822"), "attach.type_disagreement": F.col("disagreement"),
        "attach.ole_container_unknown": F.col("magic") == "ole-cfb", "security.macro_present": macro, "attach.tnef_present": F.col("tnef"),
    }
    own = found.select(*keys, F.explode(F.array_compact(F.array(*[F.when(rule, gap) for gap, rule in rules.items()]))).alias("gap_id"), F.col("path").alias("locator"))
    inline = found.where("role = 'inline'").select(*keys, "path")
    rows = own.union(at(use.where("use = 'unreferenced'").join(inline, [*keys, "path"], "left_semi"), "attach.cid_unreferenced"))
    rows = rows.union(repeated(found.withColumn("cid", bare_cid(F.col("content_id"))), "cid", *keys).select(*keys, F.lit("attach.duplicate_content_id"), "locator"))
    return rows.union(repeated(found, "sha256", *keys).select(*keys, F.lit("attach.occurrence_repeated"), "locator"))
