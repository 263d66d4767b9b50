"""Lines, ``>`` depths and reply quoting of plain views, in windows over (keys, path) by line: one exchange for all rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space as Unicode text has it; Java's \\s is ASCII.
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
LABELS = {
    "en": ("From", "Sent|Date", "To", "Cc", "Subject"),
    "de": ("Von", "Gesendet|Datum", "An", "Cc", "Betreff"),
    "fr": ("De", "Envoyé|Envoyé|Date", "À|À", "Cc", "Objet"),
}
FORWARD, DASHES = "Begin forwarded message:", "-----Original Message-----"
SUBSCRIBED = "You received this message because you are subscribed"


def lines_of(views: DataFrame, *keys: str) -> DataFrame:
    """Lines of ``text``: line_no, line, start, content_end, term_end (code points), depth, blank. CRLF, LF and a lone CR end a line."""
    each = views.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit("[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+"), F.lit(0))).alias("line_no", "full"))
    order = W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    line = F.regexp_replace("full", "[\\r\\n]+$", "")
    out = each.withColumns({"term_end": F.sum(F.length("full")).over(order), "line": line})
    out = out.withColumn("start", F.col("term_end") - F.length("full"))
    return out.select(*keys, "line_no", "line", "start", (F.col("start") + F.length("line")).alias("content_end"), "term_end", depth_of(F.col("line")).alias("depth"), F.col("line").rlike(f"^{SPACE}*$").alias("blank"))


def depth_of(line: Column) -> Column:
    """``>`` marks from column 0, blanks and tabs between them."""
    return F.length(F.regexp_replace(F.regexp_extract(line, "^(?:>[ \\t]*+)*+", 0), "[^>]", "")).cast("int")


def runs_of(lines: DataFrame, inside: Column, *keys: str) -> Column:
    """A number that is constant in each run of neighbouring lines with equal ``inside``."""
    order = W.partitionBy(*keys).orderBy("line_no")
    begins = (inside != F.coalesce(F.lag(inside).over(order), ~inside)).cast("int")
    return F.sum(begins).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))


def boundaries(lines: DataFrame, *keys: str) -> DataFrame:
    """Quote, forward, signature and footer boundaries of each view, in order: rule_id, kind, ordinal, prefix_depth, span."""
    view = W.partitionBy(*keys)
    order = view.orderBy("line_no")
    before = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    trimmed = F.regexp_replace("line", f"{SPACE}+$", "")
    wrote = trimmed.endswith("wrote:")
    slot = {lang: reduce(lambda a, k: a.when(F.col("line").rlike(f"^(?:{LABELS[lang][k]}){SPACE}*:"), k), range(1, 5), F.when(F.col("line").rlike(f"^(?:{LABELS[lang][0]}){SPACE}*:"), 0)) for lang in LABELS}
    rows = lines.withColumns({
        "n_lines": F.count("*").over(view),
        "last_end": F.max("term_end").over(view),
        "forward": F.when(trimmed == FORWARD, "forward_banner").when(trimmed == DASHES, "original_message_dashes"),
        "signature": F.when(F.col("line") == "-- ", "dash_dash_space"),
        "footer": F.when(trimmed.rlike("^_{30,}$"), "list_footer_underscores").when(F.col("line").startswith(SUBSCRIBED), "list_footer_subscribed"),
        "on": F.col("line").startswith("On "), "wrote": wrote, "next_wrote": F.coalesce(F.lead(wrote & ~F.col("blank")).over(order), F.lit(False)),
        "label": F.col("line").rlike(f"^[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000:]{{1,15}}{SPACE}*:"),
        "before_end": F.lag("content_end").over(order), **{f"slot_{lang}": c for lang, c in slot.items()},
    })
    # an attribution is one line, or two; the second of two begins none
    rows = rows.withColumn("two", F.col("on") & ~F.col("wrote") & F.col("next_wrote"))
    rows = rows.withColumns({"attribution": ((F.col("on") & F.col("wrote")) | F.col("two")) & ~F.coalesce(F.lag("two").over(order), F.lit(False)), "run": runs_of(rows, F.col("label"), *keys), "gt_run": runs_of(rows, F.col("depth") > 0, *keys)})
    run = W.partitionBy(*keys, "run")
    inside = run.orderBy("line_no")
    rows = rows.withColumns({f"bad_{lang}": (F.col(f"slot_{lang}").isNull() | (F.col(f"slot_{lang}") < F.coalesce(F.lag(f"slot_{lang}").over(inside), F.lit(0)))).cast("int") for lang in LABELS})
    whole = {lang: (F.max(f"bad_{lang}").over(run) == 0) & (F.count("*").over(run) > 1) & F.col("label") for lang in LABELS}
    flat = F.when(F.row_number().over(inside) == 1, F.coalesce(*[F.when(whole[lang], f"outlook_flat_{lang}") for lang in LABELS]))
    rows = rows.withColumn("flat", flat)
    rows = rows.withColumn("structural", F.coalesce("forward", "signature", "footer").isNotNull())
    rows = rows.withColumns({"segment": F.sum((F.col("structural") | F.col("attribution") | F.col("flat").isNotNull()).cast("int")).over(before), "forwards": F.count("forward").over(before)})
    stop = F.when(F.col("blank") | F.col("structural"), F.struct("line_no", "before_end"))
    rows = rows.withColumns({"stop_1": F.first(stop, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)), "stop_2": F.first(stop, ignorenulls=True).over(order.rowsBetween(2, W.unboundedFollowing))})

    def extent(part: str) -> Column:
        """Last line and end of a span that runs to the next line that begins a part, or to the end of the view."""
        ends = W.partitionBy(*keys, part)
        last_part = F.max(part).over(view) == F.col(part)
        text = F.when(~F.col("blank"), F.struct("line_no", "content_end"))
        return F.when(last_part, F.struct((F.col("n_lines") - 1).cast("int").alias("last"), F.col("last_end").alias("end"))).otherwise(F.struct(F.max(text).over(ends).getField("line_no").alias("last"), F.max(text).over(ends).getField("content_end").alias("end")))

    stop_at = F.when(F.col("two"), F.col("stop_2")).otherwise(F.col("stop_1"))
    to_end = F.struct((F.col("n_lines") - 1).cast("int").alias("last"), F.col("last_end").alias("end"))
    block = F.when(stop_at.isNull(), to_end).otherwise(F.struct((stop_at.line_no - 1).alias("last"), stop_at.before_end.alias("end")))
    rows = rows.withColumns({"segment_end": extent("segment"), "forward_end": extent("forwards"), "block_end": block, "to_end": to_end})
    # quotes whose extent takes in the runs of > marks inside
    reach = F.greatest(F.when(F.col("attribution"), F.col("block_end.last")), F.when(F.col("flat").isNotNull(), F.col("segment_end.last")))
    gt = W.partitionBy(*keys, "gt_run")
    rows = rows.withColumns({"reach": F.max(reach).over(before), "gt_last": F.max("line_no").over(gt), "gt_end": F.when(F.max("line_no").over(gt) == F.col("n_lines") - 1, F.col("last_end")).otherwise(F.max("content_end").over(gt)), "gt_first": F.min("line_no").over(gt) == F.col("line_no")})
    rows = rows.withColumn("marks", (F.col("depth") > 0) & F.col("gt_first") & (F.coalesce("reach", F.lit(-1)) < F.col("gt_last")))
    span = lambda rule, kind, ext: F.struct(rule.alias("rule_id"), F.lit(kind).alias("kind"), ext.last.alias("last"), ext.end.alias("end"))
    found = F.filter(F.array(
        F.when(F.col("attribution"), span(F.lit("on_wrote_en"), "quote", F.col("block_end"))),
        F.when(F.col("flat").isNotNull(), span(F.col("flat"), "quote", F.col("segment_end"))),
        F.when(F.col("forward").isNotNull(), span(F.col("forward"), "forward", F.col("forward_end"))),
        F.when(F.col("signature").isNotNull(), span(F.col("signature"), "signature", F.col("to_end"))),
        F.when(F.col("footer").isNotNull(), span(F.col("footer"), "list_footer", F.col("to_end"))),
        F.when(F.col("marks"), span(F.lit("gt_family"), "quote", F.struct(F.col("gt_last").alias("last"), F.col("gt_end").alias("end")))),
    ), lambda x: x.isNotNull())
    hits = rows.select(*keys, "line_no", "start", F.inline(found))
    hits = hits.withColumn("ordinal", F.when(F.col("kind") == "quote", F.count_if(F.col("kind") == "quote").over(view.orderBy("start", "end", "rule_id"))).otherwise(0).cast("int"))
    depths = lines.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "depth"))), lambda x: x.depth).alias("depths"))
    return hits.join(depths, list(keys)).select(*keys, "rule_id", "kind", "ordinal", F.slice("depths", F.col("line_no") + 1, F.col("last") - F.col("line_no") + 1).alias("prefix_depth"), "start", (F.col("end") - F.col("start")).alias("size"))


def levels(lines: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Per view with a boundary or a mark: level (deepest of ordinals and marks), the rule that decided it, and whether both disagree."""
    deepest = lines.groupBy(*keys).agg(F.max("depth").alias("max_depth"))
    place = F.struct("start", F.col("start") + F.col("size"), "rule_id")
    quote = F.col("kind") == "quote"
    rules = found.groupBy(*keys).agg(F.max("ordinal").alias("max_ordinal"), F.min_by("rule_id", F.when(quote & (F.col("rule_id") != "gt_family"), place)).alias("by_rule"), F.max(quote.cast("int")).alias("quotes"), F.min_by("rule_id", place).alias("any_rule"))
    both = deepest.join(rules, list(keys), "left").where("max_depth > 0 or any_rule is not null")
    depth, ordinal = F.col("max_depth"), F.coalesce("max_ordinal", F.lit(0))
    rule = F.coalesce("by_rule", F.when(F.col("quotes") == 1, "gt_family"), "any_rule", F.lit("gt_family"))
    return both.select(*keys, F.greatest(ordinal, depth).alias("level"), rule.alias("resolution_rule_id"), ((depth > 0) & (ordinal > 0) & (depth != ordinal)).alias("disagreement"))


def view_gaps(lines: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """(keys, gap_id) of plain views: no boundary of any kind, a block of labels in a language that no rule knows, answers between quotes, levels that disagree."""
    view = W.partitionBy(*keys)
    order = view.orderBy("line_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    trimmed = F.regexp_replace("line", f"{SPACE}+$", "")
    label = F.col("line").rlike(f"^[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000:]{{1,15}}{SPACE}*:")
    known = {lang: F.col("line").rlike(f"^(?:{'|'.join(heads)}){SPACE}*:") for lang, heads in LABELS.items()}
    looking = ~F.col("blank") & ~label & trimmed.endswith(":") & trimmed.rlike(f"[^\\s]{SPACE}+[^\\s]")
    rows = lines.withColumns({"label": label, "looking": looking, **{f"is_{k}": c for k, c in known.items()}})
    rows = rows.withColumns({
        "run": runs_of(rows, F.col("label"), *keys), "after": F.coalesce(F.lag("looking").over(order), F.lit(False)),
        "last_quote": F.max(F.when(F.col("depth") > 0, F.col("line_no"))).over(before), "last_text": F.max(F.when((F.col("depth") == 0) & ~F.col("blank"), F.col("line_no"))).over(before),
    })
    run = W.partitionBy(*keys, "run")
    foreign = reduce(lambda a, b: a & b, [~F.min(f"is_{k}").over(run) for k in LABELS])
    rows = rows.withColumn("i18n", F.col("label") & (F.min("line_no").over(run) == F.col("line_no")) & (F.count("*").over(run) > 1) & foreign & F.col("after"))
    told = rows.groupBy(*keys).agg(F.max("i18n").alias("i18n"), F.max((F.col("depth") > 0) & (F.col("last_text") > F.col("last_quote"))).alias("between"), F.max("depth").alias("deepest"))
    told = told.join(found.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal")), list(keys), "left")
    none = F.col("n").isNull() & (F.col("deepest") == 0) & ~F.col("i18n")
    disagree = (F.col("deepest") > 0) & (F.col("ordinal") > 0) & (F.col("deepest") != F.col("ordinal"))
    gaps = {"body.no_boundary_found": none, "body.i18n_reply_marker": F.col("i18n"), "body.inline_reply_interleaved": F.coalesce("between", F.lit(False)), "view.quote_level_disagreement": F.coalesce(disagree, F.lit(False))}
    return told.select(*keys, F.explode(F.array_compact(F.array(*[F.when(c, g) for g, c in gaps.items()]))).alias("gap_id"))
