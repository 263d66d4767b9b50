"""Queries over documents, compound files read as messages, quote rules, terms and time evidence, each over a whole table, each with SQL that knows the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.limits import Limits
from postern.operators import bodies, corpus, documents, gaps, outlook, parse, quotes
from postern.plans.mail import table
from postern.shared import cut
from postern.sources import messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CONV = ("conv_id", "turn")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# -- compound files read as messages ---------------------------------------------------------------


def _msg(spark, sf_dir, *want: str) -> DataFrame:
    return parse.parse_messages(outlook.mixed_compound_mail(table(spark, sf_dir, "conversations")), want=want)


PARTS = """
WITH c AS (SELECT conv_id, turn, turn % 4 AS v, conv_id % 2 = 0 AS files, coalesce(text, '') AS text FROM conversations),
leaf AS (
  SELECT conv_id, turn, CASE WHEN files THEN '1.1' ELSE '1' END AS path, CASE v WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html' WHEN 2 THEN 'multipart/alternative' ELSE 'text/plain' END AS content_type,
    CASE v WHEN 0 THEN sha256(text) WHEN 1 THEN sha256('<p>' || text || '</p>') WHEN 3 THEN sha256('') END AS body_sha256, NULL AS filename, NULL AS disposition FROM c
  UNION ALL SELECT conv_id, turn, CASE WHEN files THEN '1.1.1' ELSE '1.1' END, 'text/plain', sha256(text), NULL, NULL FROM c WHERE v = 2
  UNION ALL SELECT conv_id, turn, CASE WHEN files THEN '1.1.2' ELSE '1.2' END, 'text/html', sha256('<p>' || text || '</p>'), NULL, NULL FROM c WHERE v = 2
  UNION ALL SELECT conv_id, turn, '1', 'multipart/mixed', NULL, NULL, NULL FROM c WHERE files
  UNION ALL SELECT conv_id, turn, '1.2', 'text/plain', sha256(text), 'ü "' || turn || '".txt', CASE WHEN turn % 2 = 0 THEN 'inline' ELSE 'attachment' END FROM c WHERE files
  UNION ALL SELECT conv_id, turn, '1.3', 'application/octet-stream', sha256(''), 'inner.msg', 'attachment' FROM c WHERE files
)
"""


@query(PARTS + "SELECT * FROM leaf")
def msg_parts(spark, sf_dir):
    """Parts of compound files: bodies, alternatives, named attachments and an embedded item without bytes of its own."""
    return parse.rows_of(_msg(spark, sf_dir, "parts"), "parts", *CONV).select(*CONV, "path", "content_type", "body_sha256", "filename", "disposition")


@query("""SELECT gap_id, count(*) AS n FROM (SELECT CASE WHEN turn % 3 = 0 THEN 'headers.mapi_header_property_disagree' ELSE 'msg.transport_headers_absent' END AS gap_id FROM conversations) GROUP BY gap_id""")
def msg_gaps(spark, sf_dir):
    return parse.rows_of(_msg(spark, sf_dir, "container_gaps"), "container_gaps", *CONV).groupBy("gap_id").agg(F.count("*").alias("n"))


@query("""SELECT axis, sum(n) AS n FROM (
  SELECT 'stream' AS axis, CAST(sum(CASE WHEN turn % 4 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM conversations
  UNION ALL SELECT 'reencoded', CAST(sum(CASE WHEN turn % 4 IN (0, 2) THEN 1 ELSE 0 END + CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END) AS BIGINT) FROM conversations) GROUP BY axis""")
def msg_sources(spark, sf_dir):
    """Stretches of the projected bytes that a stream of the file stands behind."""
    return parse.rows_of(_msg(spark, sf_dir, "sources"), "sources", *CONV).where("axis <> 'synthetic'").groupBy("axis").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS messages, CAST(0 AS BIGINT) AS untold, CAST(0 AS BIGINT) AS untiled FROM conversations")
def msg_tiling(spark, sf_dir):
    """Each projected byte has one source row, and one region of the walk."""
    rows = _msg(spark, sf_dir, "sources", "regions")
    size = F.get("sources", 0)["size"]
    told = F.transform(F.slice("sources", 2, 1 << 30), lambda r: F.struct(r["at"].alias("at"), r["size"].alias("size")))
    return rows.agg(F.count("*").alias("messages"), F.count_if(~corpus.tiles(told, size)).alias("untold"), F.count_if(~corpus.tiles(F.col("regions"), size)).alias("untiled"))


@query("""SELECT conv_id, turn, unnest(['msg.property_tag_unknown', 'msg.named_property_unresolved', 'msg.codepage_unresolved_ladder_used', 'msg.recipient_table_unreadable'][1 + k : 1 + k] || CASE WHEN turn % 4 = 3 THEN ['msg.embedded_depth_cap'] ELSE [] END) AS gap_id
  FROM (SELECT conv_id, turn, conv_id % 5 - 1 AS k FROM conversations)""")
def msg_observations(spark, sf_dir):
    """What properties leave open: tags, named properties, pages, recipients, and messages below the first level."""
    raw = outlook.nested_compound_mail(table(spark, sf_dir, "conversations"))
    return parse.rows_of(parse.parse_messages(raw, want=("container_gaps",)), "container_gaps", *CONV).select(*CONV, "gap_id")


@query("""SELECT conv_id, turn, 'IPM.Note' AS message_class, 'inner ' || turn AS subject, turn % 2 = 1 AS has_transport, CAST(turn % 3 AS INTEGER) AS n_recipients, CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS n_attachments, CASE WHEN turn % 4 = 3 THEN 0 END AS nested FROM conversations""")
def msg_embedded(spark, sf_dir):
    """Messages attached to messages, summarised one level deep."""
    raw = outlook.nested_compound_mail(table(spark, sf_dir, "conversations"))
    return parse.rows_of(outlook.parse_compound(raw), "embedded", *CONV).drop("ordinal")


# -- documents -------------------------------------------------------------------------------------


def _mixed(spark, sf_dir) -> DataFrame:
    """Compound files and plain messages of one table, with a cap that some parts meet."""
    rows = table(spark, sf_dir, "conversations")
    both = outlook.mixed_compound_mail(rows.where("turn % 2 = 0")), messages.conversation_mail(rows).where("turn % 2 = 1")
    files, plain = (parse.parse_messages(x, SMALL, want=("parts", "views", "caps", "regions")) for x in both)
    return files.unionByName(plain)


SMALL = Limits(max_decoded_part_bytes=400)


@query("""
WITH t AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\\r?\\n', chr(13) || chr(10), 'g') AS body, coalesce(text, '') AS own FROM conversations),
m AS (SELECT a.*, strlen(a.body) + CASE WHEN b.body IS NULL THEN 0 ELSE strlen(chr(13) || chr(10) || chr(13) || chr(10) || 'On Tuesday, ' || b.role || ' wrote:' || chr(13) || chr(10) || '> ' || replace(b.body, chr(13) || chr(10), chr(13) || chr(10) || '> ')) END AS n
  FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
x AS (SELECT turn % 2 = 0 AS cfb, CASE WHEN turn % 2 = 1 THEN n > 400 WHEN turn % 4 = 0 AND conv_id % 2 = 1 THEN strlen(own) > 400 ELSE false END AS capped FROM m)
SELECT CASE WHEN cfb THEN 'cfb_msg' ELSE 'eml' END AS container_kind, CASE WHEN capped THEN 'skipped' ELSE 'parsed' END AS status, CASE WHEN capped THEN 'size_cap' END AS reason, count(*) AS n FROM x GROUP BY ALL
""")
def document_status(spark, sf_dir):
    """Documents by kind and status: a message whose own part met a cap was not read to its end."""
    return documents.assemble(_mixed(spark, sf_dir), SMALL, *CONV).groupBy("container_kind", "status", "reason").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS documents, count(*) AS read_back, CAST(0 AS BIGINT) AS faults, CAST(0 AS BIGINT) AS differ, count(*) AS unknown_found FROM conversations")
def document_codec(spark, sf_dir):
    """Every document survives its JSON form; a field that the schema lacks is found in each."""
    made = documents.identity(documents.assemble(_mixed(spark, sf_dir), SMALL, *CONV), *CONV)
    text = cut(documents.to_json(made))
    back = documents.from_json(text, made.schema)
    same = F.to_json("record", {"ignoreNullFields": "false"}).eqNullSafe(F.col("json"))
    odd = text.select(F.concat(F.lit('{"surplus":1,'), F.substring("json", 2, 1 << 30)).alias("json"))
    extra = F.get(documents.unknown_fields(F.col("json"), made.schema), 0) == "surplus"
    return back.agg(F.count("*").alias("documents"), F.count("record").alias("read_back"), F.count("fault").alias("faults"), F.count_if(~same).alias("differ")).crossJoin(odd.agg(F.count_if(extra).alias("unknown_found")))


# -- quote rules, one by one -----------------------------------------------------------------------

#: A text for each rule, ``#`` standing for the row's number: the expected boundaries are (rule, kind, ordinal, text that begins it, text that ends it).
PLAIN = (
    ("hello #\nFrom: a\nSent: today\nTo: b\nSubject: s\nold #\n", "outlook_flat_en", "quote", "From: a", "old #\n"),
    ("hello #\nFrom: a\nDate: today\nTo: b\nCc: c\nSubject: s\nold #", "outlook_flat_en", "quote", "From: a", "old #"),
    ("hallo #\nVon: a\nGesendet: heute\nAn: b\nBetreff: s\nalt #\n", "outlook_flat_de", "quote", "Von: a", "alt #\n"),
    ("salut #\nDe : a\nEnvoyé : hier\nÀ : b\nObjet : s\nvieux #\n", "outlook_flat_fr", "quote", "De : a", "vieux #\n"),
    ("see #\nBegin forwarded message:  \nkept #\n", "forward_banner", "forward", "Begin forwarded", "kept #\n"),
    ("see #\n-----Original Message-----\nkept #\n", "original_message_dashes", "forward", "-----Original", "kept #\n"),
    ("text #\n-- \nme #\n", "dash_dash_space", "signature", "-- \n", "me #\n"),
    ("text #\n______________________________\nlist #\n", "list_footer_underscores", "list_footer", "_____", "list #\n"),
    ("text #\nYou received this message because you are subscribed to # .\n", "list_footer_subscribed", "list_footer", "You received", "# .\n"),
    ("text #\nOn Monday # a\nwrote:\nold #\n\nmore #\n", "on_wrote_en", "quote", "On Monday", "\nold #"),
    ("> old #\n>> older #\nanswer\n", "gt_family", "quote", "> old", ">> older #"),
    ("text # alone\n-----Original message-----\n- - \nFrom: once\n", None, None, None, None),
)


def _plain(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    shape = F.element_at(F.array(*[F.lit(p[0]) for p in PLAIN]), (F.col("doc_id") % len(PLAIN) + 1).cast("int"))
    return docs.select("doc_id", F.regexp_replace(shape, "#", F.col("doc_id").cast("string")).alias("text"))


def _expected(shapes, shown: Callable[[str], str] = lambda t: t) -> str:
    """SQL rows of the expected boundaries: where their first and last words stand in the text."""
    quoted = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = [(k, shown(text), *rest) for k, (text, *rest) in enumerate(shapes) if rest[0]]
    values = ", ".join(f"({k}, {quoted(text)}, '{rule}', '{kind}', {quoted(first)}, {quoted(last)})" for k, text, rule, kind, first, last in rows)
    return f"""SELECT doc_id, rule_id, kind, CAST(CASE WHEN kind = 'quote' THEN 1 ELSE 0 END AS INTEGER) AS ordinal, CAST(position(replace(first, '#', i) IN t) - 1 AS BIGINT) AS start,
  CAST(length(t) - position(reverse(replace(last, '#', i)) IN reverse(t)) + 1 - (position(replace(first, '#', i) IN t) - 1) AS BIGINT) AS size
  FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, replace(v.text, '#', CAST(doc_id AS VARCHAR)) AS t, rule_id, kind, first, last FROM documents JOIN (VALUES {values}) v(k, text, rule_id, kind, first, last) ON doc_id % {len(shapes)} = k)"""


@query(_expected(PLAIN))
def quote_rules(spark, sf_dir):
    """Each rule of plain views on a text of its own, over all rows."""
    return quotes.boundaries(quotes.lines_of(_plain(spark, sf_dir), "doc_id"), "doc_id").drop("prefix_depth")


GAPS = ("just text #\n", "Dne # napsal Ada:\nPredmet: x\nKomu: y\n", "> a\ntext #\n> b\n", "> a\n\n> b\n", "hi\n\nOn # Ada wrote:\n>> a\n>> b\n")


@query("""SELECT doc_id, unnest(CASE doc_id % 5 WHEN 0 THEN ['body.no_boundary_found'] WHEN 1 THEN ['body.i18n_reply_marker'] WHEN 2 THEN ['body.inline_reply_interleaved', 'view.quote_level_disagreement'] WHEN 3 THEN ['view.quote_level_disagreement'] ELSE ['view.quote_level_disagreement'] END) AS gap_id FROM documents""")
def quote_gaps(spark, sf_dir):
    shape = F.element_at(F.array(*[F.lit(g) for g in GAPS]), (F.col("doc_id") % len(GAPS) + 1).cast("int"))
    views = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(shape, "#", F.col("doc_id").cast("string")).alias("text"))
    lines = quotes.lines_of(views, "doc_id")
    return quotes.view_gaps(lines, quotes.boundaries(lines, "doc_id"), "doc_id")


#: HTML for each rule, spans in its projected text.
DOM = (
    ('<p>hi #</p><div class="a gmail_quote">old #</div>end', "gmail_quote", "quote", "old #", "old #"),
    ('hi #<blockquote type="cite">old # <i>x</i></blockquote>end', "blockquote_type_cite", "quote", "old", "# x"),
    ('<div>hi #<div id="divRplyFwdMsg">From #</div>old #</div>', "outlook_divrplyfwd", "quote", "From", "old #"),
    ('<div>hi #<div id="appendonsend">mark</div><p>old #</p></div>', "outlook_appendonsend", "quote", "old #", "old #"),
    ('hi #<div class="moz-cite-prefix">said #:</div><blockquote>old #</blockquote>end', "thunderbird_moz_cite_prefix", "quote", "said", "old #"),
    ('hi #<div class="moz-forward-container">fwd #</div>end #', "thunderbird_moz_forward_container", "forward", "fwd", "end #"),
    ("<pre>hi #\n&gt; old #\n</pre>", "gt_family", "quote", "> old", "old #\n"),
    ('<div class="gmail_quote">out # <blockquote type="cite">in #</blockquote></div>', "gmail_quote", "quote", "out", "in #"),
    ('<div class="gmail_extra">hi #</div>', None, None, None, None),
    ("<p>hi #</p>", None, None, None, None),
)


def bare(html: str) -> str:
    import re

    return re.sub("<[^>]*>", "", html).replace("&gt;", ">")


def _dom(spark, sf_dir, *want: str) -> DataFrame:
    shape = F.element_at(F.array(*[F.lit(d[0]) for d in DOM]), (F.col("doc_id") % len(DOM) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.regexp_replace(shape, "#", F.col("doc_id").cast("string")).alias("html"))
    return parse.parse_messages(messages.page_mail(rows), want=want).withColumnRenamed("page_id", "doc_id")


@query(_expected(DOM, bare))
def dom_rules(spark, sf_dir):
    """Each rule of HTML views on a tree of its own: spans in the projected text; a quote inside a quote is part of it."""
    return parse.rows_of(_dom(spark, sf_dir, "dom_boundaries"), "dom_boundaries", "doc_id").drop("path")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 8 THEN 'body.html_quote_rule_gap' ELSE 'body.no_boundary_found' END AS gap_id FROM documents WHERE doc_id % 10 >= 8")
def dom_gaps(spark, sf_dir):
    return parse.rows_of(_dom(spark, sf_dir, "html_gaps"), "html_gaps", "doc_id").select("doc_id", "gap_id")


@query("""SELECT doc_id, 'a ' || doc_id || chr(13) || chr(10) || '>q' || chr(13) || chr(10) || ' two ' || chr(13) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE ' x' END AS text FROM documents""")
def flowed_text(spark, sf_dir):
    """format=flowed: the blank that stuffs a line goes, lines stay."""
    doc = F.col("doc_id").cast("string")
    body = F.concat(F.lit("a "), doc, F.lit("\r\n >q\r\n  two \r\n"), F.when(F.col("doc_id") % 2 == 0, " x").otherwise("  x"))
    raw = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(F.lit("Content-Type: text/plain; charset=us-ascii; Format=Flowed\r\n\r\n"), body), "UTF-8").alias("raw"))
    return parse.rows_of(parse.parse_messages(raw, want=("views",)), "views", "doc_id").select("doc_id", "text")


# -- gaps ------------------------------------------------------------------------------------------

HEAD = "From: a@example.test\r\nDate: Tue, 4 Mar 2025 08:05:00 +0000\r\n"
#: A message for each gap, and the gaps it has, sorted; ``#`` stands for the row's number.
OPEN = (
    (HEAD + "Content-Type: text/plain; charset=us-ascii; format=flowed\r\n\r\n> a #\r\n", "body.flowed_reflow_unresolved@1"),
    (HEAD + 'Content-Type: multipart/digest; boundary="b"\r\n\r\n--b\r\n\r\nFrom: b@example.test\r\n\r\n> a #\r\n--b--\r\n', "body.digest_default_not_applied@1.1"),
    (HEAD + 'Content-Type: text/html; charset=us-ascii\r\n\r\n<blockquote type="cite">#<img src="https://example.test/#"><img src="//x/#"></blockquote><img src="data:image/gif;base64,R0lGODlh">', "body.inline_data_uri@1|security.remote_content_present@1"),
    (HEAD + "Content-Type: application/pdf; name=#\r\n\r\n%PDF-#", "body.no_text_part@1"),
    (HEAD + "Subject: #\rX-A: b\r\n\r\n> a\r\n", "body.lone_cr_line_terminator@1"),
    ("From: a b <<\r\nDate: once #\r\n\r\n> a\r\n", "headers.address_unparsable@1|headers.invalid_date@1"),
    ("From: a@example.test\r\nDate: Tue, 4 Mar 2025 08:05:00\r\nSubject: a\r\nSubject: #\r\n\r\n> a\r\n", "headers.date_no_zone@1|headers.duplicate_header@1"),
    (HEAD + 'Content-Type: text/html; charset=us-ascii\r\n\r\n<blockquote type="cite">#<img src="cid:none#@x"></blockquote>', "attach.cid_dangling@1"),
    ("Date: Tue, 4 Mar 2025 08:05:00 +9960\r\nSubject: =?utf-8?q?bad word?=\r\n\r\n> a #\r\n", ""),
    ("From: a@example.test\r\nSubject: =?utf-8?b?#!?=\r\n\r\n just #\r\n", "body.no_boundary_found@1|headers.encoded_word_invalid@1|headers.no_date@1"),
)


@query(f"SELECT doc_id, [{', '.join(repr(told) for _, told in OPEN)}][CAST(doc_id % {len(OPEN)} AS INTEGER) + 1] AS gaps FROM documents")
def open_gaps(spark, sf_dir):
    """Each gap of headers and bodies on a message of its own, of all stages in one channel."""
    shape = F.element_at(F.array(*[F.lit(raw) for raw, _ in OPEN]), (F.col("doc_id") % len(OPEN) + 1).cast("int"))
    raw = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.regexp_replace(shape, "#", F.col("doc_id").cast("string")), "UTF-8").alias("raw"))
    parsed = cut(parse.parse_messages(raw, want=gaps.WANT))
    told = gaps.all_gaps(parsed, "doc_id").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("gap_id", F.lit("@"), "locator"))), "|").alias("gaps"))
    return parsed.select("doc_id").join(told, "doc_id", "left").select("doc_id", F.coalesce("gaps", F.lit("")).alias("gaps"))


# -- attachments -----------------------------------------------------------------------------------

KINDS = (("a.docm", "application/zip", "504B0304"), ("b.xls", "application/vnd.ms-excel", "D0CF11E0A1B11AE1"), ("winmail.dat", "application/ms-tnef", "789F3E22"), ("c.pdf", "application/pdf", "89504E470D0A1A0A0000000D49484452000000010000000108"), ("d.7z", "application/octet-stream", "377ABCAF271C"), ("e.rar", "application/x-thing", "526172211A0700"))


@query("""SELECT doc_id, ['zip', 'ole-cfb', 'unrecognized', 'png', '7z', 'rar'][CAST(doc_id % 6 AS INTEGER) + 1] AS magic, doc_id % 6 IN (3, 5) AS disagreement, CASE WHEN doc_id % 6 = 3 THEN 1 END AS width,
  CASE doc_id % 6 WHEN 0 THEN 'security.macro_present' WHEN 1 THEN 'attach.ole_container_unknown' WHEN 2 THEN 'attach.tnef_present' WHEN 3 THEN 'attach.cid_unreferenced,attach.type_disagreement' WHEN 5 THEN 'attach.type_disagreement' ELSE '' END AS gaps,
  CASE WHEN doc_id % 6 = 3 THEN 'inline_unreferenced_tracking_pixel' END AS hint FROM documents""")
def attachment_rules(spark, sf_dir):
    """Signatures, declared containers, gaps, sizes of images and the tracking-pixel hint."""
    pick = lambda n: F.element_at(F.array(*[F.lit(k[n]) for k in KINDS]), (F.col("doc_id") % len(KINDS) + 1).cast("int"))
    head = F.concat(F.lit("Content-Type: "), pick(1), F.when(F.col("doc_id") % 6 == 3, "\r\nContent-ID: <x@y>\r\nContent-Disposition: inline; filename=").otherwise("\r\nContent-Disposition: attachment; filename="), pick(0), F.lit("\r\nContent-Transfer-Encoding: base64\r\n\r\n"))
    raw = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat(head, F.base64(F.unhex(pick(2)))), "UTF-8").alias("raw"))
    rows = cut(parse.parse_messages(raw, want=("parts", "references")))
    found = bodies.attachments(parse.rows_of(rows, "parts", "doc_id"), "doc_id")
    use = bodies.cid_use(found, parse.rows_of(rows, "references", "doc_id"), "doc_id")
    gaps = bodies.attachment_gaps(found, use, "doc_id").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("gap_id")), ",").alias("gaps"))
    hints = bodies.decorative(found, use, "doc_id").select("doc_id", F.col("rule_id").alias("hint"))
    return found.join(gaps, "doc_id", "left").join(hints, "doc_id", "left").select("doc_id", "magic", "disagreement", F.col("dimensions.width").alias("width"), F.coalesce("gaps", F.lit("")).alias("gaps"), "hint")


# -- body text and flags ---------------------------------------------------------------------------


@query("""WITH b AS (SELECT doc_id, doc_id % 2 = 1 AS html, CASE WHEN doc_id % 2 = 1 THEN 'in ' || coalesce(lang, '') ELSE regexp_replace(coalesce(text, ''), '\\r?\\n', chr(13) || chr(10), 'g') END AS t FROM documents)
SELECT doc_id, CASE WHEN html THEN 'html' ELSE 'plain' END AS view, CASE WHEN html THEN '1.2' ELSE '1' END AS path, sha256(t) AS text_sha256, CAST(length(t) AS INTEGER) AS char_count, false AS truncated,
  len(regexp_extract_all(t, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+')) AS n_lines, CAST(length(t) AS BIGINT) AS covered FROM b""")
def body_lines(spark, sf_dir):
    """The text that a reader of each message gets, and its lines, which tile it."""
    raw = messages.alternative_mail(table(spark, sf_dir, "documents"))
    texts = cut(documents.body_text(parse.parse_messages(raw, want=("parts", "views")), "doc_id"))
    lines = documents.body_lines(texts, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.col("end") - F.col("start")).alias("covered"))
    out = texts.join(lines, "doc_id", "left")
    return out.select("doc_id", "view", "path", F.sha2("text", 256).alias("text_sha256"), "char_count", "truncated", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("covered", F.lit(0)).alias("covered"))


@query("""SELECT doc_id, term, quote_ordinal, quote_kind, CAST(n AS BIGINT) AS n, CAST(CASE WHEN quote_kind = 'quote' THEN n ELSE 0 END AS BIGINT) AS n_quoted FROM (
  SELECT doc_id, 'term' || doc_id % 3 AS term, CAST(NULL AS INTEGER) AS quote_ordinal, NULL AS quote_kind, 2 AS n FROM documents
  UNION ALL SELECT doc_id, 'term' || doc_id % 2, 1, 'quote', 1 FROM documents UNION ALL SELECT doc_id, 'term2', 0, 'signature', 1 FROM documents)""")
def flag_rollup(spark, sf_dir):
    """Hits of terms in the open, in quotes and in signatures, counted per view."""
    n = F.col("doc_id")
    text = F.concat(F.lit("a term"), (n % 3).cast("string"), F.lit(" b\nterm"), (n % 3).cast("string"), F.lit("\n> term"), (n % 2).cast("string"), F.lit("\n-- \nterm2 c\n"))
    views = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    terms = spark.range(3).select(F.concat(F.lit("term"), F.col("id").cast("string")).alias("term"))
    hits = corpus.match_terms(views.select("doc_id", F.lit(0).alias("ordinal"), "text", F.lit(0).cast("long").alias("at")), terms, "doc_id")
    found = quotes.boundaries(quotes.lines_of(views, "doc_id"), "doc_id")
    return corpus.flag_rollup(corpus.flag_hits(hits, found, "doc_id"), "doc_id")


# -- relations over the corpus ---------------------------------------------------------------------


@query(r"""
WITH t AS (SELECT DISTINCT regexp_extract(text, '[\p{L}\p{N}_]+ [\p{L}\p{N}_]+') AS term FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS w, string_split_regex(coalesce(text, ''), '[\p{L}\p{N}_]+') AS s FROM documents),
p AS (SELECT doc_id, w[k] || ' ' || w[k + 1] AS term FROM (SELECT doc_id, w, s, unnest(range(1, len(w))) AS k FROM d) WHERE s[k + 1] = ' ')
SELECT doc_id, term, count(*) AS n_hits FROM p JOIN t USING (term) WHERE term <> '' GROUP BY doc_id, term
""")
def phrase_hits(spark, sf_dir):
    """Terms of two tokens in all documents."""
    terms = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "[\\p{L}\\p{N}_]+ [\\p{L}\\p{N}_]+", 0).alias("term"))
    runs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("long").alias("at"))
    return corpus.match_terms(runs, terms, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n_hits"))


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'undecodable' ELSE 'claimed' END AS state, CASE WHEN turn % 5 <> 4 THEN md5(CAST(conv_id AS VARCHAR)) END AS conversation, CASE WHEN turn % 5 <> 4 THEN CAST(turn AS INTEGER) END AS n_replies FROM conversations")
def thread_index_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(*CONV)
    data = F.concat(F.lit("01D8A1B2C3D4"), F.md5(F.col("conv_id").cast("string").cast("binary")), F.repeat(F.lit("0102030405"), F.col("turn").cast("int")), F.when(F.col("turn") % 5 == 4, "FF").otherwise(""))
    claim = corpus.thread_index(F.base64(F.unhex(data)))
    return rows.select(*CONV, claim.alias("c")).select(*CONV, "c.state", "c.conversation", "c.n_replies")


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 17, source ORDER BY CASE WHEN doc_id % 5 <> 0 THEN doc_id * 37 % 101 END NULLS LAST, doc_id) AS INTEGER) AS version, n AS n_versions
  FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY doc_id % 17, source) AS n FROM documents WHERE source IS NOT NULL) WHERE n > 1""")
def same_name_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 17).alias("thread"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") * 37 % 101).alias("utc"), F.sha2("text", 256).alias("sha256"))
    return corpus.same_name_versions(rows, "thread", "source", "utc", "doc_id").select("doc_id", "version", "n_versions")


@query("""SELECT doc_id, m AS message_id, first, n FROM (SELECT doc_id, m, min(doc_id) OVER w AS first, count(*) OVER w AS n FROM (SELECT doc_id, '<' || doc_id % 50 || '@example.test>' AS m, sha256(coalesce(text, '')) AS h FROM documents) WINDOW w AS (PARTITION BY m, h)) WHERE n > 1""")
def same_message_candidates(spark, sf_dir):
    """Messages of one claimed Message-ID, body and view, as groups: the first, the size, every member."""
    docs = table(spark, sf_dir, "documents")
    body = docs.select("doc_id", F.lit("plain").alias("media"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("body_digest"))
    ids = docs.select("doc_id", F.concat(F.lit("<"), (F.col("doc_id") % 50).cast("string"), F.lit("@example.test>")).alias("message_id"))
    return corpus.same_message(body, ids, "doc_id").select("doc_id", "message_id", F.col("first.doc_id").alias("first"), "n")


@query("""SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'offset of absent origin' END, CASE WHEN event_id % 5 = 0 THEN 'relative time resolved' END,
  CASE WHEN event_id % 7 = 0 AND event_id % 11 <> 0 AND event_id % 4 <> 0 THEN 'filesystem time orders arrivals' END, CASE WHEN event_id % 11 = 0 THEN 'trust' END], lambda x: x IS NOT NULL)) AS violation FROM events) GROUP BY violation""")
def time_violations(spark, sf_dir):
    """Evidence that claims more than it may, by rule."""
    every = lambda k: F.col("event_id") % k == 0
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("x").alias("when_raw"), F.col("event_id").alias("utc"), F.when(every(2), "+0000").alias("offset"), F.when(every(3), "absent").otherwise("stated_in_text").alias("offset_origin"), F.lit("second").alias("precision"), F.when(every(5), "relative").otherwise("none").alias("ambiguity"), F.when(every(11), "nobody").when(every(7), "filesystem").otherwise("claimed").alias("trust"), (~every(4)).alias("usable"))
    return corpus.invalid_times(rows, "event_id").groupBy("violation").agg(F.count("*").alias("n"))
