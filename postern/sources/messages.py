"""Message sources: files, a manifest of what a scan does with them, and messages rendered from tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.limits import Limits

CRLF = "\r\n"


@dataclass(frozen=True)
class Rendered:
    """Messages that are yet to be made: rows of ``keys`` columns and then the arguments from which ``make`` makes a message's bytes.

    A kernel makes each message where it reads it, so workers are handed small rows instead of batches of whole files.
    """

    source: DataFrame
    keys: int
    make: Callable[..., bytes]

    @staticmethod
    def of(messages: DataFrame | Rendered, raw: str) -> Rendered:
        """Messages whose bytes are in the column ``raw``, all others being keys; null is an empty message."""
        if isinstance(messages, Rendered):
            return messages
        keys = [c for c in messages.columns if c != raw]
        return Rendered(messages.select(*[f"`{c}`" for c in keys], F.col(f"`{raw}`").cast("binary").alias(raw)), len(keys), lambda b: b or b"")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size_bytes, raw) of every file below ``path``. Conditions on path and size reach the scan; ``raw`` is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("content").alias("raw"))


def sniffed(raw: Column) -> Column:
    """``cfb``, ``eml`` or ``unknown`` by native expressions on the first lines: a header field before the first blank line."""
    text = F.decode(raw, "ISO-8859-1")
    bare = F.regexp_replace(text, r"^(?:ï»¿)?(?:From [^\n]*\n)?", "")
    head = F.regexp_extract(bare, r"(?s)^(?:(?!\r?\n).*?)(?=\r?\n\r?\n|\z)", 0)
    return F.when(F.substring(F.hex(raw), 1, 16) == "D0CF11E0A1B11AE1", "cfb").when(head.rlike(r"(?:^|\n)[!-9;-~]+:"), "eml").otherwise("unknown")


def gated(files: DataFrame, limits: Limits) -> DataFrame:
    """``files`` with outcome: parse, or why a file is skipped."""
    kind = sniffed(F.col("raw"))
    return files.withColumn("outcome", F.when(F.col("size_bytes") > limits.max_input_bytes, "file_over_cap").when(kind == "unknown", "not_a_message").otherwise("parse"))


def join_lines(*lines: Column | str) -> Column:
    return F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in lines])


def address(role: Column, conv: Column) -> Column:
    return F.concat(F.lit("<"), role, F.lit("."), conv, F.lit("@example.test>"))


def message_id(conv: Column, turn: Column) -> Column:
    return F.concat(F.lit("<m"), conv, F.lit("."), turn, F.lit("@example.test>"))


def conversation_mail(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, raw): each turn as a message with a thread, an encoded subject, a date zone that cycles, and the turn before quoted below its text.

    Every fifth message lacks its header block and every seventh begins with a byte-order mark.
    """
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    t = conversations.select("conv_id", "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n", CRLF).alias("body"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("last_role"), F.col("body").alias("last_body"))
    rows = t.join(before, ["conv_id", "turn"], "left")
    zones = F.array(*[F.lit(z) for z in (" +0000", " -0500", " -0000", " EST", "")])
    minutes = (F.col("conv_id") * 7 + F.col("turn") * 11) % 1440
    clock = F.concat(F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(":05"))
    chain = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("turn").cast("int") - 1), lambda k: message_id(conv, k.cast("string"))))
    subject = F.concat(F.lit("=?utf-8?b?"), F.base64(F.encode(F.concat(F.lit("★ "), conv, F.lit("/"), turn), "UTF-8")), F.lit("?="))
    head = F.concat_ws(
        CRLF, F.concat(F.lit("From: "), F.col("role"), F.lit(" "), address(F.col("role"), conv)), F.concat(F.lit("To: Friends: ben@example.test, c"), conv, F.lit("@example.test; "), F.lit("list@example.test")), F.concat(F.lit("Subject: "), subject), F.concat(F.lit("Date: Tue, 4 Mar 2025 "), clock, F.element_at(zones, (F.col("turn") % 5 + 1).cast("int"))), F.concat(F.lit("Message-ID: "), message_id(conv, turn)),
        F.when(F.col("turn") > 0, F.concat(F.lit("In-Reply-To: "), message_id(conv, (F.col("turn") - 1).cast("string")))), F.when(F.col("turn") > 0, F.concat(F.lit("References: "), F.regexp_replace(chain, " ", CRLF + " "))), F.when(F.col("turn") % 3 == 0, F.lit("Subject: again")), F.lit("Content-Type: text/plain; charset=utf-8; format=fixed"), F.lit("Content-Transfer-Encoding: 8bit"),
    )
    quoted = F.concat(F.lit(f"{CRLF}{CRLF}On Tuesday, "), F.col("last_role"), F.lit(f" wrote:{CRLF}"), F.regexp_replace(F.concat(F.lit("> "), F.col("last_body")), "\r\n", f"{CRLF}> "))
    body = F.concat("body", F.coalesce(quoted, F.lit("")))
    text = F.when(F.col("turn") % 5 == 4, F.concat(F.lit(CRLF), body)).otherwise(F.concat(head, F.lit(CRLF + CRLF), body))
    bom = F.when(F.col("turn") % 7 == 6, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    return rows.select("conv_id", "turn", F.concat(bom, F.encode(text, "UTF-8")).alias("raw"))


def part(kind: str, payload: Column, cte: str | None = None, *more: Column | str) -> Column:
    lines = [F.lit(f"Content-Type: {kind}"), *([F.lit(f"Content-Transfer-Encoding: {cte}")] if cte else []), *[F.lit(x) if isinstance(x, str) else x for x in more]]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), payload)


def multipart(kind: str, boundary: str, parts: list[Column], head: Column | str = "MIME-Version: 1.0") -> Column:
    mark = F.lit(f"--{boundary}{CRLF}")
    body = F.concat(*[x for p in parts for x in (mark, p, F.lit(CRLF))], F.lit(f"--{boundary}--{CRLF}"))
    return F.concat(F.lit(head) if isinstance(head, str) else head, F.lit(f'{CRLF}Content-Type: multipart/{kind}; boundary="{boundary}"{CRLF}{CRLF}'), body)


def document_mail(documents: DataFrame) -> DataFrame:
    """(doc_id, raw): a mixed message of a plain text in one of three encodings, an HTML alternative, and attachments whose bytes and declared types cycle."""
    doc = F.col("doc_id").cast("string")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n", CRLF)
    plain = F.when(F.col("doc_id") % 3 == 0, part("text/plain; charset=utf-8", F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "\r?\n", CRLF), "base64")).otherwise(part("text/plain; charset=utf-8", text, "8bit"))
    html = part("text/html; charset=utf-8", F.concat(F.lit("<div>doc "), doc, F.lit('</div><p>see <img src="cid:pic'), doc, F.lit('@example.test"> <img src="cid:gone@example.test"> <a href="http://example.test/'), doc, F.lit('">x</a></p>')))
    signatures = ("255044462D312E34", "89504E470D0A1A0A0000000D4948445200000001000000010802000000", "4749463839610100010000000000", "504B030414000000", "D0CF11E0A1B11AE100000000", "00010203")
    data = F.unhex(F.element_at(F.array(*[F.lit(s) for s in signatures]), (F.col("doc_id") % len(signatures) + 1).cast("int")))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("application/pdf", "image/png", "image/png", "application/zip", "application/octet-stream", "application/x-thing")]), (F.col("doc_id") % len(signatures) + 1).cast("int"))
    attached = lambda name, cid: F.concat(F.lit("Content-Type: "), kinds, F.lit(f"{CRLF}Content-Transfer-Encoding: base64{CRLF}Content-Disposition: {name[0]}; filename=\"{name[1]}\"{CRLF}"), cid, F.lit(CRLF), F.base64(data))
    first = attached(("inline", "pic.bin"), F.concat(F.lit("Content-ID: <pic"), doc, F.lit(f"@example.test>{CRLF}")))
    second = attached(("attachment", "copy.bin"), F.lit(""))
    inner = F.concat(F.lit(f'Content-Type: multipart/alternative; boundary="in"{CRLF}{CRLF}--in{CRLF}'), plain, F.lit(f"{CRLF}--in{CRLF}"), html, F.lit(f"{CRLF}--in--{CRLF}"))
    raw = multipart("mixed", "out", [inner, first, second], F.concat(F.lit("From: a@example.test\r\nMessage-ID: <d"), doc, F.lit("@example.test>\r\nMIME-Version: 1.0")))
    return documents.select("doc_id", F.encode(raw, "UTF-8").alias("raw"))


def page_mail(pages: DataFrame) -> DataFrame:
    head = f"From: web@example.test{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Transfer-Encoding: 8bit{CRLF}{CRLF}"
    return pages.select("page_id", F.encode(F.concat(F.lit(head), F.coalesce("html", F.lit(""))), "UTF-8").alias("raw"))


def alternative_mail(documents: DataFrame) -> DataFrame:
    """(doc_id, raw): the text of every second document alone, of the others with an HTML alternative that names its language."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r?\n", CRLF)
    plain = part("text/plain; charset=utf-8", text, "8bit")
    both = multipart("alternative", "=alt=", [plain, part("text/html; charset=utf-8", F.concat(F.lit("<p>in <b>"), F.coalesce("lang", F.lit("")), F.lit("</b></p>")))])
    return documents.select("doc_id", F.encode(F.when(F.col("doc_id") % 2 == 0, plain).otherwise(both), "UTF-8").alias("raw"))
