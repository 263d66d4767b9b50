"""Compound-file messages as tables: one Arrow-batched kernel, every fact an explode of its wide row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.functions import compound, mapi, rtf
from postern.sources.messages import Rendered

NESTED = {
    "entries": "path string, kind int, size long",
    "faults": "place string, fault string",
    "accounting": "class string, bytes long",
    "properties": "tag string, type string, value string, size long, how string, fault string",
    "recipients": "role string, name string, address string",
    "embedded": "ordinal int, message_class string, subject string, has_transport boolean, n_recipients int, n_attachments int, nested int",
    "attachments": "ordinal int, filename string, mime string, content_id string, method string, embedded boolean, inline boolean, hidden boolean, size long, sha256 string",
}
PLAIN = {"container_hash": "string", "size_bytes": "long", "error": "string", "version": "int", "sector_size": "int", "storage_sha256": "string", "refused": "string", "message_class": "string", "subject": "string", "sent": "string", "message_id": "string", "body": "string", "html": "string", "rtf": "binary", "rtf_fault": "string"}


def storage_digest(file: compound.Compound) -> str:
    """Hash of all paths, kinds and stream contents in path order."""
    total = hashlib.sha256()
    for e in file.entries:
        data = file.streams.get(e.path.lower(), b"") if e.kind == compound.STREAM else b""
        total.update(f"{e.path}\n{e.kind}\n{len(data)}\n{hashlib.sha256(data).hexdigest()}\n".encode("utf-8", "replace"))
    return total.hexdigest()


def read_one(raw: bytes) -> dict:
    file = compound.read(raw)
    row = dict.fromkeys([*PLAIN, *NESTED]) | {k: [] for k in NESTED} | {"container_hash": hashlib.sha256(raw).hexdigest(), "size_bytes": len(raw), "error": file.error, "version": file.version, "sector_size": file.sector_size}
    if file.error:
        return row
    found = mapi.message(file)
    row |= {k: found[k] for k in ("refused", "message_class", "subject", "sent", "message_id", "body", "html", "rtf", "rtf_fault")}
    row["storage_sha256"] = storage_digest(file)
    row["entries"] = [{"path": e.path, "kind": e.kind, "size": e.size} for e in file.entries]
    row["faults"] = [{"place": p, "fault": f} for p, f in file.faults]
    row["accounting"] = [{"class": k, "bytes": v} for k, v in file.accounting.items()]
    row["properties"] = [{"tag": f"{p['tag']:04x}", "type": f"{p['type']:04x}", "value": p["value"], "size": None if p["data"] is None else len(p["data"]), "how": p["how"], "fault": p["fault"]} for p in found["properties"]]
    row["recipients"] = found["recipients"]
    row["embedded"] = found.get("embedded", [])
    for k, a in enumerate(found["attachments"]):
        data, _ = a.pop("data"), a.pop("stream")
        row["attachments"].append(a | {"ordinal": k, "size": None if data is None else len(data), "sha256": None if data is None else hashlib.sha256(data).hexdigest()})
    return row


def _rows(batches: Iterator[pa.RecordBatch], schema: T.StructType, at: int, make, slice_rows: int = 16) -> Iterator[pa.RecordBatch]:
    """Batches of the first ``at`` columns and of what ``make`` gives for the other columns' values."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    for batch in batches:
        for lo in range(0, batch.num_rows, slice_rows):
            part = batch.slice(lo, slice_rows)
            made = [make(*values) for values in zip(*[part.column(k).to_pylist() for k in range(at, part.num_columns)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(k).cast(arrow.field(k).type) for k in range(at)], *[pa.array([r[f.name] for r in made], f.type) for f in list(arrow)[at:]]], schema=arrow)


def parse_compound(messages: DataFrame | Rendered, raw: str = "raw") -> DataFrame:
    """The key columns of ``messages`` (all but ``raw``) and the wide row of each. Bytes that are no compound file, and null, give an error and empty arrays."""
    given = Rendered.of(messages, raw)
    make, n_keys = given.make, given.keys
    wide = ", ".join([f"{k} {v}" for k, v in PLAIN.items()] + [f"{k} array<struct<{v.replace(' ', ': ').replace(',:', ',')}>>" for k, v in NESTED.items()])
    schema = T.StructType(given.source.schema.fields[:n_keys] + T.StructType.fromDDL(wide).fields)
    return given.source.mapInArrow(lambda batches: _rows(batches, schema, n_keys, lambda *x: read_one(make(*x))), schema)


def compound_mail(conversations: DataFrame) -> Rendered:
    """By (conv_id, turn): each turn as a compound file with its text as plain and as compressed RTF body, a recipient of each role, and two attachments."""
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "conv_id", "turn").toDF("conv_id", "turn", "role", "text", "c", "t")
    source = source.select("conv_id", "turn", "role", "text", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("t", F.lit(0)).alias("t"))

    def make(role: str, text: str, conv: int, turn: int) -> bytes:
        people = [(k + 1, f"{role} {k}", f"p{k}.{conv}@example.test") for k in range(3)]
        files = [(f"note-{turn}.txt", "text/plain", text.encode()), ("zeros.bin", "application/octet-stream", bytes(5000 + turn))]
        sent = 133_000_000_000_000_000 + (conv % 1000 * 60 + turn) * 600_000_000
        return compound.write(mapi.render(f"★ {conv}/{turn}", text, people, files, sent, rtf.literal(text.encode())))

    return Rendered(source, 2, make)


def mixed_compound_mail(conversations: DataFrame) -> Rendered:
    """By (conv_id, turn): each turn as a compound file whose body is plain, HTML, both or none by turn; every third has header lines of its own, and every second conversation a named attachment and an embedded item."""
    source = conversations.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("conv_id", F.lit(0)).alias("c"), F.coalesce("turn", F.lit(0)).alias("t"))

    def make(text: str, conv: int, turn: int) -> bytes:
        inline = [f"pic{turn}@example.test"] if turn % 2 == 0 else []
        files = [(f'ü "{turn}".txt', "text/plain", text.encode(), *inline), ("inner.msg", None, None)] if conv % 2 == 0 else []
        html = f"<p>{text}</p>".encode() if turn % 4 in (1, 2) else None
        head = "From: a@example.test\r\nSubject: other\r\n\r\n" if turn % 3 == 0 else None
        return compound.write(mapi.render(f"★ {conv}/{turn}", text if turn % 4 in (0, 2) else None, [], files, 0, html=html, transport=head))

    return Rendered(source, 2, make)


def nested_compound_mail(conversations: DataFrame) -> Rendered:
    """By (conv_id, turn): each turn as a compound file with a message attached to it, which by turn has recipients, header lines, or a message of its own; by conversation a tag without a meaning, a named one, 8-bit text without a page, or a count of recipients that is too high."""
    source = conversations.select("conv_id", "turn", F.coalesce("conv_id", F.lit(0)).alias("c"), F.coalesce("turn", F.lit(0)).alias("t"))
    odd = ([], [(0x6001, mapi.UNICODE, "x")], [(0x8005, mapi.UNICODE, "x")], [(0x0C1A, mapi.STRING8, b"plain")])

    def make(conv: int, turn: int) -> bytes:
        deepest = mapi.render("deepest", None, [], [], 0)
        people = [(1, f"r{k}", f"r{k}@example.test") for k in range(turn % 3)]
        inner = mapi.render(f"inner {turn}", "text", people, [("deepest.msg", None, deepest)] if turn % 4 == 3 else [], 0, transport="From: a@example.test\r\n\r\n" if turn % 2 else None)
        tree = mapi.render(f"outer {conv}", "text", [], [("inner.msg", None, inner)], 0, transport="Subject: outer " + str(conv) + "\r\n\r\n", extra=odd[conv % 5] if conv % 5 < 4 else [])
        if conv % 5 == 4:
            tree[mapi.TABLE] = tree[mapi.TABLE][:16] + (7).to_bytes(4, "little") + tree[mapi.TABLE][20:]
        return compound.write(tree)

    return Rendered(source, 2, make)
