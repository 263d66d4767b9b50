"""The one Python boundary: message bytes to a wide row of arrays. Every fact table is an explode of it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postern.functions import headers as H
from postern.functions import compound, html, mime, projection
from postern.limits import Limits
from postern.sources.messages import Rendered

FIELD = "ordinal int, name string, raw_value string, parse_status string, parsed_kind string, parsed_value string, decoded string, name_at long, name_len long, value_at long, value_len long, raw_at long, raw_len long"
PART = "path string, parent_path string, part_id string, content_type string, raw_at long, raw_len long, headers_at long, headers_len long, body_at long, body_len long, declared_cte string, declared_charset string, used_cte string, used_charset string, fallback_fired boolean, encoding_source string, body_sha256 string, decoded_size long, prefix binary, effective_type string, disposition string, filename string, filename_raw string, filename_state string, filename_reason string, content_id string, declared_mime string, is_body boolean, is_leaf boolean, flowed boolean, gaps array<string>"
VIEW = "path string, media string, text string, raw_text string, precision string, precision_reason string"
ELEMENT = "path string, ordinal int, tag string, parent_ordinal int, start long, size long, unclosed boolean"
REFERENCE = "path string, kind string, target string, element int"
BOUNDARY = "path string, rule_id string, kind string, ordinal int, start long, size long"
ADDRESS = "ordinal int, field string, seq int, at long, size long, display_name string, addr_spec string, state string, reason_id string, in_group boolean"
DATE = "ordinal int, raw string, zone_state string, utc_offset string, utc string, reason_id string"
PARAMETER = "ordinal int, field string, parameter string, value string, state string, fallback_reason string"
WIDE = {
    "container_hash": "string", "size_bytes": "long", "kind": "string", "status": "string", "reason": "string",
    "fields": f"array<struct<{FIELD}>>", "addresses": f"array<struct<{ADDRESS}>>", "dates": f"array<struct<{DATE}>>", "parameters": f"array<struct<{PARAMETER}>>",
    "parts": f"array<struct<{PART}>>", "regions": "array<struct<seq int, kind string, path string, at long, size long>>", "caps": "array<struct<path string, reason string>>",
    "sources": "array<struct<axis string, source string, source_at long, source_len long, source_sha256 string, at long, size long>>", "container_gaps": "array<struct<gap_id string, detail string>>",
    "views": f"array<struct<{VIEW}>>", "elements": f"array<struct<{ELEMENT}>>", "references": f"array<struct<{REFERENCE}>>", "dom_boundaries": f"array<struct<{BOUNDARY}>>", "html_caps": "array<struct<path string, reason string>>", "html_gaps": "array<struct<path string, gap_id string>>", "header_gaps": "array<string>",
}


def _schema(keys: list[T.StructField], asked: frozenset[str]) -> T.StructType:
    inner = lambda v: re.sub(r"(?<=[<, ])(\w+) (?=[a-z<>]+)", r"\1: ", v)
    parsed = T.StructType.fromDDL(", ".join(f"`{k}` {inner(v)}" for k, v in WIDE.items() if k in asked or not v.startswith("array")))
    return T.StructType(keys + parsed.fields)



def effective_type(part: mime.Part, parents: dict[str, mime.Part]) -> str:
    declared = part.value("content-type")
    if declared is not None:
        return part.content_type or ""
    parent = parents.get(part.parent or "")
    return "message/rfc822" if parent and parent.content_type == "multipart/digest" else "text/plain"


def unstuff(text: str) -> str:
    """format=flowed: the one blank that stuffs a line goes; lines are not joined."""
    out, at = [], 0
    for line in mime._LINE.finditer(text.encode("utf-8", "surrogatepass")):
        if line.start() < line.end() or at == 0:
            piece = line[0].decode("utf-8", "surrogatepass")
            out.append(piece[1:] if piece[:1] == " " else piece)
            at = line.end()
    return "".join(out)


def is_flowed(part: mime.Part) -> bool:
    return mime.media_of(part.value("content-type"))[1].get("format", "").lower() == "flowed"


#: Codecs whose bytes depend on what came before: no byte span belongs to a character.
STATEFUL = ("iso2022", "hz", "utf_7", "utf-7", "utf-16", "utf-32")


def view_reason(part: mime.Part) -> str | None:
    """Why a view's characters cannot be cited as raw bytes, or None where they can."""
    if part.used_cte in ("quoted-printable", "base64"):
        return "cte_not_identity"
    if part.fallback:
        return "decode_fallback"
    return "multibyte_without_offset_map" if (H.codec_of(part.used_charset or "") or "").startswith(STATEFUL) else None


def part_row(part: mime.Part, parents: dict[str, mime.Part], has_child: bool) -> tuple:
    kind = effective_type(part, parents)
    disposition = part.value("content-disposition")
    name, name_raw, name_state, name_reason = None, None, None, None
    for field, key in (("content-disposition", "filename"), ("content-type", "name")):
        value = part.value(field)
        found = next(((v, s, r) for n, v, s, r in H.parameters(value) if n == key), None) if value else None
        if found and name_state is None:
            name, name_state, name_reason = found
            name_raw = next((v for n, v in mime.media_of(value)[1].items() if n.split("*")[0] == key), None)
    token = mime.media_of(disposition)[0] if disposition else None
    cid = part.value("content-id")
    cid = cid.strip() if cid else None
    is_body = (kind.startswith("text/") or (kind == "" and part.value("content-type") is not None)) and token != "attachment"
    decoded = part.decoded
    declared = part.value("content-type")
    return (
        part.path, part.parent, part.part_id, part.content_type, *part.span, *part.headers, *part.body, part.declared_cte, part.declared_charset, part.used_cte, part.used_charset, part.fallback, part.encoding_source,
        None if decoded is None or has_child else hashlib.sha256(decoded).hexdigest(), None if decoded is None else len(decoded), None if decoded is None else decoded[:24], kind, token, name or None, name_raw, name_state, name_reason, cid,
        declared.partition(";")[0].strip() or None if declared else None, is_body and not has_child, not has_child, part.used_charset is not None and is_flowed(part), part.gaps,
    )


#: What the top header block alone tells.
HEADERS = frozenset(("fields", "addresses", "dates", "parameters", "header_gaps"))
#: What an HTML tree tells.
OF_HTML = frozenset(("elements", "references", "dom_boundaries", "html_caps", "html_gaps"))


def parse_one(raw: bytes, limits: Limits, html_depth: int, want: frozenset[str], closed: bool = False) -> dict:
    """The wide row of a message, its arrays filled as far as ``want`` asks. What goes wrong inside is told by the status ``failed``; nothing is raised for any bytes."""
    row = {"container_hash": hashlib.sha256(raw).hexdigest(), "size_bytes": len(raw), "kind": mime.sniff(raw), "status": "parsed", "reason": None}
    empty = lambda: {k: [] for k, v in WIDE.items() if v.startswith("array")}
    if len(raw) > limits.max_input_bytes:
        return row | empty() | {"status": "skipped", "reason": "file_over_cap"}
    try:
        return _parse(raw, row, empty(), limits, html_depth, want, closed)
    except Exception:  # one message must not end the job; its row says so
        return row | empty() | {"status": "failed", "reason": "extractor_error"}


def _parse(raw: bytes, row: dict, out: dict[str, list], limits: Limits, html_depth: int, want: frozenset[str], closed: bool) -> dict:
    row = row | out
    ids: dict[tuple[int, int], projection.Row] = {}
    if row["kind"] == "cfb":
        file = compound.read(raw)
        if file.error:
            return row | {"status": "skipped", "reason": file.error}
        made = projection.project(file)
        row["status"], row["reason"] = made.status, made.reason
        out["container_gaps"] += made.gaps
        out["sources"] += [(r.axis, r.source, r.source_at, r.source_len, r.source_sha256, r.at, r.size) for r in made.rows]
        if made.status == "unsupported":
            return row
        raw, ids = made.raw, {(r.at, r.size): r for r in made.rows}
    if want <= HEADERS:
        head = mime.prelude_of(raw)
        end, _ = mime.split_head(raw, head, len(raw))
        if end - head <= limits.max_header_bytes:
            _headers(raw, head, end, mime.scan_fields(raw, head, end)[0], out)
        return row
    message = mime.walk(raw, limits)
    top = message.parts[0] if message.parts else None
    parents = {p.path: p for p in message.parts}
    with_child = {p.parent for p in message.parts}
    for p in message.parts:
        if (source := ids.get(p.span)) is not None:
            p.part_id = source.part_id(row["container_hash"])
        elif row["kind"] == "cfb":
            p.part_id = mime.part_id(row["container_hash"], *p.span, raw[p.span[0] : sum(p.span)])
    out["caps"] += message.caps
    if row["status"] == "parsed" and (capped := next((why for path, why in message.caps if path == "1"), None)):
        row["status"], row["reason"] = "skipped", capped
    if "regions" in want:
        out["regions"] += [(k, *r) for k, r in enumerate(message.regions)]
    if want & HEADERS:
        at, size = top.headers if top else (0, 0)
        _headers(raw, at, at + size, top.fields if top else [], out)
    for p in message.parts:
        has_child = p.path in with_child
        if "parts" in want:
            out["parts"].append(part_row(p, parents, has_child))
        if p.decoded is None or has_child or p.used_charset is None or not want & (OF_HTML | {"views"}):
            continue
        kind = effective_type(p, parents)
        if kind != "text/html" and "views" not in want:
            continue
        text = p.decoded.decode(p.used_charset, "replace" if p.encoding_source == "fallback" else "strict")
        shown = text
        if kind == "text/plain" and is_flowed(p):
            shown = unstuff(text)
        reason = "container_stream" if row["kind"] == "cfb" else view_reason(p)
        out["views"].append((p.path, kind, shown, text, "exact" if reason is None else "part_level", reason))
        if kind == "text/html":
            tree = html.parse(text, html_depth, limits.max_parts, closed=closed)
            out["elements"] += [(p.path, e.ordinal, e.tag, e.parent, e.start, e.end - e.start, e.unclosed) for e in tree.elements]
            out["references"] += [(p.path, x["kind"], x["target"], x["element"]) for x in html.references(tree)]
            quoted = html.dom_quotes(tree)
            out["dom_boundaries"] += [(p.path, x["rule_id"], x["kind"], x["ordinal"], x["start"], x["end"] - x["start"]) for x in quoted]
            out["html_gaps"] += [(p.path, gap) for gap in html.dom_gaps(tree, quoted)]
            out["views"].append((p.path, "projection", "".join(tree.pieces), None, None, None))
            if tree.truncated:
                out["html_caps"].append((p.path, tree.truncated))
    return row


def _headers(raw: bytes, at: int, end: int, found: list[mime.Field], out: dict[str, list]) -> None:
    """Fields of the top block, what their values say, and each gap once, but for addresses that cannot be read: once each."""
    for f in found:
        parsed_kind, value = H.project(f.name, f.value, f.status)
        text, decoded, invalid, _ = H.decode_words(f.value) if parsed_kind == "text" else (None, False, False, False)
        if invalid:
            out["header_gaps"].append("headers.encoded_word_invalid")
        out["fields"].append((f.ordinal, f.name, f.value, f.status, parsed_kind, value, text.strip() if decoded else None, f.name_at, f.name_len, f.value_at, f.value_len, f.at, f.size))
        if parsed_kind == "address_list":
            out["addresses"] += [(f.ordinal, f.name, k, f.value_at + a["offset"], a["length"], a["display_name"], a["addr_spec"], a["state"], a["reason_id"], a["member"]) for k, a in enumerate(H.addresses(raw[f.value_at : f.value_at + f.value_len]))]
        elif parsed_kind == "date_time":
            out["dates"].append((f.ordinal, f.value, *H.parse_date(f.value)))
        if f.name.lower() in ("content-type", "content-disposition"):
            out["parameters"] += [(f.ordinal, f.name, *p) for p in H.parameters(f.value)]
    names = [f.name.lower() for f in found if f.status == "ok"]
    gaps = out["header_gaps"]
    # an offset or instant out of range is no gap: the value reads as a date
    dated = [reason for _, _, zone, _, _, reason in out["dates"] if reason and zone == "zone_absent"]
    told = [*gaps, *dated] if out["dates"] else [*gaps, H.NO_DATE]
    if any(names.count(n) > 1 for n in H.UNIQUE.intersection(names)):
        told.append("headers.duplicate_header")
    if lone_cr(raw, at, end):
        told.append("body.lone_cr_line_terminator")
    gaps[:] = [*dict.fromkeys(told), *["headers.address_unparsable" for a in out["addresses"] if a[-3] == "unparsed"]]
    bom = raw.startswith(mime.BOM)
    if bom:
        gaps.append("headers.leading_bom")
    if at > (len(mime.BOM) if bom else 0):
        gaps.append("headers.mbox_from_line")


def lone_cr(raw: bytes, at: int, end: int) -> bool:
    """Whether a bare CR ends a line of a header block, before its blank line."""
    if raw.count(b"\r", at, end) == raw.count(b"\r\n", at, end):
        return False
    for line in mime._LINE.finditer(raw, at, end):
        if not line[0].rstrip(b"\r\n"):
            return False
        if line[0].endswith(b"\r"):
            return True
    return False


def parse_messages(messages: DataFrame | Rendered, limits: Limits | None = None, html_depth: int = 16, raw: str = "raw", batch_rows: int = 16, want: Sequence[str] | None = None, closed: bool = False) -> DataFrame:
    """The key columns of ``messages`` (all but ``raw``) and the wide row of each. A null message is an empty one.

    ``want`` names the arrays that are asked for (default: all): only they are made and leave the worker, and if the top
    header block alone answers them, nothing else is read. Compound files are read through their projection. Where
    ``closed``, character references of HTML count only with their semicolon.
    """
    limits = limits or Limits()
    asked = frozenset(k for k, v in WIDE.items() if v.startswith("array")) if want is None else frozenset(want)
    given = Rendered.of(messages, raw)
    source, make, n_keys = given.source, given.make, given.keys
    schema = _schema(source.schema.fields[:n_keys], asked)
    nested = {f.name: [x.name for x in f.dataType.elementType.fields] for f in schema.fields[n_keys:] if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                rows = [parse_one(make(*x), limits, html_depth, asked, closed) for x in zip(*[part.column(k).to_pylist() for k in range(n_keys, part.num_columns)], strict=True)]
                cols = [part.column(k).cast(arrow.field(k).type) for k in range(n_keys)]
                for f in list(arrow)[n_keys:]:
                    names = nested.get(f.name)
                    values = [r[f.name] if names is None else [dict(zip(names, x, strict=True)) for x in r[f.name]] for r in rows]
                    cols.append(pa.array(values, f.type))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return source.mapInArrow(run, schema)


def rows_of(parsed: DataFrame, name: str, *keys: str) -> DataFrame:
    """One fact table: the keys and an array's structs, a row each."""
    return parsed.select(*keys, F.inline(F.col(f"`{name}`")))
