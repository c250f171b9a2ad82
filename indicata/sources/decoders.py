"""Decoders for formats that no SQL function reads: mail, office archives, PDF, HTML links.

Each runs in Arrow batches inside the executors, one pass, one row in and one row out
(or several for links). Broken input yields what could be read, never an error.
Nothing is ever fetched or executed.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import zipfile
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pdf
from .batches import by_bytes

#: What an extracted url looks like.
URL = re.compile(r"https?://[^\s\"'<>\)\]]+", re.I)
BARE = re.compile(r"\b(?:www\.)?(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,6}(?:/[^\s\"'<>\)\]]*)?", re.I)
#: Endings and types of the documents that are read, and of attachments without a name.
OFFICE_ZIP = (".docx", ".dotx", ".docm", ".xlsx", ".xlsm", ".xltx", ".pptx", ".ppsx", ".pptm")
ATTACHED = ("application/pdf", "application/msword", "application/vnd.ms-word", "application/vnd.ms-excel", "application/vnd.ms-powerpoint")
LINK_CAP = 50

MESSAGE = (
    "headers array<struct<name:string,value:string>>, "
    "parts array<struct<ix:int,content_type:string,disposition:string,filename:string,size:long,sha256:string,payload:binary>>, "
    "plain_text string, html_text string"
)


def _decoded(part) -> str:
    payload = part.get_payload(decode=True) or b""
    try:
        return payload.decode(part.get_content_charset() or "utf-8", errors="replace")
    except LookupError:
        return payload.decode("utf-8", errors="replace")


def read_message(raw: bytes) -> dict:
    """Headers in order, parts that are attachments or named, and the texts of the body."""
    raw = raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if not raw.strip().startswith(b"From ") and b":" not in raw[:20]:
        raw = b"Received: stub\n" + raw
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    headers = [{"name": k, "value": str(v)} for k, v in message.items()]
    parts, plain, html = [], [], []
    for ix, part in enumerate(message.walk()):
        kind, disposition = part.get_content_type().lower(), str(part.get("Content-Disposition") or "")
        name = part.get_filename() or ""
        if not part.is_multipart() and "attachment" not in disposition:
            if kind == "text/plain":
                plain.append(_decoded(part))
            elif kind == "text/html":
                html.append(_decoded(part))
        known = kind.startswith("image/") or "officedocument" in kind or kind in ATTACHED
        if "attachment" in disposition or name or known:
            payload = part.get_payload(decode=True) or b""
            parts.append({"ix": ix, "content_type": kind, "disposition": disposition, "filename": name or "unknown", "size": len(payload), "sha256": hashlib.sha256(payload).hexdigest(), "payload": payload})
    return {"headers": headers, "parts": parts, "plain_text": "\n".join(plain), "html_text": "\n".join(html)}


def _mapped(df: DataFrame, id_col: str, content_col: str, schema: str, row) -> DataFrame:
    df = df.select(F.col(id_col), F.col(content_col).cast("binary").alias("_content"))
    kind = df.schema[id_col].dataType.simpleString()
    spark_schema = f"{id_col} {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(spark_schema))

    def run(batches):
        for batch in by_bytes(batches, "_content"):
            rows = [row(x or b"") | {id_col: i} for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return df.mapInArrow(run, spark_schema)


def messages(df: DataFrame, id_col: str = "msg_id", content_col: str = "raw") -> DataFrame:
    """One row per message: its id, headers, parts and texts."""
    return _mapped(df, id_col, content_col, MESSAGE, read_message)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[list[str]] = []
        self.assets: list[str] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "a" and found.get("href"):
            self.links.append([found["href"].strip(), ""])
            self.open = True
        if tag in ("a", "link", "img", "script", "iframe"):
            self.assets += [v for k in ("href", "src", "data-url") if (v := found.get(k) or "").startswith("http")]

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.open and self.links:
            self.links[-1][1] += data


def html_links(html: str) -> _Links:
    reader = _Links()
    try:
        reader.feed(html)
        reader.close()
    except (AssertionError, ValueError):
        pass
    return reader


def anchors(df: DataFrame, id_col: str = "msg_id", html_col: str = "html_text") -> DataFrame:
    """(id, links): an array of (href, display) of the anchors that lead to the web."""

    def row(x: bytes) -> dict:
        return {"links": [{"href": h, "display": " ".join(t.split())} for h, t in html_links(x.decode("utf-8", "replace")).links if h.startswith("http")]}

    return _mapped(df, id_col, html_col, "links array<struct<href:string,display:string>>", row)


def bare_urls(text: str, noise_tlds: frozenset[str]) -> list[str]:
    """Urls of a text and, outside of them, host names with a path or www."""
    spans = [m.span() for m in URL.finditer(text)]
    found = [u for a, b in spans if len(u := text[a:b].rstrip(".,;)>\"'/\\")) > 10]
    k = 0
    for m in BARE.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        u = m.group().rstrip(".,;)>\"'/\\")
        if len(u) <= 5 or k < len(spans) and spans[k][0] <= m.start():
            continue
        if u.rsplit(".", 1)[-1].split("/")[0].lower() not in noise_tlds and ("/" in u or u.lower().startswith("www.")):
            found.append(u)
    return found


def text_urls(payload: bytes, cap: int = LINK_CAP) -> list[str]:
    """Urls of a text or HTML attachment: those in the text, then those of its elements."""
    text = payload.decode("utf-8", "replace")
    found = [u for m in URL.finditer(text) if (u := m.group().rstrip(".,;)>\"'"))]
    if "<html" in text.lower() or "<a " in text.lower():
        found += html_links(text).assets
    return list(dict.fromkeys(found))[:cap]


def _members(payload: bytes, budget: int = pdf.BUDGET):
    """Names and contents of an archive, as long as the contents fit the budget together."""
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as archive:
            for name in sorted(archive.namelist()):
                with archive.open(name) as member:
                    data = member.read(budget)
                budget -= len(data)
                yield name, data
                if budget <= 0:
                    return
    except (zipfile.BadZipFile, OSError, RuntimeError, zlib.error):
        return


def office_links(payload: bytes) -> list[str]:
    """External targets of an office archive's relationships."""
    found = []
    for name, data in _members(payload):
        if name.endswith(".rels"):
            try:
                rels = ElementTree.fromstring(data)
            except ElementTree.ParseError:
                continue
            found += [r.get("Target", "").strip().rstrip(".,;>") for r in rels if r.get("TargetMode") == "External" and r.get("Target", "").startswith(("http://", "https://"))]
    return list(dict.fromkeys(u for u in found if u))


def office_text(payload: bytes) -> str:
    """Text of an office archive's documents, sheets and slides, without markup."""
    texts = [re.sub(r"<[^>]+>", " ", data.decode("utf-8", "replace")) for name, data in _members(payload) if name.endswith(".xml") and name.startswith(("word/", "xl/", "ppt/"))]
    return re.sub(r"\s+", " ", " ".join(texts)).strip()


def pdf_links(payload: bytes, cap: int = LINK_CAP, budget: int = pdf.BUDGET) -> list[str]:
    """Web targets of a PDF's actions, then urls in its bytes."""
    found = [u for u in pdf.Document(payload, budget).uris() if u.lower().startswith("http")]
    found += [m.group().rstrip(".,;)>\"'") for m in URL.finditer(payload.decode("latin-1"))]
    return list(dict.fromkeys(u for u in found if u))[:cap]


def pdf_text(payload: bytes, budget: int = pdf.BUDGET) -> str:
    """What a PDF's content shows, else its printable runs."""
    return pdf.Document(payload, budget).text() or pdf.printable(payload)


def carved_images(data: bytes) -> list[bytes]:
    """PNG and JPEG images inside any binary file."""
    return [m.group() for m in re.finditer(rb"\x89PNG\r\n\x1a\n.*?IEND.{8}|\xff\xd8\xff.*?\xff\xd9", data, re.S)]


def qr_payloads(image: bytes) -> list[str]:
    """Texts of the QR codes of an image; none where no decoder is installed."""
    try:
        import cv2
        import numpy as np
    except ImportError:
        return []
    picture = cv2.imdecode(np.frombuffer(image, np.uint8), cv2.IMREAD_COLOR)
    if picture is None:
        return []
    _, texts, *_ = cv2.QRCodeDetector().detectAndDecodeMulti(picture)
    return [t.strip() for t in texts if t.strip()]


def extractor(content_type: str, filename: str) -> str:
    """Which extractor reads a file: image, pdf, office, legacy, html, text or none."""
    name, kind = (filename or "").lower(), (content_type or "").lower()
    if kind.startswith("image/") or name.endswith((".png", ".jpg", ".jpeg", ".webp", ".bmp", ".gif", ".tiff")):
        return "image"
    if kind == "application/pdf" or name.endswith(".pdf"):
        return "pdf"
    if name.endswith(OFFICE_ZIP):
        return "office"
    if name.endswith((".doc", ".xls", ".ppt")):
        return "legacy"
    if kind in ("text/html", "application/xhtml+xml") or name.endswith((".html", ".htm")):
        return "html"
    if kind.startswith("text/") or name.endswith((".txt", ".csv", ".eml")):
        return "text"
    return "none"


FILE = "extractor string, size long, sha256 string, text string, urls array<string>, qr array<string>"


def read_file(payload: bytes, filename: str, content_type: str, noise_tlds: frozenset[str]) -> dict:
    """What a file says and links to; a file without urls is tried as plain bytes."""
    kind = extractor(content_type, filename)
    text, urls, qr = "", [], []
    if kind == "image":
        qr = qr_payloads(payload)
    elif kind == "pdf":
        urls, text = pdf_links(payload), pdf_text(payload)
        qr = [q for image in carved_images(payload) for q in qr_payloads(image)]
    elif kind == "office":
        urls, text = office_links(payload), office_text(payload)
        qr = [q for n, d in _members(payload) if "/media/" in n for q in qr_payloads(d)]
    elif kind == "legacy":
        qr = [q for image in carved_images(payload) for q in qr_payloads(image)]
    else:
        urls, text = text_urls(payload), payload.decode("utf-8", "replace")
    urls += bare_urls(text, noise_tlds)
    if not urls:
        urls = bare_urls(payload.decode("latin-1"), noise_tlds)
    return {"extractor": kind, "size": len(payload), "sha256": hashlib.sha256(payload).hexdigest(), "text": text, "urls": list(dict.fromkeys(urls)), "qr": list(dict.fromkeys(qr))}


def files(df: DataFrame, noise_tlds, *, name_col: str = "filename", type_col: str = "content_type", payload_col: str = "payload") -> DataFrame:
    """One row per file (filename, content_type, payload): how it was read, its hash, text, urls and QR payloads."""
    noise = frozenset(noise_tlds)
    df = df.select(F.col(name_col).cast("string").alias("filename"), F.col(type_col).cast("string").alias("content_type"), F.col(payload_col).cast("binary").alias("payload"))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"filename string, content_type string, {FILE}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in by_bytes(batches, "payload"):
            rows = [{"filename": n, "content_type": t} | read_file(p or b"", n or "", t or "", noise) for n, t, p in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return df.mapInArrow(run, schema)
