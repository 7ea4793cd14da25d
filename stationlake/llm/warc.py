"""Legacy archive conversion: ARC to WARC.

`write_arc` stores pages as ARC files (version 1 and version 2), the legacy
form; `read_arc` parses them by their version block, the version's header
fields and the declared lengths; `write_warc` synthesises the equivalent WARC
records: identifiers, ISO timestamps, types and digests, with repeated
payloads as revisits; `read_warc` reads those archives back.

Archives are files that Spark's text writer writes (the record separator is
the writer's line separator) and its binary reader reads, so any file system
that Spark knows will do.  A task writes sections of bounded size, each
beginning with its own version block or warcinfo record, and a file holds a
fixed number of sections, so readers hold one file at most.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.llm._base import fresh_folder, unstage

#: Header fields of an ARC record by version (fixed by the format).
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("page_id string, url string, ip string, date string, mime string, head string, payload string, "
          "payload_bytes long, payload_digest string, record_id string, at string")


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _token(value: str | None, missing: str) -> str:
    """A header field without white space (escaped as in URLs)."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), value or "") or missing


def _sections(records: Iterator[str], first: Callable[[], str], separator: str, limit: int) -> Iterator[str]:
    """Records joined to sections of about ``limit`` characters."""
    section, size = [first()], 0
    for record in records:
        section.append(record)
        size += len(record)
        if size >= limit:
            yield separator.join(section)
            section, size = [first()], 0
    if len(section) > 1:
        yield separator.join(section)


def _write(df: DataFrame, path: str, separator: str) -> None:
    (df.write.option("lineSep", separator).option("compression", "gzip")
     .option("maxRecordsPerFile", 4).text(path))


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              crawl_date: str = "20240101000000", section_chars: int = 1 << 24) -> None:
    """One ARC record per page: an HTTP response with the html as its body.

    Null html is an empty body; a page without id has no ``X-Page-Id``.
    Sections alternate between the versions.
    """
    thin = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = {"version": 2}

        def block() -> str:
            version = state["version"] = 3 - state["version"]
            body = f"{version} 0 stationlake\n{' '.join(ARC_FIELDS[version])}\n"
            # The version block's own header always has version 1 fields.
            return record("filedesc://stationlake.arc", "text/plain", body, "200", 1)

        def record(url: str, mime: str, content: str, code: str, version: int) -> str:
            data = content.encode("utf-8", "surrogatepass")
            values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": crawl_date, "Content-type": mime,
                      "Result-code": code, "Checksum": _sha1(data), "Location": "-", "Offset": "0",
                      "Filename": "stationlake.arc", "Archive-length": str(len(data))}
            return " ".join(values[f] for f in ARC_FIELDS[version]) + "\n" + content

        def records() -> Iterator[str]:
            for batch in batches:
                for i, url, page in zip(batch["id"], batch["url"], batch["html"]):
                    page = page or ""
                    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                            f"Content-Length: {len(page.encode('utf-8', 'surrogatepass'))}"]
                    if i is not None:
                        head.append(f"X-Page-Id: {i}")
                    yield record(_token(url, "about:blank"), "text/html", "\r\n".join([*head, "", ""]) + page, "200",
                                 state["version"])

        for section in _sections(records(), block, "\n", section_chars):
            yield pd.DataFrame({"value": [section]})

    _write(thin.mapInPandas(build, "value string"), path, "\n")


def _http(block: bytes) -> tuple[dict[str, str], str, bytes]:
    """(headers, head text, body) of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    text = head.decode("utf-8", "replace")
    headers = dict(line.split(": ", 1) for line in text.split("\r\n")[1:] if ": " in line)
    return headers, text, body


def _version_fields(values: list[str], content: bytes) -> list[str] | None:
    """The fields that a version block declares; None for any other record.

    A version block is plain text under a ``filedesc:`` URL that names a known
    version and that version's fields; a page may have such a URL as well."""
    if not values[0].startswith("filedesc:") or values[3] != "text/plain":
        return None
    first, _, rest = content.decode("utf-8", "replace").partition("\n")
    version, fields = first.split(" ", 1)[0], rest.split("\n", 1)[0].split(" ")
    if version.isdigit() and fields == ARC_FIELDS.get(int(version)):
        return fields
    if version.isdigit() and fields[0] == "URL":
        raise ValueError(f"unknown ARC version block: {content[:200]!r}")
    return None


def parse_arc(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of every record but the version blocks.

    A version block names the version and its fields for the records that
    follow; content is read by the declared length, so line breaks and header
    look-alikes in it do no harm.
    """
    fields = ARC_FIELDS[1]
    while line := data.readline():
        line = line.rstrip(b"\r\n")
        if not line:  # the separator between records
            continue
        text = line.decode("utf-8", "replace")
        values = text.split(" ")
        # A version block has the fields of version 1 under either version.
        block = len(values) == len(ARC_FIELDS[1]) and values[0].startswith("filedesc:")
        if not (block or len(values) == len(fields)) or not values[-1].isdigit():
            raise ValueError(f"malformed ARC header: {text[:200]!r}")
        content = data.read(int(values[-1]))
        if len(content) != int(values[-1]):
            raise ValueError(f"ARC record cut short: {text[:200]!r}")
        declared = _version_fields(values, content) if block else None
        if declared:
            fields = declared
        elif len(values) != len(fields):
            raise ValueError(f"malformed ARC header: {text[:200]!r}")
        else:
            yield dict(zip(fields, values)), content


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of ARC files, with what WARC needs synthesised: record id
    (from URL, date, page and digest), SHA-1 payload digest; ``at`` is the
    record's place (file and number).  ``payload=False`` leaves head and
    payload null, for passes that only need the digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, size = [], 0
                with gzip.open(io.BytesIO(content)) as data:
                    for k, (h, block) in enumerate(parse_arc(data)):
                        headers, head, body = _http(block)
                        digest, page = _sha1(body), headers.get("X-Page-Id")
                        ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{h['URL']} {h['Archive-date']} {page} {digest}")
                        rows.append((page, h["URL"], h["IP-address"], h["Archive-date"], h["Content-type"],
                                     head if payload else None,
                                     body.decode("utf-8", "surrogatepass") if payload else None,
                                     len(body), digest, str(ident),
                                     f"{name.rsplit('/', 1)[-1]}#{k:09d}"))
                        size += len(body) if payload else 0
                        if size > 1 << 24:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])

    return files.mapInPandas(parse, RECORD)


def with_revisits(records: DataFrame, digests: DataFrame, min_bytes: int = 0, salts: int = 16,
                  page_type: str = "long") -> DataFrame:
    """``records`` plus ``original`` (struct page_id, record_id, or null): the
    response that a repeated payload refers to.  ``digests`` are the same
    records, payloads not needed.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page id is
    the response, in the order of ``page_type`` (missing ids last, then the place in the archive).  Only
    repeated digests are joined, ``salts`` copies of each, so a payload that a
    third of all pages share meets its group in many tasks.
    """
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").try_cast(page_type).alias("page"), "at",
                     "page_id", "record_id")
    repeated = (digests.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                .agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
                .select("payload_digest", F.struct("o.page_id", "o.record_id", "o.at").alias("o"),
                        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    salted = records.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)).cast("int"))
    return (salted.join(repeated, ["payload_digest", "salt"], "left")
            .withColumn("original", F.when((F.col("payload_bytes") >= min_bytes) & (F.col("o.at") != F.col("at")),
                                           F.struct("o.page_id", "o.record_id")))
            .drop("o", "salt"))


def write_warc(records: DataFrame, path: str, section_chars: int = 1 << 24) -> None:
    """WARC/1.1 records from `with_revisits`: responses with head and payload,
    revisits with the head only and a reference to their response."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def record(kind: str, ident: str, date: str, mime: str, extra: list[str], block: str) -> str:
            data = block.encode("utf-8", "surrogatepass")
            return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{ident}>",
                                f"WARC-Date: {date}", *extra, f"WARC-Block-Digest: sha1:{_sha1(data)}",
                                f"Content-Type: {mime}", f"Content-Length: {len(data)}", "", block])

        def info() -> str:
            body = "software: stationlake\r\nformat: WARC File Format 1.1\r\n"
            return record("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_URL, body)), "2024-01-01T00:00:00Z",
                          "application/warc-fields", [], body)

        def records_of() -> Iterator[str]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    d = r.date
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    extra = [f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}",
                             f"WARC-Payload-Digest: sha1:{r.payload_digest}"]
                    head = r.head + "\r\n\r\n"
                    if r.revisit:
                        extra += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:uuid:{r.original_record}>"]
                        if r.original_page is not None:
                            extra.append(f"X-Refers-To-Page-Id: {r.original_page}")
                    yield record("revisit" if r.revisit else "response", r.record_id, date,
                                 "application/http; msgtype=response", extra, head if r.revisit else head + r.payload)

        for section in _sections(records_of(), info, "\r\n\r\n", section_chars):
            yield pd.DataFrame({"value": [section]})

    flat = records.select("url", "ip", "date", "head", "payload_digest", "record_id",
                          F.when(F.col("original").isNull(), F.col("payload")).alias("payload"),
                          F.col("original").isNotNull().alias("revisit"),
                          F.col("original.page_id").alias("original_page"),
                          F.col("original.record_id").alias("original_record"))
    _write(flat.mapInPandas(build, "value string"), path, "\r\n\r\n")


def parse_warc(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by declared length."""
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"malformed WARC record: {line[:200]!r}")
        header: dict[str, str] = {}
        while (line := data.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            header[name] = value
        block = data.read(int(header["Content-Length"]))
        if len(block) != int(header["Content-Length"]):
            raise ValueError(f"WARC record cut short: {header}")
        yield header, block


def read_warc(spark: SparkSession, path: str, page_type: str = "long", payload: bool = True) -> DataFrame:
    """page_id, url, record_id, record_type, payload_bytes, payload_digest,
    refers_to (page id), refers_to_record, payload (null for revisits, or for
    all with ``payload=False``) of the response and revisit records.

    Every block is held against its digest.  A response's payload length and
    digest are computed anew from the payload read, and held against what the
    record declares; a revisit has no payload and keeps what it declares."""
    columns = ["page_id", "url", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to",
               "refers_to_record", "payload"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                with gzip.open(io.BytesIO(content)) as data:
                    for h, block in parse_warc(data):
                        if h["WARC-Block-Digest"] != f"sha1:{_sha1(block)}":
                            raise ValueError(f"WARC block does not match its digest: {h['WARC-Record-ID']}")
                        if h["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, body = _http(block)
                        revisit = h["WARC-Type"] == "revisit"
                        declared = int(http["Content-Length"]), h["WARC-Payload-Digest"].partition(":")[2]
                        found = declared if revisit else (len(body), _sha1(body))
                        if found != declared:
                            raise ValueError(f"WARC payload is not the declared one: {h['WARC-Record-ID']}")
                        rows.append((http.get("X-Page-Id"), h["WARC-Target-URI"], h["WARC-Record-ID"], h["WARC-Type"], *found,
                                     h.get("X-Refers-To-Page-Id"), h.get("WARC-Refers-To"),
                                     None if revisit or not payload else body.decode("utf-8", "surrogatepass")))
                        size += len(body) if payload else 0
                        if size > 1 << 24:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    read = files.mapInPandas(parse, "page_id string, url string, record_id string, record_type string, "
                             "payload_bytes long, payload_digest string, refers_to string, "
                             "refers_to_record string, payload string")
    return read.withColumns({c: F.col(c).cast(page_type) for c in ("page_id", "refers_to")})


def convert(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_bytes: int = 0, folder: str | None = None, payload: bool = True) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC archives read back (`read_warc`).

    ``folder`` gets ``arc/`` and ``warc/``; without one a fresh folder below
    the shared checkpoint folder holds them, and the legacy archives go once
    they are converted.  Of records with equal payloads exactly one is a
    response.  Empty payloads count like others from ``min_bytes`` 0; an empty
    table gives empty archives and an empty result.
    """
    spark, page_type = pages.sparkSession, dict(pages.dtypes)[id_col]
    own = folder or fresh_folder(spark, "archive")
    write_arc(pages, f"{own}/arc", id_col, url_col, html_col)
    records, digests = (read_arc(spark, f"{own}/arc", payload=whole) for whole in (True, False))
    write_warc(with_revisits(records, digests, min_bytes, page_type=page_type), f"{own}/warc")
    if not folder:
        unstage(spark, f"{own}/arc")
    return read_warc(spark, f"{own}/warc", page_type, payload)
