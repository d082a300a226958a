"""Mail source: RFC 822 message bytes -> header and part rows.

Headers are read with column functions from the text up to the first blank
line, so messages can be filtered by sender and date before any body is
parsed. MIME parsing is the one place the standard-library ``email`` parser is
used: ``mapInArrow`` runs it per Arrow batch on the executors and emits one row
per (message, part); everything after that is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

PARTS_SCHEMA = ("idx bigint, message_id string, from_header string, subject string, date string, "
                "part_idx int, content_type string, disposition string, content string")
PARTS_ARROW = pa.schema([(c.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]])
                         for c in PARTS_SCHEMA.split(", ")])


PIECE_BYTES, PIECE_ROWS = 1 << 22, 1000     # characters and rows of a batch that goes back to Spark


def _policy():
    """``email.policy.default`` that parses a header value once, however often it is
    asked for; a part's type is asked for several times, and few values differ."""
    from email import policy
    from email.headerregistry import HeaderRegistry

    registry = HeaderRegistry()
    types = {}                      # HeaderRegistry makes a class at each call

    def made(name, value):
        kind = registry.registry.get(name.lower(), registry.default_class)
        if kind not in types:
            types[kind] = registry[name]
        return types[kind](name, value)
    return policy.default.clone(header_factory=lru_cache(maxsize=256)(made))


def _part_rows(idx: int, msg) -> Iterator[tuple]:
    """The rows of one parsed message."""
    def hdr(name):
        try:
            v = msg.get(name)
            return None if v is None else str(v)
        except Exception:  # noqa: BLE001 - a malformed header leaves its field empty
            return None
    head = (idx, hdr("Message-ID"), hdr("From"), hdr("Subject") or "", hdr("Date"))
    n = 0
    for part in msg.walk() if msg.is_multipart() else [msg]:
        if part.is_multipart():
            continue
        try:
            content = part.get_content()
        except Exception:  # noqa: BLE001 - undecodable part, fall back to raw bytes
            payload = part.get_payload(decode=True)
            if payload is None:
                continue
            content = payload.decode(part.get_content_charset() or "utf-8", errors="replace")
        if not isinstance(content, str):
            content = None
        yield head + (n, part.get_content_type(), part.get_content_disposition(), content)
        n += 1
    if n == 0:
        yield head + (None, None, None, None)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One message at a time; its rows go back in pieces of bounded size, whatever
    the size of the batches that come in."""
    from email.parser import BytesParser

    parser = BytesParser(policy=_policy())
    rows, held = [], 0

    def piece():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PARTS_ARROW.types)], schema=PARTS_ARROW)
    for batch in batches:
        for idx, raw in zip(batch.column("idx"), batch.column("content")):
            if not raw.is_valid:
                continue
            for row in _part_rows(idx.as_py(), parser.parsebytes(raw.as_py())):
                rows.append(row)
                held += len(row[-1] or "")
                if held >= PIECE_BYTES or len(rows) >= PIECE_ROWS:
                    yield piece()
                    rows, held = [], 0
    if rows:
        yield piece()


HEADERS = {"message_id": "Message-ID", "from_header": "From", "subject": "Subject", "date": "Date"}


def message_headers(raw: DataFrame) -> DataFrame:
    """``(idx, content)`` with the message's headers (the first of a name, folded
    lines joined, null if missing; the subject empty). Encoded words stay as they
    are: see ``decode_headers``."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    head = F.regexp_replace(F.regexp_extract(text, r"(?s)\A(.*?)(?:(?:\A|\r?\n)\r?\n|\z)", 1), r"\r?\n(?=[ \t])", "")

    def header(name):
        found = F.when(F.regexp_like("_head", F.lit(f"(?im)^{name}:")), F.regexp_extract("_head", rf"(?im)^{name}:[ \t]*(.*)$", 1))
        return F.coalesce(found, F.lit("")) if name == "Subject" else found

    # a generator: conditions on a header are not pushed below it, where each mention would extract it again
    return raw.select("idx", "content", head.alias("_head")).select(
        "idx", "content", F.inline(F.array(F.struct(*[header(name).alias(c) for c, name in HEADERS.items()]))))


@pandas_udf(StringType())
def _decoded(values: pd.Series) -> pd.Series:
    from email.errors import HeaderParseError
    from email.header import decode_header, make_header

    def one(v):
        if v is None or "=?" not in v:
            return v
        try:
            return str(make_header(decode_header(v)))
        except (HeaderParseError, LookupError, UnicodeDecodeError):      # an unknown charset or broken word stays as sent
            return v
    return values.map(one)


def decode_headers(messages: DataFrame) -> DataFrame:
    """Encoded words of the subject and the sender's name as text."""
    return messages.withColumn("subject", _decoded("subject")).withColumn("from_header", _decoded("from_header"))


def message_parts(raw: DataFrame) -> DataFrame:
    """src_email_messages: ``(idx, content BINARY)`` -> one row per part with
    the decoded message headers."""
    return raw.select("idx", "content").mapInArrow(_parse_batches, PARTS_SCHEMA)


def read_eml_files(spark, path: str) -> DataFrame:
    """src_email_messages over landed ``.eml`` files: ``binaryFile`` source,
    one message per file, then the same part rows as ``message_parts``."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true")
           .load(path).select(F.xxhash64("path").alias("idx"), "content"))
    return message_parts(raw)
