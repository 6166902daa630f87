"""Content-addressed WARC archive (operator 11).

``archive`` stores records (exact header block, payload bytes) in a folder of the shared store:

``headers``   a Parquet row a record: its exact header block as given, its kind (response or revisit) and the
              SHA-256 of its payload.  No payload bytes.
``warc``      standard WARC 1.1 files (gzip): payload bytes once a digest, in the ``response`` record of the
              first record that has them; every other record is a ``revisit`` that names it.

Which record owns a digest is settled on (digest, order, record) alone; payload bytes cross the network once, by
their digest.  Two digests of each payload are taken, SHA-256 as key and SHA-1 for the WARC fields; a key with two
different SHA-1 values or lengths stops the archive.  ``read_warc`` parses the files by Content-Length (payloads may
hold anything, record separators included) and takes the digests anew from the bytes it finds; a block whose
digest isn't the one in its header stops the reading.  ``restore`` joins header rows to payloads and gives the
original records back, byte for byte.  A digest with very many records is joined by broadcast: there are fewer than
``HOT`` such digests, by count (``hot_join``).

Defined cases: a null html is an empty payload; a null url leaves WARC-Target-URI out; white space and control
characters in a url are percent-encoded in the header; among records with equal payloads the smallest id owns them, null ids come last, and of
repeated rows one owns and the others revisit it; a payload of less than ``least`` bytes is never revisited, all
such records are responses; an empty table gives an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcorpus.llm.common import hot_join, shuffle_parts, written

#: Payload bytes that one WARC file holds, about (a larger payload has a file almost for itself).
FILE_BYTES = 1 << 25
#: Payload bytes that one Arrow batch of parsed records holds (or one record).
BATCH_BYTES = 1 << 23
#: Records that take one payload from one place; a payload with more is dealt out so many times.
SHARE = 4096
CRLF2 = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(body: Column) -> Column:
    """Upper-case base32 of the SHA-1: ten hex digits at a time become eight digits of base 32."""
    digest = F.sha1(body)
    part = lambda i: F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*[part(i) for i in range(4)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(*cols: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _uri(url: Column) -> Column:
    out = url
    for code in [*range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def _field(name: str, value: Column) -> Column:
    """A header line; an empty string for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                 date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """(id, uri, head, payload): a response record for each page, head with the HTTP header and the blank lines."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), _uri(F.col(url)).alias("uri"), body.alias("payload"))
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(CRLF2))
    record = _uuid(F.col("id"), F.col("uri"), F.sha2("payload", 256))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), _field("WARC-Record-ID", record), _field("WARC-Target-URI", F.col("uri")),
                    _field("WARC-Date", F.lit(date)), _field("WARC-Page-ID", F.col("id")),
                    F.lit("Content-Type: application/http;msgtype=response\r\n"),
                    _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
                    _field("Content-Length", F.length(http) + size), F.lit("\r\n"), http)
    return rows.select("id", "uri", head.alias("head"), "payload")


def _head_field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive(records: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write ``records`` (id, head, payload) to ``folder``: ``headers`` and ``warc``, both new."""
    spark = records.sparkSession
    payload = F.col("payload")
    keyed = records.select(F.monotonically_increasing_id().alias("row"), "id", "head", F.sha2(payload, 256).alias("key"),
                           base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    narrow = written(keyed, "warc-records")
    long_enough = narrow.where(F.col("n_bytes") >= least)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", _head_field(F.col("head"), "WARC-Record-ID").alias("record"),
                           _head_field(F.col("head"), "WARC-Target-URI").alias("uri"), _head_field(F.col("head"), "WARC-Date").alias("date")))
    owners = long_enough.groupBy("key").agg(first.alias("o"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1"), F.min("n_bytes").alias("n0"),
                                            F.max("n_bytes").alias("n1"))
    same = (F.col("s0") == F.col("s1")) & (F.col("n0") == F.col("n1"))
    checked = F.when(same, F.col("o.row")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under one SHA-256: "), F.col("key"))))
    owners = written(owners.select("key", checked.alias("owner"), F.col("o.record").alias("refers_record"), F.col("o.uri").alias("refers_uri"),
                                   F.col("o.date").alias("refers_date")), "warc-owners")
    judged = hot_join(long_enough, owners, "key").unionByName(narrow.where(F.col("n_bytes") < least), allowMissingColumns=True)
    revisit = F.coalesce(F.col("owner") != F.col("row"), F.lit(False))
    judged.select("row", "id", "head", "key", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("kind"),
                  *[F.when(revisit, F.col(c)).alias(c) for c in ("refers_record", "refers_uri", "refers_date")]).write.parquet(f"{folder}/headers")
    _write_warc(spark, records.select(F.sha2(payload, 256).alias("key"), "payload"), folder, file_bytes)


def _write_warc(spark: SparkSession, payloads: DataFrame, folder: str, file_bytes: int) -> None:
    """The WARC files: the record separator is two line ends, which is what Spark's text writer puts after a row."""
    headers = spark.read.parquet(f"{folder}/headers")
    total = headers.where("kind = 'response'").agg(F.sum("n_bytes")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    owners = headers.where("kind = 'response'").select("key", "head")
    bodies = payloads.dropDuplicates(["key"])  # copies meet map-side first
    full = owners.join(bodies.hint("merge"), "key").select(F.concat(F.col("head").cast("binary"), "payload").cast("string").alias("value"))
    again = headers.where("kind = 'revisit'").select(_revisit_head().alias("value"))
    with shuffle_parts(spark, files):
        full.unionByName(again).write.option("lineSep", CRLF2).option("compression", "gzip").text(f"{folder}/warc")


def _revisit_head() -> Column:
    """The revisit form of a response's head: its HTTP header stays, its payload is named."""
    at = F.instr(F.col("head"), CRLF2)
    warc, http = F.expr(f"substring(head, 1, instr(head, '{_sql(CRLF2)}') + 1)"), F.expr(f"substring(head, instr(head, '{_sql(CRLF2)}') + 4)")
    kept = F.regexp_replace(warc, r"(?i)\r\nWARC-Type:[^\r\n]*", "\r\nWARC-Type: revisit")
    kept = F.regexp_replace(kept, r"(?i)\r\nContent-Length:[^\r\n]*", "")
    new = F.concat(_field("WARC-Profile", F.lit(PROFILE)), _field("WARC-Refers-To", F.col("refers_record")),
                   _field("WARC-Refers-To-Target-URI", F.col("refers_uri")), _field("WARC-Refers-To-Date", F.col("refers_date")),
                   _field("Content-Length", F.octet_length(http)))
    return F.when(at > 0, F.concat(kept, new, F.lit("\r\n"), http)).otherwise(F.raise_error(F.lit("a record's head has no blank line")))


def _sql(text: str) -> str:
    return text.replace("\r", "\\r").replace("\n", "\\n")


def split_records(raw: bytes):
    """(fields, head, payload) of each record of an unpacked WARC file; names of fields in lower case."""
    at = 0
    while at < len(raw):
        blank = raw.find(b"\r\n\r\n", at)
        lines = raw[at:blank].split(b"\r\n") if blank >= 0 else [b""]
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        start = blank + 4
        end = start + int(fields["content-length"])
        if raw[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record of {fields['content-length']} bytes doesn't end at byte {end}")
        body = start
        if fields.get("content-type", "").startswith("application/http"):
            inner = raw.find(b"\r\n\r\n", start, end)
            body = inner + 4 if inner >= 0 else end
        yield fields, raw[at:body], raw[body:end]
        at = end + 4


def _unpacked(raw: bytes) -> bytes:
    """A gzip file of any number of members, or a plain file."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        one = zlib.decompressobj(31)
        out.append(one.decompress(raw))
        raw = one.unused_data
    return b"".join(out)


_FIELDS = {"record": "warc-record-id", "kind": "warc-type", "uri": "warc-target-uri", "date": "warc-date", "id": "warc-page-id", "refers_record": "warc-refers-to"}
_READ = ", ".join([*[f"{c} string" for c in _FIELDS], "head binary", "key string", "sha1 string", "n_bytes long"])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record, kind, uri, date, id, refers_record, head, key, sha1, n_bytes[, payload]) of the records of the WARC
    files in ``path``.  key and sha1 are taken from the bytes found; for a revisit, key is null and sha1 is what
    its header names.  A file is one task's work: ``archive`` bounds it."""
    def parse(batches):
        rows, held = [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                for fields, head, payload in split_records(_unpacked(packed)):
                    named = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    key = sha1 = None
                    if fields.get("warc-type") == "revisit":
                        sha1 = named
                    else:
                        key, sha1 = hashlib.sha256(payload).hexdigest(), b32encode(hashlib.sha1(payload).digest()).decode()
                        if named not in (None, sha1):
                            raise ValueError(f"{fields.get('warc-record-id')} holds {sha1}, not {named}")
                    rows.append([*[fields.get(f) for f in _FIELDS.values()], head, key, sha1, len(payload), payload][:10 + payloads])
                    held += len(head) + len(payload) * payloads
                    if held > BATCH_BYTES or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    names = [*_FIELDS, "head", "key", "sha1", "n_bytes", "payload"][:10 + payloads]
    types = [*[pa.string()] * 6, pa.binary(), pa.string(), pa.string(), pa.int64(), pa.binary()][:10 + payloads]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, _READ + (", payload binary" if payloads else ""))


def restore(spark: SparkSession, folder: str) -> DataFrame:
    """(id, head, payload): the original records, header rows joined to the payloads of the WARC files."""
    headers = spark.read.parquet(f"{folder}/headers").select("row", "id", "head", "key")
    uses = headers.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("parts"))
    uses = written(uses, "warc-uses")
    wanted = hot_join(headers, uses, "key").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    stored = read_warc(spark, f"{folder}/warc").where("kind <> 'revisit'").select("key", "payload").dropDuplicates(["key"])
    stored = stored.join(uses, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return wanted.join(stored.select("key", "part", "payload"), ["key", "part"]).select("id", "head", "payload")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive of ``page_records``, read from
    its WARC files: a revisit is joined to the response that it names, whose payload was read and digested."""
    found = written(read_warc(spark, f"{folder}/warc", payloads=False).select(
        F.col("id").cast("long").alias("page_id"), "record", "kind", "refers_record", "sha1", "n_bytes"), "warc-index")
    of = found.where("kind = 'response'").groupBy("record").agg(F.min("page_id").alias("owner_id"), F.max("n_bytes").alias("full_bytes"), F.min("sha1").alias("full_sha1"))
    again = hot_join(found.where("kind = 'revisit'").withColumn("record", F.col("refers_record")), written(of, "warc-responses"), "record")
    agreed = F.when(F.col("sha1") == F.col("full_sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("a revisit's digest isn't its response's")))
    first = found.where("kind = 'response'").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"),
                                                    F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again.select("page_id", F.col("full_bytes").alias("payload_bytes"), agreed.alias("payload_digest"),
                                          F.col("kind").alias("record_type"), F.col("owner_id").alias("refers_to")))
