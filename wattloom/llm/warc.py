"""WARC archives: written and read by Spark, in splits, with boundary-chain verification.

Writing is a projection: a record is one string, and the text writer's separator is the blank
line that ends a record. A payload that an earlier page also has becomes a revisit of it; the
table of such payloads holds repeated ones only, so pages themselves are not shuffled
unless that table outgrows Spark's broadcast threshold.

Reading cuts archives at every magic string, wherever it stands, and splits files at will.
Tasks emit for each cut a candidate: its length and, from the header behind it, the offset of
its successor. Per file, pointer jumping from the first byte (log2 n doublings over two integer
arrays) keeps the records that the chain of lengths reaches; a magic inside a payload is never
reached. A candidate takes some 40 bytes there, so even an archive of a million records is
a small group. Cuts inside a kept record are joined to its payload again: these are read once more and told by
what they hold (128 bits of hashes of their text), never by where a scan found them, as splits change with the
number of cores; a cut that is not found again is an error. A record's block is the
octets that its Content-Length counts: what stands behind them belongs to no record, and a record with
fewer (an archive cut short) is reported as ``truncated``.

Defined results: null html is an empty payload; payloads under 100 bytes are never revisits; rows
that share payload and least page_id are all responses; a null page_id revisits a page with an
id if there is one; control characters and blanks in urls are escaped, a null url is ``urn:none``;
an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm.common import Scratch, load

#: Fixed values of the format.
MAGIC, LINE, GAP = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 100


def write_warc(pages: DataFrame, path: str, scratch: Scratch, date: str = "2020-01-01T00:00:00Z") -> None:
    """Writes pages (page_id, url, html) as .warc text files under ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("urn:none")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = rows.where(F.octet_length("html") >= LEAST_BYTES)
    repeated = scratch.save(large.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least"), "repeated")
    rows = rows.join(repeated, "digest", "left")
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(GAP))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("least").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(GAP),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", GAP).text(path)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """What stands after each magic string: (file, split, at, value), ``at`` in reading order; another scan may split otherwise."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def _field(header: Column, name: str, value: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*{value}[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> dict[str, Column]:
    """Fields of a record whose text after the magic begins ``value``; its block ends where Content-Length says."""
    header = F.substring_index(value, GAP, 1)
    length = F.coalesce(_field(header, "Content-Length", r"(\d{1,15})").cast("long"), F.lit(0))
    rest = F.octet_length(value) - F.octet_length(header) - len(GAP)
    block = F.substr(value.cast("binary"), F.octet_length(header) + len(GAP) + 1, F.least(length, F.greatest(rest, F.lit(0))).cast("int")).cast("string")
    http = F.substring_index(block, GAP, 1)
    payload = F.substr(block, F.length(http) + len(GAP) + 1)
    revisit = _field(header, "WARC-Type", r"(\w+)") == "revisit"
    return {
        "page_id": _field(header, "WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long"),
        "url": _field(header, "WARC-Target-URI", r"(\S+)"),
        "record_type": _field(header, "WARC-Type", r"(\w+)"),
        "refers_to": _field(header, "WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long"),
        "payload_bytes": F.when(revisit, _field(http, "Content-Length", r"(\d+)").cast("long")).otherwise(F.octet_length(payload).cast("long")),
        "payload_digest": F.when(revisit, _field(header, "WARC-Payload-Digest", r"sha256:([0-9a-f]{64})")).otherwise(F.sha2(payload.cast("binary"), 256)),
        "truncated": rest < length,
        "payload": F.when(~revisit, payload),
    }


def _chain(table):
    """Pointer jumping over one file's candidates; rows in, (split, at, owner's split and at, kept) out."""
    import pyarrow as pa

    get = lambda c: table.column(c).to_numpy()
    order = np.lexsort((get("at"), get("split")))
    split, at = get("split")[order], get("at")[order]
    n, head, body = get("n")[order], get("head")[order], get("body")[order]
    start = np.concatenate(([0], np.cumsum(n + len(MAGIC))[:-1])) - len(MAGIC)  # of the magic before each cut
    following = np.where(body >= 0, start + len(MAGIC) + head + len(GAP) + body + len(GAP), -1)
    end = len(n)
    jump = np.searchsorted(start, following)
    jump = np.where((jump < end) & (start[np.minimum(jump, end - 1)] == following), jump, end)
    jump = np.append(np.where(start < 0, end, jump), end)  # the cut before the first magic is no record
    kept = np.zeros(end + 1, bool)
    kept[np.searchsorted(start, 0) if (start == 0).any() else end] = True
    for _ in range(max(1, int(end).bit_length())):
        kept[jump[np.nonzero(kept)[0]]] = True
        jump = jump[jump]
    kept = kept[:end]
    owner = np.maximum.accumulate(np.where(kept, np.arange(end), -1))
    inside = np.nonzero(owner >= 0)[0]
    inside = inside[start[inside] < np.maximum(following[owner[inside]], start[owner[inside]] + 1)]
    own = owner[inside]
    columns = [pa.array([table.column("file")[0].as_py()] * len(inside), pa.string()), *(pa.array(x) for x in (split[inside], at[inside], split[own], at[own], kept[inside]))]
    return pa.table(columns, names=["file", "split", "at", "own_split", "own_at", "kept"])


def read_warc(spark: SparkSession, path: str, scratch: Scratch, payloads: bool = False) -> DataFrame:
    """Records under ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, truncated.

    With ``payloads``, also the payload of responses.
    """
    value = F.col("value")
    header = F.substring_index(value, GAP, 1)
    body = F.coalesce(F.when(F.octet_length(header) < F.octet_length(value), _field(header, "Content-Length", r"(\d{1,15})").cast("long")), F.lit(-1).cast("long"))
    fields = _parsed(value)
    names = [c for c in fields if payloads or c != "payload"]
    sizes = [F.octet_length(value).cast("long").alias("n"), F.octet_length(header).cast("long").alias("head"), body.alias("body")]
    hashes = [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(7), value).alias("h2")]
    found = scratch.save(_cuts(spark, path).select("file", "split", "at", *sizes, *hashes, *[fields[c].alias(c) for c in names]), "cuts")
    narrow = found.select("file", "split", "at", "n", "head", "body")
    chain = scratch.save(narrow.groupBy("file").applyInArrow(_chain, "file string, split long, at long, own_split long, own_at long, kept boolean"), "chain")
    parted = chain.where("not kept").select("file", F.col("own_split").alias("split"), F.col("own_at").alias("at")).distinct()
    keys = ["file", "split", "at"]
    # both sides grow with the archives, though their columns compress to little: no broadcast by file size
    whole = found.join(chain.where("kept").select(*keys).hint("merge"), keys).join(parted.hint("merge"), keys, "left_anti").select(*names)
    if not parted.limit(1).count():
        return whole
    own = parted.select("file", F.col("split").alias("own_split"), F.col("at").alias("own_at"))
    pieces = chain.join(own, ["file", "own_split", "own_at"]).join(found.select(*keys, "h1", "h2").hint("merge"), keys)
    pieces = scratch.save(pieces.select("file", "own_split", "own_at", "split", "at", "h1", "h2"), "pieces")
    wanted = pieces.select("h1", "h2").distinct()
    again = _cuts(spark, path).select(*hashes, "value").join(wanted, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("value").alias("value"))
    pieces = pieces.join(again, ["h1", "h2"], "left")
    held = F.coalesce("value", F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("file"))))
    together = pieces.groupBy("file", "own_split", "own_at").agg(F.array_sort(F.collect_list(F.struct("split", "at", held.alias("value")))).alias("cuts"))
    # the last cut of a record may run on into bytes that belong to none; its length says where it ends
    text = F.array_join(F.transform("cuts", lambda c: c["value"]), MAGIC)
    again = _parsed(value)
    return whole.unionByName(together.select(text.alias("value")).select(*[again[c].alias(c) for c in names]))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_warc(load(spark, sf_dir, "pages"), path, scratch)
    return read_warc(spark, path, scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages
), m as (
  select *, min(page_id) over (partition by html) as least from p
)
select page_id, cast(n as bigint) as payload_bytes, sha256(html) as payload_digest,
  case when n >= 100 and page_id <> least then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> least then least end as refers_to
from m
"""
