"""Merkle fixity audit of WARC replicas: compare roots, go down mismatching branches only, name the damaged records."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitloom.llm.common import stored

#: Children of a tree node, and levels over the slots: an archive file has FANOUT ** LEVELS slots.
FANOUT, LEVELS = 16, 3
SLOTS = FANOUT**LEVELS
#: Hex digits of a sha256 that name the archive, and the slot, of a page without an id.
ARCHIVE_DIGITS, SLOT_DIGITS = 5, 3


class Tree(NamedTuple):
    """Records by digest, and the nodes of each level, slots first, roots last; all of them written tables."""

    records: DataFrame
    levels: list[DataFrame]


def records(pages: DataFrame) -> DataFrame:
    """(archive, slot, page_id, url, record): pages as WARC response records.

    page_id, url, html: null html is an empty body, a null url an empty header. The same url and body make the same
    bytes. Each page id has a slot of its own, SLOTS neighbours make an archive; in it records stand by slot, url and
    digest. Pages without an id are dealt to archives below 0 by the sha256 of their url, without one of their bytes.
    """
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    record = F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")
    lost = F.when(F.col("page_id").isNull(), F.sha2(F.coalesce(F.col("url").cast("binary"), F.col("record")), 256))

    def number(begin: int, digits: int) -> Column:
        return F.conv(F.substring("lost", begin, digits), 16, 10).cast("long")

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", record.alias("record")).withColumn("lost", lost)
    archive = F.coalesce(F.floor(F.col("page_id") / SLOTS), -1 - number(1, ARCHIVE_DIGITS))
    slot = F.coalesce(F.pmod("page_id", F.lit(SLOTS)), F.pmod(number(1 + ARCHIVE_DIGITS, SLOT_DIGITS), F.lit(SLOTS)))
    return rows.select(archive.cast("long").alias("archive"), slot.cast("long").alias("slot"), "page_id", "url", "record")


def measured(archive: DataFrame) -> DataFrame:
    """(archive, slot, page_id, url, length, digest): records without their bytes."""
    return archive.select("archive", "slot", "page_id", "url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


def slots(rows: DataFrame) -> DataFrame:
    """(archive, node, length, digest): a leaf for each slot, over what it holds, however many records that are.

    Records of a slot have no order of their own, so the leaf hashes their number, bytes, and sums of parts of their digests.
    """
    parts = [F.sum(F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    whole = F.concat_ws(":", F.count("*").cast("string"), F.sum("length").cast("string"), *parts)
    return rows.groupBy("archive", F.col("slot").alias("node")).agg(F.sum("length").cast("long").alias("length"), F.sha2(whole.cast("binary"), 256).alias("digest"))


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes over FANOUT neighbours each: hashed over their digests and ordered offset ranges.

    Ranges count from the parent's own beginning, so a lost record changes the nodes above it and no others.
    """
    child = F.struct("node", "length", "digest")
    up = nodes.groupBy("archive", F.floor(F.col("node") / FANOUT).cast("long").alias("above")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    walked = F.aggregate("c", begin, lambda a, x: F.struct((a["at"] + x["length"]).alias("at"), F.concat(a["text"], F.concat_ws(":", x["node"], a["at"], x["length"], x["digest"]), F.lit("|")).alias("text")))
    return up.select("archive", F.col("above").alias("node"), walked.alias("w")).select("archive", "node", F.col("w.at").alias("length"), F.sha2(F.col("w.text").cast("binary"), 256).alias("digest"))


def tree(archive: DataFrame) -> Tree:
    """The tree of each archive file of a table (archive, slot, page_id, url, record), from `records` or a replica.

    Bytes are hashed where they are read; only digests are shuffled. Each level is written, so none is worked out twice.
    """
    rows = stored(measured(archive))
    levels = [stored(slots(rows))]
    for _ in range(LEVELS):
        levels.append(stored(parents(levels[-1])))
    return Tree(rows, levels)


def audit(master: Tree, replica: Tree) -> DataFrame:
    """Where a replica's records differ from the master's, by their trees.

    Roots are compared first; of each level below only children of nodes that differ are read. In slots that differ,
    records of the same page id and url whose bytes the other side hasn't are set against each other in the order of
    their digests. Returns a row for each: archive, slot, page_id, url; start, length, digest, copies in the master (start
    within the archive; of equal records, their number and the first one's start) and found, found_copies in the replica.
    kind: damaged (other bytes), missing (with found null), surplus (with start, length, digest null). Equal records that
    one side has more of are missing or surplus by the difference. A loss is one row: what follows it isn't damage.

    Null ids and urls are equal to themselves. Archives that only one side has are compared too. Equal replicas and empty
    tables give no rows. Other columns of either table are ignored.
    """
    off = None
    for a, b in zip(reversed(master.levels), reversed(replica.levels), strict=True):
        if off is None:
            a, b = (x.withColumn("begin", F.lit(0).cast("long")) for x in (a, b))
        else:
            a, b = (x.withColumn("above", F.floor(F.col("node") / FANOUT).cast("long")).join(off, ["archive", "above"]) for x in (a, b))
            before = Window.partitionBy("archive", "above").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
            a = a.withColumn("begin", F.col("begin") + F.coalesce(F.sum("length").over(before), F.lit(0)))
        old = a.select("archive", "node", "begin", F.col("digest").alias("old"))
        new = b.select("archive", "node", F.col("digest").alias("new"))
        differ = old.join(new, ["archive", "node"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
        off = stored(differ.select("archive", F.col("node").alias("above"), "begin"))
    here = off.withColumnRenamed("above", "slot")

    def held(rows: DataFrame) -> DataFrame:
        return rows.join(here, ["archive", "slot"]).groupBy("archive", "slot", "page_id", "url", "length", "digest", "begin").agg(F.count("*").alias("copies"))

    inside = Window.partitionBy("archive", "slot").orderBy(F.col("url").asc_nulls_first(), "digest", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    old = held(master.records).withColumn("start", F.col("begin") + F.coalesce(F.sum(F.col("length") * F.col("copies")).over(inside), F.lit(0)))
    new = held(replica.records)
    name = ["archive", "slot", "page_id", "url", "digest"]
    sides = old.select(*name, "length", "start", F.col("copies").alias("had"), F.lit(0).cast("long").alias("has")).unionByName(new.select(*name, "length", F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("had"), F.col("copies").alias("has")))
    each = sides.groupBy(*name).agg(F.max("length").alias("length"), F.max("start").alias("start"), (F.sum("had") - F.sum("has")).alias("more")).where("more <> 0")
    nth = Window.partitionBy("archive", "slot", "page_id", "url", F.col("more") > 0).orderBy("digest")
    each = each.withColumn("nth", F.row_number().over(nth))
    key = [*name[:-1], "nth"]
    gone = F.col("more") > 0

    def one(c: str, when: Column, out: str) -> Column:
        return F.max(F.when(when, F.col(c))).alias(out)

    paired = each.groupBy(*key).agg(one("start", gone, "start"), one("length", gone, "length"), one("digest", gone, "digest"), one("more", gone, "copies"), one("digest", ~gone, "found"), F.max(F.when(~gone, -F.col("more"))).alias("found_copies"))
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "surplus").otherwise("damaged")
    return paired.select("archive", "slot", "page_id", "url", "start", "length", kind.alias("kind"), "digest", "copies", "found", "found_copies")


def worn(archive: DataFrame) -> DataFrame:
    """A replica with bit rot: of records whose url's sha256 begins with 0, two of the closing bytes; those whose url's
    sha256 begins with ff are lost."""
    sign = F.sha2(F.coalesce("url", F.lit("")), 256)
    rotten = F.concat(F.expr("substring(record, 1, octet_length(record) - 2)"), F.lit(b"\n\n"))
    return archive.where(~sign.startswith("ff")).withColumn("record", F.when(sign.startswith("0"), rotten).otherwise(F.col("record")))


def oracle_sql() -> str:
    """What the audit of `worn` against `records` finds, in DuckDB's SQL over the table pages."""
    return f"""
    with r as (
      select page_id, url, coalesce(url, '') u,
        'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
          || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
          || coalesce(html, '') rec from pages),
    n as (select *, chr(13) || chr(10) || chr(13) || chr(10) ok, sha256(u) sign, sha256(coalesce(url, rec || chr(13) || chr(10) || chr(13) || chr(10))) lost from r),
    s as (
      select coalesce(floor(page_id / {SLOTS}), -1 - ('0x' || lost[1:{ARCHIVE_DIGITS}])::bigint)::bigint archive,
        coalesce(((page_id % {SLOTS}) + {SLOTS}) % {SLOTS}, ('0x' || lost[{ARCHIVE_DIGITS + 1}:{ARCHIVE_DIGITS + SLOT_DIGITS}])::bigint)::bigint slot,
        page_id, url, sign, strlen(rec) + 4 as length, sha256(rec || ok) digest, sha256(rec || chr(13) || chr(10) || chr(10) || chr(10)) bad from n),
    p as (
      select *, coalesce(sum(length) over (partition by archive order by slot, url nulls first, digest rows between unbounded preceding and 1 preceding), 0)::bigint as start from s),
    g as (
      select archive, slot, page_id, url, sign, length, digest, bad, min(start) as start, count(*) copies from p group by all),
    k as (
      select *, row_number() over (partition by archive, slot, page_id, url order by digest) i, row_number() over (partition by archive, slot, page_id, url order by bad) j
      from g where sign[1:1] = '0' or sign[1:2] = 'ff')
    select a.archive, a.slot, a.page_id, a.url, a.start, a.length::bigint length, case when b.bad is null then 'missing' else 'damaged' end kind,
      a.digest, a.copies, b.bad found, b.copies found_copies
    from k a left join k b on a.sign[1:1] = '0' and a.archive = b.archive and a.slot = b.slot and a.page_id is not distinct from b.page_id
      and a.url is not distinct from b.url and a.i = b.j"""
