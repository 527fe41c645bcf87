"""Exports, metadata and draft documents."""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom import schemas, vocab
from leadloom.functions.render import draft_content, draft_file_name
from leadloom.functions.text import blank, safe_name, yes_no
from leadloom.operators.mutate import last_per_key
from leadloom.session import local_path, parse_instant


def export_jobs(jobs: DataFrame, headers: bool = False) -> DataFrame:
    """The ten export columns, newest first; NULL ``applied_at`` becomes ''."""
    out = jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).select(
        "id", "company", "role", "jd_url", "source", "location",
        yes_no("h1b_confirmed").alias("h1b_confirmed"),
        F.col("applied_status").alias("status"),
        F.coalesce(F.col("applied_at").cast("string"), F.lit("")).alias("applied_at"),
        F.col("created_at").cast("string").alias("created_at"))
    return out.toDF(*vocab.EXPORT_HEADERS) if headers else out


def write_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def stats_long(stats: DataFrame) -> DataFrame:
    """One row per metric of a one-row statistics table."""
    pairs = [F.struct(F.lit(label).alias("metric"), F.col(name).cast("bigint").alias("value"))
             for name, label in vocab.STATS_LABELS if name in stats.columns]
    return stats.select(F.inline(F.array(*pairs)))


def folder_name(company: str = "company", role: str = "role", key: str = "id"):
    return F.concat_ws("_", safe_name(company), safe_name(role), F.col(key).cast("string"))


def metadata_rows(jobs: DataFrame, asof: dt.datetime | str) -> DataFrame:
    """One metadata record per listing."""
    stamp = F.lit(parse_instant(asof).isoformat())
    rows = jobs.select(
        F.col("id").alias("job_id"), "company", "role", "jd_url", "source", "location",
        F.coalesce("h1b_confirmed", F.lit(False)).alias("h1b_confirmed"),
        F.coalesce("applied_status", F.lit("pending")).alias("applied_status"),
        folder_name().alias("folder"), stamp.alias("created_at"))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schemas.METADATA.fields
               if f.name not in rows.columns}
    return rows.withColumns(missing).select(*schemas.METADATA.names)


def metadata_patch(meta: DataFrame, delta: DataFrame, asof: dt.datetime | str, key: str = "job_id",
                   seq: list[str] | None = None, nulls: bool = False) -> DataFrame:
    """Overlay the fields of ``delta`` on existing records; the last row per key by ``seq`` wins.

    A patch for a record that does not exist is ignored, a field the records lack is
    added. A field the delta sets to NULL keeps its old value, or with ``nulls`` becomes NULL.
    """
    fields = [c for c in delta.columns if c != key and c not in (seq or [])]
    marked = last_per_key(delta, key, fields, seq).select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = meta.join(marked, key, "left")
    stamp = F.lit(parse_instant(asof).isoformat())

    def patched(c: str):
        old = F.col(c) if c in meta.columns else F.lit(None)
        if nulls:
            return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(old)
        return F.coalesce(F.col(f"_new_{c}"), old)

    updates = {c: patched(c) for c in fields}
    updates["updated_at"] = F.when(F.col("_hit"), stamp).otherwise(
        F.col("updated_at") if "updated_at" in meta.columns else F.lit(None))
    added = [c for c in updates if c not in meta.columns]
    return joined.withColumns(updates).select(*meta.columns, *added)


def write_metadata(meta: DataFrame, path: str) -> None:
    """JSON lines, many records per file (one file per record would not scale)."""
    meta.write.mode("overwrite").json(path)


def draft_documents(outreach: DataFrame, contacts: DataFrame) -> DataFrame:
    """Draft documents; of two drafts with one name the later row (by id) wins.

    Rows are reduced before they are rendered, so text is built once per file.
    """
    people = contacts.select(
        F.col("id").alias("contact_id"), F.col("name").alias("contact_name"),
        F.col("email").alias("contact_email"), F.col("title").alias("contact_title"),
        "contact_type")
    joined = outreach.join(people, "contact_id", "left")
    named = joined.select(
        "job_id", draft_file_name("outreach_type", "followup_day", "contact_type", "id")
        .alias("file_name"),
        F.struct("id", "contact_id", "status", "subject", "body", "contact_name",
                 "contact_email", "contact_title").alias("_row"))
    last = named.groupBy("job_id", "file_name").agg(F.max("_row").alias("r"))
    return last.select("job_id", "file_name", draft_content(
        F.col("r.contact_email"), F.col("r.contact_name"), F.col("r.contact_title"),
        F.col("r.subject"), F.col("r.status"), F.col("r.body")).alias("content"))


def snapshot_documents(jobs: DataFrame) -> DataFrame:
    """The stored description of every listing that has one."""
    return jobs.where(~blank("description")).select(
        F.col("id").alias("job_id"), F.lit("jd_snapshot.txt").alias("file_name"),
        F.col("description").alias("content"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def _folder_of(name: str | None) -> str:
    """``folder=name`` with the characters escaped that Spark escapes in the folder of a partition."""
    if not name:
        return "folder=__HIVE_DEFAULT_PARTITION__"
    return "folder=" + re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda c: f"%{ord(c[0]):02X}", name)


def _put_files(root: str) -> Callable[[Iterator], Iterator]:
    def put(batches: Iterator) -> Iterator:
        part = f"part-{TaskContext.get().partitionId():05d}.txt"
        pairs = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for folder, lines in groupby(pairs, lambda pair: _folder_of(pair[0])):
            place = f"{root}/{folder}"
            os.makedirs(place, exist_ok=True)
            begun = f"{place}/.begun-{uuid.uuid4().hex}"  # no scan sees it
            with open(begun, "wb") as file:
                file.writelines((line or b"") + b"\n" for _, line in lines)
            os.replace(begun, f"{place}/{part}")
        yield from ()

    return put


def write_folders(rows: DataFrame, path: str, tasks: int) -> None:
    """Text ``value``s by ``folder`` below the new ``path``: a folder ``folder=…`` each, with one file of a line per row.

    Rows are dealt by their folder into tasks that put their files in place themselves: a task that runs again puts
    the same files there, and no file waits for the driver. Where the store is a local or mounted folder, tasks use
    its own calls, as Hadoop starts a process (``chmod``) four times for every such folder and file.
    """
    dealt = rows.select("folder", "value").repartition(tasks, "folder")
    root = local_path(rows.sparkSession, path)
    if root is None:
        (dealt.write.partitionBy("folder")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path))
        return
    os.makedirs(root)
    (dealt.sortWithinPartitions("folder").select("folder", F.col("value").cast("binary").alias("value"))
     .mapInArrow(_put_files(root), "done int").write.format("noop").mode("overwrite").save())
