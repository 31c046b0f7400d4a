"""What a synchroniser has to do: differences to a remote listing, and writes that may be refused.

The listings and the writes themselves are a client's; here they are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Paths asked for in one request.
MULTIGET = 100
#: Folders that are not read.
JUNK = ("junk", "spam", "trash", "bin", "deleted items", "deleted messages")


def to_fetch(now: DataFrame, before: DataFrame, size: int = MULTIGET) -> DataFrame:
    """``collection, request, path``: new paths and those with another tag, by requests of
    ``size`` in order of path.

    ``now`` and ``before`` have collection, path and etag.  What is gone is not told by a
    listing of tags, so nothing is removed.
    """
    key = ["collection", "path"]
    due = now.join(before.select(*key, F.col("etag").alias("_old")), key, "left").where("_old is null or _old <> etag")
    nth = F.row_number().over(Window.partitionBy("collection").orderBy("path"))
    return due.select("collection", F.floor((nth - 1) / size).cast("long").alias("request"), "path")


def write_back(writes: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes that hold only if nobody else wrote: what the remote side has then, and outcomes.

    ``writes``: path, expected (tag; null: must be new), content, etag (the new tag); ``remote``:
    path, etag, content.  Of several writes to a path with the right tag that of the least new
    tag wins.  Outcomes are ``path, etag, ok, error``.
    """
    found = writes.join(remote.select("path", F.col("etag").alias("_now")), "path", "left")
    fits = found.withColumn("_fits", F.col("expected").eqNullSafe(F.col("_now")))
    first = F.row_number().over(Window.partitionBy("path", "_fits").orderBy("etag")) == 1
    judged = fits.withColumn("ok", F.col("_fits") & first)
    error = F.when(F.col("ok"), None).when(F.col("_now").isNull(), "gone").otherwise("changed meanwhile")
    outcomes = judged.select("path", "etag", "ok", error.alias("error"))
    won = judged.where("ok").select("path", "etag", "content")
    return remote.join(won, "path", "left_anti").select("path", "etag", "content").unionByName(won), outcomes


def is_junk(folder) -> F.Column:
    """Whether a folder, by the last part of its path, holds what nobody wants."""
    return F.lower(F.element_at(F.split(folder, "[/.]"), -1)).isin(*JUNK)


def mailbox_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``folder, uidvalidity, uid, change``: messages that were added or removed.

    Both tables have folder, uidvalidity and uid.  If a folder's validity changed, all its old
    messages are gone and all others are new.  Junk folders count as empty.
    """
    key = ["folder", "uidvalidity", "uid"]
    now, before = (df.select(*key).where(~is_junk(F.col("folder"))).distinct() for df in (now, before))
    added = now.join(before, key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.join(now, key, "left_anti").withColumn("change", F.lit("removed")))


def message_graph(folder, uidvalidity, uid) -> F.Column:
    return F.concat(F.lit("<imap:"), F.replace(F.url_encode(folder), F.lit("+"), F.lit("%20")), F.lit("/"), uidvalidity.cast("string"), F.lit("/"), uid.cast("string"), F.lit(">"))


def removals(changes: DataFrame, quads: DataFrame) -> DataFrame:
    """The diff that removed messages make: their documents become empty ones."""
    gone = changes.where("change = 'removed'").select(message_graph(F.col("folder"), F.col("uidvalidity"), F.col("uid")).alias("g")).distinct()
    return quads.join(gone, "g", "left_semi").select("s", "p", "o", "g", F.lit(-1).alias("op"))
