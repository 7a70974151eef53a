"""Raw messages to archive rows: one select of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRINGS = "array<string>"


def some(s: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(s, F.lit(""))


def author_label(name: Column, discriminator: Column, ident: Column) -> Column:
    return F.format_string("%s#%s (%s)", F.coalesce(some(name), F.lit("unknown")), F.coalesce(some(discriminator), F.lit("0")), F.coalesce(some(ident), F.lit("unknown")))


def attachment_urls(attachments: Column) -> Column:
    return F.coalesce(F.transform(attachments, lambda a: a.url), F.array().cast(_STRINGS))


def image_urls(attachments: Column, embeds: Column) -> Column:
    """Attached images first, then each embed's image and thumbnail."""
    attached = F.transform(F.filter(attachments, lambda a: F.startswith(a.content_type, F.lit("image/"))), lambda a: a.url)
    embedded = F.flatten(F.transform(embeds, lambda e: F.transform(F.filter(F.array(e.image, e.thumbnail), lambda x: x.isNotNull()), lambda x: x.url)))
    none = F.array().cast(_STRINGS)
    return F.concat(F.coalesce(attached, none), F.coalesce(embedded, none))


def attachment_details(attachments: Column) -> Column:
    detail = lambda a: F.struct(a.url.alias("url"), a.proxy_url.alias("proxyUrl"), a.filename.alias("filename"), a.content_type.alias("contentType"), a.width.alias("width"), a.height.alias("height"))
    return F.coalesce(F.transform(attachments, detail), F.array().cast("array<struct<url:string,proxyUrl:string,filename:string,contentType:string,width:int,height:int>>"))


def to_rows(raw: DataFrame, *keep: str) -> DataFrame:
    """Archive rows of raw messages; `keep` names raw columns to carry along."""
    return raw.select(
        *keep,
        "id",
        author_label(F.col("author.username"), F.col("author.discriminator"), F.col("author.id")).alias("author"),
        F.coalesce("content", F.lit("")).alias("content"),
        "timestamp",
        some(F.col("message_reference.message_id")).alias("replyTo"),
        some(F.col("referenced_message.author.username")).alias("replyToAuthor"),
        F.coalesce(F.size("attachments"), F.lit(0)).alias("attachments"),
        attachment_urls(F.col("attachments")).alias("attachmentUrls"),
        image_urls(F.col("attachments"), F.col("embeds")).alias("imageUrls"),
        attachment_details(F.col("attachments")).alias("attachmentsDetailed"),
        some(F.col("thread.id")).alias("threadId"),
    )
