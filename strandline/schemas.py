"""Fixed schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001


_IMAGE = "struct<url:string,proxy_url:string,width:int,height:int>"
#: A message as it lands.
RAW_MESSAGE = (
    "id string, content string, timestamp string, channel_id string, guild_id string, webhook_id string, type int, "
    "author struct<id:string,username:string,discriminator:string,bot:boolean>, "
    "message_reference struct<message_id:string,channel_id:string,guild_id:string>, "
    "referenced_message struct<author:struct<id:string,username:string,discriminator:string>,content:string>, "
    "attachments array<struct<id:string,filename:string,url:string,proxy_url:string,content_type:string,width:int,height:int,size:bigint>>, "
    f"embeds array<struct<image:{_IMAGE},thumbnail:{_IMAGE}>>, thread struct<id:string,name:string>"
)
_DETAIL = "struct<url:string,proxyUrl:string,filename:string,contentType:string,width:int,height:int>"
#: A message as it is archived and exported.
EXPORT_ROW = (
    "id string, author string, content string, timestamp string, replyTo string, replyToAuthor string, attachments int, "
    f"attachmentUrls array<string>, imageUrls array<string>, attachmentsDetailed array<{_DETAIL}>, threadId string"
)
PROGRESS = (
    "channel_id string, server_id string, channel_name string, last_message_id string, last_extracted_ts string, total_extracted bigint, status string, "
    "error_message string, started_at string, completed_at string, updated_at string, resume_state string, newest_message_id string"
)
CHANNELS = "channel_id string, server_id string, server_name string, channel_name string, enabled boolean, created_at string, updated_at string"
SESSIONS = "session_id string, channel_id string, started_at string, last_message_id string, message_count bigint, status string"
RESUME_STATE = (
    "version int, parallelism int, updatedAt string, segments array<struct<index:int,after:string,before:string,afterInclusive:boolean,cursor:string,done:boolean>>, "
    "balance struct<strategy:string,imbalance:double,loads:array<double>,minLoad:double,maxLoad:double,probes:int,measuredAt:string>"
)
