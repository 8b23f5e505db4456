"""Fixed schemas of the message store and of the derived tables."""

from pyspark.sql import types as T

HANDLE = T.StructType(
    [
        T.StructField("rowid", T.LongType()),
        T.StructField("id", T.StringType()),
    ]
)

CHAT = T.StructType(
    [
        T.StructField("rowid", T.LongType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("chat_identifier", T.StringType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("rowid", T.LongType()),
        T.StructField("handle_id", T.LongType()),
        T.StructField("is_from_me", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("date", T.LongType()),
        T.StructField("associated_message_type", T.IntegerType()),
    ]
)

CHAT_MESSAGE_JOIN = T.StructType(
    [
        T.StructField("chat_id", T.LongType()),
        T.StructField("message_id", T.LongType()),
    ]
)

# Chat definitions: kind is 'group' (matched by display name) or
# 'individual' (matched by the other person's addresses).
CHATS = T.StructType(
    [
        T.StructField("chat_key", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("user_name", T.StringType()),
    ]
)

CONTACTS = T.StructType(
    [
        T.StructField("chat_key", T.StringType()),
        T.StructField("member_pos", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("addresses", T.ArrayType(T.StringType())),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("chat_key", T.StringType()),
        T.StructField("message_id", T.LongType()),
        T.StructField("sender", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField("type", T.IntegerType()),
    ]
)

# Derived tables that are written per batch (``batch_id`` is the partition).
SAVED_MESSAGES = T.StructType([*MESSAGES.fields, T.StructField("chat_slug", T.StringType())])

MARKS = T.StructType(
    [
        T.StructField("chat_key", T.StringType()),
        T.StructField("mark_time", T.LongType()),
        T.StructField("mark_id", T.LongType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chat_key", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)

CHUNK_VECTORS = T.StructType(
    [
        T.StructField("chat_key", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

STORE_TABLES = {
    "handle": HANDLE,
    "chat": CHAT,
    "message": MESSAGE,
    "chat_message_join": CHAT_MESSAGE_JOIN,
}
