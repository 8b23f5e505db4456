"""chatweave: chat-corpus preparation and retrieval on Spark DataFrames.

Reads a message store (handles, chats, messages, links), resolves senders,
cleans texts with composable frame-to-frame rules, loads increments, packs
messages into size-bounded chunks, embeds them and answers tables of
questions with exact top-k search -- for many chats at once.
"""

from chatweave.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
