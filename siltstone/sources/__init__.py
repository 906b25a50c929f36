"""Readers and writers: file collections, office formats, the packed snapshot format, logs and chats."""
