"""Training-data operators over a corpus of documents and web pages.

Nothing outside this subpackage imports it; `streetlink.llm.queries` holds the
registered queries and their SQL.
"""
