"""Training-data operators over documents, pages and embeddings.

Each module holds one operator with its own DataFrame interface;
:mod:`ledgerline.llm.queries` registers one query per operator. Nothing else in
the library imports this subpackage.
"""
