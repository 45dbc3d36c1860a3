"""Training-data operators over a corpus of documents.

Nothing outside this folder imports it; the folder can be removed without
touching the rest of the library.
"""
