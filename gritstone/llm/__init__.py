"""Corpus preparation for language-model training: thirteen operators over documents, pages and embeddings.

Nothing else in the package imports this subpackage; it can be deleted as a whole.
"""
