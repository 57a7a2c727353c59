"""Training-data operators: ten corpus jobs over documents, embeddings and conversations.

Nothing outside this subpackage imports it.
"""
