"""Operations of a training-data pipeline over documents, vectors, token files and conversations.

Nothing else in the library imports this package.  One module per operation; ``queries`` registers them.
"""
