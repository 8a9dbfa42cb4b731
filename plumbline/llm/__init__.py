"""Training-data operators: ten operators over documents and pages, and their queries.

Nothing else in the library imports this subpackage.
"""
