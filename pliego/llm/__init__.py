"""Training-data operators: deduplication, scoring, redaction, mixing and layout.

Each module holds one operator with a general interface; ``queries`` wraps them
as the ``op<N>_<name>`` queries over the table ``documents``.
"""
