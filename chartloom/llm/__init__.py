"""Training-data operators: dedup, classifiers, filters, redaction and tokenisation.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; ``registry`` has the thin ``opN_<name>`` queries.
"""
