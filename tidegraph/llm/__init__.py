"""Training-data operators: packing, dedup, language ID, secrets, HTML, WARC and friends.

Nothing outside this subpackage imports it; its queries live in
:mod:`tidegraph.llm.queries` and are registered by ``__spark_entry__`` only when
the subpackage is present.
"""
