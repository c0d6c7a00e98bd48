"""Training-data operators. Nothing outside this subpackage imports it.

``queries`` in :mod:`lexigrid.llm.registry` lists the thin ``opN_<name>`` queries.
"""
