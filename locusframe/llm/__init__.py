"""Training-data operators: formatting, de-duplication, filtering, mixing.

Nothing outside this folder imports it; the queries over it are in
``locusframe.llm.queries``.
"""
