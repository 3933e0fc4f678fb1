"""Token counts of whole texts with the whole-token shortcut (see ``bpe``)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .bpe import tokenizer
from .common import per_document


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Counts are the library's for the whole text, with no begin or end tokens; special strings
    inside a text count as their one token. Null and empty texts have 0; rows repeat as given.
    """

    def make():
        bpe = tokenizer(tokenizer_path, pattern)

        def work(texts):
            n = [bpe.count(t) for t in texts]
            return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return work

    return per_document(docs, [id_col], "n_bytes long, n_tokens long, over_limit boolean", make, text_col)
