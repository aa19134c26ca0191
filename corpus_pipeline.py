"""From raw documents to token ids, in stages.

Each stage takes all rows that the one before kept and returns the columns of `documents` as they came; the last returns
what became of each row's text. In every stage: null and empty texts, repeated rows, empty tables and further columns of any name are no
error. A null or empty text says nothing about quality and stays there, goes with language ID (it has none), and so
never reaches the stages after. Rows that repeat an id are one document from near-duplicates on.
"""

from __future__ import annotations

import public_tokenizers

from vigil.llm import bpe, decontaminate, langid, neardup, quality
from vigil.llm.common import stored, table


def quality_kept(spark, docs, sf_dir):
    """The documents that the resampling draws, of those that look like the ones labelled as good and not toxic; without labels all. Rows that repeat (id and text) stay or go together; a null id is a document like others."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def language_known(spark, docs, sf_dir):
    """The documents whose text has a language, of at least two fifths of its words; null, empty and letterless texts go. Rows that repeat stay or go together; without any language to learn from all go."""
    return langid.keep(docs)


def near_duplicates_dropped(spark, docs, sf_dir):
    """One document of each group of near copies (five words, similarity of 0.8), that of the smallest id, and one row of each id; rows with a null id, and with an empty text, stay."""
    return neardup.keep(docs)


def decontaminated(spark, docs, sf_dir):
    """The documents that no benchmark item's windows hit, or hit less than a twentieth of; without benchmark items all. A null id is a document like others."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; a null or empty text has no ids."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_kept), ("language ID", language_known), ("MinHash near-dedup", near_duplicates_dropped), ("benchmark decontamination", decontaminated), ("byte-level BPE", tokenized)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """What the last stage returns for the documents that all others keep. Each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
