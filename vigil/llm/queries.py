"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, decontaminate, divergence, langid, lexical, lm, neardup, packed_ids, pages, quality, setjoin, topk
from .common import table


def op2_html_extraction(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.digest(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op1_byte_level_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_language_id(spark, sf_dir):
    return langid.predict(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark, sf_dir):
    return topk.twentieth(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lm_scoring(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark, sf_dir):
    return neardup.digest(neardup.classes(table(spark, sf_dir, "documents"), words=2))


def op9_chat_formatting(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_token_id_output(spark, sf_dir):
    return packed_ids.digest(packed_ids.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op11_ranked_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_ngram_jaccard_join(spark, sf_dir):
    return setjoin.digest(setjoin.classes(table(spark, sf_dir, "documents")))


QUERIES = {"op11_ranked_lexical_search": op11_ranked_lexical_search, "op12_source_divergence": op12_source_divergence, "op13_ngram_jaccard_join": op13_ngram_jaccard_join, "op10_token_id_output": op10_token_id_output, "op9_chat_formatting": op9_chat_formatting, "op2_html_extraction": op2_html_extraction, "op7_lm_scoring": op7_lm_scoring, "op5_exact_topk": op5_exact_topk, "op1_byte_level_bpe": op1_byte_level_bpe, "op8_minhash_near_dedup": op8_minhash_near_dedup, "op4_language_id": op4_language_id, "op6_quality_classifier": op6_quality_classifier, "op3_decontamination": op3_decontamination}
ORACLES = {"op11_ranked_lexical_search": lexical.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_ngram_jaccard_join": setjoin.ORACLE, "op5_exact_topk": topk.ORACLE, "op3_decontamination": decontaminate.ORACLE}
