"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, contamination, jaccard, lm, merkle, mixing, neardup, pii, prefixtrie, secrets, sharding, toxicity, urlfilter
from .common import table


def op1_filter_urls(spark, sf_dir):
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op2_score_toxicity(spark, sf_dir):
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_shard_documents(spark, sf_dir):
    return sharding.placed(table(spark, sf_dir, "documents"))


def op5_scan_secrets(spark, sf_dir):
    return secrets.digested(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark, sf_dir):
    return neardup.joined(table(spark, sf_dir, "embeddings"))


def op7_format_chats(spark, sf_dir):
    return chat.digested(chat.with_tricky(table(spark, sf_dir, "conversations")))


def op8_join_ngrams(spark, sf_dir):
    return jaccard.links(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_score_lm(spark, sf_dir):
    return lm.scored(table(spark, sf_dir, "documents"))


def op11_share_prefixes(spark, sf_dir):
    return prefixtrie.shared_prefixes(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_find_personal_data(spark, sf_dir):
    return pii.digested(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_filter_urls": op1_filter_urls,
    "op2_score_toxicity": op2_score_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_shard_documents": op4_shard_documents,
    "op5_scan_secrets": op5_scan_secrets,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_format_chats": op7_format_chats,
    "op8_join_ngrams": op8_join_ngrams,
    "op9_score_lm": op9_score_lm,
    "op10_decontaminate": op10_decontaminate,
    "op11_share_prefixes": op11_share_prefixes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_find_personal_data": op13_find_personal_data,
}

ORACLE_SQL = {
    "op1_filter_urls": urlfilter.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op7_format_chats": chat.ORACLE,
    "op8_join_ngrams": jaccard.ORACLE,
    "op11_share_prefixes": prefixtrie.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
