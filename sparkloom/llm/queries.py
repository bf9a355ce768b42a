"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from . import chat, exact, fertility, html_crf, jaccard, lexical, mix, ngram_lm, packing, repeats, tokens, toxicity, trie
from .common import read, tokenizer_file


def op1_mix_sources(spark, sf_dir):
    return mix.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op2_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_fertility(spark, sf_dir):
    return fertility.quality_rules(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_perplexity(spark, sf_dir):
    return ngram_lm.perplexity_filter(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_repeats(spark, sf_dir):
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return found.withColumn("repeats_removed", found["n_removed"] > 0)


def op6_pack(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_html_extract(spark, sf_dir):
    return html_crf.extract(read(spark, sf_dir, "pages"))


def op8_chat_format(spark, sf_dir):
    turns = chat.fold_events(chat.as_events(chat.with_trial(read(spark, sf_dir, "conversations"))))
    return chat.digests(chat.read_back(chat.format_chats(turns)))


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op10_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_prefix_trie(spark, sf_dir):
    return trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op12_token_files(spark, sf_dir):
    path = tokens.new_path(spark)
    tokens.write_token_files(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), path)
    return tokens.read_files(spark, path)


def op13_lexical_search(spark, sf_dir):
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_fertility": op3_fertility,
    "op4_perplexity": op4_perplexity,
    "op5_repeats": op5_repeats,
    "op6_pack": op6_pack,
    "op7_html_extract": op7_html_extract,
    "op8_chat_format": op8_chat_format,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard": op10_jaccard,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_files": op12_token_files,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {
    "op1_mix_sources": mix.ORACLE,
    "op2_exact_dedup": exact.ORACLE,
    "op8_chat_format": chat.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
