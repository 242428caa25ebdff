"""One thin query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers

from . import chat, decontaminate, embeddings, html, language, quality, secrets
from .common import table
from .packing import pack_documents
from .simhash import near_duplicates
from .tokenfiles import corpus_folder, read_tokens, write_tokens


def op1_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_chat_perspectives(spark, sf_dir):
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op3_embedding_join(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op5_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir):
    folder = corpus_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder)


def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op8_html(spark, sf_dir):
    return html.extract_text(table(spark, sf_dir, "pages"))


def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat_perspectives": op2_chat_perspectives,
    "op3_embedding_join": op3_embedding_join,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_token_files": op6_token_files,
    "op7_language": op7_language,
    "op8_html": op8_html,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL: dict = {"op2_chat_perspectives": chat.ORACLE, "op3_embedding_join": embeddings.ORACLE, "op5_secrets": secrets.oracle()}
