"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audio, bpe, chat, decontam, gru_lm, html_extract, jaccard, langid, periodic, secret_scan, spotsigs, token_files, whitening
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat.digest(chat.format_paths(chat.best_paths(chat.chains(rows.union(own)))))


def op2_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark, sf_dir):
    found, _ = secret_scan.scan_paths(secret_scan.blobs(table(spark, sf_dir, "documents")))
    return secret_scan.digest(found)


def op5_lm_score(spark, sf_dir):
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op6_telephony_audio(spark, sf_dir):
    return audio.convert(audio.encode_media(table(spark, sf_dir, "documents"))).drop("pcm16k")


def op7_html_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark, sf_dir):
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks)


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op11_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.find_runs(periodic.looped(table(spark, sf_dir, "documents"))))


def op12_spotsigs(spark, sf_dir):
    return spotsigs.digest(spotsigs.compare_edits(table(spark, sf_dir, "documents")))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_language_id, op3_decontamination, op4_secret_scan, op5_lm_score, op6_telephony_audio, op7_html_text, op8_byte_bpe, op9_ngram_jaccard, op10_token_files, op11_periodic_runs, op12_spotsigs, op13_whitening)}
ORACLES = {"op1_chat_format": chat.ORACLE, "op4_secret_scan": secret_scan.ORACLE}
