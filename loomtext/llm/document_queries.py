"""Queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.byte_bpe import decode_byte_bpe, encode_byte_bpe
from loomtext.llm.decontamination import find_contamination
from loomtext.llm.document_sql import BYTE_BPE, DECONTAMINATION, NEAR_DEDUP
from loomtext.llm.lattice_lm import score_texts
from loomtext.llm.licences import scan_licences
from loomtext.llm.line_dedup import drop_repeated_lines
from loomtext.llm.merge_pieces import encode_pieces
from loomtext.llm.near_dedup import near_duplicates
from loomtext.llm.quality import judge_quality
from loomtext.llm.registry import query
from loomtext.llm.token_counts import count_tokens
from loomtext.suite import Tables

#: Folder of public tokenizer files.
TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
#: File of byte tokens and their ranks.
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op1_token_counts")
def op1_token_counts(tables: Tables) -> DataFrame:
    return count_tokens(tables.documents, PIECES, keep=["doc_id"])


@query("op6_merge_pieces")
def op6_merge_pieces(tables: Tables) -> DataFrame:
    encoded = encode_pieces(tables.documents, PIECES, keep=["doc_id"], dropout=0.1, seed=1)
    n_pieces = F.size("ids").cast("long").alias("n_pieces")
    return encoded.select("doc_id", n_pieces, "ids", "lossless")


@query("op5_decontamination", DECONTAMINATION)
def op5_decontamination(tables: Tables) -> DataFrame:
    found = find_contamination(tables.documents, tables.benchmark, keep=["doc_id"])
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op8_lm_scoring")
def op8_lm_scoring(tables: Tables) -> DataFrame:
    return score_texts(tables.documents, PIECES)


@query("op2_line_dedup")
def op2_line_dedup(tables: Tables) -> DataFrame:
    return drop_repeated_lines(tables.documents, keep=["doc_id"])


@query("op4_near_dedup", NEAR_DEDUP)
def op4_near_dedup(tables: Tables) -> DataFrame:
    return near_duplicates(tables.documents, keep=["doc_id"])


@query("op3_license_scan")
def op3_license_scan(tables: Tables) -> DataFrame:
    found = scan_licences(tables.documents, keep=["doc_id"])
    families = F.array_sort(F.array_distinct(F.col("licences.family")))
    return found.select("doc_id", "n_paragraphs", families.alias("families"), "licences")


@query("op10_quality_rules")
def op10_quality_rules(tables: Tables) -> DataFrame:
    return judge_quality(tables.documents, source="source", keep=["doc_id"])


@query("op11_byte_bpe", BYTE_BPE)
def op11_byte_bpe(tables: Tables) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path(BYTE_RANKS)
    encoded = encode_byte_bpe(
        tables.documents, ranks, public_tokenizers.PATTERN, keep=["doc_id"]
    )
    decoded = decode_byte_bpe(encoded, ranks, keep=["doc_id", "ids"])
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
