"""One query per text operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellclock.llm.common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def vocabulary() -> str:
    """Default place of the word vocabulary; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op7_bpe_automaton")
def _bpe_automaton(spark, sf_dir):
    from cellclock.llm.bpe_automaton import token_digests

    return token_digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op9_token_files")
def _token_files(spark, sf_dir):
    from cellclock.llm.token_files import token_file_digests

    return token_file_digests(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


@query("op1_near_dedup")
def _near_dedup(spark, sf_dir):
    from cellclock.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, bands=21, rows=6)


@query("op6_fingerprints")
def _fingerprints(spark, sf_dir):
    from cellclock.llm.fingerprints import matched_fingerprints

    return matched_fingerprints(table(spark, sf_dir, "documents"))


def _decontaminate_sql():
    from cellclock.llm.decontaminate import ORACLE_SQL

    return ORACLE_SQL


@query("op5_decontaminate", _decontaminate_sql())
def _decontaminate(spark, sf_dir):
    from cellclock.llm.decontaminate import contamination_digests

    return contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_context_tree")
def _context_tree(spark, sf_dir):
    from cellclock.llm.context_tree import scores

    return scores(table(spark, sf_dir, "documents"), held_modulus=10)


@query("op4_quality")
def _quality(spark, sf_dir):
    from cellclock.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_pii_surrogates")
def _pii_surrogates(spark, sf_dir):
    from cellclock.llm.pii import replace_entities

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key="corpus-2024", count="n_replaced")


def _url_lists_sql():
    from cellclock.llm.url_lists import ORACLE_SQL

    return ORACLE_SQL


@query("op10_url_lists", _url_lists_sql())
def _url_lists(spark, sf_dir):
    from cellclock.llm.url_lists import evaluate, page_captures, page_entries

    pages = table(spark, sf_dir, "pages")
    return evaluate(page_captures(pages), page_entries(pages))


@query("op2_language")
def _language(spark, sf_dir):
    from cellclock.llm.language import languages

    return languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op13_whitening")
def _whitening(spark, sf_dir):
    from cellclock.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


@query("op12_toxicity")
def _toxicity(spark, sf_dir):
    from cellclock.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_alignment")
def _alignment(spark, sf_dir):
    import public_tokenizers

    from cellclock.llm.alignment import alignments

    return alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
