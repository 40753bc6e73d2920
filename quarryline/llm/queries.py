"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import align, audio, bpe, decontaminate, html, jaccard, language, packing, pii, rollup, token_file, toxicity, variants
from .common import table

#: The source whose documents the query of token counts deletes.
TAKEN_DOWN = "src7"
QUERIES = {
    "op1_ngram_jaccard": lambda s, d: jaccard.jaccard_join(table(s, d, "documents")),
    "op2_language_id": lambda s, d: language.identify(table(s, d, "documents")),
    "op3_toxicity": lambda s, d: toxicity.judge(table(s, d, "documents"), table(s, d, "labels")),
    "op4_bpe": lambda s, d: bpe.digests(table(s, d, "documents")),
    "op5_token_counts": lambda s, d: rollup.token_counts(table(s, d, "documents"), TAKEN_DOWN),
    "op6_decontamination": lambda s, d: decontaminate.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
    "op7_html_extraction": lambda s, d: html.extract_pages(table(s, d, "pages")),
    "op8_token_file": lambda s, d: token_file.digests(table(s, d, "documents")),
    "op9_pii": lambda s, d: pii.personal_data(table(s, d, "documents")),
    "op10_mpeg_audio": lambda s, d: audio.digests(table(s, d, "documents")),
    "op11_spelling_variants": lambda s, d: variants.spelling_variants(table(s, d, "documents")),
    "op12_lexical_packing": lambda s, d: packing.pack_documents(table(s, d, "documents")),
    "op13_token_alignment": lambda s, d: align.align_documents(table(s, d, "documents")),
}
SQL = {"op5_token_counts": rollup.SQL.replace("{taken_down}", TAKEN_DOWN), "op6_decontamination": decontaminate.SQL}
